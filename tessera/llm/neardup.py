"""Near-duplicate documents by an inverted join of MinHash coordinates.

1. Each text gives the SHA-256 of its words (A-Z lower-cased, one space between
   them) and a signature of K MinHash coordinates of its set of word shingles.
   Texts of equal words are one class and go on as one row, so exact copies
   never meet each other again.
2. Classes are posted under their coordinate-value pairs. A pair of classes
   that is similar enough collides in at least T of the K coordinates. Values
   that no other class has can't collide: they are skipped, and so is a class
   that has fewer than T values left. Of the c values left to a class, two
   partners must share one among the first c - T + 1, rarest first (any common
   order of the values will do), so only these prefixes are posted, and text
   that thousands share is posted only by what consists of little else.
3. Posting lists are merged and collisions counted over all coordinates; pairs
   with T or more are retained, and only for them texts move and are compared
   word for word. What links have joined already is skipped:
   a. Every member meets one head, of the heads of its lists the one it shares
      most lists with. A list's head is the class with the most collisions in
      the corpus (the sum of its values' frequencies), which in a group of copies
      is what they were copied from.
   b. In each list the members outside its largest component (`probes`) meet all
      others, signature by signature, in blocks of bounded rows. A block gives
      the members that retain a pair, and edges that say which components hang
      together, never the pairs: no more rows than it has read.
   c. The members of what hangs together are compared in blocks of bounded
      bytes, again probes with all others, retained pairs only. A block gives as
      many links as join its components.
   A list of one component is skipped, so a hot group costs its size once its
   members are linked. Of n similar texts, m that no chain of links has joined to
   the largest component cost n * m comparisons within the blocks; a text goes to
   one block for each BLOCK_BYTES of the probes it has to meet.
4. Components of the links give each document the smallest id it can reach.

T is the largest number that a pair just at the threshold misses with a
probability below 1e-6 (binomial tail): 39 of K = 64 for a similarity of 0.85.
Classes are posted by 64 bits of their digest; two that share them (of n classes
any two do with a chance of n * n / 2**65) are compared as the classes they are.

Defined cases: shingles are of `size` words, a text with fewer words is its
only shingle, a text without words is linked with nothing and stays; repeated
rows fall in one class; rows without id can't be a component's id unless all of
its rows lack one; an empty table gives an empty table. Very long texts are
compared in blocks of bounded bytes, each with its partner.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import Scratch, materialise
from .textblocks import Block, exact_runs, seeded, shingles, text_blocks
from .workers import tidy

SHINGLE_WORDS = 5
K = 64
MISS = 1e-6
#: Probes of a list that one task compares with eight times as many of its members.
BLOCK = 512
#: Bytes of probes' texts, and of members' texts, that one task compares.
BLOCK_BYTES = 1 << 20
#: Partners of a head that share one copy of its text.
SHARE = 1000
#: Candidates (about 100 bytes each) are broadcast to the texts up to this
#: number; beyond it, texts and candidates are joined by shuffle.
BROADCAST_ROWS = 200_000
_A, _B = seeded(K, 101) | np.uint64(1), seeded(K, 202)
FINGERPRINTS = "doc_id long, text_hash long, n_shingles long, class binary, signature array<int>"


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after the other, and bounds."""
    found, bounds = shingles(block, size)
    sets = [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return (np.concatenate(sets) if sets else found), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, K) coordinates; rows of empty sets are zero."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, K), np.int32)
    if len(full):
        at, buffer = bounds[:-1][full], np.empty_like(sets)
        with np.errstate(over="ignore"):
            for k in range(K):
                np.multiply(sets, _A[k], out=buffer)
                buffer += _B[k]
                out[full, k] = (np.minimum.reduceat(buffer, at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    def prints(batches):
        for batch in batches:
            texts = batch.column("text")
            for i, j, block in text_blocks(texts):
                sets, bounds = shingle_sets(block, size)
                n = np.diff(bounds)
                flat = pa.array(signatures(sets, bounds).ravel())
                columns = [
                    batch.column("doc_id").slice(i, j - i),
                    batch.column("text_hash").slice(i, j - i),
                    pa.array(n),
                    pa.array(block.normal_digests(), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * K), flat),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "class", "signature"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(tidy(prints), FINGERPRINTS)


def match_threshold(percent: int) -> int:
    """Collisions that pairs of this similarity reach, but for a share of MISS."""
    p, tail = percent / 100, 0.0
    for t in range(K + 1):
        tail += comb(K, t) * p**t * (1 - p) ** (K - t)
        if tail >= MISS:
            return t
    return K


def posted_prefixes(classes: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """(cid, token, weight): the coordinate-value pairs that each class is
    posted under, and its collisions with all other classes."""
    tokens = classes.select("cid", F.posexplode("signature").alias("k", "v")).select(
        "cid", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token")
    )
    shared = scratch.stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1"), "shared")
    held = F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("held")
    mine = tokens.join(shared, "token").groupBy("cid").agg(held, F.sum("freq").alias("weight"))
    prefix = F.slice("held", 1, F.size("held") - threshold + 1)
    posted = mine.filter(F.size("held") >= threshold).select("cid", "weight", F.explode(prefix).alias("x"))
    return posted.select("cid", "x.token", "weight")


def retained(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) of `pairs` that collide in `threshold` coordinates or more."""
    one = classes.select(F.col("cid").alias("a"), F.col("signature").alias("sa"))
    two = classes.select(F.col("cid").alias("b"), F.col("signature").alias("sb"))
    hits = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    return pairs.join(two, "b").join(one, "a").filter(hits >= threshold).select("a", "b")


def head_pairs(posted: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): for each class b in a list of two or more, the head it shares most lists with."""
    heads = posted.groupBy("token").agg(F.max_by("cid", F.struct("weight", "cid")).alias("a"), F.max("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    heads = scratch.stored(heads.filter("n > 1").select("token", "a", "w"), "heads")
    met = posted.select("cid", "token").join(heads, "token").groupBy("cid", "a").agg(F.count(F.lit(1)).alias("lists"), F.max("w").alias("w"))
    nearest = met.filter("a <> cid").groupBy("cid").agg(F.max_by("a", F.struct("lists", "w", "a")).alias("a"))
    return nearest.select("a", F.col("cid").alias("b"))


def open_lists(posted: DataFrame, labels: DataFrame, classes: DataFrame, threshold: int, percent: int, scratch: Scratch) -> DataFrame:
    """(cid, la, lb) of the lists that have several components: with a cid, it
    retains a pair with another component; without, the components la and lb
    hang together."""
    named = posted.select("cid", "token").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    named = scratch.stored(named.select("token", "cid", F.coalesce("root", "cid").alias("label")), "named")
    sizes = scratch.stored(named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")), "sizes")
    lists = sizes.groupBy("token").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others")
    )
    blocks = {"parts": F.ceil(F.col("others") / BLOCK).cast("int"), "blocks": F.ceil(F.col("n") / (8 * BLOCK)).cast("int")}
    lists = scratch.stored(lists.filter("others > 0").withColumns(blocks).drop("n", "others"), "lists")
    members = scratch.stored(named.join(lists, "token").join(classes.select("cid", "signature", F.col("n").alias("size")), "cid"), "members")
    dealt = dealt_blocks(members, "token", ["cid", "label", "size", "signature"])

    def touched(rows: pa.RecordBatch):
        cid, label = rows.column("cid").to_numpy(), rows.column("label").to_numpy()
        met, joined = np.zeros(len(cid), bool), Joined()
        for a, b, good in _retained(rows, threshold, percent):
            met[a[good.any(axis=1)]] = met[b[good.any(axis=0)]] = True
            for i, near in zip(a, good):
                joined.add(label[i], label[b[near]])
        own = np.unique(np.stack((cid[met], label[met]), 1), axis=0)
        edges = np.array(joined.edges, np.int64).reshape(-1, 2)
        if len(own):
            columns = [own[:, 0].tolist() + [None] * len(edges), np.append(own[:, 1], edges[:, 0]), np.append(own[:, 1], edges[:, 1])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cid", "la", "lb"])

    return dealt.mapInArrow(tidy(_by_block(touched)), "cid long, la long, lb long").distinct()


def group_links(hanging: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, threshold: int, scratch: Scratch) -> DataFrame:
    """Links (a, b as digests) between the components that hang together."""
    groups = components(hanging.filter("cid IS NULL").select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch)
    named = hanging.filter("cid IS NOT NULL").select("cid", F.col("la").alias("node")).join(groups, "node")
    sized = named.select("cid", F.col("node").alias("label"), F.col("root").alias("token")).join(
        texts.select("cid", F.octet_length("text").alias("bytes")), "cid"
    )
    sized = scratch.stored(sized, "sized")
    bytes_of = scratch.stored(sized.groupBy("token", "label").agg(F.sum("bytes").alias("n")), "bytes")
    lists = bytes_of.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others"))
    blocks = {k: F.ceil((F.col(n) + 1) / BLOCK_BYTES).cast("int") for k, n in (("parts", "others"), ("blocks", "n"))}
    lists = scratch.stored(lists.withColumns(blocks).drop("n", "others"), "groups")
    members = sized.drop("bytes").join(lists, "token").join(classes.select("cid", "signature", F.col("n").alias("size")), "cid").join(texts, "cid")
    dealt = dealt_blocks(scratch.stored(members, "grouped"), "token", ["cid", "label", "size", "signature", "class", "text"])

    def links(rows: pa.RecordBatch):
        label, names, texts = rows.column("label").to_numpy(), rows.column("class"), rows.column("text")
        joined, found = Joined(), []
        for a, b, good in _retained(rows, threshold, percent):
            if not good.any():
                continue
            a, good = a[good.any(axis=1)], good[good.any(axis=1)]
            b, good = b[good.any(axis=0)], good[:, good.any(axis=0)]
            good &= similar(texts.take(pa.array(a)), texts.take(pa.array(b)), size, percent)
            for i, near in zip(a, good):
                found += [(names[i].as_py(), names[b[near][k]].as_py()) for k in joined.add(label[i], label[b[near]])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["a", "b"])

    return dealt.mapInArrow(tidy(_by_block(links)), "a binary, b binary")


def dealt_blocks(members: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each probe of a key's members in one of `parts` and every one of `blocks`, each
    member in one of `blocks` and every one of `parts`; rows of a block follow each other."""
    one = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = [F.col(key).alias("token"), "part", "block", "probe", (F.col("label") == F.col("main")).alias("inside"), *columns]
    probes = members.filter("label <> main").withColumns({"probe": F.lit(True), "part": one("parts")}).withColumn("block", every("blocks"))
    others = members.withColumns({"probe": F.lit(False), "block": one("blocks")}).withColumn("part", every("parts"))
    both = probes.select(*kept).union(others.select(*kept))
    return both.repartition("token", "part", "block").sortWithinPartitions("token", "part", "block", "probe", "cid")


class Joined:
    """Components that a block has joined so far, and the edges that did it."""

    def __init__(self):
        self.root, self.edges = {}, []

    def find(self, x: int) -> int:
        while (up := self.root.setdefault(x, x)) != x:
            self.root[x] = x = self.root[up] = self.root.setdefault(up, up)
        return x

    def add(self, label: int, others: np.ndarray) -> list[int]:
        """Join a component with others; where among them new ones stand."""
        new = []
        for other, at in zip(*[x.tolist() for x in np.unique(others, return_index=True)]):
            one, two = self.find(int(label)), self.find(other)
            if one != two:
                self.root[max(one, two)] = min(one, two)
                self.edges.append((int(label), other))
                new.append(at)
        return new


def _retained(rows: pa.RecordBatch, threshold: int, percent: int):
    """(probes, others, which pairs are retained) in slices of bounded size;
    pairs of one component are left out, and so are those whose sets are of too
    different sizes; each pair of probes stands once."""
    probe = rows.column("probe").to_numpy(zero_copy_only=False)
    cid, label = rows.column("cid").to_numpy(), rows.column("label").to_numpy()
    inside = rows.column("inside").to_numpy(zero_copy_only=False)
    signature = rows.column("signature").flatten().to_numpy().reshape(-1, K)
    size = rows.column("size").to_numpy()
    a, b = np.flatnonzero(probe), np.flatnonzero(~probe)
    step = max(1, (1 << 18) // max(1, len(b)))
    for low in range(0, len(a), step):
        own = a[low : low + step]
        if len(own) * len(b) <= 64:
            hits = (signature[own][:, None, :] == signature[b][None, :, :]).sum(2)
        else:
            hits = np.zeros((len(own), len(b)), np.uint8)
            for k in range(K):
                hits += signature[own, k][:, None] == signature[b, k][None, :]
        good = (hits >= threshold) & (label[own][:, None] != label[b][None, :])
        small, large = np.minimum(size[own][:, None], size[b][None, :]), np.maximum(size[own][:, None], size[b][None, :])
        good &= 100 * small >= percent * large
        yield own, b, good & (inside[b][None, :] | (cid[own][:, None] < cid[b][None, :]))


def _by_block(handle):
    """A batch function that gives `handle` the rows of each (token, part, block)."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            keys = [table.column(c).to_numpy() for c in ("token", "part", "block")]
            cuts = (np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()
            rows = table.to_batches()[0]
            for low, high in zip([0, *cuts[:-1]], cuts):
                yield from handle(rows.slice(low, high - low))
            held = rows.slice(cuts[-1] if cuts else 0)
        if held is not None:
            yield from handle(held)

    return run


def similar(one: pa.Array, two: pa.Array, size: int, percent: int) -> np.ndarray:
    """Which texts of `one` are similar enough to which of `two`, by their sets
    of runs of words: products of 0/1 matrices, taken in slices of the runs that
    more than one text has."""
    n = len(one)
    first, key, of, bounds = _runs_of(pa.concat_arrays([one, two]), size)
    whole = np.unique(np.stack((key, of), 1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
    sizes = np.bincount(whole[:, 1], minlength=n + len(two))
    feature = np.cumsum(np.append(True, whole[1:, 0] != whole[:-1, 0])) - 1 if len(whole) else np.zeros(0, np.int64)
    common = np.bincount(feature)[feature] > 1 if len(feature) else np.zeros(0, bool)
    feature, of = feature[common], whole[common, 1]
    if len(feature):
        feature = np.cumsum(np.append(True, feature[1:] != feature[:-1])) - 1
    both = np.zeros((n, len(two)), np.int64)
    width = 2048
    for low in range(0, int(feature[-1]) + 1 if len(feature) else 0, width):
        i, j = np.searchsorted(feature, [low, low + width])
        part = np.zeros((n + len(two), width), np.float32)
        part[of[i:j], feature[i:j] - low] = 1
        both += (part[:n] @ part[n:].T).astype(np.int64)
    return (both > 0) & (100 * both >= percent * (sizes[:n, None] + sizes[None, n:] - both))


def _runs_of(texts: pa.Array, size: int):
    """First words of all runs of `size` words, their exact keys, their texts, and bounds."""
    ((_, _, block),) = text_blocks(texts, limit=1 << 62)
    of = block.of_word()
    first, key = exact_runs(block.words(fold_case=True)[1], of, size, apart=False)
    return first, key, of[first], np.searchsorted(of[first], np.arange(block.n + 1))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b as digests) among `pairs`, a stored table of (a, b): the sets
    of both texts are compared word for word. A head's text is copied once for
    SHARE of its partners."""

    def links(batches):
        for batch in batches:
            a, b = [batch.column(c).to_pylist() for c in ("class_a", "class_b")]
            one, two = batch.column("text_a"), batch.column("text_b")
            found = []
            for low, high in _runs(a, two):
                own = pa.concat_arrays([one.slice(low, 1), two.slice(low, high - low)])
                found += [(a[low], b[low + k]) for k in linked(own, size, percent)]
            columns = list(zip(*found)) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    copies = scratch.stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("copies")), "copies")
    many = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    one = copies.join(texts.withColumnRenamed("cid", "a"), "a").select(
        "a", "copies", many.alias("part"), F.col("class").alias("class_a"), F.col("text").alias("text_a")
    )
    two = texts.select(F.col("cid").alias("b"), F.col("class").alias("class_b"), F.col("text").alias("text_b"))
    dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("part"))
    both = dealt.join(two, "b").join(one.drop("copies"), ["a", "part"]).select("class_a", "class_b", "text_a", "text_b")
    return both.mapInArrow(tidy(links), "a binary, b binary")


def _runs(heads: list, texts: pa.Array, limit: int = 2 << 20):
    """Row ranges of one head each, with a bounded number of bytes if they have two rows or more."""
    low, held = 0, 0
    for k, text in enumerate(texts):
        n = text.as_buffer().size
        if k > low and (heads[k] != heads[low] or held + n > limit):
            yield low, k
            low, held = k, 0
        held += n
    if heads:
        yield low, len(heads)


def linked(texts: pa.Array, size: int, percent: int) -> list[int]:
    """Which of the texts after the first are similar enough to it."""
    _, key, _, bounds = _runs_of(texts, size)
    head = np.unique(key[: bounds[1]])
    found = []
    for k in range(1, len(texts)):
        own = np.unique(key[bounds[k] : bounds[k + 1]])
        both = len(np.intersect1d(head, own, assume_unique=True))
        if both and 100 * both >= percent * (len(head) + len(own) - both):
            found.append(k - 1)
    return found


def linked_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, class and first for each row of `docs`;
    `first` is the smallest (no_id, doc_id, text_hash) of its component, null
    for a text without words."""
    spark, threshold = docs.sparkSession, match_threshold(percent)
    scratch, kept = Scratch(spark), Scratch(spark)
    prints = kept.stored(fingerprints(docs, size), "prints")
    classes = kept.stored(
        prints.filter("n_shingles > 0")
        .groupBy("class")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
        .withColumn("cid", F.xxhash64("class")),
        "classes",
    )
    posted = scratch.stored(posted_prefixes(classes, threshold, scratch), "posted")
    texts = scratch.stored(class_texts(docs, classes, posted), "texts")
    ids = classes.select("cid", "class")

    def merge(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components of the links as (node, root) of digests, and of cids."""
        roots = components(links, scratch)
        numbered = roots.join(ids, roots["node"] == ids["class"]).select(F.col("cid").alias("node"), F.xxhash64("root").alias("root"))
        return roots, scratch.stored(numbered, "labels")

    pairs = scratch.stored(retained(head_pairs(posted, scratch), classes, threshold), "pairs")
    links = scratch.stored(confirmed(pairs, texts, size, percent, scratch), "links")
    roots, labels = merge(links)
    hanging = scratch.stored(open_lists(posted, labels, classes, threshold, percent, scratch), "hanging")
    if hanging.limit(1).count():
        more = group_links(hanging, classes, texts, size, percent, threshold, scratch)
        roots, _ = merge(scratch.stored(links.union(more), "links"))
    firsts = roots.join(classes.select(F.col("class").alias("node"), "first"), "node")
    least = scratch.stored(firsts.groupBy("root").agg(F.min("first").alias("least")), "least")
    reached = scratch.stored(firsts.join(least, "root").select(F.col("node").alias("class"), "least"), "reached")
    of_class = classes.select("class", "first").join(reached, "class", "left").select("class", F.coalesce("least", "first").alias("first"))
    of_class = kept.stored(of_class, "firsts")  # stored, so that the rows of a hot class can be split
    scratch.clear()
    return prints.select("doc_id", "text_hash", "n_shingles", "class").join(of_class, "class", "left")


def class_texts(docs: DataFrame, classes: DataFrame, posted: DataFrame) -> DataFrame:
    """(cid, class, text), one text for each class that is posted."""
    wanted = classes.join(posted.select("cid").distinct(), "cid", "left_semi")
    wanted = wanted.select("cid", "class", F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = rows.join(wanted, rows["doc_id"].cast("long").eqNullSafe(wanted["__id"]) & (rows["text_hash"] == wanted["__hash"]))
    return found.groupBy("class").agg(F.first("cid").alias("cid"), F.first("text").alias("text"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id,
    text), linked where 100 * intersection >= percent * union."""
    root = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return linked_rows(docs, size, percent).select("doc_id", "n_shingles", root.alias("component_id"), F.col("doc_id").eqNullSafe(root).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = 85) -> DataFrame:
    """The rows of `docs` with one row of each component, and every row without
    words. The row is one of the smallest id (rows without id come last), of its
    texts the one with the smallest hash; rows equal in both differ in other
    columns at most, and a hash of the whole row decides."""
    won = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    rows = linked_rows(docs, size, percent).filter("class IS NOT NULL")
    rows = materialise(rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), won.alias("won")), "verdicts")
    gone = rows.filter("NOT won").select("__id", "__hash").distinct()
    repeated = rows.filter("won").groupBy("__id", "__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__id", "__hash")
    repeated = materialise(repeated, "repeated")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    several = repeated.limit(BROADCAST_ROWS + 1).count()
    if not several:
        return docs.join(gone, same, "left_anti")
    row = F.struct(*docs.columns)
    copies = docs.join(F.broadcast(repeated) if several <= BROADCAST_ROWS else repeated, same)
    single = copies.groupBy("__id", "__hash").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return docs.join(gone.union(repeated), same, "left_anti").union(single)


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
