"""Operators 1 to 4 and 6 against brute force, and their odd cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import linededup, mixing, quality, tokenbin, tokencount
from tessera.llm.storage import fresh_folder
from tessera.llm.tokens import Encoder, tokenizer_path

ODD = [
    None, "", " ", "\n", "a", "one two", "a b c a b c", "x\n\nx\n x \nX", "é\tÉ é", "tab\there  two  spaces ",
    "<|endoftext|> hi <|endoftext|>\n", "the cat sat on the mat\n" * 30, "w" * 5000, " ".join(f"w{i}" for i in range(3000)),
    "日本語 の テキスト\r\nline", "a # $ % & | < > b", "\u0085x\x1cy",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if i % 4 == 0 else f"s{i % 3}", None) for i, t in enumerate(ODD)]
    rows += [(None, "no id", "en", "s1", 5), (3, "\n", "en", "s0", 1), (3, "\n", "en", "s0", 1)]
    rows += [(100 + i, f"Shared line here\nown line {i}\n  SHARED line here \t", "en", "hot", None) for i in range(15)]
    return spark.createDataFrame(rows, SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mixing_targets_and_draws(spark, docs):
    rows = mixing.mixing_plan(docs).collect()
    assert len(rows) == docs.count()
    size = Counter()
    for r in rows:
        assert r["size"] == len(words(r.text))
        size[r.source] += r["size"]
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1) if r.source_size else r.copies == 0
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:  # reshare round by round
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        free = sum(w for s, w in weight.items() if s not in full)
        target = {s: 2 * size[s] if s in full else left * weight[s] / free for s in order}
        over = {s for s in order if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for r in rows:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
    mixed = Counter((r.doc_id, r.text) for r in mixing.mix_sources(docs).collect())
    plan = Counter()
    for r in rows:
        plan[(r.doc_id, r.text)] += r.copies
    assert mixed == +plan
    assert mixing.mixing_plan(docs.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    docs = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source")
    )
    got = mixing.mixing_plan(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("aim"))
    for r in got.collect():
        assert abs(r.t - r.aim) < 0.05 * r.aim


def brute_quality(text):
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def test_quality_counts(spark, docs):
    labels = spark.createDataFrame([(13, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs.withColumn("score", F.lit("clash")), labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text), r
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(docs.limit(0), labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).filter("score != 0").count() == 0


def test_quality_scores(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary, 80)), 1) for i in range(200)]
    rows += [(1000 + i, " ".join(w + "###" for w in rng.choice(vocabulary, 80)), 0) for i in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2 == 0], "doc_id long, quality int, toxic int")
    trusted = {i for i, _, q in rows if i % 2 == 0 and q}
    raw, aim = Counter(), Counter()
    grams = {i: [t.encode()[k : k + 4] for k in range(len(t) - 3)] for i, t, _ in rows}
    buckets = lambda g: (int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 % 2**64) >> 48
    for i, g in grams.items():
        raw.update(map(buckets, g))
        if i in trusted:
            aim.update(map(buckets, g))
    share = sum(aim.values()) / sum(raw.values())
    ratio = lambda x: np.log((aim[x] + 1) / (raw[x] * share + 1))
    for r in quality.quality_rules(docs, labels).collect():
        expected = np.mean([ratio(buckets(g)) for g in grams[r.doc_id]])
        assert r.score == pytest.approx(expected, abs=1e-5)
        assert r.kept == (r.doc_id < 1000)


def test_quality_of_frequent_and_barely_labelled_text(spark):
    rng = np.random.default_rng(2)
    rows = []
    for lang, letters in (("en", "abcdefgh"), ("de", "qrstuvwx"), (None, "ijklmnop")):
        vocabulary = ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(300)]
        rows += [(len(rows) + i, " ".join(rng.choice(vocabulary, 120)), lang) for i in range(100)]
    noise = [(1000 + i, " ".join(w + "###" for w in rows[i][1].split()), "en") for i in range(10)]
    copies = [(2000 + i, rows[90][1], "en") for i in range(155)]  # a third of all rows, none labelled
    # Half of English is labelled, a twelfth of German, and nothing of the third language.
    labels = spark.createDataFrame([(i, 1, 0) for i in (*range(50), *range(100, 108))], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(spark.createDataFrame(rows + noise + copies, "doc_id long, text string, lang string").repartition(3), labels).collect()
    assert {r.doc_id for r in got if not r.kept} == {r[0] for r in noise}
    plain = quality.quality_rules(spark.createDataFrame(rows + noise, "doc_id long, text string, lang string"), labels).collect()
    score = {r.doc_id: r.score for r in plain}
    assert all(r.score == (score[r.doc_id] if r.doc_id < 2000 else score[90]) for r in got)


def test_line_dedup(spark, docs):
    rows = docs.collect()
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    seen = Counter(k for r in rows for k in {key(x) for x in (r.text or "").split("\n")})
    for least in (2, 10):
        got = linededup.dedup_lines(docs.withColumn("n_lines", F.lit("clash")), least, stats=True).collect()
        want = Counter()
        for r in rows:
            lines = (r.text or "").split("\n")
            stay = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
            want[(r.doc_id, "\n".join(stay), len(lines), len(lines) - len(stay), r.source)] += 1
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped, r.source) for r in got) == want
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    assert linededup.dedup_lines(docs).columns == docs.columns


def test_line_dedup_counts_documents(spark):
    rows = [(1, "mine\nall")] * 10 + [(i, f"own {i}\nall") for i in range(2, 11)] + [(None, f"none\nall {i}") for i in range(10)] + [(None, "all")]
    got = Counter(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 10).collect())
    assert got == Counter((i, t.removesuffix("\nall") if t != "all" else "") for i, t in rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    library, own = Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name))
    rng = np.random.default_rng(7)
    bits = [" ", "  ", "\n", "\n\n", "\t", "a", "Zé", "İ", "'s", "12", "½", "!?", "ñ", "日本", "\r\n", "\x00", "　", "\x85", "\x1c",
            "<|endoftext|>", "😀", "Σ", "word", " word", "\nWord", ".", ", "]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(1500)]
    for t in texts:
        assert own.ids(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_token_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 3000):
        for high in (1, 2, 300, 50257, 2**32):
            ids = rng.integers(0, high, n).astype(np.uint32)
            if n:
                ids[rng.integers(0, n, max(1, n // 20))] = high - 1
            back, names, lengths = tokenbin.decode_segment(tokenbin.encode_segment(ids, [3, None], np.array([n, 0])))
            assert (back == ids).all() and len(back) == n and names == [3, None] and lengths.tolist() == [n, 0]
    stream = tokenbin.encode_ids(np.arange(1000, dtype=np.uint32) * 50)
    starts = np.frombuffer(stream, "<u4", 8).astype(np.int64)
    one = tokenbin.decode_blocks(np.frombuffer(stream, np.uint8)[32:], starts[3:4])  # any block alone
    assert (one[0] == np.arange(384, 512) * 50).all()
    with pytest.raises(ValueError):
        tokenbin.decode_segment(b"nonsense")


def test_token_dataset(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenbin, "SEGMENT_IDS", 500)
    path, file = fresh_folder(spark, "test"), tokenizer_path("byte_bpe_50k.json")
    tokenbin.write_tokens(docs, path, file)
    got = sorted(tokenbin.read_tokens(spark, path).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(file)
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (0,)) for r in docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    empty = fresh_folder(spark, "test")
    tokenbin.write_tokens(docs.limit(0), empty, file)
    assert tokenbin.read_tokens(spark, empty).count() == 0


def test_token_counts_and_cache(spark, docs):
    file, cache = tokenizer_path("byte_bpe_50k.json"), fresh_folder(spark, "test")
    library = Tokenizer.from_file(file)
    for _ in range(2):  # the second time every text is in the cache
        got = tokencount.token_counts(docs.withColumn("n_tokens", F.lit("clash")), file, cache).collect()
        assert len(got) == docs.count()
        for r in got:
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)
        stored = spark.read.parquet(cache)
        assert stored.count() == len({r.text or "" for r in docs.collect()})
    digest = hashlib.sha256(b"one two").digest()
    assert stored.filter(F.col("content") == F.lit(bytearray(digest))).count() == 1
    more = docs.limit(0).union(spark.createDataFrame([(1, "new text", None, None, None), (2, "one two", None, None, None)], SCHEMA))
    tokencount.token_counts(more, file, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 1
