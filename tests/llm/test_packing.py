import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.tokens import tokenizer_path


def test_fullest_window_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.choice(np.arange(1, 20), rng.integers(1, 5), False)}
        got = packing.fullest_window(counts, 20)
        assert all(0 < m <= counts[k] for k, m in got.items()) and max(counts) in got
        best = max(
            sum(k * m for k, m in zip(counts, ms))
            for ms in product(*[range(v + 1) for v in counts.values()])
            if dict(zip(counts, ms))[max(counts)] and sum(k * m for k, m in zip(counts, ms)) <= 20
        )
        assert sum(k * m for k, m in got.items()) == best


def test_plan_uses_every_rank_once():
    rng = np.random.default_rng(4)
    histogram = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 4097), 700, False), rng.integers(1, 60, 700))} | {2600: 5000}
    plan = packing.packing_plan(histogram)
    assert packing.packing_plan({}) == []
    total = sum(k * v for k, v in histogram.items())
    windows = len({w for w in plan}) and max(
        w + (nxt - r) // m for (k, r, m, w, o), nxt in ((p, next((q[1] for q in sorted(plan) if q[0] == p[0] and q[1] > p[1]), histogram[p[0]])) for p in plan)
    )
    assert windows * 4096 < 1.25 * total


def check(got, docs, library, capacity):
    ids = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in docs]
    want = Counter()
    for d, x in ids:
        for s in range(0, len(x), capacity):
            piece = np.array(x[s : s + capacity], "<u4").tobytes()
            want[(d, s, len(piece) // 4, zlib.crc32(piece), len(x))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(rng.choice(["a", "bb", "Ccc,", "12"], rng.integers(0, 150)))) for i in range(150)]
    docs += [(1000 + i, "same text for many") for i in range(120)] + [(3, None), (3, None), (None, ""), (7, "x " * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS length")
    file = tokenizer_path("word_bpe_49k.json")
    got = packing.pack_documents(frame, file, capacity=128, with_ids=True).collect()
    check(got, docs, Tokenizer.from_file(file), 128)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert packing.pack_documents(frame.limit(0), file).count() == 0
