"""Every stage of the pipeline against brute force over its own input."""

import os
from collections import Counter

import numpy as np
import pytest
from test_neardup import brute
from test_packing import check
from test_text_ops import brute_quality
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{k}")
        rows[name], before = spark.read.parquet(f"file://{tmp_path}/{k}").collect(), docs.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "quality rules":
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 AND toxic = 0").collect()}
            bucket = lambda g: (int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 % 2**64) >> 48
            grams = {r.doc_id: [bucket(r.text.encode()[i : i + 4]) for i in range(len(r.text.encode()) - 3)] for r in before}
            raw, aim = Counter(), Counter()
            for i, g in grams.items():
                raw.update(g)
                aim.update(g if i in good else [])
            share = sum(aim.values()) / sum(raw.values())
            score = lambda g: np.mean([np.log((aim[x] + 1) / (raw[x] * share + 1)) for x in g])
            want = {r.doc_id for r in before if not brute_quality(r.text)[-1] and score(grams[r.doc_id]) >= -0.2}
            assert {r.doc_id for r in rows[name]} == want
        if name == "line dedup":
            key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
            seen = Counter(x for r in before for x in {key(y) for y in r.text.split("\n")})
            want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not (key(x) and seen[key(x)] >= 10)) for r in before}
            assert {r.doc_id: (r.text, r.n_chars) for r in rows[name]} == {i: (t, len(t)) for i, t in want.items()}
        if name == "near dedup":
            want = {i for i, _, root in brute([(r.doc_id, r.text) for r in before], 80) if i == root}
            assert {r.doc_id for r in rows[name]} == want
        if name == "mixing":
            copies = Counter(r.doc_id for r in rows[name])
            assert set(copies) <= {r.doc_id for r in before} and max(copies.values()) <= 2
            assert {(r.doc_id, r.text) for r in rows[name]} <= {(r.doc_id, r.text) for r in before}
        if name == "packing":
            check(rows[name], [(r.doc_id, r.text) for r in before], Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 4096)
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
    assert corpus_pipeline.run(spark, SF).count() == len(rows["packing"])
