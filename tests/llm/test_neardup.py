import re

import numpy as np
import pytest

from tessera.llm import graph, neardup


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows, percent=85):
    """Component of every row by comparing all pairs of texts."""
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows):
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", "  \n", "a b", "A B", "one two three four five", "One two three four five", "x", "one two three four five six"]
    for _ in range(25):  # groups of edited copies, near the threshold too
        base = rng.choice(vocabulary, rng.integers(40, 200)).tolist()
        for _ in range(rng.integers(1, 8)):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, max(2, len(copy) // 30))):
                copy[at] = str(rng.choice(vocabulary))
            out.append(" ".join(copy))
            if rng.random() < 0.3:
                out.append("\n".join(copy).upper().replace("W", "w"))
    return [(int(i), t) for i, t in zip(rng.permutation(len(out)), out)]


def test_against_all_pairs(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = np.random.default_rng(9)
    base = [f"v{i}" for i in range(120)]
    rows = [(5000 + i, " ".join(base)) for i in range(40)]  # exact copies
    for i in range(60):
        copy = list(base)
        for at in rng.integers(0, 120, i % 6):
            copy[at] = f"e{i}-{at}"
        rows.append((i, " ".join(copy)))
    rows.append((3, rows[-1][1]))
    assert run(spark, rows) == brute(rows)


def test_thresholds():
    assert neardup.match_threshold(85) == 39 and neardup.match_threshold(80) < 39 and neardup.match_threshold(100) == 64


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (9, "z " * 3000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == []
    docs = spark.createDataFrame([(1, "a b c d e", 3), (0, "A b c d e", 4), (2, None, 5)], "doc_id long, text string, kept int")
    assert sorted(neardup.drop_near_duplicates(docs).collect()) == [(0, "A b c d e", 4), (2, None, 5)]


def test_drop_decides_by_row(spark):
    text, near = " ".join(f"w{i}" for i in range(99)), " ".join(f"w{i}" for i in range(100))
    own = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(None, near, 0), (4, text, 0)]  # the row without id goes, others without id stay
    rows += [(None, own[0], 0), (None, "", 0), (None, "", 0), (None, None, 0)]
    rows += [(9, text, 0), (9, own[1], 0)]  # the same id with another text stays
    rows += [(None, own[2], i) for i in range(3)] + [(7, own[3], i) for i in range(4)] + [(None, own[4], 1), (8, own[4], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    got = neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    want = [(4, text), (None, own[0]), (None, ""), (None, ""), (None, None), (9, own[1]), (None, own[2]), (7, own[3]), (8, own[4])]
    found = got.collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in found])) == sorted(map(str, want))
    assert sorted(map(str, neardup.drop_near_duplicates(docs.repartition(2)).collect())) == sorted(map(str, found))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 60), (60, 70), (200, 201)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 60, 60: 60, 70: 60, 200: 200, 201: 200}
