"""Words and lines that polynomial hashes confuse, hot and tied rows, and odd pages and media."""

import re
import struct

import numpy as np
import pyarrow as pa
from test_neardup import brute, run
from test_text_ops import brute_quality

from tessera.llm import htmlextract, media, neardup, quality, tokenbin
from tessera.llm.storage import fresh_folder
from tessera.llm.textblocks import text_blocks
from tessera.llm.tokens import tokenizer_path


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n)), "".join("ba"[k.bit_count() & 1] for k in range(n))


def test_counts_tell_strings_apart():
    one, two = thue_morse(1024)
    texts = [f"{one}\n{two}\n{one}", " ".join(one) + " " + " ".join(two), "x" * 300 + "\n" + "x" * 300]
    for i, j, block in text_blocks(pa.array(texts)):
        got = quality.base_counts(block)
        for k in range(i, j):
            assert tuple(int(got[c][k - i]) for c in quality.COUNTS) == brute_quality(texts[k])[:5]


def test_classes_tell_words_apart(spark):
    one, two = thue_morse(1024)
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, one), (2, two), (3, f"{one} b c d e"), (4, f"{two} b c d e"), (5, words), (6, f"{words} x"), (7, f"{words}  X"), (8, words.upper())]
    assert run(spark, rows) == brute(rows)


def test_chains_and_templates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 3000)
    rng = np.random.default_rng(11)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(60):  # near one another, yet below the threshold for the most part
        copy = list(base)
        for at in rng.choice(100, 3, False):
            copy[at] = f"e{i}-{at}"
        rows.append((i, " ".join(copy)))
    for i in range(20):  # each a few words on from the last
        rows.append((100 + i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 90))))
    assert run(spark, rows) == brute(rows)


def test_equal_rows_in_any_order_give_one_file(spark):
    rows = [(1, f"text {i}") for i in range(9)] + [(None, f"none {i}") for i in range(6)] + [(1, "text 1")] * 4
    found = []
    for seed in (1, 2):
        docs = spark.createDataFrame([rows[k] for k in np.random.default_rng(seed).permutation(len(rows))], "doc_id long, text string")
        path = fresh_folder(spark, "test")
        tokenbin.write_tokens(docs, path, tokenizer_path("byte_bpe_50k.json"), parts=3)
        found.append(sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in tokenbin.read_tokens(spark, path, with_ids=False).collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)


LONG = "<p>Words of some length, with marks; and more of them, on and on.</p>"


def test_attributes_are_read_one_by_one():
    kept = [
        '<p title="A hidden gem">X, y.</p>', '<a href="/hidden/valley">X, y.</a>', '<a href="/p?id=login">X, y.</a>', '<p data-id="share">X, y.</p>',
        '<p data-hidden="false">X, y.</p>', '<div id="disclaimer-of-war">X, y.</div>', f'<div class="social science">{LONG * 3}<p>X, y.</p></div>',
    ]
    for part in kept:
        assert "X, y." in htmlextract.main_text(f"<nav>n</nav><article>{LONG * 4}{part}</article>"), part
    for part in ("<div class='ad'>X, y.</div>", "<div id=cookie-notice>X, y.</div>", "<p hidden>X, y.</p>", "<div class='share'>X, y</div>", "<ul class='social-share'><li>X, y."):
        assert "X, y" not in htmlextract.main_text(f"<article>{LONG * 4}{part}</article>"), part


def test_deep_pages_cost_their_size():
    n = 30_000
    assert htmlextract.main_text("<div>" * n + "x, y") == "x, y"
    assert htmlextract.main_text("<div>" * n + "x, y" + "</span></p></li></td>" * n) == "x, y"


def test_content_paths_against_plain_sums():
    rng = np.random.default_rng(6)
    for _ in range(60):
        tags = rng.choice(["div", "p", "li", "td", "h2"], rng.integers(2, 9))
        parts = [(t, ("ab, " if rng.random() < 0.5 else "abc ") * int(rng.integers(1, 60))) for t in tags]
        blocks = htmlextract.text_blocks_of("".join(f"<{t}>{x}</{t}>" for t, x in parts))
        names, texts = [e.tag for e, _ in blocks], [x for _, x in blocks]
        mean = lambda f: [np.mean([f(y) for m, y in zip(names, texts) if m == t]) for t in names]
        size, marks = mean(len), mean(lambda y: len(re.findall("[.,]", y)))
        near = lambda v, i: sum(np.exp(-((i - j) ** 2) / 2) * v[j] for j in range(len(v)) if abs(i - j) < 3) / sum(np.exp(-((i - j) ** 2) / 2) for j in range(len(v)) if abs(i - j) < 3)
        scores = [(size[i] * (1 + marks[i]) * near(size, i) * (1 + near(marks, i))) ** 0.5 for i in range(len(names))]
        least = min(max(0.5 * np.std(scores), 0.33 * np.mean(scores)), max(scores)) * (1 - 1e-12)
        want = {t for t, s in zip(names, scores) if s >= least}
        got = htmlextract.content_paths(blocks)
        assert {e.tag for e, _ in blocks if e.path in got} == want


def ogg_pages(n):
    out = b""
    for k in range(n):
        page = b"OggS\0" + bytes([2 if k == 0 else 4 if k == n - 1 else 0]) + struct.pack("<qII", k, 77, k) + b"\0\0\0\0" + b"\1\5" + b"hello"
        out += page[:22] + struct.pack("<I", media._ogg_checksum(page)) + page[26:]
    return out


def test_a_stream_is_one_medium():
    stream = ogg_pages(4)
    assert media.sniff(stream) == [("ogg", 0, len(stream))]
    assert media.sniff(b"xx" + stream + b"yy") == [("ogg", 2, len(stream))]
    assert media.sniff(stream[:40] + b"?" + stream[41:]) != [("ogg", 0, len(stream))]
    crc = 0
    page = bytearray(stream[: len(stream) // 4])
    page[22:26] = b"\0\0\0\0"
    for byte in page:  # the checksum bit by bit
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    assert crc == struct.unpack("<I", stream[22:26])[0]
    nested = media.wav_bytes(media.wav_bytes(media.wav_bytes(b"abcd")))
    assert [k for k, _, _ in media.sniff(nested)] == ["wav", "wav"]
    assert sum(n for _, s, n in media.sniff(nested) if s) <= len(nested)
