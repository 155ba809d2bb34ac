import gzip
import hashlib
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import htmlextract, media, urlfilter
from tessera.llm.storage import fresh_folder

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://m.www.example.com/en", "http://a.net/es/1",
    "http://net/fr/", "http://xnet/fr/", "http://a.com", "http://a.com/", "http://spam.org/p", "http://deep.x.spam.org", "http://notspam.org/", "http://spam.org.",
    "http://bad.example.org#f", "http://u:p@spam.org/en/", "http://" + "a." * 400 + "spam.org/", "x://ÉA.com/é\nq", "http://spam.com/", "a://b://c.com/d",
]


def brute_verdict(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urlfilter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fits:
        rule = max(fits, key=lambda r: len(r[0] + r[1]))
        return host, path, rule[0] + rule[1], rule[2]
    labels = host.split(".")
    return host, path, None, "block" if any(".".join(labels[k:]) in listed for k in range(len(labels))) else "allow"


@pytest.mark.parametrize("bits", [1 << 20, 1])  # the second needs the semi-join
def test_url_filter(spark, bits):
    listed = {"spam.org", "bad.example.org", "spam.com"} | {f"d{i}.zz" for i in range(0, 3000, 3)}
    urls = URLS + [f"http://h.d{i}.zz/p" for i in range(3000)] + URLS[4:6]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    names = spark.createDataFrame([(x,) for x in listed], "key string")
    got = urlfilter.filter_urls(pages, names, max_bits=bits).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(r.url, listed), r
    assert urlfilter.filter_urls(pages.limit(0), names).count() == 0
    assert urlfilter.filter_urls(pages, names.limit(0)).filter("verdict = 'block' AND rule IS NULL").count() == 0


def test_url_filter_reads_a_list(spark, tmp_path):
    urls = ["http://a.d1.org/", "http://d2.org/", "http://ads-track.example.org/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"file://{tmp_path}/pages.parquet")
    verdicts = lambda: [r.verdict for r in urlfilter.op5_url_filter(spark, f"file://{tmp_path}").orderBy("page_id").collect()]
    assert verdicts() == ["allow", "allow", "block"]
    spark.createDataFrame([("D1.org",), (None,)], "key string").write.parquet(f"file://{tmp_path}/blocked_domains.parquet")
    assert verdicts() == ["block", "allow", "allow"]


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 4 == 0).alias("listed")).cache()
    cascade = urlfilter.build_cascade(universe)
    assert len(cascade.levels) > 1
    assert universe.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    assert urlfilter.build_cascade(universe, 64) is None


ARTICLE = "<h1>A &amp; B</h1><p>First   line,\n of text.<p>Second <b>bold</b> &eacute;&#10;x<br>y, and so on; yes.</p><ul><li>one<li>two</ul><p>Of.</p>"
WANT = "A & B\nFirst line, of text.\nSecond bold é x y, and so on; yes.\none\ntwo\nOf."
PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("just words, no tags.", "just words, no tags."), ("<p>One, two. <p>Three, four.", "One, two.\nThree, four."),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>Menu</ul></nav><article>{ARTICLE}</article><footer>&copy; f</footer>", WANT),
    (f"<body><header><p>Site, name.</p></header><div class='ad'>Buy, now! Really, do.</div><main>{ARTICLE}</main><aside>Side, bar.</aside></body>", WANT),
    (f"<body><div id=\"cookie-notice\">We use cookies, ok.</div><article>{ARTICLE}<section class='comments'><p>First, comment! Good.</p></section></article>", WANT),
    (f"<script>var a = '<p>no</p>';</script><article>{ARTICLE}<form><input><p>Send, it.</p></form></article><!-- <p>never</p> -->", WANT),
    (f"<body><article class='comment'><p>{'Me, too. ' * 90}</p></article><article>{ARTICLE}</article>", WANT),
    ("<article><p>a < b, c > d.</p><p>&unknown; &am</p></article>", "a < b, c > d.\n&unknown; &am"),
    ("<article><p>" + "long, text. " * 20000 + "</p></article>", ("long, text. " * 20000).strip()),
    ("<script>never closed <p>x", ""), ("<!-- open <p>x", ""), ("</p></div><article><p>Fine, text.</div></p></article></b>", "Fine, text."),
]


def test_main_text(spark):
    for page, want in PAGES:
        assert htmlextract.main_text(page) == want, page and page[:90]
    table = spark.createDataFrame([(i, "u", p, 1) for i, (p, _) in enumerate(PAGES)] * 2, "page_id long, url string, html string, n_chars int")
    got = htmlextract.extract_main_text(table).collect()
    assert len(got) == 2 * len(PAGES)
    assert all(r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text) for r in got)
    assert htmlextract.extract_main_text(table.limit(0)).count() == 0


def test_main_text_of_a_bare_layout():
    page = "<body><div><a href=x>Home</a></div><div><div>" + "".join(f"<p>Sentence {i}, with words, and marks.</p>" for i in range(9)) + "</div></div><div>Contact</div>"
    assert htmlextract.main_text(page) == "\n".join(f"Sentence {i}, with words, and marks." for i in range(9))


def test_main_text_keeps_the_container_whole():
    long = [f"<p>{f'Sentence {i}, with words, and marks. ' * 8}</p>" for i in range(6)]
    short = ["<ul><li>one<li>two</ul>", "<blockquote>Said so.</blockquote>", "<table><tr><td>a<td>b</table>", "<pre>x = 1</pre>", "<h2>Part</h2>"]
    plain = lambda *parts: "\n".join(t for p in parts for _, t in htmlextract.text_blocks_of(p))
    frame = "<body><div><a href=x>Home</a></div>{}<div>Contact</div>"
    body = [x for pair in zip(long, short) for x in pair] + long[5:] + short[:1]
    assert htmlextract.main_text(frame.format(f"<div>{''.join(body)}</div>")) == plain(*body)
    assert htmlextract.main_text(frame.format(f"<div>{long[0]}{short[0]}</div>")) == plain(long[0], short[0])
    items = f"<ul>{''.join(p.replace('p>', 'li>') for p in long)}</ul>"  # the list holds the content
    assert htmlextract.main_text(frame.format(f"<div><p>Of these:</p>{items}</div>")) == plain("<p>Of these:</p>", items)
    articles = "".join(f"<article><h2>No. {i}</h2>{p}{short[i % 4]}</article>" for i, p in enumerate(long))
    assert htmlextract.main_text(frame.format(articles)) == plain(articles)
    teaser = "<article><div><p>Soon.</p></div></article>"  # scores choose, not the tag
    assert htmlextract.main_text(frame.format(f"{teaser}<div>{''.join(body)}</div>")) == plain(*body)


def png():
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
JPEG = b"\xff\xd8\xff\xe0\0\4xx\xff\xda\0\3zab\xff\0c\xff\xd9"
OGG = b"OggS\0\4" + b"\0" * 20 + b"\1\5hello"
FLAC = b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"\xff\xf8rest"


def test_sniff():
    whole = {"wav": media.wav_bytes(b"abc"), "png": png(), "gif": GIF, "bmp": BMP, "jpeg": JPEG, "pgm": b"P5 2 2 255\nabcd", "gzip": gzip.compress(b"x" * 99), "ogg": OGG, "pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF"}
    for kind, data in whole.items():
        assert media.sniff(data) == [(kind, 0, len(data))], kind
        assert not media.sniff(data[:-1]), kind
        assert (kind, 7, len(data)) in media.sniff(b"garbage" + data + b"more"), kind
    assert media.sniff(FLAC) == [("flac", 0, len(FLAC))]
    assert media.sniff(png()[:20] + b"?" + png()[21:]) == []
    assert media.sniff(None) == media.sniff(b"") == media.sniff(b"BMP5RIFF%PDF-") == []


def test_type_correction_and_carving(spark):
    rows = [(1, png(), "image/gif"), (2, media.wav_bytes(b"x" * 10 + png() + GIF), "audio/wav"), (3, b"text", "image/png"), (4, None, None), (4, None, None)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "id long, media binary, declared string, type string")
    got = {r.id: r for r in media.correct_types(table).collect()}
    assert (got[1].sniffed, got[1].type, got[1].carved) == ("image/png", "image/png", [])
    assert [(c.type, bytes(c.bytes)) for c in got[2].carved] == [("image/png", png()), ("image/gif", GIF)]
    assert (got[3].sniffed, got[3].type, got[4].type) == (None, "image/png", None)
    assert media.correct_types(table.limit(0)).count() == 0


def test_payloads(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "BM P5 1 1 255 q", "long " * 50000, "a"]
    path = fresh_folder(spark, "test")
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    media.store_payloads(docs, path)
    got = {r.doc_id: r for r in media.read_media(spark.read.parquet(path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw) % 64) if raw else 64)
        stored = media.wav_bytes(payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), zlib.crc32(payload[-64:]), len(stored))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())
    assert got[2][1:] == got[8][1:] and got[0][1:] == got[1][1:]
    assert "embedded=1" in got[6].feature
    media.store_payloads(docs.limit(0), path + "-empty")
    assert media.read_media(spark.read.parquet(path + "-empty")).count() == 0
