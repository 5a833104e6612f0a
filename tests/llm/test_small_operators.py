"""Sharding, media, URL rules, HTML: round trips and brute force."""

import time
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conceptlink.llm import decontam, html_extract, media_tiff, quality, queries, sharding, suffix_dedup, url_filter

# ---------------------------------------------------------------- sharding


def records(spark, n, same=0):
    rows = [(i if i % 50 else None, 10 + i % 7, zlib.crc32(b"%d" % i)) for i in range(n)] + [(1, 5, 5)] * same
    return spark.createDataFrame(rows, "doc_id long, size long, shard_hint long")


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 40])
def test_shards_are_gapless_stable_and_grow(spark, bucket_bytes):
    df = records(spark, 600, 5)
    done = sharding.shuffle_into_shards(df, shards=6, bucket_bytes=bucket_bytes)
    rows = done.collect()
    assert len(rows) == 605 and set(df.columns) < set(done.columns)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 6) for r in rows)
    moved = sum(r.grown_shard == 6 for r in rows)
    assert 40 < moved < 140
    grown = {r.doc_id: r.shard for r in sharding.shuffle_into_shards(df, shards=7).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in rows)
    again = sharding.shuffle_into_shards(df.orderBy(F.desc("shard_hint")), shards=6, bucket_bytes=bucket_bytes).collect()
    key = lambda r: (r.shard, r.slot, str(r.doc_id), r.size)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id and r.shard == 0]
    assert order != sorted(order)
    assert sharding.shuffle_into_shards(df.limit(0), shards=6).count() == 0


def test_sharding_query_writes_whole_records(spark, monkeypatch):
    written = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda df, path: (write(df, path), written.append(path)))
    got = {r.doc_id: r for r in queries.op5_sharding(spark, "/root/testdata/sf0.001").collect()}
    shards = {r.doc_id: r for r in spark.read.parquet(written[0]).collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        text = (r.text or "").encode()
        assert shards[r.doc_id].text.encode() == text and shards[r.doc_id].shard == got[r.doc_id].shard
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32) == (len(text) + 8, zlib.crc32(text))


def test_clashing_names_are_carried_under_another(spark):
    df = spark.createDataFrame([(i, "some words here", 7, f"s{i}", i) for i in range(20)], "doc_id long, text string, shard int, slot string, score int")
    rows = sharding.shuffle_into_shards(df.withColumn("size", F.lit(4)), shards=3).collect()
    assert all(r.shard_in == 7 and r.slot_in == f"s{r.doc_id}" and 0 <= r.shard < 3 for r in rows) and len(rows) == 20
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score_in == r.doc_id and r.score == 0.5 for r in quality.score_quality(df, none, keep=("score",)).collect())
    named = df.withColumnsRenamed({"shard": "n_words", "slot": "kept"})
    items = spark.createDataFrame([("q", "some words")], "item_id string, text string")
    assert all(r.n_words_in == 7 and r.n_words == 3 for r in decontam.find_contamination(named, items, keep=("n_words",)).collect())
    assert all(r.kept_in == f"s{r.doc_id}" for r in suffix_dedup.remove_repeated(named, keep=("kept",)).collect())


# ---------------------------------------------------------------- media


@settings(max_examples=120, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.tuples(st.integers(0, 255), st.integers(1, 300)), max_size=20).map(lambda x: b"".join(bytes([b]) * n for b, n in x)))
def test_codecs_round_trip(data):
    assert media_tiff.unpackbits(media_tiff.packbits(data), len(data)) == data
    assert media_tiff.unlzw(media_tiff.lzw(data), len(data)) == data


def test_lzw_of_long_data_clears_its_table():
    data = random.Random(2).randbytes(30_000)
    assert media_tiff.unlzw(media_tiff.lzw(data), len(data)) == data
    # fixed values: 7 7 7 8 8 7 7 6 6 as TIFF LZW codes 256 7 258 8 8 258 6 6 257
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert media_tiff.unlzw(packed, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and media_tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed


@pytest.mark.parametrize("compression", [media_tiff.NONE, media_tiff.PACKBITS, media_tiff.LZW, media_tiff.DEFLATE])
@pytest.mark.parametrize(("tile", "order", "predictor"), [(0, "<", 1), (0, ">", 2), (16, "<", 2), (32, ">", 1)])
def test_pages_round_trip(compression, tile, order, predictor):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 255, s, dtype=np.uint8) for s in ((40, 50, 1), (17, 33, 3), (1, 1, 1))]
    data = media_tiff.encode_pages(pages, compression, predictor, 7, tile, order)
    got = list(media_tiff.decode_pages(data))
    assert [p.index for p in got] == [0, 1, 2] and all((p.pixels == q).all() for p, q in zip(got, pages, strict=True))
    assert all(p.tiled == bool(tile) and p.predictor == predictor for p in got)


@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("compression", [media_tiff.PACKBITS, media_tiff.LZW, media_tiff.DEFLATE])
def test_texts_come_back_from_every_way_of_storing(compression, tile):
    for text in ("", "one", "a long text with ünïcode. " * 400):
        payload = media_tiff.payload_of(text.encode())
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, 24, 1)
        media = media_tiff.encode_pages([pixels[k : k + 96] for k in range(0, len(pixels), 96)], compression, 2, 20, tile)
        assert b"".join(p.pixels.tobytes() for p in media_tiff.decode_pages(media)) == payload


def test_no_broken_file_fails_a_task(spark):
    """Every byte of a directory changed to extremes, files cut short, and headers that lie about sizes."""
    rng = np.random.default_rng(4)
    good = media_tiff.encode_pages([np.arange(60, dtype=np.uint8).reshape(5, 4, 3)], media_tiff.LZW, 2, 2)
    files = [good[:k] for k in range(0, len(good), 7)]
    for at in range(4, len(good)):
        files += [good[:at] + bytes([value]) + good[at + 1 :] for value in (0, 1, 127, 255)]
    for _ in range(300):
        data = bytearray(good)
        for at in rng.integers(0, len(data), 4):
            data[at] = rng.integers(0, 256)
        files.append(bytes(data))
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "id long, media binary").repartition(4)
    got = media_tiff.decode_tiff(df, most_bytes=1 << 24).collect()
    assert {r.id for r in got} == set(range(len(files)))
    assert all((r.page == -1) == (r.error is not None) and len(r.pixels or b"") <= 1 << 24 for r in got)


def test_tiff_rows(spark):
    good = media_tiff.encode_pages([np.zeros((2, 3, 1), np.uint8)] * 2)
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0\xff\xff\xff\x7f"), (5, good[:-40]), (1, good)]
    got = media_tiff.decode_tiff(spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in rows], "id long, media binary")).collect()
    assert sorted((r.id, r.page) for r in got if r.page >= 0 and r.id != 5) == [(1, 0), (1, 0), (1, 1), (1, 1)]
    assert {r.id for r in got if r.error} == {2, 3, 4, 5}
    assert media_tiff.decode_tiff(spark.createDataFrame([], "id long, media binary")).count() == 0


def test_text_media(spark):
    texts = [None, "", "x", "é" * 288, "a" * 575, "b" * 577, "long " * 40_000, "x"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    got = {r.doc_id: r for r in media_tiff.text_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * ((576 - len(raw) % 576) % 576 or (576 if not raw else 0))
        r = got[i]
        assert len(want) % 576 == 0 and (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
    assert got[2][1:] == got[7][1:] and got[0][1:] == got[1][1:] and got[6].n_pages > 1


# ---------------------------------------------------------------- urls

URLS = [
    None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "https://Example.com/en/1?x=/en/#f", "http://example.com/en", "http://www.EXAMPLE.com/en/a/b",
    "http://m.www.example.com/en/", "http://notexample.com/en/", "ftp://a.b.example.com/en/x://y", "http://x.example.net/es/", "http://net/fr/#", "http://net/de/",
    "http://example.com:80/en/", "http://example.org/en/", "http://example.com?/en/", "http://.com/", "http://é.com/ü\n/x", "http://İ.NET/es/",
]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_urls_equal_brute_force(spark, limit):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, None, "x")], "page_id long, url string, host string")
    rules = spark.createDataFrame([*RULES, ("com", None, "block")], "host string, path string, verdict string")
    rows = url_filter.judge_urls(df, rules, broadcast_bytes=limit).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url), r
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    none = url_filter.judge_urls(df, rules.limit(0), otherwise="block").collect()
    assert {r.verdict for r in none} == {"block"}


def test_digest_collisions_are_told_apart():
    same = lambda text: len(text) % 2  # noqa: E731  nearly all digests collide
    array = url_filter.DigestArray(url_filter.DigestArray.build([("a", "/", "block"), ("bcd", "/", "allow"), ("bb", "/", "allow")], same))
    assert [array.string(p) if p >= 0 else None for p in array.find([b"a/", b"bb/", b"bcd/", b"zz", b"zzz"], same)] == [b"a/", b"bb/", b"bcd/", None, None]
    assert xxhash.xxh64_intdigest(b"a/") in url_filter.DigestArray(url_filter.DigestArray.build([("a", "/", "block")])).keys


# ---------------------------------------------------------------- html


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b).replace("  ", " ")).split()) for b in blocks)
        assert got[r.page_id].text == "\n".join(x for x in lines if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_held_out_layouts():
    """Pages composed with another seed: nearly all main text is found, nearly nothing else."""
    rng, model = random.Random(12345), html_extract.trained()
    exact, kept, extra, total = 0, 0, 0, 0
    pages = [html_extract.compose_page(rng) for _ in range(300)]
    for (_, truth), text in zip(pages, html_extract.extract_batch([p for p, _ in pages], model), strict=True):
        lines, wanted = text.split("\n"), [" ".join(t.split()) for t in truth]
        exact += lines == wanted
        kept += sum(len(x) for x in wanted if x in lines)
        extra += sum(len(x) for x in lines if x not in wanted)
        total += sum(map(len, wanted))
    assert kept > 0.97 * total and extra < 0.04 * total and exact > 0.7 * len(pages)


def test_broken_and_odd_pages(spark):
    body = "This is the first paragraph of the story, and it is long enough. " * 3
    cases = {
        "": "",
        "plain text only": None,
        f"<article><p>{body}<p>caf&eacute; &#x41;&amp;amp; x\n\t y<script>var a='</p>'</script></article>": f"{body.strip()}\ncafé A&amp; x y",
        f"<nav><a href=/>home</a></nav><main><h1>T</h1><p>{body}</p><div class=ad>buy</div></main><footer>f</footer>": f"T\n{body.strip()}",
        "<" * 50 + "&#xFFFFFFFF; &nope;": None,
        "<div>" * 3000 + "deep": None,
    }
    df = spark.createDataFrame([(i, "u", h, i) for i, h in enumerate(cases)] + [(99, None, None, 1)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_extract.extract_main_text(df).collect()}
    for i, want in enumerate(cases.values()):
        if want is not None:
            assert got[i].text == want
    assert (got[99].text, got[99].n_chars, got[99].url) == ("", 0, None)
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_only_raw_elements_hide_text():
    body = "This is the first paragraph of the story, and it is long enough. " * 3
    model = html_extract.trained()
    for odd in ("<svg width=1 />", "<button>", "<object data=x>", "<select>", "<math/>", "<canvas>"):
        page = f"<article><p>{body}</p>{odd}<p>Then more: {body}</p></article>"
        assert html_extract.extract_batch([page], model) == [f"{body.strip()}\nThen more: {body.strip()}"], odd
    page = f"<article><p>{body}<math><mi>x</mi><mo>+</mo><mn>1</mn></math></p></article>"
    assert html_extract.extract_batch([page], model)[0].endswith("x+1")


def test_nothing_below_a_dropped_element_is_kept():
    tree = html_extract.Tree("<div><nav><p>a</p><div><p>b</p></div></nav><p>c</p></div>")
    rng = np.random.default_rng(0)
    for _ in range(200):
        state = html_extract.decode(tree, rng.normal(0, 4, len(tree.tag)))
        for k in range(1, len(tree.tag)):
            above = state[tree.parent[k]]
            assert not (above == html_extract.DROPPED and state[k] != html_extract.DROPPED)
            assert not (above == html_extract.KEPT and state[k] == html_extract.UNDECIDED)


ARTICLE = "<article><h1>The title</h1>" + "".join(f"<p>Sentence {i} of the article, with some words. And one more.</p>" for i in range(8)) + "</article>"
WANTED = "The title\n" + "\n".join(f"Sentence {i} of the article, with some words. And one more." for i in range(8))


@pytest.mark.parametrize("depth", [3, 260, 1000])
def test_an_article_below_many_elements_comes_whole(depth):
    page = f"<html><body><nav><a href='/'>Home</a></nav>{'<div>' * depth}{ARTICLE}{'</div>' * depth}<footer>All rights.</footer></body></html>"
    assert html_extract.extract_batch([page], html_extract.trained()) == [WANTED]


def test_pages_written_by_hand():
    """Pages that the training pages' generator did not make, with the text that a reader would call the article."""
    pages = [
        "<html><body><header><a href=/>Site</a></header><main><h1>On formulas</h1><p>The formula <math><mi>E</mi>=<mn>mc2</mn></math> shows energy, as everyone knows.</p>"
        "<p>A second paragraph &amp; more text follows here, so that there is an article.</p></main><aside class='related'><a href=x>Read more</a></aside></body></html>",
        "<body><div class='cookie-notice'>We use cookies. <button>OK</button></div><div class='post-content'><p>First part of the story, told at length."
        "<p>Second   part\nof the story, told at length.<ul><li>An item of a list.<li>Another item of it.</ul></div><div id='comments'><p>Nice story, thanks!</p></div></body>",
    ]
    want = [
        "On formulas\nThe formula E=mc2 shows energy, as everyone knows.\nA second paragraph & more text follows here, so that there is an article.",
        "First part of the story, told at length.\nSecond part of the story, told at length.\nAn item of a list.\nAnother item of it.",
    ]
    assert html_extract.extract_batch(pages, html_extract.trained()) == want


def test_broken_markup_takes_time_in_proportion():
    for page in ('<a "' * 250_000, "<x>" * 100_000 + "</y>" * 100_000, "<li><div>" * 50_000, "<a \"'>" * 100_000, "<!--" * 100_000):
        begin = time.perf_counter()
        html_extract.Tree(page)
        assert time.perf_counter() - begin < 2
    tree = html_extract.Tree("<p class='x>Hello</p> world <b title=\"a>b\">!</b>")
    assert "".join(t for _, t, _ in tree.texts) == "Hello world !"
