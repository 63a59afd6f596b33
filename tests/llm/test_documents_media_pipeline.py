"""Operators 4 and 10, the pipeline, and the registry."""

import hashlib
import html
import re
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from keystrata.llm import html_extract, media

SF = "/root/testdata/sf0.001"

# -- HTML -----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a>b">Home</a></li></ul></nav><div class="cookie-notice">We use</div>
<div id="wrap"><div class="post-12"><h1>Title &amp; more</h1><p>First <b>bo</b>ld&nbsp;text,<br>line two<p>Second para that is long enough to matter
<div class="ad">Buy</div><ul><li>one<li>two</ul><form><input name=q><p>Search</p></form></div><aside>Side</aside>
<div class="comments"><p>A reader's comment that is rather long, so that it would outweigh short articles</p></div></div><footer>&copy; x</footer></body>"""


def test_main_text():
    assert html_extract.extract(PAGE, []) == "Title & more First bold text, line two Second para that is long enough to matter one two"
    assert html_extract.vote(PAGE)[0] == "/div/div.post-#"


@pytest.mark.parametrize("source,text", [(None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a b"), ("<p", ""), ("<", "<"), ("<!-- x <p>a</p>", ""), ("<div><p>a", "a"), ("<script>x", ""), ("<table><tr><td>a<td>b</table>", "a b"), ("</p></div>a", "a"), ("<b>a</b>b <i>c", "ab c"), ("<article><p>a</article><p>b</p>", "a")])
def test_broken_markup(source, text):
    assert html_extract.extract(source, []) == text


LONG = "Running text of the article that goes on for a while and then a little more."


@pytest.mark.parametrize("inner", ['<h2 id="related-work">X</h2>', '<h3 id="search-methods"><a href="#s">X</a></h3>', '<section id="social-impact"><p>X</section>', '<div class="side-by-side"><p>X</div>', '<p class="note alert">X</p>', '<h2 id="comments">X</h2>', '<div class="no-sidebar"><p>X</div>', '<pre><span class="token comment">X</span></pre>'])
@pytest.mark.parametrize("outer", ["<article>{}</article>", "<div class='post'>{}</div>"])
def test_a_word_of_a_name_drops_nothing(outer, inner):
    page = f"<body>{outer.format(f'<p>{LONG}</p>{inner}<p>{LONG}</p>')}</body>"
    assert html_extract.extract(page, []) == f"{LONG} X {LONG}"


@pytest.mark.parametrize("inner", ['<div class="cookie-notice">X</div>', '<p class="ad">X</p>', '<div id="sidebar-2">X</div>', '<section class="comments-area">X</section>', '<ul class="col share-links"><li>X</ul>', '<div role="search">X</div>', '<div class="related-work"><a href="a">X Y</a></div>', '<a class="share-button">X</a>'])
def test_boilerplate_is_dropped_by_its_whole_name_or_links(inner):
    assert html_extract.extract(f"<body><article><p>{LONG}</p>{inner}<p>{LONG}</p></article></body>", []) == f"{LONG} {LONG}"


def test_a_word_of_a_name_and_the_place_drop():
    page = f"<body><article><p>{LONG}</p></article><div class='reader-comments-x'><p>{LONG} {LONG}</p></div></body>"
    assert html_extract.extract(page, [""]) == html_extract.extract(page, []) == LONG
    assert html_extract.extract(f"<body><div class='no-sidebar'><div><p>Before</p></div><article><p>{LONG}</p></article></div></body>", []) == LONG
    assert LONG in html_extract.extract(f"<body><div class='post'><p>{LONG}</p></div><div class='reader-comments-x'><p>{LONG * 3}</p></div></body>", [])


def test_shared_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert (found[r.page_id].text, found[r.page_id].n_chars, found[r.page_id].url) == (text, len(text), r.url)


@pytest.mark.parametrize("limit", [1000, -1])
def test_hosts_agree_on_a_path(spark, limit):
    """A page whose own best container is a sidebar-like list follows the host's vote; odd rows pass."""
    good = "<div class='c{0}'><p>{1}</p></div><div class='x'><p>{2}</p></div>"
    rows = [(i, f"http://Host/{i}", good.format(i, "article words " * 10, "short")) for i in range(6)]
    rows += [(7, "http://host/7", good.format(7, "article words " * 3, "much longer other text " * 3)), (8, None, None), (9, "nonsense", "<p>x"), (9, "nonsense", "<p>x"), (None, "http://host/", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, host int")
    got = html_extract.extract_pages(pages, broadcast_bytes=limit).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[0] == ("article words " * 10).strip() and texts[7] == ("article words " * 3).strip()
    assert (texts[8], texts[9], texts[None]) == ("", "x", "")
    assert html_extract.extract_pages(pages.where("false")).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_every_voted_path_of_a_host_counts(spark, limit):
    """The path with the fewest votes of forty still gives the text of an odd page."""
    good, words = "<div class='{0}'><p>{1}</p></div><div class='{0}-list'><p>{2}</p></div>", "article words "
    names = [f"{a}{b}" for a in "abcde" for b in "pqrstuvw"]
    rows = [(100 * k + j, good.format(name, words * 20, "short")) for k, name in enumerate(names) for j in range(2 if name == "ew" else 3)]
    rows.append((-1, good.format("ew", words * 3, "much longer other text " * 3)))
    pages = spark.createDataFrame([(i, f"http://host/{i}", h) for i, h in rows], "page_id bigint, url string, html string")
    texts = {r.page_id: r.text for r in html_extract.extract_pages(pages, broadcast_bytes=limit).collect()}
    assert len(texts) == len(rows) and texts[-1] == (words * 3).strip()
    assert all(t == (words * 20).strip() for i, t in texts.items() if i >= 0)


# -- TIFF -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.DEFLATE, media.PACKBITS, media.DEFLATE_OLD])
@pytest.mark.parametrize("tile", [None, (16, 16), (32, 16)])
def test_tiff_round_trip(compression, tile):
    rng = np.random.default_rng(1)
    for predictor in (1, 2):
        for big in (False, True):
            for samples in (1, 3):
                pages = [rng.integers(0, rng.choice([2, 256]), (*rng.integers(1, 70, 2), samples)).astype(np.uint8) for _ in range(2)]
                read = list(media.read_pages(media.write_tiff(pages, compression, predictor, 7, tile, big)))
                assert [(p.index, p.height, p.width, p.samples, p.pixels) for p in read] == [(k, *i.shape, i.tobytes()) for k, i in enumerate(pages)]


def test_long_lzw():
    raw = np.random.default_rng(0).integers(0, 256, 60_000).astype(np.uint8).tobytes() + b"ab" * 20_000
    assert media.lzw_decode(media.lzw_encode(raw), len(raw)) == raw


def test_pages_of_damaged_files(spark):
    image = np.zeros((4, 4, 1), np.uint8)
    good = media.write_tiff([image, image])
    rows = spark.createDataFrame([(1, good), (2, good[:40]), (3, None), (4, b""), (5, b"GIF89a..")], "id bigint, media binary")
    got = [(r.id, r.page, r.error is None) for r in media.tiff_pages(rows).collect()]
    assert got == [(1, 0, True), (1, 1, True), (2, None, False), (5, None, False)]


def test_hostile_files_give_an_error_row(spark):
    """Sizes and tags that no data backs, and every kind of damage, are errors of one row each."""
    import struct

    rng = np.random.default_rng(3)
    image = rng.integers(0, 255, (9, 7, 3)).astype(np.uint8)
    files = [media.write_tiff([image], c, 1 + k % 2, 4, (16, 16) if k % 3 == 0 else None) for k, c in enumerate([media.NONE, media.LZW, media.DEFLATE, media.PACKBITS] * 2)]
    hostile = []
    for raw in files:
        (at,) = struct.unpack_from("<I", raw, 4)
        for k in range(struct.unpack_from("<H", raw, at)[0]):
            for value in (0, 2, 2_000_000, 0xFFFFFFFF):
                bad = bytearray(raw)
                struct.pack_into("<I", bad, at + 10 + 12 * k, value)
                hostile.append(bytes(bad))
        for _ in range(60):
            bad = bytearray(raw)
            for _ in range(rng.integers(1, 6)):
                bad[rng.integers(0, len(bad))] = rng.integers(0, 256)
            hostile.append(bytes(bad[: rng.integers(1, len(bad) + 1)]))
    rows = spark.createDataFrame([(k, h) for k, h in enumerate([*hostile, files[1]])], "id bigint, media binary")
    got = media.tiff_pages(rows).collect()
    assert {r.id for r in got} >= {r.id for r in got if r.error} and got[-1].error is None and sum(r.error is not None for r in got) > 100


def test_text_media(spark):
    texts = [None, "", "x", "é" * 96, "a" * 192, "long " * 90_000, "x"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, media int")
    rows = media.text_media(docs).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[2][1:] == rows[6][1:] and rows[5].n_pages > 1 and rows[0].media_bytes > 0
    assert media.text_media(docs.where("false")).count() == 0


# -- pipeline and registry ------------------------------------------------------------------------


def test_stages_of_the_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() <= n, name
        n = docs.count()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
    assert n > 100 and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.run(spark, SF).exceptAll(docs).count() == 0


def test_stages_remove_what_they_should(spark):
    """Copies go but one, a passage that repeats goes but once, a document with one benchmark window goes; clean ones stay."""
    stages = dict(corpus_pipeline.STAGES)
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").first().text
    passage = words("p", 60)
    texts = {1: words("a", 90), 2: words("a", 90), 3: f"{words('b', 40)} {passage} {words('c', 40)}", 4: f"{words('d', 50)} {passage}", 5: f"{words('e', 30)} {item} {words('f', 30)}", 6: words("g", 70)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    ids = lambda frame: sorted(r.doc_id for r in frame.collect())
    assert ids(stages["SimHash near-dedup"](spark, docs, SF)) == [1, 3, 4, 5, 6]
    left = {r.doc_id: r.text for r in stages["suffix-array dedup"](spark, docs, SF).collect()}
    assert passage in left[3] and "p30" not in left[4] and left[6] == texts[6] and left[2] == ""
    assert ids(stages["benchmark decontamination"](spark, docs, SF)) == [1, 2, 3, 4, 6]


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "few words", "en", "s", 9), (3, "few words", "en", "s", 9), (4, "z" * 50_000, None, None, 50_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, hits string, fp int")
    for some in (docs, docs.where("false")):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, some, SF)
            assert made.count() <= some.count(), name
            if k + 1 < len(corpus_pipeline.STAGES):
                assert made.columns == docs.columns, name


def test_registry():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for k in range(1, 11):
        assert sum(n.startswith(f"op{k}_") for n in names) == 1
