"""Archives and HTML extraction."""

from __future__ import annotations

import hashlib
import random

import pytest

from lexweave.llm import warc
from lexweave.llm.htmltext import extract_pages, main_text

BIG = "<html>" + "x" * 200
ROWS = [(3, "http://a.org/x?y=1", BIG), (1, None, BIG), (2, "http://b.org/\r\nInjected: 1", "tiny"), (5, "u", "tiny"), (None, "v", BIG), (None, None, None), (7, "w", BIG), (7, "w", BIG), (-4, "z", "é" * 60)]


def pages(spark, rows=ROWS):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("body", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("first", F.lit(3))


def test_captures(spark):
    got = sorted((tuple(r)[:5] for r in warc.page_captures(pages(spark)).collect()), key=repr)
    want = []
    for i, _, h in ROWS:
        body = (h or "").encode()
        first = 1 if h == BIG and i != 1 else None
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if first else "response", first))
    assert got == sorted(want, key=repr)
    assert warc.page_captures(pages(spark).where("1 = 0")).count() == 0


def test_nested_row(spark):
    found = warc.assemble(warc.read_records(warc.write_archives(pages(spark))))
    r = found.where("metadata.page_id = 3").first()
    assert r.request.line == "GET /x?y=1 HTTP/1.1" and r.capture.kind == "revisit" and (r.n_requests, r.n_metadata) == (1, 1)


def test_identifiers_and_damage(spark):
    ids = {warc.record_id(k, p, u, "ab" * 32) for k in ("response", "request") for p in (0, -4, 2**62, None) for u in ("u", "", None)}
    assert len(ids) == 24 and all(x[23] == "8" and x[28] in "89ab" for x in ids)
    with pytest.raises(ValueError):
        list(warc.records(b"not a record"))


def test_pages_without_id_keep_their_own_records(spark):
    rows = [(None, "http://a/x", BIG), (None, "http://b/y", BIG), (None, None, "z" * 150)]
    found = warc.assemble(warc.read_records(warc.write_archives(pages(spark, rows))))
    got = sorted((r.capture.uri or "", r.request.line, r.capture.kind, r.n_requests, r.n_metadata) for r in found.collect())
    assert got == [("", "GET / HTTP/1.1", "response", 1, 1), ("http://a/x", "GET /x HTTP/1.1", "response", 1, 1), ("http://b/y", "GET /y HTTP/1.1", "response", 1, 1)]


def test_foreign_archive_and_missing_target(spark):
    """Records with identifiers of their own: a revisit finds its target by the identifier alone."""
    about = {"Content-Type": "application/http; msgtype=response"}
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"
    data = warc.record("response", "urn:x:1", "http://a/", about, http + b"hello")
    data += warc.record("metadata", "urn:x:2", "http://a/", {"WARC-Concurrent-To": "<urn:x:1>"}, b"pageId: 11\r\n")
    data += warc.record("revisit", "urn:x:3", "http://b/", about | {"WARC-Refers-To": "<urn:x:1>"}, http)
    data += warc.record("revisit", "urn:x:4", "http://c/", about | {"WARC-Refers-To": "<urn:x:9>"}, http)
    archive = spark.createDataFrame([(bytearray(data),), (None,), (bytearray(b""),)], "content binary")
    got = {r.record_id: r for r in warc.assemble(warc.read_records(archive)).collect()}
    assert len(got) == 3 and (got["urn:x:3"].referred.page_id, got["urn:x:3"].referred.uri) == (11, "http://a/")
    assert got["urn:x:4"].referred is None and got["urn:x:1"].metadata.page_id == 11 and got["urn:x:3"].request is None


def test_payload_longer_than_a_segment(spark):
    rows = [(i, f"u{i}", chr(97 + i) * (warc.SEGMENT_BYTES * 3 if i % 2 else 10)) for i in range(4)]
    archives = warc.write_archives(pages(spark, rows).coalesce(1))
    assert archives.count() >= 1
    got = sorted((r.capture.payload_bytes, r.capture.digest) for r in warc.assemble(warc.read_records(archives)).collect())
    assert got == sorted((len(h), hashlib.sha256(h.encode()).hexdigest()) for _, _, h in rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<main><article class="post"><header><h1>Head &amp; tail</h1></header><p>One  <a href=x>linked</a>
 text.<p>Two<br>lines</p><aside>Related</aside><form>Sub <input></form><p>End.</p><section id="comments"><article class="comment"><p>nice</p></article></section></article></main>
<div class="sidebar">side</div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head & tail\nOne linked text.\nTwo\nlines\nEnd."
    plain = '<div class="menu"><a href="/">Home</a></div><div class=content><h2>Title</h2><p>Some long text here that counts.</p><p>More</p></div><div class=footer>x</div>'
    assert main_text(plain) == "Title\nSome long text here that counts.\nMore"
    assert main_text('<div class="page nav-open"><article><p>Kept.</p></article></div>') == "Kept."
    assert main_text('<main><p>Text.</p></main><div id="comments"><article><p>Nice</p></article></div>') == "Text."
    assert main_text("") == "" and main_text("a < b &lt;i&gt; &#233;") == "a < b <i> é"
    assert main_text("<p>cut <script>never closed <p>x") == "cut"


LOREM = "The river ran on through the quiet valley and nobody there had counted its bends. "


def test_names_of_furniture():
    for name in ("overflow-hidden", "elementor-widget-container", "content-with-sidebar"):
        assert main_text(f'<article><p>Start.</p><div class="{name}"><p>{LOREM}</p></div><p>End.</p></article>') == f"Start.\n{LOREM.strip()}\nEnd."
    assert main_text('<article><h2 id="social-impact">Impact</h2><p>a</p><section id="related-work"><h2 id="related">Work</h2><p>b</p></section></article>') == "Impact\na\nWork\nb"
    assert main_text("<html><head><title>T</title><body><p>Kept without an end of the head.</p></body></html>") == "Kept without an end of the head."
    assert main_text(f'<article><div class="widget"><p>{LOREM * 5}</p></div><div class="ad-box">Buy</div><p>x</p></article>') == f"{(LOREM * 5).strip()}\nx"
    assert main_text('<article><p>a</p><div class="social-links">s</div><div id="site-footer">f</div><div class="ads">b</div></article>') == "a"


def test_windows_choose_on_pages_with_an_article():
    real = "".join(f"<p>{i} {LOREM * 3}</p>" for i in range(4))
    want = "\n".join(f"{i} {(LOREM * 3).strip()}" for i in range(4))
    assert main_text(f"<div>{real}</div><article><h3>Card</h3><p>Read this too.</p></article>") == want
    assert main_text(f"<article><h3>Card</h3><p>Read this too.</p></article><div>{real}</div>") == want
    assert main_text(f"<div><p>A line outside.</p></div><article>{real}</article><div><p>{LOREM * 6}</p></div>") == want


def test_furniture_and_links_inside_a_container():
    a, b = (f"{x} {LOREM * 2}".strip() for x in "ab")
    for block in (
        '<div class="ad"><p>Buy</p><p>this</p><p>now</p><p>please</p></div>',
        "<form><p>Your</p><p>name</p><p>and</p><p>address</p></form>",
        '<ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul>',
    ):
        assert main_text(f"<body><div><p>{a}</p>{block}<p>{b}</p></div></body>") == f"{a}\n{b}"
        assert main_text(f"<div id=x><div><section><p>{a}</p></section>{block}<section><p>{b}</p></section></div><div>{block}</div><div><p>Side</p></div></div>") == f"{a}\n{b}"
    assert main_text(f"<div><p>Crumbs</p><article><p>{a}</p><p>{b}</p></article><p>Outro</p></div>") == f"{a}\n{b}"
    links = '<p><a href="/1">A paragraph that is mostly a link</a> to read.</p>'
    text = "A paragraph that is mostly a link to read."
    assert main_text(f"<div><p>{a}</p>{links}{links}{links}<p>{b}</p>{links}</div>") == "\n".join([a, text, text, text, b, text])


def test_text_that_names_or_markup_must_not_drop():
    for name in ("notice-period", "social-history", "formation", "shareholders"):
        assert main_text(f'<article><p>a</p><div class="{name}"><p>{LOREM}</p></div><p>b</p></article>') == f"a\n{LOREM.strip()}\nb"
    assert main_text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == "If x=2 holds."
    assert main_text(f'<div><p>{LOREM * 3}</p><p>See <a href="/">the whole long story of it all</a>.</p><p>{LOREM * 3}</p></div>').count("whole long story") == 1


def _plain_article(sizes):
    """Places between surge and dive for paragraphs of given sizes (0: links alone), window by
    window: stretches whose windows are not empty, the heaviest of those that surge."""
    n = len(sizes)
    sums = [sum(sizes[j] for j in range(i, min(i + 3, n))) for i in range(n)]
    level = max(sums, default=0) / 4
    best, i = (0, -1, -1), 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        own = [k for k in range(i, j) if sizes[k]]
        if max(sums[i:j]) >= level and sum(sizes[i:j]) > best[0]:
            best = (sum(sizes[i:j]), own[0], own[-1])
        i = j
    return best[1], best[2]


def test_windows_against_every_window():
    """Bare paragraphs of random sizes, in containers of their own, against a plain version."""
    rng = random.Random(9)
    for _ in range(400):
        sizes = [rng.choice([0, 0, 0, 7, 40, 300]) for _ in range(rng.randrange(1, 25))]
        text = [f"{i} " + "x" * (n - len(f"{i} ")) if n else f"link {i}" for i, n in enumerate(sizes)]
        page = "".join(f"<div><p>{t}</p></div>" if n else f'<div><p><a href="/">{t}</a></p></div>' for t, n in zip(text, sizes, strict=True))
        first, last = _plain_article([len(t) if n else 0 for t, n in zip(text, sizes, strict=True)])
        alone = {i for i, n in enumerate(sizes) if not n and any(all(not sizes[k] for k in range(s, s + 3)) for s in range(i - 2, i + 1) if s >= 0 and s + 3 <= len(sizes))}
        want = [text[i] for i in range(first, last + 1) if i not in alone] if last >= 0 else []
        assert main_text(page) == "\n".join(want), sizes


def _random_page(rng):
    """A page with its article's blocks known: furniture around and inside, markup broken as the
    standard allows."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    furniture = [
        lambda: "<nav><ul>" + "".join(f'<li><a href="/{word()}">{say(1)}</a></li>' for _ in range(rng.randrange(3, 9))) + "</ul></nav>", lambda: f'<div class="ad">{say(12)}</div>', lambda: f"<aside><p>{say(8)}</p></aside>",
        lambda: f"<form><p>{say(3)}</p><input><button>{word()}</button></form>", lambda: f'<div id="cookie-notice"><p>{say(9)}</p></div>', lambda: f"<script>var x = '<p>{word()}</p>';</script>", lambda: f"<!-- {say(5)} -->",
        lambda: f'<ul class="share-links"><li>{say(2)}<li>{say(2)}</ul>',
    ]
    blocks, inside = [], ""
    for _ in range(rng.randrange(1, 9)):
        text = say(rng.choice([1, 3, 25, 80]))
        shown = rng.choice([text, text.replace(" ", " \n ", 1), f"<b>{text}", f'<a href="/x">{text.split(" ")[0]}</a>' + text[len(text.split(" ")[0]) :], text + "&amp;"])
        blocks.append(text + "&" if shown.endswith("&amp;") else text)
        inside += rng.choice([f"<p>{shown}</p>", f"<p>{shown}", f"<h2>{shown}</h2>", f"<div><p>{shown}</p></div>"])
        if rng.random() < 0.3:
            inside += rng.choice(furniture)()
    blocks.append(long := say(60))
    inside += f"<p>{long}</p>"
    if rng.random() < 0.5:
        inside += f'<section id="comments"><article><p>{say(90)}</p></article></section>'
    tag = rng.choice(["article", "main", "article"])
    around = lambda: "".join(rng.choice(furniture)() for _ in range(rng.randrange(4)))
    return f"<!DOCTYPE html><html><head><title>{say(4)}</title><body>{around()}<header><p>{say(4)}</p></header>{around()}<{tag}>{inside}</{tag}>{around()}<footer>{say(7)}</footer></body></html>", blocks


def test_pages_with_a_known_article():
    rng = random.Random(4)
    for _ in range(400):
        page, blocks = _random_page(rng)
        assert main_text(page) == "\n".join(blocks), page


def test_very_long_page():
    body = "".join(f"<p>{i} {LOREM}</p>" for i in range(20_000))
    assert main_text(f"<nav><a href=/>x</a></nav><div>{body}</div>").count("\n") == 19_999


def test_pages_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    got = sorted((tuple(r) for r in extract_pages(pages(spark, rows)).collect()), key=repr)
    text = main_text(PAGE)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
