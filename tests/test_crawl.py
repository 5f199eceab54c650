"""A whole crawl over fetched pages, to exports and canonical sections."""

from __future__ import annotations

import pytest

from lexweave.sources import crawl, imports

SITE = "https://law.example/"
PAGES = [
    (0, SITE + "titles.htm", '<a href="title_01.htm">Title 1</a><a href="title_01.htm">One</a><a href="title_04c.htm">Title 4c</a><a href="title_09.htm">Title 9</a>'),
    (1, SITE + "title_01.htm", '<a href="chap_002.htm">Chapter 2</a> <a href="chap_002.htm">Two</a>'),
    (2, SITE + "chap_002.htm", '<a href="#sec_1-1">Sec. 1-1. Name.</a><a href="#sec_1-2">Sec. 1-2. Old.</a><p><a id="sec_1-1"></a>Sec. 1-1. Name. Text &amp; more.</p><p class="history">(1949)</p><p><a id="sec_1-2"></a>Sec. 1-2. Old. Repealed.</p>'),
    (3, SITE + "title_04c.htm", '<a href="#sec_4c-1">Sec. 4c-1. Gone.</a><p>Formerly published as chapter 047a</p><p><a id="sec_4c-1"></a>Sec. 4c-1. Gone. Obsolete.</p>'),
]


def test_crawl(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    exports = crawl.title_exports(crawl.crawl(pages, SITE + "titles.htm", ["1", "4C"]))
    rows = imports.canonical_sections(exports).select("title_number", "chapter_name", "id", "heading", "content.plainText", "content.history", "status").collect()
    assert sorted(map(tuple, rows)) == [
        ("1", "Two", "section-1-1", "Sec. 1-1. Name.", "Text & more.", ["(1949)"], "active"),
        ("1", "Two", "section-1-2", "Sec. 1-2. Old.", "Repealed.", [], "repealed"),
        ("4c", "Repealed and obsolete provisions", "section-4c-1", "Sec. 4c-1. Gone.", "Obsolete.", [], "obsolete"),
    ]


@pytest.mark.parametrize(("titles", "message"), [(["9"], "title_09.htm"), (["7"], "title was not found: 07")])
def test_what_is_missing_raises(spark, titles, message):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    with pytest.raises(Exception, match=message):
        crawl.crawl(pages, SITE + "titles.htm", titles).collect()
