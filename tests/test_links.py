"""Links of pages: the page's address, and nothing of it through the driver."""

import pytest

from lexweave.sources import crawl
from lexweave.sources.html import parse_pages

PAGES = [(1, "https://law.example/a.htm", '<a href="#sec_1-1">Sec. 1-1. One.</a><p>x <a href="b.htm#y">b</a></p>'), (2, None, '<a href="#z">z</a>'), (3, "https://law.example/c.htm", None), (None, "https://law.example/d.htm", '<a href="#d">d</a>'), (4, "https://law.example/e.htm", '<p>none</p><a href="/r">r</a>')]
SCHEMA = "page_id long, url string, html string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_addresses_from_the_parser(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    carried, joined = crawl.page_links(parse_pages(pages, url="url")), crawl.page_links(parse_pages(pages), pages)
    want = [
        (1, "https://law.example/a.htm", "Sec. 1-1. One.", "https://law.example/a.htm#sec_1-1"), (1, "https://law.example/a.htm", "b", "https://law.example/b.htm#y"),
        (2, None, "z", None), (4, "https://law.example/e.htm", "r", "https://law.example/r"),
    ]
    for d in (carried, joined):
        assert [(r.key, r.page_url, r.text, r.href) for r in d.orderBy("key", "ordinal").collect()] == want
    assert "Join" not in _plan(carried) and "Broadcast" not in _plan(joined)
    assert parse_pages(pages).columns == parse_pages(pages, url="url").columns[:-1]


@pytest.mark.parametrize("threshold", ["10m", "1g"])
def test_query_broadcasts_no_links(spark, sf_dir, threshold):
    import __spark_entry__ as e

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = _plan(e.queries()["section_links"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "MapInArrow" in plan and "Join" not in plan and "Broadcast" not in plan
