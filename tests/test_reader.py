"""Labels, catalogs, resolution digests and shard names on small literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import links, versions
from lexweave.sources import artifacts


def test_labels(spark):
    rows = [(["1-2", "", "1-4a"], "1-2", "H"), (None, "3-1", "H"), ([], "3-1", "H"), (["12a-5"], None, "Secs. 1-2 and 1-3.  Old. Text "), (None, None, " Sec. 1-2. T")]
    d = spark.createDataFrame(rows, "cs array<string>, c string, h string")
    out = d.select(tx.navigation_label(F.col("cs"), F.col("h"), F.col("c")).alias("l"), tx.compact_heading(F.col("h")).alias("h")).collect()
    assert [r.l for r in out] == ["§§ 1-2–4a", "§ 3-1", "H", "§ 12a-5", " Sec. 1-2. T"]
    assert [r.h for r in out[3:]] == ["Old. Text", "Sec. 1-2. T"]
    sub = spark.createDataFrame([("(B2) x",), ("x (a)",), (None,)], "t string").select(tx.leading_subsection(F.col("t")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in sub] == [("(B2)", "b2", "x"), (None, None, "x (a)"), (None, None, None)]


def test_catalog_entries_have_their_files(spark):
    catalog = spark.createDataFrame([("1", "c1", "a/1.json"), ("2", "c2", "a/2.json")], "title_id string, chapter_id string, path string")
    files = spark.createDataFrame([("1.json", 7), ("9.json", 9)], "file string, n int")
    assert [tuple(r) for r in artifacts.dereference(catalog, files, ["1"]).collect()] == [("1", "c1", "a/1.json", "1.json", 7)]
    assert artifacts.dereference(catalog, files, []).count() == 0
    with pytest.raises(Exception, match="a/2.json"):
        artifacts.dereference(catalog, files).collect()


def test_resolution_split(spark):
    a = '{"b": [{"resolution": {"status": "exact"}, "n": 1}], "a": null}'
    b = '{"a": null, "b": [{"n": 1, "resolution": {"status": "unresolved"}}]}'
    c = '{"a": 0, "b": [{"n": 1, "resolution": {"status": "exact"}}]}'
    d = spark.createDataFrame([(1, a), (2, b), (3, c), (4, None), (5, "[]")], "id int, t string")
    x = {r.id: r.x for r in d.select("id", versions.resolution_split(F.col("t")).alias("x")).collect()}
    assert x[1].content == x[2].content != x[3].content and x[1].resolution == x[3].resolution != x[2].resolution
    assert (x[4].content, x[4].resolution) == (None, None) and x[5].content == x[5].resolution


def test_shard_names(spark):
    d = spark.createDataFrame([(0, 1), (0, 2), (8, 10), (9, 10), (99, 120), (100, 120)], "i int, n int")
    names = [r.x for r in d.select(links.shard_name(F.lit("k"), F.col("i"), F.col("n")).alias("x")).collect()]
    assert names == ["k.json", "k-01.json", "k-09.json", "k-10.json", "k-100.json", "k-101.json"]
