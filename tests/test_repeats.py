"""Queries against their SQL on small tables with the repeats and keys that larger tables have."""

from __future__ import annotations

import duckdb
import pytest

LINEITEMS = [
    (1, 0, 0, 1, "R"), (1, 0, 0, 1, "R"), (1, 0, 0, 1, "A"),  # one order and number three times in one section
    (1, 1, 1, 1, "R"), (1, 1, 1, 2, "N"),  # and once in another
    (4, 0, 0, 1, "R"), (4, 0, 0, 1, "R"),  # an order whose infractions are not there
    (5, 0, 0, 3, "R"), (5, 0, 0, 3, "R"), (6, 0, 0, 3, "R"), (6, 1, 1, 5, "R"), (6, 1, 1, 5, "R"), (7, 1, 1, 7, "R"),
]
PARTS = [(0, "bolt", "Brand#1", "SMALL", 1), (1, "nut", "Brand#2", "LARGE", 2), (9998, "cog", "Brand#3", "SMALL", 30), (9999, "pin", "Brand#4", "LARGE", 28), (10000, "rod", "Brand#4", "LARGE", 27)]


@pytest.mark.parametrize("name", ["section_context", "section_links"])
@pytest.mark.parametrize("odd", [0, 1])
def test_against_sql(spark, tmp_path, name, odd):
    import __spark_entry__ as e

    parts = [(k, n, b, t, s + odd) for k, n, b, t, s in PARTS]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, p, s + odd, n, f) for o, p, s, n, f in LINEITEMS]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = e.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    want = found.fetchall()
    assert len(want) > 5 and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
