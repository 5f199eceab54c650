"""Files, publishing, HTML, streaming, and the entry module with and without its optional part."""

from __future__ import annotations

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexweave.functions.query import Options
from lexweave.operators import search
from lexweave.sources import artifacts
from lexweave.sources.html import anchored_sections, html_rows, merged_links, page_anchors, parse_pages
from lexweave.sources.tables import sections
from lexweave.streaming.progressive import ProgressiveSearch, recents_stream, shard_stream


def test_chapters_to_documents(spark, tmp_path):
    section = {"id": "section-1-1", "kind": "section", "citation": "1-1", "citations": ["1-1"], "heading": "Sec. 1-1. Words", "sourceUrl": "u", "status": "active", "content": {"body": ["x"], "plainText": "Words of tax", "history": ["h"], "annotations": [{"first": True, "text": "note"}]}}
    (tmp_path / "c.json").write_text(json.dumps({"schemaVersion": "1.0.0", "id": "chapter-1", "number": "1", "name": "N", "title": {"id": "title-1", "number": "1", "name": "T"}, "sections": [section]}))
    d = artifacts.search_documents(artifacts.chapter_sections(artifacts.read_chapters(spark, str(tmp_path))))
    assert search.search(d, "note", Options(field="all")).first().matched_fields == ["annotations"]


def test_publish_keeps_the_last_good_generation(spark, tmp_path):
    root = str(tmp_path / "pub")
    artifacts.publish(spark.range(3), root)

    def refuse(_):
        raise ValueError("bad")

    with pytest.raises(ValueError):
        artifacts.publish(spark.range(5), root, refuse)
    assert artifacts.current(spark, root).count() == 3


def test_content_store_fails_closed(spark):
    m, b = artifacts.content_store(spark.createDataFrame([("u1", "x"), ("u2", "x"), ("u3", "y")], "url string, body string"), "url", "body")
    assert b.count() == 2 and artifacts.replay(m, b).count() == 3
    with pytest.raises(Exception, match="missing or altered"):
        artifacts.replay(m, b.where("1 = 0")).collect()


def test_html(spark):
    page = '<h2 id="sec_1">Sec. 1.</h2><p>Body <a href="/x#f">one</a></p><p class="source">S</p><p class="history-first">H</p><h2 id="sec_2">Sec. 2.</h2><a href="/x">two</a><script>no</script>'
    rows = parse_pages(spark.createDataFrame([(1, page), (2, None)], "page_id bigint, html string")).cache()
    assert [(r.url, r.text) for r in merged_links(rows).collect()] == [("/x", "one two")]
    anchors = page_anchors(spark.createDataFrame([(1, page), (2, None), (None, "<p>x</p>")], "page_id bigint, html string"))
    s = anchored_sections(anchors).orderBy("first").collect()
    assert (s[0].body, s[0].source, s[0].history) == (["Sec. 1.", "Body one"], ["S"], ["H"]) and s[1].anchor == "sec_2"
    assert html_rows("<p>a") [0]["text"] == "a"


def test_progressive_search(spark, sf_dir, tmp_path):
    d = sections(spark, sf_dir).withColumn("history", F.array().cast("array<string>")).withColumn("annotations", F.array().cast("array<string>"))
    for i in range(3):
        d.where(F.col("doc_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "shards"))
    p = ProgressiveSearch("the of", limit=5)
    p.run(shard_stream(spark, str(tmp_path / "shards"), d.schema), str(tmp_path / "ck")).awaitTermination()
    assert p.batches == 3 and p.total == search.total_matches(d, "the of").first()[0]
    assert [r["id"] for r in p.results] == [r.id for r in search.search(d, "the of", limit=5).collect()]
    with pytest.raises(ValueError):
        ProgressiveSearch('"open')


def test_progressive_search_replays_and_restarts(spark, sf_dir, tmp_path):
    """A batch that comes again counts once, and a new process goes on from the stored state."""
    d = sections(spark, sf_dir)
    first, second = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    p = ProgressiveSearch("the of", limit=5)
    p.merge(first, 0)
    p.merge(first, 0)
    p.merge(second, 1)
    want, total = [r.id for r in search.search(d, "the of", limit=5).collect()], search.total_matches(d, "the of").first()[0]
    assert (p.total, p.batches, [r["id"] for r in p.results]) == (total, 2, want)
    path, ck = str(tmp_path / "shards"), str(tmp_path / "ck")
    first.coalesce(1).write.parquet(path)
    ProgressiveSearch("the of", limit=5).run(shard_stream(spark, path, d.schema), ck).awaitTermination()
    second.coalesce(1).write.mode("append").parquet(path)
    again = ProgressiveSearch("the of", limit=5)
    again.run(shard_stream(spark, path, d.schema), ck).awaitTermination()
    assert (again.total, again.batches, [r["id"] for r in again.results]) == (total, 2, want)


def test_recents_stream(spark, tmp_path):
    events = spark.createDataFrame([("u", "a", "2024-01-01 00:00:00"), ("u", "a", "2024-01-01 00:10:00"), ("u", "b", "2024-01-01 00:05:00")], "u string, k string, t string").withColumn("at", F.to_timestamp("t"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = recents_stream(stream, "u", "k", "at").writeStream.outputMode("complete").format("memory").queryName("recents").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.views) for r in spark.table("recents").collect()} == {("a", 2), ("b", 1)}


def test_entry_has_sql_columns(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "citation", "score", "matched_fields"]


def test_entry_imports_without_the_optional_part(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'search_boolean' in n and not any(x.startswith('op') and x[2].isdigit() for x in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from lexweave.cli import run

    s = sections(spark, sf_dir)
    s.write.parquet(str(tmp_path / "a"))
    s.where("doc_id % 10 <> 0").write.parquet(str(tmp_path / "b"))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert run(["search", "--data", a, "--query", "the", "--limit", "2"], spark) == 0 and "| citation |" in capsys.readouterr().out
    assert run(["search", "--data", a, "--query", '"open'], spark) == 1
    assert run(["gate", "--before", a, "--after", a], spark) == 0 and run(["gate", "--before", a, "--after", b], spark) == 1
    assert run(["diff", "--before", a, "--after", b, "--titles", "none"], spark) == 0 and "| 0 | 0 | 0 |" in capsys.readouterr().out
    assert run(["validate", "--data", a], spark) == 0


def test_linked_text_and_binding(spark):
    from lexweave.functions.text import linked_text
    from lexweave.operators.reports import binding_errors

    rows = [("See Sections  1-2A & 9-9; section 9-9, chapter 3b", {"1-2a": "#/x?a&b"}, {"3b": "#/c"}), (None, None, None), ("section 1-1", None, None)]
    d = spark.createDataFrame(rows, "t string, s map<string,string>, c map<string,string>")
    linked = [r.h for r in d.select(linked_text(F.col("t"), F.col("s"), F.col("c")).alias("h")).collect()]
    at = '<a class="legal-reference" href="{}">{}</a>'.format
    assert linked == [f"See Sections {at('#/x?a&amp;b', '1-2A')} &amp; 9-9; section 9-9, chapter {at('#/c', '3b')}", "", "section 1-1"]
    e = spark.createDataFrame([("2026", "b", "1.0.0", "t", "h"), ("2025", "b", "1.0.0", "t", "other")], "edition string, base_id string, schema_version string, generated_at string, manifest_sha256 string")
    assert [(r.edition, r.wrong) for r in binding_errors(e, e.limit(1).drop("edition")).collect()] == [("2025", ["manifest_sha256"])]
