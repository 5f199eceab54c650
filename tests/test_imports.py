"""Raw exports, crawled pages, printed schedules, schemas of documents, editions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexweave.operators import jsonschema, schedule, validate, versions
from lexweave.sources import artifacts, crawl, imports
from lexweave.sources.html import parse_pages


def _title(sections):
    return {"title_key": "01", "name": "Provisions", "chapters": [{"chapter_key": "002A", "label": "Chapter 2a", "name": " Acts ", "url": "u", "sections": sections}]}


def test_titles_to_canonical_sections(spark, tmp_path):
    sections = [
        {"section_key": "1-1", "label": "Sec. 1-1. Words", "url": "u#1", "content": {"body_paragraphs": [" a ", "", "b"], "annotations": [{"text": " n "}, {"text": " "}]}},
        {"grouped": True, "section_keys": ["1-2", "1-3"], "label": "", "url": "u#2", "content": {"status": "Reserved", "text": "kept"}},
        {"label": "No key", "url": "u#3"},
    ]
    (tmp_path / "title_01.json").write_text(json.dumps(_title(sections)))
    (tmp_path / "titles_index.json").write_text("{}")
    c = imports.canonical_sections(imports.read_titles(spark, str(tmp_path)))
    rows = c.orderBy("position").collect()
    assert [(r.chapter_id, r.kind, r.citations, r.status, r.title_number) for r in rows] == [
        ("chapter-002a", "section", ["1-1"], "active", "1"), ("chapter-002a", "group", ["1-2", "1-3"], "reserved", "1"), ("chapter-002a", "section", [], "active", "1"),
    ]
    assert [r.id for r in rows[:2]] == ["section-1-1", "group-1-2-to-1-3"] and len(rows[2].id) == len("section-") + 12
    assert rows[0].content.plainText == "a\n\nb" and [a.text for a in rows[0].content.annotations] == ["n"] and rows[1].heading == "Untitled provision"
    assert [len(x.sections) for x in imports.chapters(c).collect()] == [3] and imports.duplicate_ids(c).isEmpty()
    assert imports.manifest_counts(c).where("title_number is null").first().sections == 3
    path = imports.import_titles(spark, str(tmp_path), str(tmp_path.parent / "published"))
    assert artifacts.current(spark, str(tmp_path.parent / "published")).count() == 3 and "generation-" in path


def test_bad_exports_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        imports.read_titles(spark, str(tmp_path))
    (tmp_path / "title_01.json").write_text(json.dumps(_title([{"section_key": "1-1", "label": "x", "url": "u", "content": {"status": "odd"}}])))
    with pytest.raises(Exception, match="unsupported status"):
        imports.canonical_sections(imports.read_titles(spark, str(tmp_path))).collect()
    for target in (tmp_path, tmp_path.parent, tmp_path / "in", "/"):
        with pytest.raises(ValueError):
            imports.safe_paths(str(tmp_path), str(target))


def test_group_keys(spark):
    cases = {"1-2 to 1-4": ["1-2", "1-3", "1-4"], "1-2a to 1-2c, 1-9 and 1-9": ["1-2a", "1-2b", "1-2c", "1-9"], "1-1 to 1-2 to 1-3": ["1-1", "1-2", "1-3"], "": [], "to 1-1": ["1-1"], "1-5 and 1-7": ["1-5", "1-7"]}
    d = spark.createDataFrame([(k,) for k in cases], "x string").select("x", crawl.group_keys(F.col("x")).alias("k"))
    assert {r.x: r.k for r in d.collect()} == cases


def test_section_links(spark):
    page = "https://law.example/chap_001.htm"
    html = """<a href="#sec_1-1">Sec. 1-1. One.</a><a href="#sec_1-1">again</a><a href="#sec_1-3">Sec. 1-2. Two.</a><a href="#secs_1-4to1-6">Secs. 1-4 to 1-6. Reserved.</a>
    <a href="#sec_2-9">other</a><a href="chap_002.htm#sec_1-7">away</a><a href="#top">up</a>"""
    pages = spark.createDataFrame([(1, page, html)], "page_id long, url string, html string")
    links = crawl.page_links(parse_pages(pages), pages)
    rows = crawl.section_links(links, F.lit("1")).orderBy("ordinal").collect()
    assert [(r.section_key, r.grouped, r.section_keys) for r in rows] == [("1-1", False, []), ("1-2", False, []), ("", True, ["1-4", "1-5", "1-6"])]
    assert rows[1].source_fragment_key == "1-3" and "which counts" in rows[1].identifier_warning and rows[0].identifier_warning is None


def test_contents_and_inline_chapters(spark):
    html = '<a href="chap_010.htm">Chapter 10</a> <a href="chap_010.htm">Ten</a><a href="chap_002a.htm">Two</a><a href="/x/art_001.htm"> Article 1 </a>'
    inline = '<a href="#sec_4c-1">Sec. 4c-1. Old.</a><p>Formerly published as chapter 047a</p>'
    pages = spark.createDataFrame([(1, "https://law.example/pub/title_01.htm", html), (2, "https://law.example/pub/title_04c.htm", inline)], "page_id long, url string, html string")
    rows = parse_pages(pages)
    links = crawl.page_links(rows, pages)
    assert [(r.key, r.label, r.name, r.url) for r in crawl.contents(links, "chapter").collect()] == [
        ("art_001", "Article 1", "", "https://law.example/x/art_001.htm"), ("002a", "Chapter 002a", "Two", "https://law.example/pub/chap_002a.htm"), ("010", "Chapter 10", "Ten", "https://law.example/pub/chap_010.htm"),
    ]
    found = crawl.section_links(links)
    assert [(r.key, r.label) for r in crawl.inline_chapters(pages, rows, found).collect()] == [("former-047a", "Former Chapter 47a")]


def _boxes(spark, lines):
    rows = [("s", page, n, float(x), float(x) + 10.0, 200.0 + n, t) for page, n, words in lines for x, t in words]
    return spark.createDataFrame(rows, "source string, page int, line int, x0 double, x1 double, top double, text string")


def test_schedule_rows(spark):
    lines = [
        (6, 0, [(30, "STAT"), (70, "NO")]), (6, 1, [(30, "MOTOR"), (80, "VEHICLES"), (140, "-"), (150, "Numerical"), (200, "Order")]),
        (6, 2, [(30, "14-100a(d1B*"), (120, "Failure"), (180, "to"), (447, "92.00"), (474, "50.00"), (600, "x")]), (6, 3, [(120, "wear"), (160, "vio-")]),
        (6, 4, [(120, "lated"), (447, "99.00"), (700, "see")]), (6, 5, [(300, "7")]),
        (7, 0, [(30, "14-296aa(b1Z"), (120, "Violation"), (180, "of"), (200, "14-296aa(b1st"), (300, "zone")]), (7, 1, [(30, "BOATS")]), (7, 2, [(120, "stray")]),
        (7, 3, [(30, "PA25-55(3(b(1"), (120, "Act"), (474, "1,050.00")]), (7, 4, [(30, "X"), (60, "-"), (80, "Alphabetical"), (150, "Order")]), (7, 5, [(30, "1-1"), (120, "late")]),
    ]
    a, b, c = schedule.schedule_rows(_boxes(spark, lines)).orderBy("nth").collect()
    assert (a.citation, a.section_key, a.description, a.category, a.subsequent, a.note) == ("14-100a(d)(1)(B)", "14-100a", "Failure to wear violated", "MOTOR VEHICLES", True, "see")
    assert float(a.amounts.total_due) == 92 and float(a.amounts.fine) == 50 and a.amounts.fee is None
    assert (b.citation, b.description, b.page) == ("14-296aa(b)", "Violation of 14-296aa(b) (1st offense) zone", 7)
    assert (c.citation, c.section_key, c.category, float(c.amounts.fine)) == ("PA 25-55(3)(b)(1)", "pa25-55", "BOATS", 1050)


def test_fee_rules(spark):
    lines = [(1, 0, [(20, "51-56a(b)"), (120, "Court"), (180, "fee"), (300, "14-"), (580, "All")]), (1, 1, [(120, "col-"), (300, "219(a)"), (340, "14-219(A)"), (400, "1-1")]), (2, 0, [(120, "lected"), (580, "cases")]), (2, 1, [(20, "4-28k"), (120, "Other")])]
    a, b = schedule.fee_rules(_boxes(spark, lines)).orderBy("nth").collect()
    assert (a.authority, a.section_key, a.description, a.comments, a.pages) == ("51-56a(b)", "51-56a", "Court fee collected", "All cases", [1, 2])
    assert [(r.display, r.section_key) for r in a.affected] == [("14-219(a)", "14-219"), ("1-1", "1-1")] and (b.authority, b.pages) == ("4-28k", [2])


def test_column_heads_and_chart_b(spark):
    heads = ["DUE", "FINE", "FEE", "FEE", "COST", "CHARGE", "STF", "BIPSA", "MF", "PLUS"]
    lines = [
        (1, 0, [(30, "STAT"), (60, "NO"), *((500 + 20 * i, h) for i, h in enumerate(heads))]), (1, 1, [(30, "1-1"), (120, "Act"), (520, "5.00")]),
        (2, 0, [(30, "1-2"), (120, "Act"), (474, "6.00")]), (3, 0, [(20, "CHART"), (60, "B"), (80, "(Rev."), (100, "10/2025)")]), (3, 1, [(30, "1-3"), (120, "Rule")]),
    ]
    words = _boxes(spark, lines)
    rows = schedule.schedule_rows(words)
    assert [(r.citation, float(r.amounts.fine)) for r in rows.orderBy("nth").collect()] == [("1-1", 5), ("1-2", 6)]
    chart = schedule.chart_b(words)
    assert {(r.page, r.revision) for r in chart.collect()} == {(3, "10/2025")}
    assert [(r.authority, r.description) for r in schedule.fee_rules(chart).collect()] == [("1-3", "Rule")]
    places = spark.createDataFrame([("1-1", "1", "c", "s")], "key string, title_number string, chapter_number string, id string")
    found = schedule.canonical_rows(rows, places).orderBy("citation").collect()
    assert [(r.status, r.to_id, r.amounts.fine) for r in found] == [("exact", "s", 500), ("unresolved", None, 600)]


def test_editions_and_patches(spark, tmp_path):
    spark.createDataFrame([(2025, "a"), (2026, "b")], "year int, id string").write.partitionBy("year").parquet(str(tmp_path / "e"))
    assert [r.id for r in artifacts.latest_edition(spark.read.parquet(str(tmp_path / "e"))).collect()] == ["b"]
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    patched, degraded = artifacts.with_patch(base, lambda: (base.where("n = 1").select("id"), base.where("n = 2").withColumn("id", F.lit("c"))), ["id"])
    assert sorted(r.id for r in patched.collect()) == ["b", "c"] and not degraded
    same, degraded = artifacts.with_patch(base, lambda: (spark.read.parquet(str(tmp_path / "none")), base), ["id"])
    assert degraded and same.count() == 2


def test_documents_against_a_schema(spark):
    schema = json.dumps({
        "type": "object", "required": ["id", "sections"], "additionalProperties": False,
        "properties": {"id": {"type": "string", "pattern": "^c-"}, "at": {"type": "string", "format": "date-time"}, "n": {"type": "number", "minimum": 1}, "sections": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/definitions/s"}}},
        "definitions": {"s": {"type": "object", "properties": {"kind": {"enum": ["a", "b"]}, "u": {"type": ["string", "null"], "format": "uri"}}}},
    })
    cases = {
        '{"id": "c-1", "n": 2, "at": "2026-01-01T00:00:00Z", "sections": [{"kind": "a", "u": null}]}': [],
        '{"id": "x", "n": 0, "at": "2026-01-01", "sections": []}': ["$/id: does not match ^c-", "$/n: must be at least 1", "$/at: is not a valid date-time", "$/sections: has fewer than 1 items"],
        '{"id": 5, "extra": 1}': ["$: missing required property sections", "$/id: expected string, received integer", "$: unexpected property extra"],
        '{"id": "c-1", "sections": [{"kind": "z", "u": "nowhere"}, {"kind": "z", "u": "nowhere"}]}': ["$/sections: contains duplicate items", "$/sections/0/kind: must be one of a, b", "$/sections/0/u: is not a valid uri", "$/sections/1/kind: must be one of a, b", "$/sections/1/u: is not a valid uri"],
        "{": ["$: is not JSON"],
        None: ["$: is missing"],
    }
    d = spark.createDataFrame([(k,) for k in cases], "x string").select("x", jsonschema.document_errors(F.col("x"), schema).alias("e"))
    assert {r.x: r.e for r in d.collect()} == cases


def test_published_editions(spark):
    schema = "chapter_id string, id string, kind string, citations array<string>, heading string"
    base = spark.createDataFrame([("c", "a", "section", ["1-1"], "A"), ("c", "b", "section", ["1-2"], "B")], schema)
    overlay = spark.createDataFrame([("c", "n", "section", ["1-2"], "New")], schema)
    keys = ["chapter_id", "id"]
    current = versions.apply_overlay(base, overlay).select(*base.columns)
    removed, added = versions.derive_patch(base, current, keys)
    assert validate.overlay_errors(base, overlay, current, removed, added, keys).isEmpty()
    bad = validate.overlay_errors(base, overlay.unionByName(overlay.withColumn("id", F.lit("m"))), current, removed, added, keys)
    assert {(r.layer, r.problem) for r in bad.collect()} == {("claims", "claimed twice"), ("sections", "missing"), ("patch documents", "missing")}


def test_hot_shards_are_spread(spark):
    rows = spark.range(250).selectExpr("CASE WHEN id < 240 THEN 'hot' WHEN id < 245 THEN NULL ELSE 'cold' END AS k", "id", "CAST(NULL AS STRING) AS empty")
    shards = artifacts.json_shards(rows, "k", "id", limit=100).collect()
    hot = [json.loads(r.body)["items"] for r in shards if (r.path or "").startswith("hot-")]
    assert len(hot) == 3 and sorted(x["id"] for h in hot for x in h) == list(range(240)) and all(h == sorted(h, key=lambda x: x["id"]) for h in hot)
    assert hot[0][0]["empty"] is None and sum(r.path == "cold.json" for r in shards) == 1 and len(shards) == 5
