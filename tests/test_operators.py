"""Search, versions, links, index, state and validation on small literals."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.functions.query import Near, Options, Term
from lexweave.operators import folds, index, links, search, state, validate, versions
from lexweave.operators.revision import diff_texts

DOC = "id string, citation string, citations array<string>, heading string, text string, status string, title_number string, chapter_id string, chapter_number string, supplement_year int, history array<string>, annotations array<string>"


def docs(spark, *rows):
    full = []
    for r in rows:
        d = {"id": "x", "citation": "1-1", "citations": None, "heading": "", "text": "", "status": "active", "title_number": "1", "chapter_id": "c1", "chapter_number": "1", "supplement_year": None, "history": None, "annotations": None} | r
        d["citations"] = d["citations"] or [d["citation"]]
        full.append(tuple(d[c.split(" ")[0]] for c in DOC.split(", ")))
    return spark.createDataFrame(full, DOC)


def ids(df):
    return [r.id for r in df.collect()]


def test_search_ranks_and_filters(spark):
    d = docs(
        spark, {"id": "a", "citation": "10-2", "heading": "Income tax", "text": "The tax on income"}, {"id": "b", "citation": "2-9", "heading": "Sales", "text": "tax records; café résumé", "supplement_year": 2026},
        {"id": "c", "citation": "3-1", "heading": "Old", "text": None, "status": "repealed", "chapter_id": "c2", "history": ["tax history"]},
    )
    assert ids(search.search(d, "tax")) == ["a", "b"]
    assert ids(search.search(d, "tax", Options(sort="citation"))) == ["b", "a"]
    assert ids(search.search(d, "tax", Options(field="all"))) == ["a", "b", "c"]
    assert ids(search.search(d, "cafe resume")) == ["b"] and ids(search.search(d, '"ax rec"')) == ["b"]
    assert ids(search.search(d, "NOT tax")) == ["c"] and set(ids(search.search(d, "NOT -"))) == {"a", "b", "c"}
    assert ids(search.search(d, "2-9")) == ["b"] and search.search(d, "2-9").first().score == 121.0
    assert ids(search.search(d, "tax", Options(supplement="updated"))) == ["b"]
    assert ids(search.search(d, "tax", Options(within="sales"))) == ["b"]
    assert search.search(d, "old").first().score == 1 + 34 - 0.25
    assert search.search(d, "income").first().matched_fields == ["heading", "body"]
    assert search.total_matches(d, "tax").first()[0] == 2
    parts = [search.search(d.where(F.col("id") == i), "tax", limit=1) for i in ("a", "b")]
    assert ids(search.merge_results(*parts, limit=1)) == ["a"]
    with pytest.raises(ValueError):
        search.search(d, '"open')


def test_near_equals_positions(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c", "ab", "ca"], k=rng.randrange(0, 9))) for _ in range(300)]
    d = search.prepare(docs(spark, *({"id": str(i), "text": t} for i, t in enumerate(texts))), ("body",))
    for left, right, n in ((Term("a"), Term("b"), 1), (Term("a b"), Term("c"), 3), (Term("c", "prefix"), Term("a", "prefix"), 2), (Term("a"), Term("a"), 1)):

        def at(term, words):
            k = len(term.tokens)
            return [i for i in range(len(words) - k + 1) if all(w.startswith(t) if term.kind == "prefix" and j == k - 1 else w == t for j, (w, t) in enumerate(zip(words[i : i + k], term.tokens, strict=True)))]

        want = {str(i) for i, t in enumerate(texts) if any(abs(x - y) <= n for x in at(left, t.split()) for y in at(right, t.split()))}
        assert set(ids(d.where(search.near_in(Near(left, right, n), "body")))) == want


def test_highlight_and_excerpt(spark):
    d = spark.createDataFrame([("x" * 100 + " Tax <b> & real   estate " + "y " * 200,)], "t string")
    r = d.select(search.highlighted(F.col("t"), ["real estate", "tax"]).alias("h"), search.excerpt(F.col("t"), ["tax"]).alias("e")).first()
    assert "<mark>Tax</mark> &lt;b&gt; &amp; <mark>real   estate</mark>" in r.h
    assert r.e.startswith("…") and r.e.endswith("…") and "<mark>Tax</mark>" in r.e
    assert search.highlight_terms('b "long phrase" (') == [] and search.highlight_terms('b "long phrase"') == ["long phrase", "b"]


BASE = "chapter_id string, id string, kind string, citations array<string>, status string, body array<string>"
RESERVED = ["Reserved for future use.", "Note: x"]


def overlay(spark, base, over):
    b = spark.createDataFrame([("c", i, "group" if len(c) > 1 else "section", c, s, t) for i, c, s, t in base], BASE)
    o = spark.createDataFrame([("c", i, "section", c, "active", ["new"]) for i, c in over], BASE)
    rows = {r.overlay_id: (r.mode, r.presentation, r.error) for r in versions.classify_overlay(b, o).collect()}
    out = [(r.id, r.citations) for r in versions.apply_overlay(b, o).orderBy("sort_key").collect()]
    return rows, out


def test_overlay_cases(spark):
    rows, out = overlay(spark, [("s1", ["1-1"], "active", ["x"]), ("s3", ["1-3"], "active", ["x"])], [("o1", ["1-1"]), ("o2", ["1-2"])])
    assert rows == {"o1": ("single", "amended", None), "o2": ("addition", "new", None)} and [c for _, c in out] == [["1-1"], ["1-2"], ["1-3"]]
    rows, _ = overlay(spark, [("g", ["1-1", "1-2"], "active", ["x"])], [("o", ["1-1"])])
    assert rows["o"][2] == "ambiguous partial group"
    rows, out = overlay(spark, [("g", ["4-66i", "4-66j"], "reserved", RESERVED)], [("o", ["4-66i"])])
    assert rows["o"][:2] == ("single", "new") and out == [("o", ["4-66i"]), ("section-4-66j", ["4-66j"])]
    rows, out = overlay(spark, [("s", ["a"], "active", ["x"]), ("g", ["a", "b", "c"], "reserved", RESERVED)], [("o", ["a"])])
    assert rows["o"][0] == "single" and out == [("o", ["a"]), ("group-b-c", ["b", "c"])]
    rows, out = overlay(spark, [("s1", ["a"], "active", ["x"]), ("s2", ["b"], "active", ["x"])], [("o", ["a", "b"])])
    assert rows["o"][0] == "aggregate" and out == [("o", ["a", "b"])]
    rows, _ = overlay(spark, [("s1", ["a"], "active", ["x"])], [("o", [])])
    assert rows["o"][2] == "no citation"


def test_claims_and_duplicates(spark):
    b = spark.createDataFrame([("c", "g", "group", ["a", "b"], "reserved", RESERVED)], BASE)
    o = spark.createDataFrame([("c", x, "section", ["a"], "active", ["y"]) for x in ("o1", "o2")], BASE)
    with pytest.raises(ValueError):
        versions.require_none(versions.claimed_twice(b, o))
    versions.require_none(versions.duplicate_keys(b, "id"))


def test_diff_of_itself_is_empty_and_patch_round_trips(spark):
    a = spark.createDataFrame([("1", "x", None), ("2", None, "q"), ("3", "z", "q")], "key string, t string, u string")
    b = spark.createDataFrame([("1", "x", None), ("3", "z", None), ("4", "w", "q")], "key string, t string, u string")
    fields = {"content": F.col("t"), "status": F.col("u")}
    assert versions.diff_sections(a, a, fields).count() == 0
    got = {r.key: (r.change, r.changes) for r in versions.diff_sections(a, b, fields).collect()}
    assert got == {"2": ("removed", []), "3": ("changed", ["status"]), "4": ("added", [])}
    out = versions.apply_patch(a, *versions.derive_patch(a, b, ["key"]), ["key"])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_token_diff_rebuilds_both_texts():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (" ".join(rng.choices(["tax", "it's", "§", "a-b", "x."], k=rng.randrange(0, 12))) for _ in range(2))
        d = diff_texts(a, b)
        assert "".join(x["text"] for x in d if x["type"] != "insert") == a and "".join(x["text"] for x in d if x["type"] != "delete") == b
    assert diff_texts("a b", "a c") == [{"type": "equal", "text": "a "}, {"type": "delete", "text": "b"}, {"type": "insert", "text": "c"}]
    assert [x["type"] for x in diff_texts("a b c d", "e f g h", 2)] == ["delete", "insert"]
    assert diff_texts(None, None) == []


def test_text_functions(spark):
    r = spark.range(1).select(
        tx.expand_range(F.lit("20-341s"), F.lit("20-341bb")).alias("letters"), tx.expand_range(F.lit("1-2"), F.lit("1-5")).alias("numbers"), tx.expand_range(F.lit("1-2"), F.lit("2-5")).alias("neither"),
        tx.clean_citation(F.lit("14-100a(d1B*"), F.lit("14-100a")).alias("cited"), tx.to_cents(F.lit("117.005")).alias("cents"), tx.money(F.lit(123456)).alias("money"),
        tx.natural_key(F.lit("10-2")).alias("n10"), tx.natural_key(F.lit("2-9")).alias("n2"), tx.slug(F.lit(" Über §1 ")).alias("slug"), tx.iso_timestamp(F.lit("0")).alias("iso"), tx.iso_timestamp(F.lit("x")).alias("bad"),
        tx.parse_route(F.lit("#/t/1/c/2%20a/s/x")).alias("route"), tx.leading_subsection(F.lit(" (a) Text")).alias("sub"), tx.percent(F.lit(1), F.lit(0)).alias("inf"),
        tx.topic_letter(F.lit("§")).alias("t"), tx.shard_letter(F.lit("§")).alias("s"), tx.query_letter(F.lit("1")).alias("q"), tx.normalize_text(F.lit("Ça § ﬁx—a-b")).alias("norm"), tx.token_string(F.lit("-a b--c- d-e")).alias("tok"),
    ).first()
    assert len(r.letters) == 10 and r.letters[-1] == "20-341bb" and r.numbers == ["1-2", "1-3", "1-4", "1-5"] and r.neither == ["1-2", "2-5"]
    assert (r.cited, r.cents, r.money, r.slug, r.iso, r.bad) == ("14-100a(d)(1)(B)", 11701, "$1,234.56", "uber-1", "1970-01-01T00:00:00Z", None)
    assert r.n2 < r.n10 and (r.route.kind, r.route.chapter, r.route.section) == ("section", "2 a", "x") and (r.sub.key, r.sub.rest, r.inf) == ("a", "Text", float("inf"))
    assert (r.t, r.s, r.q, r.norm, r.tok) == ("a", "other", None, "ca fix a-b", " a b c d-e ")


def test_routes(spark):
    cases = {
        "": ("home", None, None), "#/": ("home", None, None), "#/t/1": ("title", "1", None), "#/t/1/c/2": ("chapter", "1", "2"), "#/t/1/c/2/s/3/p/a": ("section", "1", "2"), "#/t/1/c": ("not-found", None, None),
        "#/t": ("not-found", None, None), "#/search?q=a+b&title=9": ("search", "9", None), "#/search/x": ("not-found", None, None), "#/index/Q": ("index", None, None), "#/index/qq": ("not-found", None, None),
        "#/infractions/a/entry": ("not-found", None, None), "#/a": ("about", None, None), "?chapter=5": ("chapter", None, "5"), "?chapter=5&section=6#/": ("section", None, "5"), "#/nowhere": ("not-found", None, None),
    }
    d = spark.createDataFrame([(x,) for x in cases], "h string").select("h", tx.parse_route(F.col("h")).alias("r"))
    rows = {r.h: r.r for r in d.collect()}
    assert {h: (r.kind, r.title, r.chapter) for h, r in rows.items()} == cases
    assert rows["#/t/1/c/2/s/3/p/a"].subsection == "a" and rows["#/index/Q"].letter == "q"
    assert (rows["#/search?q=a+b&title=9"].query, rows["#/search?q=a+b&title=9"].sort, rows["#/search?q=a+b&title=9"].within) == ("a b", "relevance", None)
    none = F.lit(None).cast("string")
    r = spark.range(1).select(tx.section_href(none, F.lit("1"), F.lit("2")).alias("a"), tx.section_href(F.lit("1"), none, F.lit("2")).alias("b"), tx.infractions_href(none, none, F.lit("x y")).alias("c"), tx.index_href(none, none, none, F.lit("A"), F.lit("B")).alias("d")).first()
    assert tuple(r) == ("#/", "#/t/1", "#/infractions?q=x%20y", "#/index?heading=A&subheading=B")


def test_links_and_shards(spark):
    items = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 5, 5, 30, 1, 1])] + [("b", 0, 99)], "k string, o int, n int")
    got = sorted(map(tuple, links.pack_shards(items, "k", "o", F.col("n"), 10).collect()))
    assert [s for *_, s in got] == [0, 0, 1, 2, 3, 3, 0]
    r = links.resolve(spark.createDataFrame([("1-1", "1-1*"), ("1-1", "1-1(a)"), ("9-9", "9-9"), (None, "x")], "section_key string, display string"), spark.createDataFrame([("1-1", "p")], "key string, id string"))
    assert [x.status for x in r.collect()] == ["exact", "section-only", "unresolved", "not-applicable"]


def test_index_and_state(spark):
    e = spark.createDataFrame([(1, 0, "1-0", 1, "Sub tax"), (1, 1, "1-1", 0, "Taxes"), (1, 2, "1-2", 1, "tax")], "topic_id int, ordinal int, entry_id string, level int, text string")
    assert [r.grp for r in index.entry_groups(e).orderBy("ordinal").collect()] == [1, 2, 2]
    assert index.subheading_match(e, "Tax").first().ordinal == 1 and index.subheading_match(e, " ").count() == 0
    t = spark.createDataFrame([(1, "Tax", 0)], "topic_id int, label string, position int")
    assert [(r.entry_id, r.score, r.total) for r in index.topic_search(t, e, "tax").collect()] == [("", 0, 4), ("1-1", 2, 4), ("1-2", 2, 4), ("1-0", 3, 4)]
    log = spark.createDataFrame([("u", f"k{i % 22}", i) for i in range(44)], "u string, k string, at int")
    recent = state.latest_per_key(log, "u", "k", [F.col("at")]).orderBy("rank").collect()
    assert len(recent) == 20 and (recent[0].k, recent[0].at) == ("k21", 43)
    assert state.bookmarks(spark.createDataFrame([("u", "a", 1), ("u", "a", 2), ("u", "b", 3)], "u string, k string, at int"), "u", "k", "at").collect()[0].k == "b"


def test_validation(spark):
    d = spark.createDataFrame([("x", ["a", "a"], "2020-13-01")], "s string, a array<string>, t string")
    errors = d.select(validate.schema_errors({"s": {"enum": ["y"], "minLength": 2}, "a": {"uniqueItems": True, "minItems": 3}, "t": {"format": "date-time"}}).alias("e")).first().e
    assert len(errors) == 5
    assert spark.range(1).select(validate.unexpected_properties(F.lit('{"a":1,"b":2}'), ["a"]).alias("u")).first().u == ["b"]


def test_folds(spark):
    w = spark.createDataFrame([(1, "b", 50.0, 10.5), (1, "a", 20.0, 10.0), (1, "late", 20.0, 12.4), (1, "right", 300.0, 10.0)], "page int, text string, x0 double, top double")
    assert [r.text for r in folds.visual_lines(w).orderBy("line").collect()] == ["a b right", "late"]
    assert [(r.col, r.text) for r in folds.column_lines(w, 2.0).orderBy("col", "line").collect()] == [(0, "a b"), (0, "late"), (1, "right")]
    assert [(r.col, r.text) for r in folds.column_lines(w).orderBy("col", "line").collect()] == [(0, "a late b"), (1, "right")]
    levels = spark.createDataFrame([(1, "x", 123.0, 1.0), (1, "y", 141.5, 9.0), (1, "z", 330.0, 1.0)], "page int, text string, x0 double, top double")
    assert [(r.text, r.level) for r in folds.column_lines(levels).orderBy("col", "line").collect()] == [("x", 0), ("y", 2), ("z", 2)]
