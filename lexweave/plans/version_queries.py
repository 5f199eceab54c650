"""Diff, overlay, patch and policy queries.

Before and after are two cuts of the documents: ``doc_id % 5`` chooses membership, every
eleventh text is upper-cased, every thirteenth moves chapter. The cuts are what is compared,
so they are part of the queries' meaning, not a reduction of their input.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import versions as v
from lexweave.sources.tables import SECTIONS_SQL, natural_sql, sections

QUERIES, ORACLE = {}, {}

_SNAP_SQL = f"""WITH {SECTIONS_SQL}, b AS (
  SELECT lower(citation) AS key, chapter_id AS location, heading, status, text AS content, title_number, upper(title_number) AS title_name, chapter_number FROM sections WHERE doc_id % 5 <> 0
), a AS (
  SELECT lower(citation) AS key, CASE WHEN doc_id % 13 = 0 THEN 'moved' ELSE chapter_id END AS location, heading,
         CASE WHEN doc_id % 17 = 0 THEN 'reserved' ELSE status END AS status, CASE WHEN doc_id % 11 = 0 THEN upper(text) ELSE text END AS content, title_number,
         CASE WHEN title_number = 'fr' THEN 'French' ELSE upper(title_number) END AS title_name, chapter_number
  FROM sections WHERE doc_id % 5 <> 1
), diff AS (
  SELECT coalesce(b.key, a.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'changed' END AS change,
    list_filter([CASE WHEN b.location IS DISTINCT FROM a.location THEN 'location' END, CASE WHEN b.heading IS DISTINCT FROM a.heading THEN 'heading' END,
     CASE WHEN b.status IS DISTINCT FROM a.status THEN 'status' END, CASE WHEN b.content IS DISTINCT FROM a.content THEN 'content' END], lambda x: x IS NOT NULL) AS changes,
    b.status AS status_before, a.status AS status_after
  FROM b FULL JOIN a ON b.key = a.key
  WHERE b.key IS NULL OR a.key IS NULL OR b.location <> a.location OR b.heading <> a.heading OR b.status <> a.status OR b.content <> a.content
)"""


def snapshots(spark, d):
    s = sections(spark, d).withColumn("key", v.section_key(F.col("citation"), F.col("citations"), F.col("id"))).withColumn("title_name", F.upper("title_number"))
    before = s.where("doc_id % 5 <> 0")
    after = s.where("doc_id % 5 <> 1").withColumns({
        "text": F.when(F.col("doc_id") % 11 == 0, F.upper("text")).otherwise(F.col("text")),
        "chapter_id": F.when(F.col("doc_id") % 13 == 0, "moved").otherwise(F.col("chapter_id")),
        "status": F.when(F.col("doc_id") % 17 == 0, "reserved").otherwise(F.col("status")),
        "title_name": F.when(F.col("title_number") == "fr", "French").otherwise(F.col("title_name")),
    })
    return before, after


def diff(spark, d):
    before, after = snapshots(spark, d)
    return v.diff_sections(before, after, {"location": F.col("chapter_id"), "heading": F.col("heading"), "status": F.col("status"), "content": F.col("text")})


def _register(name, sql, depends=None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


@_register("diff_sections", f"{_SNAP_SQL} SELECT key, change, CASE WHEN change = 'changed' THEN array_to_string(changes, ',') ELSE '' END AS changes FROM diff")
def diff_sections(spark, d):
    return diff(spark, d).select("key", "change", F.array_join("changes", ",").alias("changes"))


@_register("diff_added", f"{_SNAP_SQL} SELECT key FROM diff WHERE change = 'added'")
def diff_added(spark, d):
    return diff(spark, d).where("change = 'added'").select("key")


@_register("diff_removed", f"{_SNAP_SQL} SELECT key FROM diff WHERE change = 'removed'")
def diff_removed(spark, d):
    return diff(spark, d).where("change = 'removed'").select("key")


@_register("diff_status", f"{_SNAP_SQL} SELECT status_before, status_after, count(*) AS n FROM diff WHERE change = 'changed' AND list_contains(changes, 'status') GROUP BY ALL")
def diff_status(spark, d):
    return v.status_transitions(diff(spark, d))


@_register("diff_moves", f"{_SNAP_SQL} SELECT key FROM diff WHERE change = 'changed' AND list_contains(changes, 'location')")
def diff_moves(spark, d):
    return diff(spark, d).where((F.col("change") == "changed") & F.array_contains("changes", "location")).select("key")


_SUMMARY = """SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed,
 count(*) FILTER (WHERE change = 'changed' AND list_contains(changes, 'location')) AS moved, count(*) FILTER (WHERE change = 'changed' AND list_contains(changes, 'status')) AS status_transitions,
 count(*) FILTER (WHERE change = 'changed' AND list_contains(changes, 'content')) AS content_changed FROM diff"""


@_register("diff_summary", f"{_SNAP_SQL} {_SUMMARY}")
def diff_summary(spark, d):
    return v.diff_summary(diff(spark, d))


@_register("diff_secondary", """WITH b AS (SELECT p_partkey AS id, p_name AS c, p_size AS r FROM part WHERE p_partkey % 7 <> 0), a AS (SELECT p_partkey AS id,
 CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) ELSE p_name END AS c, CASE WHEN p_partkey % 9 = 0 THEN -1 ELSE p_size END AS r FROM part WHERE p_partkey % 8 <> 0), x AS (
 SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN b.c IS DISTINCT FROM a.c THEN 'changed' WHEN b.r IS DISTINCT FROM a.r THEN 'resolution' END AS change
 FROM b FULL JOIN a ON b.id = a.id)
 SELECT id, change, row_number() OVER (PARTITION BY change ORDER BY id) <= 50 AS sample FROM x WHERE change IS NOT NULL""")
def diff_secondary(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    before = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), F.col("p_size").alias("resolution"))
    after = p.where("p_partkey % 8 <> 0").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("content"),
        F.when(F.col("p_partkey") % 9 == 0, -1).otherwise(F.col("p_size")).alias("resolution"))
    return v.hash_diff(before, after)


def report(spark, d):
    """One row of counts before and after for titles, chapters and provisions."""
    return v.corpus_report(*snapshots(spark, d), diff(spark, d))


_META_SQL = """tmeta AS (SELECT coalesce(x.title_number, y.title_number) AS title_number, CASE WHEN x.title_number IS NULL THEN 'added' WHEN y.title_number IS NULL THEN 'removed' WHEN x.n <> y.n THEN 'changed' END AS change, 'title_name' AS changes
 FROM (SELECT title_number, min(title_name) AS n FROM b GROUP BY 1) x FULL JOIN (SELECT title_number, min(title_name) AS n FROM a GROUP BY 1) y ON x.title_number = y.title_number
), cmeta AS (SELECT coalesce(x.title_number, y.title_number) AS title_number, coalesce(x.location, y.location) AS chapter_id, CASE WHEN x.location IS NULL THEN 'added' WHEN y.location IS NULL THEN 'removed' WHEN x.n <> y.n OR x.c <> y.c THEN 'changed' END AS change,
 concat_ws(',', CASE WHEN x.n <> y.n THEN 'chapter_number' END, CASE WHEN x.c <> y.c THEN 'sections' END) AS changes
 FROM (SELECT title_number, location, min(chapter_number) AS n, count(*) AS c FROM b GROUP BY 1, 2) x FULL JOIN (SELECT title_number, location, min(chapter_number) AS n, count(*) AS c FROM a GROUP BY 1, 2) y ON x.title_number = y.title_number AND x.location = y.location)"""


@_register("diff_titles", f"{_SNAP_SQL}, {_META_SQL} SELECT title_number, change, CASE WHEN change = 'changed' THEN changes ELSE '' END AS changes FROM tmeta WHERE change IS NOT NULL")
def diff_titles(spark, d):
    b, a = (v.metadata(x, ["title_number"], {"title_name": F.min("title_name")}) for x in snapshots(spark, d))
    return v.diff_metadata(b, a, ["title_number"], ["title_name"]).withColumn("changes", F.array_join("changes", ","))


@_register("diff_chapters", f"{_SNAP_SQL}, {_META_SQL} SELECT title_number, chapter_id, change, changes FROM cmeta WHERE change IS NOT NULL")
def diff_chapters(spark, d):
    keys, fields = ["title_number", "chapter_id"], {"chapter_number": F.min("chapter_number"), "sections": F.count("*")}
    b, a = (v.metadata(x, keys, fields) for x in snapshots(spark, d))
    return v.diff_metadata(b, a, keys, list(fields)).withColumn("changes", F.array_join("changes", ","))


_REPORT_SQL = f"""{_SNAP_SQL}, {_META_SQL}, r AS (SELECT
 (SELECT count(*) FROM tmeta WHERE change = 'changed') AS tch, (SELECT count(*) FROM cmeta WHERE change = 'changed') AS cch,
 (SELECT count(DISTINCT title_number) FROM b) AS tb, (SELECT count(DISTINCT title_number) FROM a) AS ta,
 (SELECT count(*) FROM (SELECT DISTINCT title_number, location FROM b)) AS cb, (SELECT count(*) FROM (SELECT DISTINCT title_number, location FROM a)) AS ca,
 (SELECT count(*) FROM b) AS pb, (SELECT count(*) FROM a) AS pa,
 (SELECT count(*) FROM (SELECT DISTINCT title_number, location FROM a EXCEPT SELECT DISTINCT title_number, location FROM b)) AS cadd,
 (SELECT count(*) FROM (SELECT DISTINCT title_number, location FROM b EXCEPT SELECT DISTINCT title_number, location FROM a)) AS crem,
 (SELECT count(*) FROM (SELECT DISTINCT title_number FROM a EXCEPT SELECT DISTINCT title_number FROM b)) + (SELECT count(*) FROM (SELECT DISTINCT title_number FROM b EXCEPT SELECT DISTINCT title_number FROM a)) AS tm,
 (SELECT count(*) FROM diff WHERE change = 'added') AS padd, (SELECT count(*) FROM diff WHERE change = 'removed') AS prem, (SELECT count(*) FROM diff WHERE change = 'changed') AS pch
), c AS (SELECT unnest([{{'name': 'Title count delta', 'actual': abs(ta - tb)::DOUBLE, 'limit': 0.0}}, {{'name': 'Title additions and removals', 'actual': tm::DOUBLE, 'limit': 0.0}},
 {{'name': 'Title metadata changes', 'actual': tch::DOUBLE, 'limit': 10.0}}, {{'name': 'Chapter count delta', 'actual': abs(ca - cb) * 100.0 / cb, 'limit': 5.0}},
 {{'name': 'Chapter additions and removals', 'actual': (cadd + crem) * 100.0 / cb, 'limit': 5.0}}, {{'name': 'Chapter metadata changes', 'actual': cch * 100.0 / cb, 'limit': 10.0}},
 {{'name': 'Provision count delta', 'actual': abs(pa - pb) * 100.0 / pb, 'limit': 5.0}}, {{'name': 'Added provisions', 'actual': padd * 100.0 / pb, 'limit': 5.0}},
 {{'name': 'Removed provisions', 'actual': prem * 100.0 / pb, 'limit': 2.0}}, {{'name': 'Changed provisions', 'actual': pch * 100.0 / pb, 'limit': 35.0}}]) AS x FROM r)"""


@_register("policy_corpus", f"{_REPORT_SQL} SELECT x.name AS name, CAST(x.actual AS DOUBLE) AS actual, CAST(x.\"limit\" AS DOUBLE) AS \"limit\", x.actual <= x.\"limit\" AS passed FROM c")
def policy_corpus(spark, d):
    return v.corpus_checks(report(spark, d))


@_register("policy_gate", f"{_REPORT_SQL} SELECT bool_and(x.actual <= x.\"limit\") AS passed, count(*) FILTER (WHERE x.actual > x.\"limit\") AS failed FROM c")
def policy_gate(spark, d):
    return v.gate(v.corpus_checks(report(spark, d)))


_SEC = "infractions", "feeRules", "indexHeadings", "indexItems", "indexEntries"


@_register("policy_secondary", """WITH p AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 7 = 0) AS gone FROM part), c AS (SELECT count(*) AS n, count(DISTINCT conv_id) AS h FROM conversations), o AS (SELECT count(*) AS n FROM region)
SELECT name, CAST(actual AS DOUBLE) AS actual, CAST("limit" AS DOUBLE) AS "limit", CASE WHEN mx THEN actual <= "limit" ELSE actual >= "limit" END AS passed FROM (
 SELECT unnest([{'name':'infractions count','actual':p.n::DOUBLE,'limit':1300.0,'mx':false},{'name':'feeRules count','actual':o.n::DOUBLE,'limit':8.0,'mx':false},{'name':'indexHeadings count','actual':c.h::DOUBLE,'limit':4000.0,'mx':false},
 {'name':'indexItems count','actual':c.n::DOUBLE,'limit':150000.0,'mx':false},{'name':'infractions removals','actual':p.gone*100.0/p.n,'limit':5.0,'mx':true},{'name':'feeRules removals','actual':0.0,'limit':0.0,'mx':true},
 {'name':'indexHeadings removals','actual':0.0,'limit':5.0,'mx':true},{'name':'indexEntries removals','actual':0.0,'limit':5.0,'mx':true},{'name':'infractions resolution','actual':(p.n-p.gone)*100.0/p.n,'limit':90.0,'mx':false},
 {'name':'feeRuleReferences resolution','actual':100.0,'limit':85.0,'mx':false},{'name':'indexReferences resolution','actual':100.0,'limit':95.0,'mx':false}], recursive := true) FROM p, c, o) t""")
def policy_secondary(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").agg(F.count("*").alias("infractions_after"), F.count_if(F.col("p_partkey") % 7 == 0).alias("infractions_removed"))
    c = spark.read.parquet(f"{d}/conversations.parquet").agg(F.count("*").alias("indexItems_after"), F.countDistinct("conv_id").alias("indexHeadings_after"))
    o = spark.read.parquet(f"{d}/region.parquet").agg(F.count("*").alias("feeRules_after"))
    r = p.crossJoin(c).crossJoin(o)  # one row each
    return v.secondary_checks(r.withColumns({
        "infractions_before": F.col("infractions_after"), "infractions_resolved": F.col("infractions_after") - F.col("infractions_removed"), "infractions_total": F.col("infractions_after"),
        "feeRules_before": F.col("feeRules_after"), "feeRules_removed": F.lit(0), "indexHeadings_before": F.col("indexHeadings_after"), "indexHeadings_removed": F.lit(0),
        "indexEntries_before": F.col("indexItems_after"), "indexEntries_removed": F.lit(0), "feeRuleReferences_resolved": F.col("feeRules_after"), "feeRuleReferences_total": F.col("feeRules_after"),
        "indexReferences_resolved": F.col("indexItems_after"), "indexReferences_total": F.col("indexItems_after"),
    }))


# Overlay: base sections are consecutive documents of a source, every ninth group of four is a
# reserved placeholder; the overlay rewrites every seventh document and adds new ones.
def overlay_tables(spark, d):
    s = sections(spark, d).withColumn("body", F.array("text")).withColumn("kind", F.lit("section"))
    n = F.col("doc_id")
    place = (n % 36) >= 32
    single = s.where(~place).select("chapter_id", "id", "kind", "citations", "status", "body")
    grouped = s.where(place).groupBy("chapter_id", F.floor(n / 720).alias("g")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "citation"))).alias("x"))
    grouped = grouped.select(
        "chapter_id", F.concat(F.lit("group-"), F.col("chapter_id"), F.lit("-"), F.col("g")).alias("id"), F.lit("group").alias("kind"), F.transform("x", lambda y: y["citation"]).alias("citations"),
        F.lit("reserved").alias("status"), F.array(F.lit("Reserved for future use."), F.lit("Note: none.")).alias("body"))
    base = single.unionByName(grouped)
    over = s.where(n % 7 == 0).select("chapter_id", F.concat(F.lit("o"), F.col("id")).alias("id"), "kind", "citations", "status", F.array(F.upper("text")).alias("body"))
    new = s.where(n % 50 == 0).select("chapter_id", F.concat(F.lit("n"), F.col("id")).alias("id"), "kind", F.array(F.concat("citation", F.lit("a"))).alias("citations"), F.lit("active").alias("status"), F.array("text").alias("body"))
    return base, over.unionByName(new)


_OVER_SQL = f"""WITH {SECTIONS_SQL}, singles AS (SELECT chapter_id, id, [citation] AS citations, status, doc_id FROM sections WHERE doc_id % 36 < 32), g AS (
 SELECT chapter_id, 'group-' || chapter_id || '-' || CAST(doc_id // 720 AS VARCHAR) AS id, list(citation ORDER BY doc_id) AS citations, 'reserved' AS status FROM sections WHERE doc_id % 36 >= 32 GROUP BY chapter_id, doc_id // 720
), base AS (SELECT chapter_id, id, citations, status, false AS grouped FROM singles UNION ALL SELECT chapter_id, id, citations, status, true FROM g
), o AS (SELECT chapter_id, 'o' || id AS id, citation AS c, status FROM sections WHERE doc_id % 7 = 0 UNION ALL SELECT chapter_id, 'n' || id, citation || 'a', 'active' FROM sections WHERE doc_id % 50 = 0
), bx AS (SELECT chapter_id, id AS base_id, citations, status, grouped, unnest(citations) AS c FROM base
), m AS (SELECT o.chapter_id, o.id AS overlay_id, o.status AS o_status, bx.base_id, bx.citations, bx.status AS b_status, bx.grouped FROM o LEFT JOIN bx ON o.chapter_id = bx.chapter_id AND o.c = bx.c)"""


@_register("overlay_classify", f"""{_OVER_SQL} SELECT chapter_id, overlay_id, CASE WHEN base_id IS NULL THEN 'addition' WHEN len(citations) = 1 OR grouped THEN 'single' ELSE 'error' END AS mode,
 CASE WHEN base_id IS NULL THEN 'addition' WHEN len(citations) = 1 OR grouped THEN 'replacement' END AS kind,
 CASE WHEN base_id IS NOT NULL AND NOT (len(citations) = 1 OR grouped) THEN NULL WHEN o_status = 'repealed' THEN 'repealed' WHEN base_id IS NULL OR b_status = 'reserved' THEN 'new' ELSE 'amended' END AS presentation, base_id AS primary_id FROM m""")
def overlay_classify(spark, d):
    return v.classify_overlay(*overlay_tables(spark, d)).select("chapter_id", "overlay_id", "mode", "kind", "presentation", "primary_id")


@_register("overlay_counts", f"""{_OVER_SQL} SELECT chapter_id, count(*) FILTER (WHERE base_id IS NOT NULL) AS replacements, count(*) FILTER (WHERE base_id IS NULL) AS additions FROM m GROUP BY ROLLUP (chapter_id)""")
def overlay_counts(spark, d):
    c = v.classify_overlay(*overlay_tables(spark, d))
    return c.rollup("chapter_id").agg(F.count_if(F.col("mode") != "addition").alias("replacements"), F.count_if(F.col("mode") == "addition").alias("additions"))


_APPLY_SQL = f"""{_OVER_SQL}, rest AS (SELECT b.chapter_id, b.id, b.citations, list_filter(b.citations, lambda x: NOT list_contains(coalesce(t.taken, []), x)) AS remaining
 FROM base b LEFT JOIN (SELECT chapter_id, list(DISTINCT c) AS taken FROM o GROUP BY chapter_id) t ON b.chapter_id = t.chapter_id
), applied AS (SELECT chapter_id, id, array_to_string(citations, ',') AS citations, 'base' AS origin, citations[1] AS k FROM rest WHERE len(remaining) = len(citations)
 UNION ALL SELECT chapter_id, id, c, 'overlay', c FROM o
 UNION ALL SELECT chapter_id, CASE WHEN len(remaining) = 1 THEN 'section-' ELSE 'group-' END || array_to_string(remaining, '-'), array_to_string(remaining, ','), 'residual', remaining[1] FROM rest WHERE len(remaining) > 0 AND len(remaining) < len(citations))"""


@_register("overlay_apply", f"{_APPLY_SQL} SELECT chapter_id, id, citations, origin, {natural_sql('k')} AS sort_key FROM applied")
def overlay_apply(spark, d):
    return v.apply_overlay(*overlay_tables(spark, d)).select("chapter_id", "id", F.array_join("citations", ",").alias("citations"), "origin", "sort_key")


@_register("overlay_residual", f"{_APPLY_SQL} SELECT chapter_id, id, citations FROM applied WHERE origin = 'residual'")
def overlay_residual(spark, d):
    return v.apply_overlay(*overlay_tables(spark, d)).where("origin = 'residual'").select("chapter_id", "id", F.array_join("citations", ",").alias("citations"))


@_register("overlay_aggregate", """SELECT 'g' || CAST(o_custkey AS VARCHAR) AS overlay_id, 'aggregate' AS mode, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1
 UNION ALL SELECT 'g' || CAST(o_custkey AS VARCHAR), 'single', CAST(1 AS BIGINT) FROM orders GROUP BY o_custkey HAVING count(*) = 1""")
def overlay_aggregate(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    c = F.col("o_orderkey").cast("string")
    common = [F.lit("section").alias("kind"), F.lit("active").alias("status"), F.array(F.lit("x")).alias("body")]
    base = o.select(F.lit("c").alias("chapter_id"), c.alias("id"), F.array(c).alias("citations"), *common)
    over = o.groupBy("o_custkey").agg(F.collect_list(c).alias("citations")).select(F.lit("c").alias("chapter_id"), F.concat(F.lit("g"), F.col("o_custkey")).alias("id"), "citations", *common)
    r = v.classify_overlay(base, over)
    return r.select("overlay_id", "mode", F.size("base_ids").cast("long").alias("n"))


def patch_tables(spark, d):
    s = sections(spark, d).select("title_number", "id", "heading", "text", "status", "doc_id")
    current = s.where("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" (amended)"))).otherwise(F.col("text")))
    return s, current


_PATCH_SQL = f"""WITH {SECTIONS_SQL}, cur AS (SELECT id, title_number, CASE WHEN doc_id % 7 = 0 THEN text || ' (amended)' ELSE text END AS text FROM sections WHERE doc_id % 9 <> 0), ops AS (
 SELECT s.title_number, s.id, 'remove' AS op FROM sections s LEFT JOIN cur c ON s.id = c.id WHERE c.id IS NULL OR c.text <> s.text
 UNION ALL SELECT c.title_number, c.id, 'add' FROM cur c JOIN sections s ON s.id = c.id WHERE c.text <> s.text)"""


@_register("patch_derive", f"{_PATCH_SQL} SELECT * FROM ops")
def patch_derive(spark, d):
    removed, added = v.derive_patch(*patch_tables(spark, d), ["title_number", "id"])
    return removed.withColumn("op", F.lit("remove")).unionByName(added.select("title_number", "id", F.lit("add").alias("op")))


@_register("patch_apply", f"{_PATCH_SQL} SELECT title_number, id, md5(text) AS text_md5 FROM cur")
def patch_apply(spark, d):
    base, current = patch_tables(spark, d)
    out = v.apply_patch(base, *v.derive_patch(base, current, ["title_number", "id"]), ["title_number", "id"])
    return out.select("title_number", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@_register("patch_verify", f"""{_PATCH_SQL} SELECT count(*) FILTER (WHERE s.doc_id % 50 = 0) AS missing, CAST(0 AS BIGINT) AS unexpected FROM cur c JOIN sections s ON s.id = c.id WHERE c.text <> s.text""")
def patch_verify(spark, d):
    """A patch that lost the documents of every fiftieth id, held against the current edition."""
    base, current = patch_tables(spark, d)
    removed, added = v.derive_patch(base, current, ["title_number", "id"])
    out = v.apply_patch(base, removed, added.where("doc_id % 50 <> 0"), ["title_number", "id"])
    a, b = current.select(*base.columns), out.select(*base.columns)
    return a.exceptAll(b).agg(F.count("*").alias("missing")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("unexpected")))  # one row each


@_register("overlay_changes", f"""{_OVER_SQL} SELECT chapter_id, overlay_id, CASE WHEN base_id IS NULL THEN 'addition' ELSE 'replacement' END AS kind,
 CASE WHEN o_status = 'repealed' THEN 'repealed' WHEN base_id IS NULL OR b_status = 'reserved' THEN 'new' ELSE 'amended' END AS presentation, coalesce(base_id, '') AS previous, coalesce(array_to_string(citations, ','), '') AS citations FROM m WHERE base_id IS NULL OR len(citations) = 1 OR grouped""")
def overlay_changes(spark, d):
    c = v.overlay_changes(*overlay_tables(spark, d))
    ids = F.array_join(F.transform("previous", lambda x: x["id"]), "|")
    return c.select("chapter_id", "overlay_id", "kind", "presentation", ids.alias("previous"), F.array_join(F.flatten(F.transform("previous", lambda x: x["citations"])), ",").alias("citations"))


@_register("merge_new_chapters", """SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey AS VARCHAR) AS number FROM nation
 UNION ALL SELECT 'r' || CAST(n_nationkey + 20 AS VARCHAR), CAST(n_nationkey + 20 AS VARCHAR) FROM nation WHERE n_nationkey + 20 > 24""")
def merge_new_chapters(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    base = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").cast("string").alias("number"))
    extra = n.select(F.concat(F.lit("r"), F.col("n_nationkey") + 20).alias("id"), (F.col("n_nationkey") + 20).cast("string").alias("number"))
    return v.merge_new_chapters(base, extra)
