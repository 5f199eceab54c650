"""Reader text, catalogs, contents pages, editions and shard names over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import folds, links, reports, search, validate, versions
from lexweave.sources import artifacts, crawl
from lexweave.sources.tables import SECTIONS_SQL, sections, table

QUERIES, ORACLE = {}, {}


def q(sql: str):
    def wrap(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return wrap


# reader -----------------------------------------------------------------------------------
@q("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 3 = 1 THEN '(A' ELSE '(b' END || p_size || ')' END AS label,
  CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 3 = 1 THEN 'a' ELSE 'b' END || p_size END AS key, p_name AS rest FROM part""")
def leading_subsections(spark, d):
    number, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    given = F.concat(F.when(k == 1, " (A").otherwise("(b"), number, F.lit(")  "), "p_name")
    return table(spark, d, "part").select("p_partkey", tx.leading_subsection(F.when(k > 0, given).otherwise(F.col("p_name"))).alias("x")).select("p_partkey", "x.*")


@q("""SELECT p_partkey, 'See Section ' || CASE WHEN p_partkey % 2 = 0 THEN '<a class="legal-reference" href="#/s?a&amp;b=' || p_partkey || '">1-' || p_partkey || 'A</a>' ELSE '1-' || p_partkey || 'A' END
  || ' &amp; &lt;chapters <a class="legal-reference" href="#/c">12a</a>&gt;, sections 9-9.' AS html FROM part""")
def linked_text(spark, d):
    key = F.concat(F.lit("1-"), F.col("p_partkey").cast("string"))
    known = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.concat(key, F.lit("a")), F.concat(F.lit("#/s?a&b="), F.col("p_partkey").cast("string"))))
    text = F.concat(F.lit("See Section  "), key, F.lit("A & <chapters 12a>, sections 9-9."))
    return table(spark, d, "part").select("p_partkey", tx.linked_text(text, known, F.create_map(F.lit("12a"), F.lit("#/c"))).alias("html"))


@q(f"WITH {SECTIONS_SQL} SELECT id, status FROM sections WHERE status IS DISTINCT FROM 'repealed' OR id = (SELECT CAST(min(doc_id) AS VARCHAR) FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents))")
def navigation_sections(spark, d):
    s = sections(spark, d).select("doc_id", "id", "status")
    selected = s.where("status = 'repealed'").agg(F.min("doc_id")).first()[0]
    return search.visible(s, True, str(selected)).select("id", "status")


@q("SELECT page_id, trim(regexp_replace(' a' || chr(10) || ' ' || url || chr(9), '\\s+', ' ', 'g')) AS label, string_split(url, '#')[1] AS url FROM pages")
def clean_links(spark, d):
    label = F.concat(F.lit(" a\n "), "url", F.lit("\t"))
    return table(spark, d, "pages").select("page_id", tx.collapse_space(label).alias("label"), tx.normalize_url(F.concat("url", F.lit("#top"))).alias("url"))


# catalogs and contents pages --------------------------------------------------------------
@q("SELECT CAST(n_regionkey AS VARCHAR) AS title_id, n_name AS chapter_id, 'chapters/' || n_nationkey || '.json' AS path, n_nationkey AS position FROM nation WHERE n_regionkey IN (1, 2)")
def catalog_chapters(spark, d):
    """Chapters of two titles by their catalog entries."""
    n = table(spark, d, "nation")
    name = F.concat(F.col("n_nationkey").cast("string"), F.lit(".json"))
    catalog = n.select(F.col("n_regionkey").cast("string").alias("title_id"), F.col("n_name").alias("chapter_id"), F.concat(F.lit("chapters/"), name).alias("path"))
    return artifacts.dereference(catalog, n.select(name.alias("file"), F.col("n_nationkey").alias("position")), ["1", "2"]).drop("file")


@q("""SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || CASE WHEN n_nationkey % 2 = 1 THEN 'a' ELSE '' END AS title,
  lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || CASE WHEN n_nationkey % 2 = 1 THEN 'a' ELSE '' END AS of_section FROM nation""")
def title_keys(spark, d):
    key = F.concat(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 1, "a").otherwise(""))
    return table(spark, d, "nation").select("n_nationkey", crawl.title_key(F.upper(key)).alias("title"), crawl.key_title(F.concat(key, F.lit("-12b"))).alias("of_section"))


@q("""WITH c AS (SELECT p_brand, p_name, p_partkey AS n, ['', 'a', 'bb'][p_partkey % 3 + 1] AS s FROM part)
SELECT 'https://law.example/' || p_brand AS page_url, n || s AS key, 'Chapter ' || n AS label, p_name AS name, 'https://law.example/chap_' || n || s || '.htm' AS url,
  row_number() OVER (PARTITION BY p_brand ORDER BY n, length(s), s) AS nth FROM c""")
def contents_order(spark, d):
    """Chapters of contents pages from two links each, in the order of a crawl."""
    n = F.col("p_partkey")
    key = F.concat(n.cast("string"), F.when(n % 3 == 0, "").when(n % 3 == 1, "a").otherwise("bb"))
    page = F.concat(F.lit("https://law.example/"), "p_brand").alias("page_url")
    href = F.concat(F.lit("https://law.example/chap_"), key, F.lit(".htm")).alias("href")
    p = table(spark, d, "part")
    both = p.select(page, href, (2 * n).alias("ordinal"), F.concat(F.lit("Chapter "), n.cast("string")).alias("text")).unionByName(p.select(page, href, (2 * n + 1).alias("ordinal"), F.col("p_name").alias("text")))
    nth = F.row_number().over(Window.partitionBy("page_url").orderBy(*crawl.crawl_order(F.col("key"))))
    return crawl.contents(both, "chapter").withColumn("nth", nth.cast("bigint"))


@q("""SELECT 'former-0' || n_nationkey || 'a' AS key, 'Former Chapter ' || ltrim('0' || n_nationkey || 'a', '0') AS label, 'Repealed and obsolete provisions' AS name, 'https://law.example/' || n_name AS url
  FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey <> 3""")
def former_chapters(spark, d):
    """Title pages with section links and a note of the chapter they were published in."""
    n = table(spark, d, "nation")
    pages = n.select(F.col("n_nationkey").cast("long").alias("page_id"), F.concat(F.lit("https://law.example/"), "n_name", F.lit("#x")).alias("url"))
    note = F.when(F.col("n_regionkey") != 3, F.concat(F.lit("(Formerly published as Chapter 0"), F.col("n_nationkey").cast("string"), F.lit("A)"))).otherwise("General provisions")
    rows = n.select(F.col("n_nationkey").cast("long").alias("key"), F.lit("block").alias("kind"), note.alias("text"), F.lit(1).alias("ordinal"))
    return crawl.inline_chapters(pages, rows, n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("key")))


@q("""SELECT p_partkey, last_value(CASE WHEN p_partkey % 7 = 0 THEN p_name END IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category
  FROM part QUALIFY p_partkey % 7 <> 0""")
def category_lines(spark, d):
    lines = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), F.col("p_size").alias("page"))
    return folds.carry_category(lines, F.col("p_partkey") % 7 == 0, "p_partkey").select("p_partkey", "category")


# editions and artifacts -------------------------------------------------------------------
@q("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def newest_edition(spark, d):
    return artifacts.latest_edition(table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")))


@q("""SELECT n_name AS edition, CAST(n_regionkey AS VARCHAR) AS base_id, CASE WHEN n_nationkey % 12 = 0 THEN 'generated_at,manifest_sha256' WHEN n_nationkey % 3 = 0 THEN 'manifest_sha256' ELSE 'generated_at' END AS wrong
  FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 4 = 0""")
def edition_binding(spark, d):
    """Editions whose recorded base is not the base: a nation is an edition of its region."""
    digest = F.sha2(F.col("r_name").cast("binary"), 256)
    bases = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("base_id"), F.lit("1.0.0").alias("schema_version"), F.lower("r_name").alias("generated_at"), digest.alias("manifest_sha256"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("edition"), F.col("n_regionkey").cast("string").alias("base_id"), "n_nationkey").join(F.broadcast(bases), "base_id")
    k = F.col("n_nationkey")
    editions = n.withColumns({"manifest_sha256": F.when(k % 3 == 0, "other").otherwise(F.col("manifest_sha256")), "generated_at": F.when(k % 4 != 0, F.col("generated_at"))}).drop("n_nationkey")
    return reports.binding_errors(editions, bases).withColumn("wrong", F.array_join("wrong", ","))


@q("""SELECT p_partkey, sha256('{"entries":[{"n":' || p_size || '}],"id":"' || p_partkey || '"}') AS content,
  sha256('[["/entries/0/authorityResolution","' || p_brand || '"],["/resolution",{"status":"exact"}]]') AS resolution FROM part""")
def resolution_hashes(spark, d):
    """Digests of an entity without its resolutions, and of the resolutions alone."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    body = F.concat(F.lit('{"resolution": {"status": "exact"}, "id": "'), key, F.lit('", "entries": [{"n": '), size, F.lit(', "authorityResolution": "'), "p_brand", F.lit('"}]}'))
    return table(spark, d, "part").select("p_partkey", versions.resolution_split(body).alias("x")).select("p_partkey", "x.*")


@q("SELECT doc_id, doc_id % 3 = 0 AS pdf FROM documents")
def pdf_snapshots(spark, d):
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7\n").otherwise(" %PDF-"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", artifacts.is_pdf(content.cast("binary")).alias("pdf"))


@q("""SELECT DISTINCT CASE WHEN length(event_type) % 2 = 0 THEN event_type || '.json' ELSE event_type || '-' || CASE WHEN user_id % 120 < 9 THEN '0' ELSE '' END || (user_id % 120 + 1) || '.json' END AS name FROM events""")
def shard_names(spark, d):
    e = table(spark, d, "events")
    shards = F.when(F.length("event_type") % 2 == 0, 1).otherwise(120)
    return e.select(links.shard_name(F.col("event_type"), F.col("user_id") % 120, shards).alias("name")).distinct()


# whole corpora ----------------------------------------------------------------------------
_DOCS_SQL = "SELECT lang AS title_id, source AS chapter_id, CAST(doc_id AS VARCHAR) AS id, doc_id FROM documents"


@q(f"""WITH s AS ({_DOCS_SQL}), c AS (SELECT title_id, chapter_id, count(*) AS n, count(*) FILTER (doc_id % 90 = 5) AS bad FROM s GROUP BY 1, 2)
SELECT 'catalog' AS layer, 'section count' AS problem, title_id || '/' || chapter_id AS key FROM c WHERE bad > 0
UNION ALL SELECT 'sections', CASE WHEN doc_id % 40 = 0 THEN 'a group has no citation of its own' ELSE 'a section has one citation' END, title_id || '/' || chapter_id || '/' || id FROM s WHERE doc_id % 80 = 0 OR (doc_id % 90 = 7 AND doc_id % 40 <> 0)
UNION ALL SELECT 'search', CASE doc_id % 50 WHEN 1 THEN 'not searched' WHEN 2 THEN 'stale' WHEN 3 THEN 'repeated document' ELSE 'not searched' END, title_id || '/' || chapter_id || '/' || id FROM s WHERE doc_id % 50 IN (1, 2, 3, 4)
UNION ALL SELECT 'search', 'no canonical section', title_id || '/' || chapter_id || '/' || id || 'x' FROM s WHERE doc_id % 50 = 4
UNION ALL SELECT 'artifacts', CASE WHEN n % 7 = 0 THEN 'sha256' ELSE 'size' END, title_id || '/' || chapter_id || '.json' FROM c WHERE n % 7 = 0 OR n % 7 = 1""")
def corpus_validation(spark, d):
    """All layers of a corpus in which some of everything is broken."""
    t = table(spark, d, "documents")
    k, key = F.col("doc_id"), F.col("doc_id").cast("string")
    kind, two = F.when(k % 40 == 0, "group").otherwise("section"), k % 90 == 7
    s = t.select(F.col("lang").alias("title_id"), F.col("source").alias("chapter_id"), key.alias("id"), kind.alias("kind"), F.when(k % 40 != 0, key).when(k % 80 == 0, key).alias("citation"), F.when(two, F.array(key, F.lit("x"))).otherwise(F.array(key)).alias("citations"), F.lit("H").alias("heading"), "text", "doc_id")
    docs = s.where("doc_id % 50 <> 1").select("title_id", "chapter_id", F.when(k % 50 == 4, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), F.when(k % 50 == 2, "old").otherwise(F.col("heading")).alias("heading"), F.explode(F.array_repeat("text", F.when(k % 50 == 3, 2).otherwise(1))).alias("text"))
    c = s.groupBy("title_id", "chapter_id").agg(F.count("*").alias("n"), F.count_if(k % 90 == 5).alias("bad"))
    path = F.concat("title_id", F.lit("/"), "chapter_id", F.lit(".json")).alias("path")
    catalog = c.select("title_id", "chapter_id", path, (F.col("n") + F.col("bad")).alias("n_sections"))
    found, recorded = c.select(path, F.col("n").alias("bytes"), F.lit("a").alias("sha256")), c.select(path, F.when(F.col("n") % 7 == 1, 0).otherwise(F.col("n")).alias("bytes"), F.when(F.col("n") % 7 == 0, "b").otherwise("a").alias("sha256"))
    return validate.corpus_errors(catalog, s.drop("doc_id"), docs, found, recorded)
