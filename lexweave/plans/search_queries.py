"""Search queries over the documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import query as q
from lexweave.functions import text as tx
from lexweave.functions.query import Options
from lexweave.operators import search as s
from lexweave.sources.tables import PREPARED_SQL, SECTIONS_SQL, auxiliary, natural_sql, norm_sql, provisions, sections, statuses, table, tok_sql


def _out(found: DataFrame) -> DataFrame:
    return found.select("id", "citation", "score", F.array_join("matched_fields", ",").alias("matched_fields"))


# SQL written by hand from the meaning of each query: terms are ' w ' in token strings, phrases
# substrings of normalized text, weights by field.
def _has(col: str, term: str) -> str:
    if term.startswith('"'):
        return f"contains(n_{col}, '{term.strip(chr(34))}')"
    return f"contains(t_{col}, ' {term[:-1]}')" if term.endswith("*") else f"contains(t_{col}, ' {term} ')"


def _any(term: str, fields: tuple[str, ...]) -> str:
    return "(" + " OR ".join(_has(f, term) for f in fields) + ")"


_W = {"heading": (34, 44), "body": (12, 20), "history": (9, 16), "annotations": (8, 14)}


def _score_sql(terms: list[str], fields: tuple[str, ...]) -> str:
    out = ["CAST(1 AS DOUBLE)", "CASE WHEN status <> 'active' THEN -0.25 ELSE 0 END"]
    for t in terms:
        if "citation" in fields:
            bare = t.strip('"*')
            prefix = f"WHEN starts_with(n_citation, '{bare}') THEN 55" if t.endswith("*") else ""
            out.append(f"CASE WHEN n_citation = '{bare}' THEN 120 {prefix} WHEN {_has('citation', t)} THEN 30 ELSE 0 END")
        out += [f"CASE WHEN {_has(f, t)} THEN {_W[f][t.startswith(chr(34))]} ELSE 0 END" for f in fields if f in _W]
    return "CAST(" + " + ".join(out) + " AS DOUBLE)"


def _matched_sql(terms: list[str], fields: tuple[str, ...]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(_has(f, t) for t in terms)} THEN '{f}' END" for f in fields) + "], lambda x: x IS NOT NULL), ',')"


STATUTE, ALL = ("citation", "heading", "body"), ("citation", "heading", "body", "history", "annotations")


def _search_sql(where: str, terms: list[str], fields: tuple[str, ...] = STATUTE, limit: int | None = 50, sort: str = "relevance", extra: str = "TRUE") -> str:
    natural = ", ".join(natural_sql(x) for x in ("citation", "title_number", "chapter_number")) + ", id"
    order = f"score DESC, {natural}" if sort == "relevance" else f"{natural}, score DESC"
    return f"""WITH {PREPARED_SQL}
SELECT id, citation, {_score_sql(terms, fields)} AS score, {_matched_sql(terms, fields)} AS matched_fields
FROM prepared WHERE ({where}) AND {extra} ORDER BY {order}{f' LIMIT {limit}' if limit else ''}"""


#: name -> (query, options, SQL predicate, positive terms, extra SQL filter)
CASES: dict[str, tuple] = {
    "search_boolean": ("the AND (in OR of) NOT was", Options(), f"{_any('the', STATUTE)} AND ({_any('in', STATUTE)} OR {_any('of', STATUTE)}) AND NOT {_any('was', STATUTE)}", ["the", "in", "of"], "TRUE"),
    "search_implicit_and": ("de la § que", Options(), f"{_any('de', STATUTE)} AND {_any('la', STATUTE)} AND {_any('que', STATUTE)}", ["de", "la", "que"], "TRUE"),
    "search_not": ("NOT the", Options(), f"NOT {_any('the', STATUTE)}", [], "TRUE"),
    "search_phrase": ('"of the" OR "de la"', Options(), f"""{_any('"of the"', STATUTE)} OR {_any('"de la"', STATUTE)}""", ['"of the"', '"de la"'], "TRUE"),
    "search_prefix": ("thr* OR 1-1*", Options(), f"{_any('thr*', STATUTE)} OR {_any('1-1*', STATUTE)}", ["thr*", "1-1*"], "TRUE"),
    "search_field_heading": ("the", Options(field="heading"), _any("the", ("heading",)), ["the"], "TRUE"),
    "search_filters": ("the OR der", Options(chapter="src3", status="active", supplement="base"), f"{_any('the', STATUTE)} OR {_any('der', STATUTE)}", ["the", "der"], "chapter_id = 'src3' AND status = 'active' AND supplement_year IS NULL"),
    "search_within": ("the", Options(within="licensed OR license"), f"{_any('the', STATUTE)} AND ({_any('licensed', STATUTE)} OR {_any('license', STATUTE)})", ["the", "licensed", "license"], "TRUE"),
    "search_sort_citation": ("une OR eine", Options(sort="citation"), f"{_any('une', STATUTE)} OR {_any('eine', STATUTE)}", ["une", "eine"], "TRUE"),
    "search_citation_exact": ("3-2 OR 4-*", Options(field="citation"), f"{_any('3-2', ('citation',))} OR {_any('4-*', ('citation',))}", ["3-2", "4-*"], "TRUE"),
}

QUERIES, ORACLE = {}, {}
for _name, (_text, _options, _where, _terms, _extra) in CASES.items():
    QUERIES[_name] = lambda spark, d, t=_text, o=_options: _out(s.search(provisions(spark, d), t, o, enrich=statuses(spark, d)))
    _fields = s.fields_of(_options)
    ORACLE[_name] = _search_sql(_where, _terms, _fields, sort=_options.sort, extra=_extra) if _terms else _search_sql(_where, ["\x01"], _fields, extra=_extra)

NEAR = "the NEAR/3 an*"


def search_near(spark, d):
    return _out(s.matches(provisions(spark, d), NEAR, enrich=statuses(spark, d)))


ORACLE["search_near"] = f"""WITH {PREPARED_SQL}, words AS (
  SELECT id, f, w, unnest(range(len(w))) AS pos
  FROM (SELECT id, f, string_split(trim(t), ' ') AS w FROM (
    SELECT id, 'citation' AS f, t_citation AS t FROM prepared UNION ALL SELECT id, 'heading', t_heading FROM prepared
    UNION ALL SELECT id, 'body', t_body FROM prepared) x WHERE t <> '  ') y
), hits AS (
  SELECT DISTINCT a.id FROM (SELECT id, f, pos FROM words WHERE w[pos + 1] = 'the') a
  JOIN (SELECT id, f, pos FROM words WHERE starts_with(w[pos + 1], 'an')) b ON a.id = b.id AND a.f = b.f AND abs(a.pos - b.pos) <= 3
)
SELECT id, citation, {_score_sql(['the', 'an*'], STATUTE)} AS score, {_matched_sql(['the', 'an*'], STATUTE)} AS matched_fields
FROM prepared WHERE id IN (SELECT id FROM hits)"""


def search_total_matches(spark, d):
    return s.total_matches(provisions(spark, d), "the AND (in OR of) NOT was")


ORACLE["search_total_matches"] = f"WITH {PREPARED_SQL} SELECT count(*) AS total_matches FROM prepared WHERE {CASES['search_boolean'][2]}"


def search_page(spark, d):
    return _out(s.page(provisions(spark, d), "la OR license", number=2, size=30, enrich=statuses(spark, d)))


ORACLE["search_page"] = _search_sql(f"{_any('la', STATUTE)} OR {_any('license', STATUTE)}", ["la", "license"], limit=30) + " OFFSET 30"


def nav_visible(spark, d):
    return s.visible(sections(spark, d), True, "7").select("id", "status")


ORACLE["nav_visible"] = f"WITH {SECTIONS_SQL} SELECT id, status FROM sections WHERE status <> 'repealed' OR id = '7'"


def search_matched_fields(spark, d):
    return _out(s.matches(provisions(spark, d), "la OR license", enrich=statuses(spark, d)))


ORACLE["search_matched_fields"] = _search_sql(f"{_any('la', STATUTE)} OR {_any('license', STATUTE)}", ["la", "license"], limit=None)


def search_with_aux(spark, d):
    o = Options(field="all")
    return _out(s.search(s.with_auxiliary(sections(spark, d), auxiliary(spark, d), o), "src4 de", o))


ORACLE["search_with_aux"] = _search_sql(f"{_any('src4', ALL)} AND {_any('de', ALL)}", ["src4", "de"], ALL)


def search_shard_merge(spark, d):
    docs = sections(spark, d)
    titles = sorted(r[0] for r in table(spark, d, "documents").select("lang").distinct().collect())  # the catalog's titles
    parts = [s.search(docs.where(F.col("title_number") == t), "NOT zzz license", limit=20) for t in titles]
    return _out(s.merge_results(*parts, limit=20))


ORACLE["search_shard_merge"] = _search_sql(f"NOT {_any('zzz', STATUTE)} AND {_any('license', STATUTE)}", ["license"], limit=20)


def normalize_text_query(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(tx.normalize_text(F.col("text")).cast("binary")).alias("norm_md5"))


ORACLE["normalize_text"] = f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5 FROM documents"


def tokenize_stats(spark, d):
    norm = table(spark, d, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("n"))
    t = norm.select("doc_id", tx.tokens(F.col("n")).alias("t"), tx.token_string(F.col("n")).alias("s"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.col("s").cast("binary")).alias("token_md5"))


ORACLE["tokenize_stats"] = f"""WITH n AS (SELECT doc_id, {norm_sql('text')} AS n FROM documents), t AS (
  SELECT doc_id, regexp_extract_all(n, '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*') AS t, {tok_sql('n')} AS s FROM n)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, md5(s) AS token_md5 FROM t"""


def search_highlight(spark, d):
    terms = s.highlight_terms('license OR "of the"')
    return sections(spark, d).where(F.lower("text").contains("license")).select("id", s.highlighted(F.col("text"), terms).alias("html"))


ORACLE["search_highlight"] = """SELECT CAST(doc_id AS VARCHAR) AS id,
 regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '(license|of\\s+the)', '<mark>\\1</mark>', 'gi') AS html
FROM documents WHERE contains(lower(text), 'license')"""


def search_excerpt(spark, d):
    return sections(spark, d).select("id", s.excerpt(F.col("text"), ["license"]).alias("excerpt"))


def search_explain(spark, d):
    texts = ['tax* "real estate" OR NOT (a b) near/3 c', "a OR b AND NOT c", "(a OR b) c", 'x NEAR/5 y*', "not not z"]
    rows = []
    for i, t in enumerate(texts):
        try:
            rows.append((i, q.parse(t).explanation))
        except q.QuerySyntaxError as e:
            rows.append((i, str(e)))
    return spark.createDataFrame(rows, "n int, explanation string")


ORACLE["search_explain"] = """SELECT * FROM (VALUES (0, 'NEAR/n requires a word, prefix, or quoted phrase on each side.'), (1, 'a OR b AND NOT c'),
 (2, '(a OR b) AND c'), (3, 'x NEAR/5 y*'), (4, 'NOT NOT z')) t(n, explanation)"""

QUERIES |= {
    "search_page": search_page, "nav_visible": nav_visible, "search_near": search_near, "search_total_matches": search_total_matches, "search_matched_fields": search_matched_fields,
    "search_with_aux": search_with_aux, "search_shard_merge": search_shard_merge, "normalize_text": normalize_text_query,
    "tokenize_stats": tokenize_stats, "search_highlight": search_highlight, "search_excerpt": search_excerpt, "search_explain": search_explain,
}
__all__ = ["ORACLE", "QUERIES", "SECTIONS_SQL"]
