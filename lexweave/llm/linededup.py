"""Cross-site boilerplate lines by distinct-site spread.

Every line is known by a 128-bit hash of its trimmed bytes. HyperLogLog sketches of the sites
that carry a line merge by aggregation (partial sums before the shuffle, so a line that stands
everywhere is no hot key). Estimates well under or over the threshold decide at once; lines
whose estimate is within the sketch's error of it get an exact distinct count. A boilerplate
line goes from every document but the first that has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import checkpointed, stored

#: Characters trimmed from the ends of a line.
BLANK = " \t\n\x0b\x0c\r"
_P = "__line_"


@dataclass(frozen=True)
class SpreadParams:
    """``min_sites``: distinct sites from which a line is boilerplate. ``log2_buckets``: size of
    the sketch; its relative error is 1.04 / sqrt(2^log2_buckets). ``sigmas``: how many of these
    errors around the threshold are counted exactly."""

    min_sites: int = 8
    log2_buckets: int = 12
    sigmas: float = 4.0

    @property
    def margin(self) -> float:
        return self.sigmas * 1.04 / 2 ** (self.log2_buckets / 2)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_table(docs: DataFrame, site: str = "source") -> DataFrame:
    """A row per line with something on it: ``id, body`` (hash of the text), ``pos``, hash
    ``h1, h2`` and ``site`` (null: one site of its own)."""
    d = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce(F.col(site).cast("string"), F.lit("\u0000")).alias("site"),
        F.posexplode(F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(BLANK)))).alias("pos", "line"),
    ).where("line <> ''")
    return d.select("id", "body", "pos", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"))


def boilerplate(lines: DataFrame, p: SpreadParams = SpreadParams()) -> DataFrame:
    """``h1, h2, first, sites``: lines on ``min_sites`` or more sites, and the least id there."""
    spread = lines.groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.hll_sketch_agg("site", F.lit(p.log2_buckets)).alias("sketch")
    )
    # fewer places than min_sites cannot reach it
    spread = spread.where(F.col("n") >= p.min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = checkpointed(spread.where(F.col("sites") >= p.min_sites * (1 - p.margin)))
    near = F.col("sites") <= p.min_sites * (1 + p.margin)
    close = spread.where(near)
    if close.isEmpty():
        return spread
    exact = lines.join(close.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= p.min_sites)
    return spread.where(~near).unionByName(close.drop("sites").join(exact, ["h1", "h2"]))


def _removals(docs: DataFrame, site: str, p: SpreadParams) -> DataFrame:
    """``id, body, gone``: positions of the lines that go, per document that loses any."""
    lines = line_table(docs, site)
    common = stored(boilerplate(lines, p).select("h1", "h2", "first"), "boilerplate")
    hit = lines.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
    return hit.groupBy("id", "body").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, site: str = "source", params: SpreadParams = SpreadParams()) -> DataFrame:
    """``docs`` with cleaned ``text`` and two more columns, ``n_lines`` and ``n_removed``.

    Rows and other columns stay as they are (``n_chars`` follows the text where present); a
    document may end up empty. A null text stays null and has no lines; a null site counts as
    one site; among rows without a doc_id none is first, so a boilerplate line that only they
    carry is kept in all of them. Repeated rows are cleaned alike. Blank lines never count.
    """
    gone = _removals(docs, site, params)
    gone = gone.select(F.col("id").alias(_P + "id"), F.col("body").alias(_P + "body"), F.col("gone").alias(_P + "gone"))
    key = F.col("doc_id").eqNullSafe(F.col(_P + "id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(_P + "body"))
    d = docs.join(gone, key, "left").withColumn(_P + "lines", _lines(F.col("text")))
    left = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(_P + "lines") - 1), F.col(_P + "gone")), lambda i: F.get(F.col(_P + "lines"), i)
    )
    cleaned = F.when(F.col(_P + "gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    counts = {
        "n_lines": F.size(F.filter(F.col(_P + "lines"), lambda x: F.btrim(x, F.lit(BLANK)) != "")).cast("long"),
        "n_removed": F.coalesce(F.size(F.col(_P + "gone")), F.lit(0)).cast("long"),
    }
    d = d.withColumns({**counts, _P + "text": cleaned})
    size = {"n_chars": F.length(_P + "text").cast("long")} if "n_chars" in docs.columns else {}
    columns = [F.col(_P + "text").alias("text") if c == "text" else size[c].alias(c) if c in size else F.col(f"`{c}`") for c in docs.columns if c not in counts]
    return d.select(*columns, *counts)


def spread_report(docs: DataFrame, params: SpreadParams = SpreadParams()) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_removed, text`` after boilerplate removal."""
    return dedup_lines(docs.select("doc_id", "text", "source"), "source", params).select("doc_id", "n_lines", "n_removed", "text")


def clean_lines(docs: DataFrame, params: SpreadParams = SpreadParams()) -> DataFrame:
    """``docs`` with boilerplate lines gone and the same columns."""
    extra = [c for c in ("n_lines", "n_removed") if c in docs.columns]
    renamed = docs.withColumnsRenamed({c: _P + c for c in extra})
    out = dedup_lines(renamed, "source", params).drop("n_lines", "n_removed").withColumnsRenamed({_P + c: c for c in extra})
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle(params: SpreadParams = SpreadParams()) -> str:
    """The same result in DuckDB SQL, with exact distinct counts throughout."""
    trimmed = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH lines AS (
  SELECT doc_id, source, u.pos AS pos, u.line AS line, {trimmed.format('u.line')} AS l
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS pos) u
), common AS (
  SELECT l, min(doc_id) AS first_id FROM lines WHERE l <> ''
  GROUP BY l HAVING count(DISTINCT coalesce(source, chr(0))) >= {params.min_sites}
), marked AS (
  SELECT lines.*, c.l IS NOT NULL AND lines.doc_id IS DISTINCT FROM c.first_id AS gone
  FROM lines LEFT JOIN common c ON lines.l = c.l
)
SELECT doc_id,
       CAST(count(*) FILTER (WHERE l <> '') AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id"""
