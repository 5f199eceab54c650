"""The driver's tables as the engine's model: sections, labels, snapshots, catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as provisions without their status: title = lang, chapter = source."""
    d = table(spark, sf_dir, "documents")
    number = (F.substring("source", 4, 10).try_cast("int") + 1).cast("string")
    citation = F.concat(number, F.lit("-"), F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        F.col("lang").alias("title_number"),
        F.col("source").alias("chapter_id"),
        number.alias("chapter_number"),
        citation.alias("citation"),
        F.array(citation).alias("citations"),
        F.substring_index("text", ".", 1).alias("heading"),
        "text",
        F.when(F.col("doc_id") % 7 == 0, F.lit(2026)).alias("supplement_year"),
    )


def statuses(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``status`` from ``labels``, which has one row a document, so no row multiplies."""

    def add(docs: DataFrame) -> DataFrame:
        labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
        status = F.when(F.col("toxic") == 1, "repealed").when(F.col("quality") == 0, "obsolete").otherwise("active")
        return docs.join(labels, "doc_id", "left").withColumn("status", status).drop("quality", "toxic")

    return add


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisions with their status."""
    return statuses(spark, sf_dir)(provisions(spark, sf_dir))


def auxiliary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and annotations of each provision, kept apart and joined on demand."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("title_number"), F.col("doc_id").cast("string").alias("id"),
        F.array(F.concat(F.lit("History of "), F.col("source"))).alias("history"),
        F.array(F.concat(F.lit("Language "), F.col("lang"))).alias("annotations"),
    )


#: The same view for DuckDB.
SECTIONS_SQL = """sections AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.lang AS title_number, d.source AS chapter_id,
         CAST(TRY_CAST(substr(d.source, 4, 10) AS INT) + 1 AS VARCHAR) AS chapter_number,
         CAST(TRY_CAST(substr(d.source, 4, 10) AS INT) + 1 AS VARCHAR) || '-' || CAST(d.doc_id AS VARCHAR) AS citation,
         string_split(d.text, '.')[1] AS heading, d.text AS text,
         CASE WHEN l.toxic = 1 THEN 'repealed' WHEN l.quality = 0 THEN 'obsolete' ELSE 'active' END AS status,
         CASE WHEN d.doc_id % 7 = 0 THEN 2026 END AS supplement_year
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\\p{{L}}\\p{{N}}-]+', ' ', 'g'))"


def tok_sql(norm: str) -> str:
    return f"' ' || array_to_string(regexp_extract_all({norm}, '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*'), ' ') || ' '"


def natural_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '(\\d+)', '000000000000\\1', 'g'), '\\d*(\\d{{12}})', '\\1', 'g')"


#: Sections with normalized text and token strings.
PREPARED_SQL = f"""{SECTIONS_SQL}, normed AS (
  SELECT *, {norm_sql('citation')} AS n_citation, {norm_sql('heading')} AS n_heading, {norm_sql('text')} AS n_body,
         {norm_sql("'History of ' || chapter_id")} AS n_history, {norm_sql("'Language ' || title_number")} AS n_annotations
  FROM sections
), prepared AS (
  SELECT *, {tok_sql('n_citation')} AS t_citation, {tok_sql('n_heading')} AS t_heading, {tok_sql('n_body')} AS t_body,
         {tok_sql('n_history')} AS t_history, {tok_sql('n_annotations')} AS t_annotations
  FROM normed
)"""
