"""Raw title exports to canonical sections, chapters and search documents.

An export is one JSON file per title with its chapters and their sections. Everything is one
projection per level over exploded arrays; what must not be is an error row or ``raise_error``,
never a loop over files.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as tx

_CONTENT = "body_paragraphs:array<string>,source:array<string>,history:array<string>,annotations:array<struct<first:boolean,text:string>>,text:string,status:string,statuses:array<string>"
_SECTION = f"section_key:string,label:string,url:string,grouped:boolean,section_keys:array<string>,source_fragment_key:string,identifier_warning:string,content:struct<{_CONTENT}>"
RAW_TITLE = f"title_key string, label string, name string, url string, supplement_year int, chapters array<struct<chapter_key:string,label:string,name:string,url:string,sections:array<struct<{_SECTION}>>>>"

# Statuses that a canonical section may have.
STATUSES = ("active", "repealed", "reserved", "transferred", "obsolete", "mixed")
#: Version of the canonical form.
SCHEMA_VERSION = "1.0.0"


def safe_paths(source: str, target: str) -> None:
    """Refuses a target that is the root, the source, or above or inside the source."""
    a, b = os.path.realpath(source), os.path.realpath(target)
    if b == os.path.sep or a == b or a.startswith(b.rstrip("/") + "/") or b.startswith(a.rstrip("/") + "/"):
        raise ValueError(f"unsafe output path: {target}")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Export files ``title_<key>.json`` (any case), one row each; none at all is an error."""
    d = spark.read.schema(RAW_TITLE).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    d = d.where(F.col("file").rlike(r"(?i)^title_[0-9a-z]+\.json$"))
    if d.isEmpty():
        raise ValueError(f"no title files in {path}")
    return d


def annotations(c: Column) -> Column:
    """Annotations with trimmed text; empty ones go."""
    kept = F.transform(c, lambda a: F.struct(F.coalesce(a["first"], F.lit(False)).alias("first"), tx.clean_string(a["text"]).alias("text")))
    return F.coalesce(F.filter(kept, lambda a: a["text"] != ""), F.array().cast("array<struct<first:boolean,text:string>>"))


def _or(*choices: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices))


def canonical_sections(titles: DataFrame) -> DataFrame:
    """A row per section: where it stands, then its canonical fields.

    A grouped section is identified by all its keys, another by its own; without a key the id
    comes from a hash of label and address. A status outside ``STATUSES``, a section without
    an address and a chapter without a number raise.
    """
    c = titles.select(
        tx.comparable_number(F.col("title_key")).alias("title_number"), F.concat_ws("", F.col("name")).alias("title_name"),
        F.col("supplement_year"), F.posexplode("chapters").alias("chapter_position", "c"),
    )
    number = tx.slug(F.col("c.chapter_key"))
    c = c.withColumn("chapter_number", F.when(number == "", F.raise_error(F.concat(F.lit("no chapter_key in title "), F.col("title_number"))).cast("string")).otherwise(number))
    s = c.select(
        "title_number", "title_name", "supplement_year", F.concat(F.lit("chapter-"), F.col("chapter_number")).alias("chapter_id"), "chapter_number",
        F.coalesce(_or(tx.clean_string(F.col("c.name")), tx.clean_string(F.col("c.label"))), F.concat(F.lit("Chapter "), F.col("chapter_number"))).alias("chapter_name"),
        tx.clean_string(F.col("c.url")).alias("chapter_url"), "chapter_position", F.posexplode("c.sections").alias("position", "s"),
    )
    f, content = (lambda n: F.col("s")[n]), (lambda n: F.col("s")["content"][n])
    grouped = F.coalesce(f("grouped"), F.lit(False))
    citation = F.nullif(tx.clean_string(f("section_key")), F.lit(""))
    keys = F.when(grouped, tx.string_array(f("section_keys"))).when(citation.isNotNull(), F.array(citation)).otherwise(F.array().cast("array<string>"))
    joined = tx.slug(F.when(grouped, F.array_join(keys, "-to-")).otherwise(citation))
    ident = F.concat(F.when(grouped, "group-").otherwise("section-"), F.coalesce(F.nullif(joined, F.lit("")), tx.stable_id(tx.clean_string(f("label")), tx.clean_string(f("url")), length=12)))
    given = F.coalesce(F.nullif(F.lower(tx.clean_string(content("status"))), F.lit("")), F.lit("active"))
    status = F.when(given.isin(*STATUSES), given).otherwise(F.raise_error(F.concat(F.lit("unsupported status: "), given)).cast("string"))
    url = tx.clean_string(f("url"))
    body = tx.string_array(content("body_paragraphs"))
    return s.select(
        "title_number", "title_name", "supplement_year", "chapter_id", "chapter_number", "chapter_name", "chapter_url", "chapter_position", "position",
        ident.alias("id"), F.when(grouped, "group").otherwise("section").alias("kind"), citation.alias("citation"), keys.alias("citations"),
        F.coalesce(_or(tx.clean_string(f("label"))), citation, F.lit("Untitled provision")).alias("heading"),
        F.when(url == "", F.raise_error(F.concat(ident, F.lit(" has no address"))).cast("string")).otherwise(url).alias("sourceUrl"),
        F.nullif(tx.clean_string(f("source_fragment_key")), F.lit("")).alias("sourceAnchor"),
        F.nullif(tx.clean_string(f("identifier_warning")), F.lit("")).alias("identifierWarning"), status.alias("status"),
        F.struct(
            body.alias("body"), tx.string_array(content("source")).alias("sourceNotes"), tx.string_array(content("history")).alias("history"),
            annotations(content("annotations")).alias("annotations"),
            F.coalesce(_or(tx.clean_string(content("text"))), F.array_join(body, "\n\n")).alias("plainText"),
        ).alias("content"),
    )


def search_rows(canonical: DataFrame) -> DataFrame:
    """Canonical sections as search documents with their address inside the application."""
    href = F.concat(F.lit("?chapter="), tx.url_component(F.col("chapter_number")), F.lit("&section="), tx.url_component(F.col("id")))
    return canonical.select(
        "id", "citation", "citations", "heading", F.col("content.plainText").alias("text"), "status", "title_number", "chapter_id", "chapter_number",
        "supplement_year", F.col("content.history").alias("history"), F.transform("content.annotations", lambda a: a["text"]).alias("annotations"), href.alias("href"),
    )


def duplicate_ids(canonical: DataFrame) -> DataFrame:
    """``chapter_id, id, n`` of section ids that a chapter has more than once."""
    return canonical.groupBy("title_number", "chapter_id", "id").agg(F.count("*").alias("n")).where("n > 1")


def chapters(canonical: DataFrame) -> DataFrame:
    """Chapter records with their sections in order (a chapter is bounded by its file)."""
    section = F.struct(F.col("position").alias("__at"), F.struct("id", "kind", "citation", "citations", "heading", "sourceUrl", "sourceAnchor", "identifierWarning", "status", "content").alias("s"))
    g = canonical.groupBy("title_number", "title_name", "chapter_id", "chapter_number", "chapter_name", "chapter_url", "chapter_position").agg(F.array_sort(F.collect_list(section)).alias("x"))
    title = F.struct(F.concat(F.lit("title-"), F.col("title_number")).alias("id"), F.col("title_number").alias("number"), F.col("title_name").alias("name"))
    return g.select(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.col("chapter_id").alias("id"), F.col("chapter_number").alias("number"), F.col("chapter_name").alias("name"),
        title.alias("title"), F.col("chapter_url").alias("sourceUrl"), F.transform("x", lambda y: y["s"]).alias("sections"),
    )


def manifest_counts(canonical: DataFrame) -> DataFrame:
    """Chapters and sections per title, with a total row (null title)."""
    return canonical.rollup("title_number").agg(F.count_distinct("chapter_id").alias("chapters"), F.count("*").alias("sections"))


def import_titles(spark: SparkSession, source: str, target: str) -> str:
    """Reads an export, checks it, and publishes its search documents by title; returns the path.

    ``target`` holds generations and a pointer; a failed import leaves the last good one.
    """
    from lexweave.operators.versions import require_none
    from lexweave.sources.artifacts import publish

    safe_paths(source, target)
    canonical = canonical_sections(read_titles(spark, source))
    require_none(duplicate_ids(canonical))
    return publish(search_rows(canonical), target, lambda d: require_none(d.where("id is null or status is null")))
