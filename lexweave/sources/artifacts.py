"""Corpus artifacts: reading exports, content stores, JSON shards, manifests, publishing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.text import escape_html

SECTION = "id string, kind string, citation string, citations array<string>, heading string, sourceUrl string, sourceAnchor string, identifierWarning string, status string, content struct<body:array<string>,sourceNotes:array<string>,history:array<string>,annotations:array<struct<first:boolean,text:string>>,plainText:string>"
CHAPTER = f"schemaVersion string, id string, number string, name string, title struct<id:string,number:string,name:string>, sourceUrl string, sections array<struct<{','.join(':'.join(x.split(' ', 1)) for x in SECTION.split(', '))}>>"


def read_chapters(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Canonical chapter files, one row each, with a fixed schema (nothing is inferred)."""
    return spark.read.schema(CHAPTER).option("multiLine", True).option("pathGlobFilter", glob).json(path).withColumn("file", F.col("_metadata.file_name"))


def dereference(catalog: DataFrame, chapters: DataFrame, titles: Sequence[str] | None = None) -> DataFrame:
    """The catalog's chapters (``title_id, chapter_id, path``) with the columns of their files (by
    the name in ``file``), of some titles or of all; an entry without a file raises. Files that
    the catalog does not name give no row."""
    wanted = catalog.where(F.col("title_id").isin(*titles)) if titles is not None else catalog
    named = wanted.select("title_id", "chapter_id", "path", F.substring_index("path", "/", -1).alias("__file"))
    found = chapters.select(*(c for c in chapters.columns if c not in ("title_id", "chapter_id", "path")))
    j = named.join(found, F.col("__file") == F.col("file"), "left").drop("__file")
    missing = F.raise_error(F.concat(F.lit("chapter file is missing: "), F.col("path"))).cast("string")
    return j.withColumn("chapter_id", F.when(F.col("file").isNull(), missing).otherwise(F.col("chapter_id").cast("string")))


def chapter_sections(chapters: DataFrame) -> DataFrame:
    return chapters.select(F.col("title.number").alias("title_number"), F.col("id").alias("chapter_id"), F.col("number").alias("chapter_number"), F.posexplode("sections").alias("position", "s")).select("title_number", "chapter_id", "chapter_number", "position", "s.*")


def search_documents(sections: DataFrame) -> DataFrame:
    """Section rows as search documents."""
    return sections.select("id", "citation", "citations", "heading", F.col("content.plainText").alias("text"), "status", "title_number", "chapter_id", "chapter_number", F.lit(None).cast("int").alias("supplement_year"), F.col("content.history").alias("history"), F.transform("content.annotations", lambda a: a["text"]).alias("annotations"))


def content_store(files: DataFrame, url: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Url manifest and blobs by SHA-256, each content once."""
    hashed = files.select(F.col(url).alias("url"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.col(content).cast("binary").alias("content"))
    return hashed.select("url", "sha256", F.octet_length("content").alias("bytes")), hashed.groupBy("sha256").agg(F.any_value("content").alias("content"))


def replay(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Contents by url; a missing or altered blob raises (offline replay fails closed)."""
    j = manifest.join(blobs, "sha256", "left")
    ok = F.col("content").isNotNull() & (F.sha2("content", 256) == F.col("sha256"))
    return j.withColumn("content", F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("snapshot is missing or altered: "), F.col("url"))).cast("binary")))


def is_pdf(content: Column) -> Column:
    return F.startswith(content, F.lit(b"%PDF-").cast("binary"))


def json_shards(rows: DataFrame, key: str, order: str, limit: int = 100_000) -> DataFrame:
    """JSON documents per key: ``path, body`` with items in order, nulls kept.

    A key of more than ``limit`` rows is spread over as many documents as that takes, named
    ``key-0.json`` on, so that no task builds a document of a whole hot key.
    """
    parts = rows.groupBy(key).agg(F.ceil(F.count("*") / limit).cast("int").alias("__parts"))
    d = rows.join(parts, rows[key].eqNullSafe(parts[key])).drop(parts[key]).withColumn("__part", F.pmod(F.xxhash64(order), F.col("__parts").cast("long")))
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*(c for c in rows.columns if c != key)).alias("item")))), lambda x: x["item"])
    name = F.concat(F.col(key).cast("string"), F.when(F.col("__parts") > 1, F.concat(F.lit("-"), F.col("__part").cast("string"))).otherwise(""), F.lit(".json"))
    return d.groupBy(key, "__parts", "__part").agg(items.alias("items")).select(name.alias("path"), F.to_json(F.struct(F.col(key), F.col("items")), {"ignoreNullFields": "false"}).alias("body"))


def fingerprint(artifacts: DataFrame) -> DataFrame:
    """12 hex digits over the sorted (path, sha256) pairs: digests of digests by the first four
    and two letters, so that no list of all paths is built in one task."""
    joined = lambda c, sep: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), sep), 256)
    d = artifacts.groupBy(F.substring("sha256", 1, 4).alias("p")).agg(joined(F.concat_ws(" ", "path", "sha256"), "\n").alias("h"))
    d = d.groupBy(F.substring("p", 1, 2).alias("q")).agg(joined(F.concat_ws(" ", "p", "h"), "\n").alias("h"))
    return d.agg(F.substring(joined(F.concat_ws(" ", "q", "h"), "\n"), 1, 12).alias("fingerprint"))


def build_id(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The id of a build: 12 hex digits of the SHA-256 over path and bytes of its files, in
    order of their paths. That is one digest over a few shell files; ``fingerprint`` is for many."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(path).alias("p"), F.col(content).cast("binary").alias("c"))))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["p"].cast("binary"), x["c"]))
    return files.agg(F.substring(F.sha2(joined, 256), 1, 12).alias("build_id"))


def offline_files(*parts: DataFrame) -> DataFrame:
    """Files to be kept for offline use: the union of manifests (``path`` and other columns),
    each path once; a later manifest's entry stands."""
    ranked = [p.withColumn("__rank", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, ranked)
    newest = both.groupBy("path").agg(F.max_by(F.struct(*(c for c in both.columns if c not in ("path", "__rank"))), "__rank").alias("x"))
    return newest.select("path", "x.*")


def sitemap(urls: DataFrame, origin: str, url: str = "path") -> DataFrame:
    """A line of a sitemap for each distinct path."""
    loc = F.concat(F.lit(origin.rstrip("/") + "/"), F.col(url))
    return urls.select(url).distinct().select(F.concat(F.lit("<url><loc>"), escape_html(loc), F.lit("</loc></url>")).alias("line"))


def robots(origin: str) -> str:
    """A robots file that allows all and names the sitemap."""
    return f"User-agent: *\nAllow: /\n\nSitemap: {origin.rstrip('/')}/sitemap.xml\n"


def letter_shards(manifest: DataFrame, letter: str) -> DataFrame:
    """Paths of the shards of a letter in order; those of "other" where it has none."""
    own = manifest.where(F.col("letter").isin(letter.lower(), "other"))
    best = own.agg(F.max(F.col("letter") == letter.lower()).alias("has"))
    return own.crossJoin(best).where(F.when(F.col("has"), F.col("letter") == letter.lower()).otherwise(F.col("letter") == "other")).select("letter", "shard", "path").orderBy("shard")


def publish(df: DataFrame, root: str, validate=None) -> str:
    """Writes a new generation, validates it, then moves the pointer; a failed one leaves the
    pointer where it was. Returns the generation's path."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/generation-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if validate is not None:
        validate(spark.read.parquet(path))
    pointer = spark.createDataFrame([(path,)], T.StructType([T.StructField("path", T.StringType())]))
    pointer.coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/current")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The generation that the pointer names."""
    return spark.read.parquet(spark.read.schema("path string").json(f"{root.rstrip('/')}/current").first()["path"])


def latest_edition(editions: DataFrame, year: str = "year") -> DataFrame:
    """Rows of the newest edition; ``year`` is a partition column, so one folder is read."""
    newest = editions.select(F.max(year)).first()[0]
    return editions.where(F.col(year) == newest)


def with_patch(base: DataFrame, read_patch: Callable[[], tuple[DataFrame, DataFrame]], keys: list[str]) -> tuple[DataFrame, bool]:
    """The patched documents, or the base alone and True if the patch cannot be read.

    A patch is read through (its removals are small) before the plan is built on it, so that a
    missing or broken one degrades the search and does not fail it.
    """
    from lexweave.operators.versions import apply_patch

    try:
        removed, added = read_patch()
        removed.count(), added.count()
    except Exception:  # noqa: BLE001 - whatever is wrong with the patch, the base stands
        return base, True
    return apply_patch(base, removed, added, keys), False
