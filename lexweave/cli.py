"""Command line: ``python -m lexweave.cli COMMAND ...``.

Snapshots are Parquet folders of sections with ``id, citation, citations, heading, text, status,
title_number, chapter_id, chapter_number`` (and ``supplement_year`` for search filters), as
``import`` publishes them; secondary snapshots have ``kind, id, content, resolution``. A command
exits 1 on an error, a failed check or a failed gate.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.query import Options
from lexweave.operators import jsonschema, reports, search, validate, versions
from lexweave.session import build_session
from lexweave.sources import artifacts, imports

FIELDS = {"location": "chapter_id", "identifier": "id", "heading": "heading", "status": "status", "content": "text"}


def _keyed(spark: SparkSession, path: str, titles: str | None) -> DataFrame:
    d = spark.read.parquet(path)
    if titles:
        d = d.where(F.col("title_number").isin(*titles.split(",")))
    return d.withColumn("key", versions.section_key(F.col("citation"), F.col("citations"), F.col("id")))


def _report(errors: DataFrame, title: str) -> int:
    """Prints error rows; 1 if there are any."""
    if errors.isEmpty():
        return 0
    print(reports.markdown_table(errors, title))
    return 1


def _search(spark: SparkSession, a: argparse.Namespace) -> int:
    found = search.search(spark.read.parquet(a.data), a.query, Options(field=a.field, sort=a.sort), a.limit)
    print(reports.markdown_table(found.select("citation", "heading", "score", "matched_fields"), a.query, a.limit))
    return 0


def _import(spark: SparkSession, a: argparse.Namespace) -> int:
    print(imports.import_titles(spark, a.input, a.output))
    return 0


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Unique keys of a snapshot; with a schema, the JSON files of a folder against it."""
    if a.schema is None:
        return _report(versions.duplicate_keys(_keyed(spark, a.data, None), "key"), "Duplicate keys")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(a.data).select(F.col("_metadata.file_path").alias("path"), "value")
    schema = "\n".join(r.value for r in spark.read.option("wholetext", True).text(a.schema).collect())  # one file
    return _report(jsonschema.invalid_documents(files, "path", "value", schema), "Schema errors")


def _diff(spark: SparkSession, a: argparse.Namespace) -> int:
    """Changes between snapshots; ``gate`` also holds them against a policy."""
    before, after = _keyed(spark, a.before, a.titles), _keyed(spark, a.after, a.titles)
    for d in (before, after):
        versions.require_none(versions.duplicate_keys(d, "key"))
    diff = versions.diff_sections(before, after, {k: F.col(c) for k, c in FIELDS.items()})
    if a.output:
        diff.write.mode("overwrite").parquet(a.output)
    print(reports.markdown_table(versions.diff_summary(diff), "Summary"))
    if a.command == "diff":
        return 0
    policy = versions.CORPUS_POLICY if a.policy is None else versions.CORPUS_POLICY | versions.read_policy(_text(a.policy))
    checks = versions.corpus_checks(versions.corpus_report(before, after, diff), policy)
    print(reports.markdown_table(checks, "Checks"))
    return 0 if versions.gate(checks).first()["passed"] else 1


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _diff_secondary(spark: SparkSession, a: argparse.Namespace) -> int:
    named = lambda p: spark.read.parquet(p).select(F.concat_ws(":", "kind", "id").alias("id"), "content", "resolution")
    diff = versions.hash_diff(named(a.before), named(a.after))
    if a.output:
        diff.write.mode("overwrite").parquet(a.output)
    counts = diff.groupBy(F.substring_index("id", ":", 1).alias("kind"), "change").agg(F.count("*").alias("n"))
    print(reports.markdown_table(counts.orderBy("kind", "change"), "Changes"))
    print(reports.markdown_table(diff.where("sample").orderBy("change", "id").select("change", "id"), "Samples", 250))
    return 0


def _overlay(spark: SparkSession, a: argparse.Namespace) -> int:
    """Consolidates an edition with its base and publishes sections and the search patch."""
    base, overlay = spark.read.parquet(a.base), spark.read.parquet(a.edition)
    versions.require_none(versions.claimed_twice(base, overlay))
    versions.require_none(versions.classify_overlay(base, overlay).where("kind is null"))
    current = versions.apply_overlay(base, overlay).select(*base.columns)
    removed, added = versions.derive_patch(base, current, a.keys.split(","))
    root = a.output.rstrip("/")
    for name, d in (("sections", current), ("removed", removed), ("added", added)):
        artifacts.publish(d, f"{root}/{name}")
    print(reports.markdown_table(versions.classify_overlay(base, overlay).groupBy("mode").count(), "Overlay"))
    return 0


def _check_edition(spark: SparkSession, a: argparse.Namespace) -> int:
    """A published edition against what its base and overlay give again."""
    parts = [artifacts.current(spark, f"{a.published.rstrip('/')}/{n}") for n in ("sections", "removed", "added")]
    return _report(validate.overlay_errors(spark.read.parquet(a.base), spark.read.parquet(a.edition), *parts, a.keys.split(",")), "Edition errors")


# command: (function, required options, optional options with defaults)
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], int], tuple[str, ...], dict]] = {
    "search": (_search, ("data", "query"), {"field": "statute", "sort": "relevance", "limit": 50}),
    "import": (_import, ("input", "output"), {}),
    "validate": (_validate, ("data",), {"schema": None}),
    "diff": (_diff, ("before", "after"), {"titles": None, "output": None}),
    "gate": (_diff, ("before", "after"), {"titles": None, "output": None, "policy": None}),
    "diff-secondary": (_diff_secondary, ("before", "after"), {"output": None}),
    "overlay": (_overlay, ("base", "edition", "output"), {"keys": "chapter_id,id"}),
    "check-edition": (_check_edition, ("base", "edition", "published"), {"keys": "chapter_id,id"}),
}


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, required, optional) in COMMANDS.items():
        p = commands.add_parser(name)
        for x in required:
            p.add_argument(f"--{x}", required=True)
        for x, default in optional.items():
            p.add_argument(f"--{x}", default=default, type=type(default) if default is not None else str)
    a = parser.parse_args(argv)
    try:
        return COMMANDS[a.command][0](spark or build_session("lexweave-cli"), a)
    except Exception as error:  # noqa: BLE001 - a command reports what it cannot do
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
