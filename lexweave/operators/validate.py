"""Validation layers: schema, references, aggregates, hashes. Each gives error rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def schema_errors(rules: dict[str, dict]) -> Column:
    """Errors of a row by JSON-Schema keywords per column: required, enum, const, minLength,
    pattern, format (date-time, uri), minimum, minItems, uniqueItems."""
    found: list[Column] = []
    for name, rule in rules.items():
        c = F.col(name)
        say = lambda bad, what, n=name: F.when(bad, F.lit(f"{n}: {what}"))
        if rule.get("required"):
            found.append(say(c.isNull(), "is required"))
        if "enum" in rule:
            found.append(say(c.isNotNull() & ~c.isin(*rule["enum"]), "is not an allowed value"))
        if "const" in rule:
            found.append(say(c.isNotNull() & (c != F.lit(rule["const"])), "is not the constant"))
        if "minLength" in rule:
            found.append(say(F.length(c) < rule["minLength"], "is too short"))
        if "pattern" in rule:
            re.compile(rule["pattern"])
            found.append(say(c.isNotNull() & ~c.rlike(rule["pattern"]), "does not match the pattern"))
        if rule.get("format") == "date-time":
            found.append(say(c.isNotNull() & F.try_to_timestamp(c).isNull(), "is not a date-time"))
        if rule.get("format") == "uri":
            found.append(say(c.isNotNull() & ~c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$"), "is not a uri"))
        if "minimum" in rule:
            found.append(say(c < rule["minimum"], "is below the minimum"))
        if "minItems" in rule:
            found.append(say(F.size(c) < rule["minItems"], "has too few items"))
        if rule.get("uniqueItems"):
            found.append(say(F.size(F.array_distinct(c)) < F.size(c), "has repeated items"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def unexpected_properties(raw: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a closed schema does not have."""
    return F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))


def orphans(child: DataFrame, parent: DataFrame, keys: list[tuple[str, str]], layer: str) -> DataFrame:
    """``layer, key, n`` of child rows whose keys are not in the parent."""
    cond = reduce(Column.__and__, (child[a] == parent[b] for a, b in keys))
    lost = child.join(parent.select(*(b for _, b in keys)).distinct(), cond, "left_anti")
    return lost.groupBy(F.concat_ws("/", *(F.col(a).cast("string") for a, _ in keys)).alias("key")).agg(F.count("*").alias("n")).select(F.lit(layer).alias("layer"), "key", "n")


def set_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows missing from, and rows unexpected in, the actual table, with their multiplicity."""
    return expected.exceptAll(actual).withColumn("problem", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("problem", F.lit("unexpected")))


def count_mismatches(actual: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Keys whose count in the manifest is not what the rows give."""
    a, m = actual.select(key, F.col("n").alias("actual")), manifest.select(key, F.col("n").alias("recorded"))
    return a.join(m, key, "full").where(~F.col("actual").eqNullSafe(F.col("recorded")))


def bounds(report: DataFrame, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """``name, value, low, high, plausible`` of a one-row report."""
    rows = [F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value"), F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high"), F.col(n).between(a, b).alias("plausible")) for n, (a, b) in limits.items()]
    return report.select(F.inline(F.array(*rows)))


def artifact_record(path: Column, body: Column) -> list[Column]:
    """``path, bytes, sha256`` of an artifact."""
    return [path.alias("path"), F.octet_length(body).cast("long").alias("bytes"), F.sha2(body.cast("binary"), 256).alias("sha256")]


def integrity_errors(artifacts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Artifacts that are missing, not recorded, or of other bytes than recorded."""
    a = artifacts.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    r = recorded.select("path", F.col("bytes").alias("rb"), F.col("sha256").alias("rs"))
    problem = F.when(F.col("s").isNull(), "missing").when(F.col("rs").isNull(), "not recorded").when(F.col("b") != F.col("rb"), "size").when(F.col("s") != F.col("rs"), "sha256")
    return a.join(r, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def overlay_errors(base: DataFrame, overlay: DataFrame, published: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """A published edition held against what its overlay gives again: ``layer, problem, key``.

    Layers: citations that two overlay rows claim, sections of the consolidation that are
    missing or unexpected, and the same for the published patch's removals and documents.
    """
    from lexweave.operators import versions

    key = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    claimed = versions.claimed_twice(base, overlay).select(F.lit("claims").alias("layer"), F.lit("claimed twice").alias("problem"), F.concat_ws("/", "chapter_id", "c").alias("key"))
    derived = versions.apply_overlay(base, overlay).select(*base.columns)
    gone, new = versions.derive_patch(base, derived, keys)
    out = claimed
    for layer, expected, actual in (
        ("sections", derived, published.select(*base.columns)),
        ("patch removals", gone, removed.select(*gone.columns)),
        ("patch documents", new, added.select(*new.columns)),
    ):
        out = out.unionByName(set_difference(expected, actual).select(F.lit(layer).alias("layer"), "problem", key.alias("key")))
    return out


def corpus_errors(catalog: DataFrame, sections: DataFrame, documents: DataFrame, artifacts: DataFrame, recorded: DataFrame) -> DataFrame:
    """A whole corpus against itself: ``layer, problem, key``, one row an error.

    ``catalog`` has ``title_id, chapter_id, path, n_sections``; ``sections`` and the search
    ``documents`` have ``title_id, chapter_id, id, heading, text``, sections also ``kind,
    citation, citations``; ``artifacts`` and ``recorded`` have ``path, bytes, sha256`` as found
    and as the manifest says. Texts meet as digests, so no text is shuffled.
    """
    chapter = F.concat_ws("/", "title_id", "chapter_id")
    place = F.concat_ws("/", "title_id", "chapter_id", "id")

    def error(d: DataFrame, layer: str, problem: str | Column, key: Column) -> DataFrame:
        return d.select(F.lit(layer).alias("layer"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"), key.alias("key"))

    def repeated(d: DataFrame, layer: str, what: str, key: Column) -> DataFrame:
        return error(d.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("n > 1"), layer, what, F.col("k"))

    have = sections.groupBy("title_id", "chapter_id").agg(F.count("*").alias("have"))
    counted = catalog.select("title_id", "chapter_id", F.col("n_sections").alias("want"), F.lit(True).alias("listed")).join(have, ["title_id", "chapter_id"], "full")
    wrong = F.when(F.col("listed").isNull(), "not in the catalog").when(~F.coalesce("have", F.lit(0)).eqNullSafe(F.col("want")), "section count")
    cited = F.size(F.coalesce("citations", F.array().cast("array<string>")))
    shape = F.when((F.col("kind") == "section") & (F.col("citation").isNull() | (cited != 1)), "a section has one citation").when((F.col("kind") == "group") & F.col("citation").isNotNull(), "a group has no citation of its own")
    digest = F.sha2(F.concat_ws("\0", F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    canonical = sections.groupBy(place.alias("k")).agg(F.min(digest).alias("canonical"))
    searched = documents.groupBy(place.alias("k")).agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    both = canonical.join(searched, "k", "full")
    stale = F.when(F.col("canonical").isNull(), "no canonical section").when(F.col("low").isNull(), "not searched").when((F.col("low") != F.col("canonical")) | (F.col("high") != F.col("canonical")), "stale")
    kept = recorded.groupBy("path").agg(F.min("bytes").alias("bytes"), F.min("sha256").alias("sha256"))
    parts = [
        repeated(catalog, "catalog", "repeated chapter", chapter), repeated(catalog, "catalog", "repeated path", F.col("path")),
        error(counted.withColumn("wrong", wrong).where("wrong is not null"), "catalog", F.col("wrong"), chapter),
        repeated(sections, "sections", "repeated section", place), error(sections.withColumn("shape", shape).where("shape is not null"), "sections", F.col("shape"), place),
        repeated(documents, "search", "repeated document", place), error(both.withColumn("stale", stale).where("stale is not null"), "search", F.col("stale"), F.col("k")),
        repeated(recorded, "artifacts", "repeated record", F.col("path")), error(integrity_errors(artifacts, kept), "artifacts", F.col("problem"), F.col("path")),
        error(catalog.join(kept, "path", "left_anti").join(artifacts, "path", "left_anti").select("path").distinct(), "artifacts", "neither found nor recorded", F.col("path")),
    ]
    return reduce(DataFrame.unionByName, parts)
