"""Versioned corpora: snapshot diffs, overlays, delta patches, refresh policies.

Snapshots are section tables keyed by citation; every operator is a join on keys, never a scan
of pairs. Rows that a strict import would refuse come out as error rows, so that one bad row
does not stop a cluster job; ``require_none`` turns them into an exception.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import natural_key, percent

#: Compared fields, in the order in which changes are named.
CHANGE_ORDER = ("location", "identifier", "heading", "status", "sourceUrl", "content")


def require_none(errors: DataFrame) -> None:
    """Raises with the first error row, if there is one."""
    first = errors.limit(1).collect()
    if first:
        raise ValueError(f"refused: {first[0].asDict(recursive=True)}")


def section_key(citation: Column, citations: Column, ident: Column) -> Column:
    """Citation, else the citations joined in their order, else the id; lower-cased."""
    joined = F.array_join(citations, "|")
    return F.lower(F.coalesce(F.nullif(citation, F.lit("")), F.nullif(joined, F.lit("")), ident))


def diff_sections(before: DataFrame, after: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """``key, change, changes, status_before, status_after``: added, removed and changed keys.

    ``fields`` are expressions over the snapshot's columns by name of change; both sides have a
    unique ``key``. Unchanged keys give no row; content is compared null-safe.
    """
    names = list(fields)
    side = lambda df, p: df.select("key", *(c.alias(f"{p}_{n}") for n, c in fields.items()), F.lit(True).alias(f"{p}_in"))
    both = side(before, "b").join(side(after, "a"), "key", "full")
    differ = F.filter(F.array(*(F.when(~F.col(f"b_{n}").eqNullSafe(F.col(f"a_{n}")), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    change = F.when(F.col("b_in").isNull(), "added").when(F.col("a_in").isNull(), "removed").when(F.size("changes") > 0, "changed")
    out = both.withColumn("changes", differ).withColumn("change", change).where(F.col("change").isNotNull())
    status = [F.col(f"{p}_status").alias(f"status_{x}") for p, x in (("b", "before"), ("a", "after"))] if "status" in fields else []
    return out.select("key", "change", F.when(F.col("change") == "changed", F.col("changes")).otherwise(F.array().cast("array<string>")).alias("changes"), *status)


def duplicate_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row of counts by kind of change."""
    has = lambda name: F.count_if((F.col("change") == "changed") & F.array_contains("changes", name))
    return diff.agg(
        *(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")),
        has("location").alias("moved"), has("status").alias("status_transitions"), has("content").alias("content_changed"),
    )


def status_transitions(diff: DataFrame) -> DataFrame:
    return diff.where((F.col("change") == "changed") & F.array_contains("changes", "status")).groupBy("status_before", "status_after").agg(F.count("*").alias("n"))


def metadata(sections: DataFrame, keys: list[str], fields: Mapping[str, Column]) -> DataFrame:
    """What a snapshot's sections say of their titles or chapters: one row a key, ``fields`` are
    aggregates."""
    return sections.groupBy(*keys).agg(*(c.alias(n) for n, c in fields.items()))


def diff_metadata(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys (unique on both sides) that were added, removed or changed, with the changed fields
    in their order: ``*keys, change, changes``."""
    side = lambda d, p: d.select(*keys, F.struct(*fields).alias(p))
    both = side(before, "b").join(side(after, "a"), keys, "full")
    names = F.array_compact(F.array(*(F.when(F.col("b").isNotNull() & F.col("a").isNotNull() & ~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(names) > 0, "changed")
    return both.select(*keys, change.alias("change"), names.alias("changes")).where("change is not null")


# The keys under which an entity holds what its references resolve to.
RESOLUTION_KEYS = ("resolution", "authorityResolution")


def resolution_split(body: Column) -> Column:
    """Two SHA-256 of a JSON document, ``content`` without the resolutions at any depth and
    ``resolution`` of them alone by their paths, over JSON with sorted keys; null stays null.

    Documents are of any shape, so they are read in Arrow batches.
    """

    def digest(value: object) -> str:
        return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def split(value: object, path: str, found: list) -> object:
        if isinstance(value, list):
            return [split(x, f"{path}/{i}", found) for i, x in enumerate(value)]
        if not isinstance(value, dict):
            return value
        found += [[f"{path}/{k}", x] for k, x in value.items() if k in RESOLUTION_KEYS]
        return {k: split(x, f"{path}/{k}", found) for k, x in value.items() if k not in RESOLUTION_KEYS}

    def run(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for text in bodies:
            found: list = []
            out.append((None, None) if text is None else (digest(split(json.loads(text), "", found)), digest(sorted(found, key=lambda x: x[0]))))
        return pd.DataFrame(out, columns=["content", "resolution"])

    return F.pandas_udf(run, "content string, resolution string")(body)


def hash_diff(before: DataFrame, after: DataFrame, samples: int = 50) -> DataFrame:
    """Changes of an entity table by id with a content and a resolution hash: ``id, change`` and
    ``sample`` (the first ``samples`` ids of a kind are shown in a report)."""
    both = before.select("id", F.col("content").alias("bc"), F.col("resolution").alias("br"), F.lit(1).alias("b")).join(
        after.select("id", F.col("content").alias("ac"), F.col("resolution").alias("ar"), F.lit(1).alias("a")), "id", "full"
    )
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("bc").eqNullSafe(F.col("ac")), "changed").when(~F.col("br").eqNullSafe(F.col("ar")), "resolution")
    d = both.select("id", change.alias("change")).where(F.col("change").isNotNull())
    # few rows per kind, so the limit is taken before the shuffle and the join is a broadcast
    first = d.withColumn("nth", F.row_number().over(Window.partitionBy("change").orderBy("id"))).where(F.col("nth") <= samples)
    return d.join(F.broadcast(first.select("id", F.lit(True).alias("sample"))), "id", "left").select("id", "change", F.coalesce("sample", F.lit(False)).alias("sample"))


# overlays ---------------------------------------------------------------------------------


def is_placeholder(kind: Column, status: Column, citations: Column, body: Column) -> Column:
    """A reserved group of several citations whose text says nothing but that."""
    return (
        (kind == "group") & (status == "reserved") & (F.size(citations) > 1)
        & (F.lower(F.trim(F.get(body, F.lit(0)))) == "reserved for future use.")
        & F.forall(F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0))), lambda x: F.lower(F.trim(x)).rlike("^note:"))
    )


def overlay_matches(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay rows and the base rows of their chapter that share a citation, one row a pair.

    Citations are exploded on both sides and joined, so a chapter's rows never meet pairwise.
    """
    b = base.select("chapter_id", F.col("id").alias("base_id"), F.explode("citations").alias("c"))
    o = overlay.select("chapter_id", F.col("id").alias("overlay_id"), F.explode("citations").alias("c"))
    return o.join(b, ["chapter_id", "c"]).groupBy("chapter_id", "overlay_id", "base_id").agg(F.count("*").alias("shared"))


def classify_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """What each overlay row does: ``chapter_id, overlay_id, mode, kind, presentation, error``
    and ``base_ids`` (sorted), ``primary_id``.

    One base row: it is replaced if the citations are equal or it is a reserved placeholder.
    Several: replaced together if none is equal, they are disjoint and make up the overlay's
    set; or one is equal and the others are placeholders. Anything else is an error, as are no
    citations and a base citation claimed twice.
    """
    b = base.select("chapter_id", F.col("id").alias("base_id"), F.col("citations").alias("bc"), is_placeholder(F.col("kind"), F.col("status"), F.col("citations"), F.col("body")).alias("placeholder"), (F.col("status") == "reserved").alias("reserved"))
    o = overlay.select("chapter_id", F.col("id").alias("overlay_id"), F.col("citations").alias("oc"), F.col("status").alias("o_status"))
    m = overlay_matches(base, overlay).join(b, ["chapter_id", "base_id"])
    m = m.join(o.select("chapter_id", "overlay_id", "oc"), ["chapter_id", "overlay_id"])
    exact = (F.size("bc") == F.size("oc")) & (F.size(F.array_except("bc", "oc")) == 0)
    m = m.withColumn("exact", exact)
    g = m.groupBy("chapter_id", "overlay_id").agg(
        F.count("*").alias("n"), F.count_if("exact").alias("n_exact"), F.bool_and(F.col("exact") | F.col("placeholder")).alias("rest_placeholders"),
        F.bool_or("placeholder").alias("any_placeholder"), F.sum(F.size("bc")).alias("n_base"), F.sum("shared").alias("n_shared"),
        F.sort_array(F.collect_list("base_id")).alias("base_ids"), F.min(F.when(F.col("exact"), F.col("base_id"))).alias("exact_id"),
        F.bool_and("reserved").alias("all_reserved"), F.bool_or(F.col("exact") & F.col("reserved")).alias("exact_reserved"),
    )
    d = o.join(g, ["chapter_id", "overlay_id"], "left")
    # disjoint and covering: every base citation is shared, once, and together they are the set
    aggregate = (F.col("n_exact") == 0) & (F.col("n_base") == F.col("n_shared")) & (F.col("n_base") == F.size("oc"))
    mode = (
        F.when(F.size("oc") == 0, "error").when(F.col("n").isNull(), "addition")
        .when(F.col("n") == 1, F.when((F.col("n_exact") == 1) | F.col("any_placeholder"), "single").otherwise("error"))
        .when(aggregate, "aggregate").when((F.col("n_exact") == 1) & F.col("rest_placeholders"), "single").otherwise("error")
    )
    error = (
        F.when(F.size("oc") == 0, "no citation")
        .when((F.col("n") == 1) & (F.col("mode") == "error"), "ambiguous partial group")
        .when(F.col("mode") == "error", "matches multiple provisions")
    )
    kind = F.when(F.col("mode") == "addition", "addition").when(F.col("mode") != "error", "replacement")
    reserved = F.when(F.col("mode") == "aggregate", F.col("all_reserved")).when(F.col("exact_id").isNotNull(), F.col("exact_reserved")).otherwise(F.col("all_reserved"))
    shown = F.when(F.col("o_status") == "repealed", "repealed").when((F.col("mode") == "addition") | reserved, "new").otherwise("amended")
    return d.withColumn("mode", mode).select(
        "chapter_id", "overlay_id", "mode", kind.alias("kind"), F.when(F.col("mode") != "error", shown).alias("presentation"), error.alias("error"),
        F.coalesce("base_ids", F.array().cast("array<string>")).alias("base_ids"), F.coalesce("exact_id", F.get("base_ids", F.lit(0))).alias("primary_id"),
    )


def overlay_changes(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """The change list of an edition: ``chapter_id, overlay_id, kind, presentation`` and
    ``previous``, the sections that a row replaces (all of an aggregate's, else the primary
    one, none for an addition) in order of their ids. Rows in error are no changes."""
    found = classify_overlay(base, overlay).where("mode <> 'error'")
    replaced = F.when(F.col("mode") == "aggregate", F.col("base_ids")).when(F.col("mode") == "single", F.array("primary_id")).otherwise(F.array().cast("array<string>"))
    d = found.select("chapter_id", "overlay_id", "kind", "presentation", replaced.alias("ids"))
    section = F.struct(F.col("id"), *(c for c in base.columns if c not in ("chapter_id", "id")))
    before = d.select("chapter_id", "overlay_id", F.explode("ids").alias("id")).join(base, ["chapter_id", "id"])
    before = before.groupBy("chapter_id", "overlay_id").agg(F.array_sort(F.collect_list(section)).alias("previous"))
    none = F.array().cast(before.schema["previous"].dataType)
    return d.join(before, ["chapter_id", "overlay_id"], "left").select("chapter_id", "overlay_id", "kind", "presentation", F.coalesce("previous", none).alias("previous"))


def claimed_twice(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base citations that several overlay rows replace."""
    o = overlay.select("chapter_id", F.col("id").alias("overlay_id"), F.explode("citations").alias("c"))
    b = base.select("chapter_id", F.col("id").alias("base_id"), F.explode("citations").alias("c"))
    return o.join(b, ["chapter_id", "c"]).groupBy("chapter_id", "base_id", "c").agg(F.countDistinct("overlay_id").alias("n")).where("n > 1")


def apply_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """The consolidated sections: untouched base rows, overlay rows, and what is left of
    placeholders (new id, one citation makes it a section). Sorted by ``sort_key`` on demand;
    a base row is never dropped because an overlay lacks it."""
    o = overlay.select("chapter_id", F.explode("citations").alias("c")).distinct().withColumn("taken", F.lit(True))
    touched = base.select("chapter_id", F.col("id").alias("id"), F.posexplode("citations").alias("pos", "c")).join(o, ["chapter_id", "c"], "left")
    left = touched.groupBy("chapter_id", "id").agg(
        F.count_if("taken").alias("n_taken"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("taken").isNull(), F.struct("pos", "c")))), lambda x: x["c"]).alias("remaining"),
    )
    b = base.join(left, ["chapter_id", "id"], "left")
    kept = b.where(F.coalesce("n_taken", F.lit(0)) == 0).select(*base.columns)
    shrunk = b.where((F.col("n_taken") > 0) & (F.size("remaining") > 0))
    one = F.size("remaining") == 1
    residual = {
        "id": F.concat(F.when(one, "section-").otherwise("group-"), F.regexp_replace(F.lower(F.array_join("remaining", "-")), "[^a-z0-9]+", "-")),
        "kind": F.when(one, "section").otherwise("group"),
        "citations": F.col("remaining"),
    }
    shrunk = shrunk.select(*((residual.get(c, F.col(c))).alias(c) for c in base.columns))
    out = kept.withColumn("origin", F.lit("base")).unionByName(overlay.select(*base.columns).withColumn("origin", F.lit("overlay")))
    out = out.unionByName(shrunk.withColumn("origin", F.lit("residual")))
    return out.withColumn("sort_key", natural_key(F.coalesce(F.get("citations", F.lit(0)), F.col("id"))))


def merge_new_chapters(chapters: DataFrame, extra: DataFrame) -> DataFrame:
    """Chapters and those of an edition that are new by id and by number."""
    new = extra.join(chapters.select("id"), "id", "left_anti").join(chapters.select(F.regexp_replace(F.lower("number"), "^0+(?=\\d)", "").alias("k")), F.regexp_replace(F.lower(extra["number"]), "^0+(?=\\d)", "") == F.col("k"), "left_anti")
    return chapters.unionByName(new)


def derive_patch(base: DataFrame, current: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Removed keys and documents of a delta: rows that are not deeply equal on both sides."""
    body = [c for c in base.columns if c not in keys]
    packed = lambda df, name: df.select(*keys, F.struct(*body).alias(name))
    both = packed(base, "b").join(packed(current, "c"), keys, "full")
    removed = both.where(F.col("b").isNotNull() & ~F.col("b").eqNullSafe(F.col("c"))).select(*keys)
    added = both.where(F.col("c").isNotNull() & ~F.col("b").eqNullSafe(F.col("c"))).select(*keys, "c.*")
    return removed, added


def apply_patch(base: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(removed, keys, "left_anti").unionByName(added)


# policies ---------------------------------------------------------------------------------

# Limits of the corpus and secondary refresh policies, version 1.0.0.
CORPUS_POLICY = {
    "maxTitleCountDelta": 0, "maxTitleMembershipChanges": 0, "maxTitleMetadataChanges": 10,
    "maxChapterCountDeltaPercent": 5, "maxChapterMembershipChangesPercent": 5, "maxChapterMetadataChangesPercent": 10,
    "maxProvisionCountDeltaPercent": 5, "maxAddedProvisionsPercent": 5, "maxRemovedProvisionsPercent": 2, "maxChangedProvisionsPercent": 35,
}
SECONDARY_POLICY = {
    "minimumCounts": {"infractions": 1300, "feeRules": 8, "indexHeadings": 4000, "indexItems": 150000},
    "maximumRemovalPercent": {"infractions": 5, "feeRules": 0, "indexHeadings": 5, "indexEntries": 5},
    "minimumResolutionPercent": {"infractions": 90, "feeRuleReferences": 85, "indexReferences": 95},
}


def read_policy(text: str) -> dict:
    policy = json.loads(text)
    if policy.get("schemaVersion") != "1.0.0":
        raise ValueError("unsupported policy schemaVersion")
    return policy


def checks(report: DataFrame, rows: list[tuple[str, Column, float, bool]]) -> DataFrame:
    """``name, actual, limit, passed`` for each (name, expression, limit, whether a maximum)
    over a one-row report."""
    made = [F.struct(F.lit(n).alias("name"), c.cast("double").alias("actual"), F.lit(float(x)).alias("limit"), F.when(F.lit(is_max), c <= x).otherwise(c >= x).alias("passed")) for n, c, x, is_max in rows]
    return report.select(F.inline(F.array(*made)))


def corpus_checks(report: DataFrame, policy: Mapping[str, float] = CORPUS_POLICY) -> DataFrame:
    """The ten limits of a corpus refresh; percentages are of the counts before."""
    c = F.col
    delta = lambda x: F.abs(c(f"{x}_after") - c(f"{x}_before"))
    member = lambda x: c(f"{x}_added") + c(f"{x}_removed")
    of = lambda x, total: percent(x, c(f"{total}_before"))
    return checks(report, [
        ("Title count delta", delta("titles"), policy["maxTitleCountDelta"], True),
        ("Title additions and removals", member("titles"), policy["maxTitleMembershipChanges"], True),
        ("Title metadata changes", c("titles_changed"), policy["maxTitleMetadataChanges"], True),
        ("Chapter count delta", of(delta("chapters"), "chapters"), policy["maxChapterCountDeltaPercent"], True),
        ("Chapter additions and removals", of(member("chapters"), "chapters"), policy["maxChapterMembershipChangesPercent"], True),
        ("Chapter metadata changes", of(c("chapters_changed"), "chapters"), policy["maxChapterMetadataChangesPercent"], True),
        ("Provision count delta", of(delta("provisions"), "provisions"), policy["maxProvisionCountDeltaPercent"], True),
        ("Added provisions", of(c("provisions_added"), "provisions"), policy["maxAddedProvisionsPercent"], True),
        ("Removed provisions", of(c("provisions_removed"), "provisions"), policy["maxRemovedProvisionsPercent"], True),
        ("Changed provisions", of(c("provisions_changed"), "provisions"), policy["maxChangedProvisionsPercent"], True),
    ])


def secondary_checks(report: DataFrame, policy: Mapping = SECONDARY_POLICY) -> DataFrame:
    """The eleven limits of a secondary-source refresh."""
    c = F.col
    rows = [(f"{n} count", c(f"{n}_after"), x, False) for n, x in policy["minimumCounts"].items()]
    rows += [(f"{n} removals", percent(c(f"{n}_removed"), c(f"{n}_before")), x, True) for n, x in policy["maximumRemovalPercent"].items()]
    rows += [(f"{n} resolution", percent(c(f"{n}_resolved"), c(f"{n}_total")), x, False) for n, x in policy["minimumResolutionPercent"].items()]
    return checks(report, rows)


def gate(found: DataFrame) -> DataFrame:
    """One row: whether all checks passed, and how many did not."""
    return found.agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def corpus_report(before: DataFrame, after: DataFrame, diff: DataFrame) -> DataFrame:
    """One row of counts before and after, memberships and changes for ``corpus_checks``.

    Titles and chapters are compared by what their sections say of them: name, number and
    address where the snapshots have such columns, and a chapter's number of sections. Every
    part is one row, so the joins below are of single rows.
    """
    out = None
    levels = {
        "titles": (["title_number"], {c: F.min(c) for c in ("title_name",) if c in before.columns and c in after.columns}),
        "chapters": (["title_number", "chapter_id"], {c: F.min(c) for c in ("chapter_number", "chapter_name", "chapter_url") if c in before.columns and c in after.columns} | {"sections": F.count("*")}),
    }
    for name, (keys, fields) in levels.items():
        fields = fields or {"sections": F.lit(1)}
        b, a = metadata(before, keys, fields), metadata(after, keys, fields)
        changes = diff_metadata(b, a, keys, list(fields))
        row = changes.agg(*(F.count_if(F.col("change") == c).alias(f"{name}_{c}") for c in ("added", "removed", "changed")))
        row = row.crossJoin(b.agg(F.count("*").alias(f"{name}_before"))).crossJoin(a.agg(F.count("*").alias(f"{name}_after")))
        out = row if out is None else out.crossJoin(row)
    out = out.crossJoin(before.agg(F.count("*").alias("provisions_before"))).crossJoin(after.agg(F.count("*").alias("provisions_after")))
    return out.crossJoin(diff_summary(diff).select(*(F.col(x).alias(f"provisions_{x}") for x in ("added", "removed", "changed"))))
