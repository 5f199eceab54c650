"""Citation resolution, shards, reverse links and section context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def locations(sections: DataFrame, ordinal: str) -> DataFrame:
    """Where each citation key stands; of several rows with one key the last (by ``ordinal``)."""
    exploded = sections.select(F.explode("citations").alias("c"), "title_number", "chapter_number", "id", ordinal)
    return exploded.groupBy(F.lower("c").alias("key")).agg(F.max_by(F.struct("title_number", "chapter_number", "id"), ordinal).alias("place")).select("key", "place.*")


def resolve(references: DataFrame, places: DataFrame, key: str = "section_key", display: str = "display") -> DataFrame:
    """Adds ``status``: exact (the printed citation, stars aside, is the section key),
    section-only, unresolved, or not-applicable without a key; and the place found."""
    p = places.withColumnsRenamed({c: f"to_{c}" for c in places.columns})
    d = references.join(p, F.lower(F.col(key)) == F.col("to_key"), "left")
    printed = F.lower(F.replace(F.coalesce(display, F.lit("")), F.lit("*"), F.lit("")))
    status = (
        F.when(F.col(key).isNull() | (F.col(key) == ""), "not-applicable").when(F.col("to_key").isNull(), "unresolved")
        .when(printed == F.col("to_key"), "exact").otherwise("section-only")
    )
    return d.withColumn("status", status)


def resolution_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count("*").alias("n"))


def link_rows(infractions: DataFrame, fees: DataFrame, index: DataFrame) -> DataFrame:
    """What points to a section, one row a link: ``title_number, section, kind, id, role,
    topic_id, entry_id``. Fee links are distinct by rule and role; index links may repeat.

    Inputs have ``title_number, section`` and their own id columns. A section that very many
    links point to is as many rows, never one list.
    """
    keys, none = ["title_number", "section"], F.lit(None).cast("string")
    columns = lambda kind, **own: [*keys, F.lit(kind).alias("kind"), *(own.get(c, none).alias(c) for c in ("id", "role", "topic_id", "entry_id"))]
    out = infractions.select(*columns("infraction", id=F.col("id")))
    out = out.unionByName(fees.select(*columns("fee", id=F.col("id"), role=F.col("role"))).distinct())
    return out.unionByName(index.select(*columns("index", topic_id=F.col("topic_id"), entry_id=F.col("entry_id"))))


def link_counts(found: DataFrame) -> DataFrame:
    """Links of each kind per section, from partial counts."""
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    return found.groupBy("title_number", "section").agg(of("infraction"), of("fee"), of("index"))


def reverse_links(infractions: DataFrame, fees: DataFrame, index: DataFrame) -> DataFrame:
    """The links of a section as lists, for a shard of JSON (``link_rows`` has them as rows):
    one row per (title, section), infractions, fee rules and index entries sorted."""
    f = link_rows(infractions, fees, index)
    of = lambda kind, c: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, c)))
    return f.groupBy("title_number", "section").agg(
        of("infraction", F.col("id")).alias("infractions"), of("fee", F.struct("id", "role")).alias("fee_rules"), of("index", F.struct("topic_id", "entry_id")).alias("index_entries")
    )


def section_context(found: DataFrame, infractions: DataFrame, fees: DataFrame, entries: DataFrame) -> DataFrame:
    """What a reader sees beside a section, from link rows: ``title_number, section, kind, pos,
    id, roles, text``.

    Infractions and fee rules (``id, position, text``) once each, in the order of their
    artifact, rules with their sorted roles; index entries (``topic_id, entry_id, position,
    text``) for every link. A link to something that is not there gives no row.
    """
    keys = ["title_number", "section"]
    once = found.where("kind <> 'index'").groupBy(*keys, "kind", "id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    own = infractions.select(F.lit("infraction").alias("kind"), "id", "position", "text").unionByName(fees.select(F.lit("fee").alias("kind"), "id", "position", "text"))
    ruled = once.join(own, ["kind", "id"]).select(*keys, "kind", F.col("position").alias("pos"), "id", "roles", "text")
    listed = found.where("kind = 'index'").select(*keys, "topic_id", "entry_id").join(entries, ["topic_id", "entry_id"])
    none = F.array().cast("array<string>")
    return ruled.unionByName(listed.select(*keys, F.lit("index").alias("kind"), F.col("position").alias("pos"), F.concat_ws("/", "topic_id", "entry_id").alias("id"), none.alias("roles"), "text"))


def text_references(docs: DataFrame, places: DataFrame, pattern: str) -> DataFrame:
    """References in texts (group 1 of ``pattern``) to known sections, once per document."""
    refs = docs.select(F.col("id").alias("from_id"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda x: F.lower(x)))).alias("key"))
    return refs.join(places.select("key", F.col("id").alias("to_id")), "key").select("from_id", "key", "to_id")


def chapter_lookup(wanted: DataFrame, chapters: DataFrame) -> DataFrame:
    """The first chapter (in catalog order) with an equal comparable number, in the wanted title
    or, where none is given, in any: ``wanted, title, chapter_id``."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^0+(?=\d)", "")
    c = chapters.select(norm(F.col("number")).alias("n"), norm(F.col("title_number")).alias("t"), "chapter_id", "position")
    j = wanted.join(c, (norm(F.col("wanted")) == F.col("n")) & F.coalesce(norm(F.col("title")) == F.col("t"), F.lit(True)))
    return j.groupBy("wanted", "title").agg(F.min_by("chapter_id", "position").alias("chapter_id"))


def title_lookup(wanted: DataFrame, titles: DataFrame) -> DataFrame:
    """The first title (in catalog order) with an equal comparable number."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^0+(?=\d)", "")
    j = wanted.join(titles, norm(F.col("wanted")) == norm(F.col("number")))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("wanted").orderBy("position"))).where("rank = 1").drop("rank")


def overlay_lookup(entries: DataFrame, overlays: DataFrame) -> DataFrame:
    """Entries with their overlay by id or by comparable number, and overlays not used."""
    by_id = overlays.select(F.col("overlay_id").alias("oid"), F.col("number").alias("o_number"))
    j = entries.join(by_id, (F.col("id") == F.col("oid")), "left").drop("o_number")
    rest = entries.join(by_id, F.col("id") == F.col("oid"), "left_anti")
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^0+(?=\d)", "")
    by_number = rest.join(by_id, norm(F.col("number")) == norm(F.col("o_number")), "left").drop("o_number")
    matched = j.where("oid is not null").unionByName(by_number)
    unused = overlays.join(matched.where("oid is not null").select("oid"), F.col("overlay_id") == F.col("oid"), "left_anti")
    return matched.select("id", "number", "oid").unionByName(unused.select(F.lit(None).cast("string").alias("id"), "number", F.col("overlay_id").alias("oid")))


def pack_shards(items: DataFrame, group: str, order: str, size: Column, limit: int = 2_000_000) -> DataFrame:
    """``group, order, shard``: each group cut in order into runs of at most ``limit`` bytes; an
    item is never split, one above the limit is alone.

    The cut restarts at every overflow, so it is a fold in order: groups are dealt to tasks,
    sorted there, and streamed with two numbers of state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, shard, held = None, 0, 0
        for b in batches:
            shards = []
            for g, n in zip(b[group], b["__size"], strict=True):
                if g != now:
                    now, shard, held = g, 0, 0
                elif held and held + n > limit:
                    shard, held = shard + 1, 0
                held += n
                shards.append(shard)
            yield b[[group, order]].assign(shard=shards)

    sized = items.select(group, order, size.cast("long").alias("__size")).repartition(group).sortWithinPartitions(group, order)
    kinds = dict(sized.dtypes)
    return sized.mapInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, shard int")


def shard_name(key: Column, shard: Column, shards: Column) -> Column:
    """``key.json`` of a single shard, else ``key-01.json`` on, with two digits at least."""
    number = (shard + 1).cast("string")
    padded = F.when(F.length(number) < 2, F.concat(F.lit("0"), number)).otherwise(number)
    return F.when(shards == 1, F.concat(key, F.lit(".json"))).otherwise(F.concat(key, F.lit("-"), padded, F.lit(".json")))
