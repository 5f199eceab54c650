"""Subject index, navigation and federated quick search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_of(query: str) -> list[str]:
    return query.strip().lower().split()


def has_all(text: Column, words: list[str]) -> Column:
    """Every word is a substring of the lower-cased text; no word, no match."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(Column.__and__, (F.contains(low, F.lit(w)) for w in words)) if words else F.lit(False)


def label_score(label: Column, query: str) -> Column:
    q, low = query.strip().lower(), F.lower(label)
    return F.when(low == q, 0).when(F.startswith(low, F.lit(q)), 1).otherwise(2)


def topic_search(topics: DataFrame, entries: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Headings (score 0 or 1) before entries (2 if the text starts with the query, else 3), then
    topic position and entry id; every row has the ``total`` before the limit of the report."""
    q, words = query.strip().lower(), words_of(query)
    heads = topics.where(has_all(F.col("label"), words)).select("topic_id", "position", F.lit("").alias("entry_id"), F.when(F.lower("label") == q, 0).otherwise(1).alias("score"))
    found = entries.where(has_all(F.col("text"), words)).join(topics.select("topic_id", "position"), "topic_id")
    found = found.select("topic_id", "position", "entry_id", F.when(F.startswith(F.lower("text"), F.lit(q)), 2).otherwise(3).alias("score"))
    both = heads.unionByName(found)
    top = both.orderBy("score", "position", "entry_id").limit(limit)
    return top.crossJoin(both.agg(F.count("*").alias("total"))).withColumn("truncated", F.col("total") > limit)  # one row


def entry_search(entries: DataFrame, query: str, limit: int = 100) -> DataFrame:
    return entries.where(has_all(F.col("text"), words_of(query))).orderBy("topic_id", "ordinal").limit(limit)


def entry_groups(entries: DataFrame) -> DataFrame:
    """Adds ``grp``: an entry of level 0, or a topic's first, starts a new group."""
    w = Window.partitionBy("topic_id").orderBy("ordinal")
    starts = F.when((F.coalesce(F.col("level"), F.lit(0)) == 0) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return entries.withColumn("__starts", starts).withColumn("grp", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def subheading_match(entries: DataFrame, subheading: str) -> DataFrame:
    """Per topic the first entry of the best of six tiers: level 0 equal, level 0 prefix, equal,
    prefix, level 0 contains, contains."""
    target, text = subheading.strip().lower(), F.lower(F.trim(F.coalesce("text", F.lit(""))))
    top = F.coalesce(F.col("level"), F.lit(0)) == 0
    equal, prefix, inside = text == target, F.startswith(text, F.lit(target)), F.contains(text, F.lit(target))
    tier = F.when(top & equal, 1).when(top & prefix, 2).when(equal, 3).when(prefix, 4).when(top & inside, 5).when(inside, 6)
    d = entries.withColumn("tier", tier).where(F.col("tier").isNotNull() & F.lit(bool(target)))
    best = d.groupBy("topic_id").agg(F.min_by(F.struct("ordinal", "text", "tier"), F.struct("tier", "ordinal")).alias("x"))
    return best.select("topic_id", "x.*")


def navigation_matches(titles: DataFrame, chapters: DataFrame, query: str, title_limit: int = 2, chapter_limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """Best titles and chapters by number and names: exact, prefix, else; then by label text."""
    words = words_of(query)
    t = titles.where(has_all(F.concat_ws(" ", "number", "name"), words)).select(F.lit("Title").alias("kind"), F.concat(F.lit("Title "), F.col("number")).alias("label"), F.col("name").alias("subtitle"), label_score(F.col("number"), query).alias("score"))
    c = chapters.where(has_all(F.concat_ws(" ", "number", "name", "title_number", "title_name"), words)).select(
        F.lit("Chapter").alias("kind"), F.concat(F.lit("Chapter "), F.col("number")).alias("label"), F.concat("name", F.lit(" · Title "), "title_number").alias("subtitle"), label_score(F.col("number"), query).alias("score")
    )
    return t.orderBy("score", "label").limit(title_limit), c.orderBy("score", "label", "subtitle").limit(chapter_limit)


def infraction_matches(entries: DataFrame, query: str, limit: int = 3) -> DataFrame:
    found = entries.where(has_all(F.concat_ws(" ", "citation", "description", "category"), words_of(query)))
    found = found.withColumn("score", label_score(F.col("citation"), query)).orderBy("score", "citation").limit(limit)
    return found.select(F.lit("Infraction").alias("kind"), F.concat(F.lit("Sec. "), F.col("citation")).alias("label"), F.concat("description", F.lit(" · "), "category").alias("subtitle"), "score")


def infraction_list(entries: DataFrame, category: str, query: str = "", limit: int = 150) -> DataFrame:
    """The first ``limit`` entries of a category, in their ``position``, whose citation or
    description has every word (a page of a list; no word, all entries)."""
    words = words_of(query)
    found = entries.where(F.col("category") == category)
    if words:
        found = found.where(has_all(F.concat_ws(" ", "citation", "description"), words))
    return found.orderBy("position").limit(limit)


def statute_matches(results: DataFrame, limit: int = 5) -> DataFrame:
    """Quick-search rows of the first search results (with their ``rank``)."""
    shown = F.coalesce("citation", F.array_join("citations", "–"))
    supplement = F.when(F.col("supplement_year").isNotNull(), F.concat(F.lit(" · "), F.col("supplement_year"), F.lit(" Supp."))).otherwise("")
    subtitle = F.concat("heading", F.lit(" · Title "), "title_number", F.lit(", Chapter "), "chapter_number", supplement)
    return results.orderBy("rank").limit(limit).select(F.lit("Section").alias("kind"), F.concat(F.lit("Sec. "), shown).alias("label"), subtitle.alias("subtitle"), "rank")


def index_matches(topics: DataFrame, entries: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """Quick-search rows of the subject index: a heading with its number of entries, or an entry
    under its heading."""
    top = topic_search(topics, entries, query, limit).drop("total", "truncated")
    sizes = entries.join(F.broadcast(top.select("topic_id").distinct()), "topic_id", "left_semi").groupBy("topic_id").agg(F.count("*").alias("n"))
    d = top.join(topics.select("topic_id", "label"), "topic_id").join(sizes, "topic_id", "left").join(entries.select("topic_id", "entry_id", "text"), ["topic_id", "entry_id"], "left")
    heading = F.concat(F.lit("Subject heading · "), F.format_number(F.coalesce("n", F.lit(0)), 0), F.lit(" entries"))
    return d.select(F.lit("Index").alias("kind"), "label", F.coalesce("text", heading).alias("subtitle"), "score", "position", "entry_id")


def letter_totals(shards: DataFrame, letter: str, count: str) -> DataFrame:
    """Entries by letter from shard counts: what is no number or below zero counts as none,
    shards without a letter do not count."""
    n = F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.col(count).try_cast("bigint"), F.lit(0)))
    return shards.where(F.col(letter).isNotNull()).groupBy(F.col(letter).alias("letter")).agg(F.sum(n).alias("n"))


def by_category(entries: DataFrame, category: str, first: str) -> DataFrame:
    """Categories in order with their number of entries and the first of them by ``first``."""
    return entries.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.min(first).alias("first"))


def merged_headings(items: DataFrame, heading: str, position: str) -> DataFrame:
    """Items of headings that several files have: the heading stands where it comes first, its
    items follow in order: ``heading, at, nth`` and the item's own columns."""
    w = Window.partitionBy(heading)
    d = items.withColumns({"at": F.min(position).over(w), "nth": F.row_number().over(w.orderBy(position))})
    return d.withColumnRenamed(heading, "heading")


def omni_rows(*parts: DataFrame) -> DataFrame:
    """The parts one after another, with their rank."""
    return reduce(DataFrame.unionByName, (p.select("kind", "label", "subtitle", F.lit(i).alias("part")) for i, p in enumerate(parts)))
