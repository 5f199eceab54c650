"""Device state as tables: recents, search history, bookmarks, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 20


def latest_per_key(log: DataFrame, user: str, key: str, at: list[Column], limit: int = LIMIT) -> DataFrame:
    """The newest record of each key, the ``limit`` newest keys of each user (the list's length
    is part of its definition), with their ``rank``.

    The newest record of a key is a partial aggregate, so only one row a key is ranked.
    """
    order = F.struct(*at)
    newest = log.groupBy(user, key).agg(F.max_by(F.struct(*log.columns), order).alias("x"), F.max(order).alias("o"))
    ranked = newest.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("o"))))
    return ranked.where(F.col("rank") <= limit).select("x.*", "rank")


def bookmarks(toggles: DataFrame, user: str, key: str, at: str) -> DataFrame:
    """Keys toggled an odd number of times, with the time of the last toggle."""
    return toggles.groupBy(user, key).agg(F.count("*").alias("n"), F.max(at).alias("since")).where("n % 2 = 1").drop("n")


def preferences(scale: Column, theme: Column) -> Column:
    """Text scale within 0.85 and 1.25, a known theme or the system's."""
    return F.struct(
        F.least(F.greatest(F.coalesce(scale, F.lit(1.0)), F.lit(0.85)), F.lit(1.25)).alias("text_scale"),
        F.when(theme.isin("light", "dark", "system"), theme).otherwise("system").alias("theme"),
    )
