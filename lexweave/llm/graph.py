"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, root`` for every node of ``edges`` (long ``a``, ``b``): root is the least node.

    Each round replaces edges by edges to the least neighbour (Kiveris et al., "Connected
    Components in MapReduce and Beyond"). Minima are taken by partial aggregation and joined
    back, so no neighbourhood is ever gathered; each round's edges go to the shared folder,
    which cuts the lineage. Ends when a round changes nothing, and raises if that takes more
    than ``max_rounds``. Loops and null ends are ignored; no edges give no rows.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct())
    seen = _state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = checkpointed(_small_star(_large_star(now)))
        state = _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )


def with_least(members: DataFrame, value: str, name: str, parts: int = 16) -> DataFrame:
    """``members`` (``node, root`` and ``value``) with ``name``, the least value under each root.

    A root may have a large share of all members, so that the join back is dealt over ``parts``
    keys a root; the other side has one row a root and key.
    """
    least = members.groupBy("root").agg(F.min(value).alias(name)).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    part = F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")
    return members.withColumn("__part", part).join(least, ["root", "__part"]).drop("__part")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(r)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the least in the node's neighbourhood."""
    least = edges.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
    # a node without a smaller neighbour is its own least
    linked = edges.join(least, F.col("u") == F.col("n"), "left").select("v", F.coalesce("m", "u").alias("u"))
    return linked.unionByName(edges.join(least, F.col("v") == F.col("n")).where("u = m").select("v", "u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, point to the least of them."""
    least = edges.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
    moved = edges.join(least, F.col("v") == F.col("n")).where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionByName(least.select(F.col("n").alias("v"), F.col("m").alias("u"))).distinct()
