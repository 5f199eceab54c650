"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, components.

Fingerprints that differ in at most ``max_bits`` bits, cut in ``max_bits + spare`` blocks,
agree on at least ``spare`` of them; so each set of ``spare`` blocks is a key, pairs are sought
among equal keys only, and the full Hamming distance is then verified. Equal fingerprints are
one node throughout, so exact copies never meet each other. A bucket of equal keys is scanned
block by block in bounded memory and gives a spanning forest of its links instead of all
pairs; a bucket above ``bucket_limit`` is spread over all tasks through the points half-way
between two linked fingerprints, which is exact too and linear in its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.llm import shingles
from lexweave.llm.common import bound_batches, bounded_if_small, checkpointed, text_bytes
from lexweave.llm.graph import connected_components, with_least

SEED, BITS = 42, 64
#: Distinct fingerprints per key value that the number of spare blocks aims at.
BUCKET_AIM = 64
#: Fingerprints of a bucket up to which one task scans its pairs.
BUCKET_LIMIT = 4096
#: Rows from which a fingerprint's component may be broadcast, and how many fingerprints may be.
HOT_ROWS, HOT_PRINTS = 256, 10_000
#: Shingles hashed before their bits are counted.
_CHUNK = 1 << 15


def fingerprint(body: bytes, width: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = body.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)  # over half of one hash: its own bits
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for i in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i + width - 1 : i + width - 1 + _CHUNK], strict=False)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp``: each text's fingerprint as a signed long (null text: no words, 0)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(run, "doc_id bigint, fp bigint")


def spare_blocks(n: int, max_bits: int) -> int:
    """Spare blocks for ``n`` distinct fingerprints: enough key bits that a key value holds
    about ``BUCKET_AIM`` of them; more keys are the price."""
    for spare in range(1, 5):
        if n >> spare * (BITS // (max_bits + spare)) <= BUCKET_AIM:
            return spare
    return 4


def block_keys(max_bits: int, spare: int) -> list[int]:
    """A bit mask for each set of ``spare`` out of ``max_bits + spare`` blocks, as signed longs."""
    n = max_bits + spare
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    masks = [sum(blocks[i] for i in c) for c in combinations(range(n), spare)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def bucket_forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) joining the components of one bucket's distinct fingerprints.

    Each fingerprint is compared once with those not reached yet; memory is linear."""
    rest = np.sort(fps)
    a, b = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            step = max(1, (1 << 20) // len(rest))
            for i in range(0, len(front), step):
                near |= (np.bitwise_count((front[i : i + step, None] ^ rest[None, :]).view(np.uint64)) <= max_bits).any(axis=0)
            front, rest = rest[near], rest[~near]
            a.append(front)
            b.append(np.full(len(front), root))
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(fps: DataFrame, max_bits: int = 4, spare: int | None = None, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges ``a, b`` over distinct fingerprints (column ``fp``) with the components of all
    pairs at ``max_bits`` or fewer differing bits."""
    if spare is None:
        spare = spare_blocks(fps.count(), max_bits)
    masks = block_keys(max_bits, spare)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))).alias("x")).select("x.c", "x.k", "fp")
    hot = keyed.groupBy("c", "k").count().where(F.col("count") > bucket_limit).select("c", "k")
    any_hot = not hot.isEmpty()
    cold = keyed.join(hot, ["c", "k"], "left_anti") if any_hot else keyed
    edges = cold.repartition("c", "k").sortWithinPartitions("c", "k").mapInArrow(_scan(max_bits), "a bigint, b bigint")
    if any_hot:
        edges = edges.unionByName(_half_way(keyed.join(hot, ["c", "k"], "left_semi"), masks, max_bits))
    return edges


def _scan(max_bits: int):
    """Runs of equal keys of a sorted partition, one at a time across batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def emit(c: np.ndarray, k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
            bounds = [0, *cut.tolist(), len(c)]
            out = [bucket_forest(f[i:j], max_bits) for i, j in zip(bounds, bounds[1:], strict=False) if j - i > 1]
            out = [x for x in out if len(x[0])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]))], names=["a", "b"])

        for batch in batches:
            c, k, f = (np.concatenate([old, batch.column(i).to_numpy().astype(np.int64)]) for i, old in enumerate(kept))
            last = len(c)
            while last and c[last - 1] == c[-1] and k[last - 1] == k[-1]:
                last -= 1
            if last:
                yield from emit(c[:last], k[:last], f[:last])
            kept = [c[last:], k[last:], f[last:]]
        if len(kept[0]):
            yield from emit(*kept)

    return run


def _half_way(rows: DataFrame, masks: list[int], max_bits: int) -> DataFrame:
    """Links of large buckets: two fingerprints within ``2 r`` bits have a point within ``r``
    bits of both, so each is sent to the points around it (outside its key's bits) and joined
    to the least fingerprint there. For an odd ``max_bits`` the distance is verified after."""
    reach = (max_bits + 1) // 2
    flips = []
    for m in masks:
        free = [i for i in range(BITS) if not m >> i & 1]
        values = [sum(1 << i for i in c) for r in range(reach + 1) for c in combinations(free, r)]
        flips.append([v - (1 << BITS) if v >> (BITS - 1) else v for v in values])
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, x) for i, x in enumerate(flips)], T.StructType([T.StructField("c", T.IntegerType()), T.StructField("flips", T.ArrayType(T.LongType()))]))
    points = rows.join(F.broadcast(table), "c").select("c", "fp", F.explode("flips").alias("flip")).select("c", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")
    if max_bits % 2:
        raise ValueError("large buckets are exact for an even number of bits")
    least = points.groupBy("c", "point").agg(F.min("fp").alias("b"))
    return points.join(least, ["c", "point"]).where("fp > b").select(F.col("fp").alias("a"), "b").distinct()


def components(docs: DataFrame, max_bits: int = 4, width: int = 4, spare: int | None = None, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; see ``near_duplicates``."""
    prints = checkpointed(with_fingerprints(docs, width))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    linked = connected_components(links(nodes.select("fp"), max_bits, spare, bucket_limit))
    members = linked.join(nodes.withColumnRenamed("fp", "node"), "node")
    members = with_least(members, "first", "least").select(F.col("node").alias("fp"), "least", F.lit(True).alias("linked"))
    own = F.when(F.col("linked"), F.col("least")).otherwise(F.col("first"))
    found = checkpointed(nodes.join(members, "fp", "left").select("fp", "n", own.alias("component_id")))
    # fingerprints of very many rows go to the rows; there are at most HOT_PRINTS of them
    often = F.col("n") > max(HOT_ROWS, (found.agg(F.sum("n")).first()[0] or 0) // HOT_PRINTS)
    hot = F.broadcast(found.where(often).drop("n"))
    cold = prints.join(hot.select("fp"), "fp", "left_anti").join(found.where(~often).drop("n"), "fp")
    return cold.unionByName(prints.join(hot, "fp")).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like
    any other. The component is that of all fingerprints reachable over links of ``max_bits``
    or fewer differing bits (an odd number raises if a bucket is larger than ``BUCKET_LIMIT``);
    its id is the least doc_id in it, nulls aside (null if it has no other). Repeated rows repeat; an empty table gives no rows; other columns are not read.
    """
    found = components(docs, max_bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, least: float = 0.8, width: int = 5, max_bits: int = 4, **limits: int) -> DataFrame:
    """``docs`` with one row of each component of texts whose ``width``-word shingles have a
    Jaccard similarity of ``least`` or more: that with the least doc_id.

    Fingerprints of the ``width``-word shingles within ``max_bits`` bits, found by ``links``, are
    candidates; near copies at 0.8 differ in more bits than blocks can find, so the bands of
    ``shingles`` (which has the ``limits``) add those further apart. The exact similarity then
    decides about all of them. Rows of one doc_id
    with different texts are different documents. Of rows with the least doc_id in a component,
    that with the least hash of its words stays, then that with the least text (null first), of
    repeated rows any one; null doc_ids come last. Texts without words (null, empty, white
    space) are one group; columns of any name are kept; an empty table gives no rows.
    """
    rows = shingles.with_nodes(docs, "__near_node")
    found = shingles.components(docs.select("doc_id", "text"), least, width, lambda fps: links(fps, max_bits), **limits)
    # nulls are the greatest here: a row without doc_id is kept only if no row has one
    same = found.groupBy("root", "doc_id", "fp").agg(F.count("*").alias("n"))
    heads = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "n")).alias("head"))
    heads = checkpointed(heads.select(F.col("head.doc_id").alias("__near_id"), F.col("head.fp").alias("__near_fp"), F.col("head.n").alias("__near_n")))

    def kept(which: DataFrame) -> DataFrame:
        own = F.col("doc_id").eqNullSafe(F.col("__near_id")) & (F.col("__near_node") == F.col("__near_fp"))
        return rows.join(bounded_if_small(which, F.lit(32)), own, "left_semi")

    once, often = kept(heads.where("__near_n = 1")), heads.where("__near_n > 1")
    if often.isEmpty():
        return once.drop("__near_node")
    one = Window.partitionBy("doc_id", "__near_node").orderBy(F.col("text").asc_nulls_first())
    first = kept(often).withColumn("__near_row", F.row_number().over(one)).where("__near_row = 1").drop("__near_row")
    return once.unionByName(first).drop("__near_node")
