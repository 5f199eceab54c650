"""Near copies by word shingles: SimHash and min-hash bands for candidates, exact Jaccard for the verdict.

Two texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is
``least`` or more. Texts of the same words are one node. Candidates are texts whose SimHash
fingerprints are within a few bits (the caller's ``near``) and, since texts at 0.8 differ in more
bits than blocks of 64 can find, texts that share a band. Texts at 0.8 share one of 32 bands of
5 min-hashes but for 3 in a million. Inside a band's bucket, 64 bytes of the min-hashes tell
the texts that are far apart (below half of them equal; at 0.8 one pair in ten million) and the
others are joined to clumps; the shingle sets of each clump are then compared exactly, one text
with those not reached yet. So every shingle set is shuffled once, whatever the number of
bands, and a large group of copies costs its size, not its square.

No task holds a group that can grow: a bucket above ``BUCKET_NODES`` is a clump as it is, by a
star around its least node, and a clump above ``CLUMP_BYTES`` stays spread over all tasks. Blocks of
bounded size of its texts are then compared with all of them, until every text outside the
clump's largest component has been in a block; a link that were missing would need two texts of
different components, so one that has been compared with everything (see ``spread_links``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import bound_batches, bounded_if_small, checkpointed, fits, stored, text_bytes
from lexweave.llm.graph import connected_components

SEED, BANDS, ROWS = 42, 32, 5
#: Min-hashes of which one byte each goes along, and how many of them have to agree.
BYTES, AGREE = 64, 32
#: Odd factors: one permutation of the hashes each.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles multiplied at a time.
_CHUNK = 1 << 10
#: Texts of a bucket that one task scans, and bytes of text of a clump that one task compares.
BUCKET_NODES, CLUMP_BYTES = 1 << 15, 16 << 20
#: Texts, and bytes of shingle hashes, of a block that is compared with a whole large clump.
BLOCK_NODES, BLOCK_BYTES = 2048, 16 << 20


def node(body: bytes) -> int:
    """Hash of a text's words as a signed long; 0 without words."""
    words = body.lower().split()
    return _signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)) if words else 0


def shingle_set(body: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    words = body.lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def sketch(shingles: np.ndarray) -> tuple[list[int], bytes]:
    """The band keys of a shingle set and the bytes that tell sets in a bucket apart."""
    mins = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        mins = np.minimum(mins, (_FACTORS[:, None] * shingles[None, i : i + _CHUNK]).min(axis=1))
    keys = [_signed(xxhash.xxh64_intdigest(mins[c * ROWS : (c + 1) * ROWS].tobytes(), c)) for c in range(BANDS)]
    return keys, (mins[:BYTES] & np.uint64(255)).astype(np.uint8).tobytes()


def simhash(shingles: np.ndarray) -> int:
    """64-bit SimHash of a shingle set as a signed long: a bit is 1 if set in over half of the
    hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), _CHUNK):
        part = shingles[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_clumps(nodes: np.ndarray, sigs: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges joining the nodes of one bucket whose bytes agree, each compared once with those
    not reached yet."""
    a, b = [], []
    while len(nodes) > 1:
        root, front = int(nodes[0]), [sigs[0]]
        nodes, sigs = nodes[1:], sigs[1:]
        while front and len(nodes):
            near = (sigs == front.pop()).sum(axis=1) >= AGREE
            if near.any():
                a.extend(nodes[near].tolist())
                b.extend([root] * int(near.sum()))
                front.extend(sigs[near])
                nodes, sigs = nodes[~near], sigs[~near]
    return a, b


def exact_links(nodes: list[int], sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Edges with the components of all pairs of one clump at ``least`` similarity or more."""
    a, b = [], []
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(codes, np.cumsum(sizes)[:-1])
    seen = np.zeros(int(codes.max()) + 1, np.int64)
    rest = np.arange(len(nodes))
    while len(rest) > 1:
        root = int(rest[0])
        front = [root]
        keep = np.arange(len(rest)) > 0
        while True:
            if not keep.all():
                codes, rest = codes[np.repeat(keep, sizes[rest])], rest[keep]
            if not front or not len(rest):
                break
            x = front.pop()
            seen[own[x]] = 1
            both = np.add.reduceat(seen[codes], np.cumsum(sizes[rest]) - sizes[rest])
            seen[own[x]] = 0
            near = both / (sizes[x] + sizes[rest] - both) >= least
            a.extend(nodes[i] for i in rest[near])
            b.extend([nodes[root]] * int(near.sum()))
            front.extend(rest[near].tolist())
            keep = ~near
    return a, b


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with an equal first column, across batches."""
    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and run[0][0] != row[0]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def with_nodes(docs: DataFrame, column: str = "node") -> DataFrame:
    """``docs`` with the hash of each text's words."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def nodes(bodies: pa.Array) -> pa.Array:
        return pa.array([node(x.as_py()) for x in bodies], pa.int64())

    return docs.withColumn(column, nodes(text_bytes()))


def _candidates(nodes: DataFrame, bucket_nodes: int) -> DataFrame:
    """Edges ``a, b`` that join all texts which may be linked to clumps; ``nodes`` has one row a
    text: ``node, keys, sig``."""
    keyed = nodes.select(F.explode("keys").alias("k"), "node")
    sizes = checkpointed(keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
    shared = keyed.join(sizes.where(F.col("n") <= bucket_nodes).select("k"), "k", "left_semi")

    def clump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(batches):
            a, b = bucket_clumps(np.array([x[1] for x in run]), np.frombuffer(b"".join(x[2] for x in run), np.uint8).reshape(-1, BYTES))
            if a:
                yield _edges(a, b)

    near = shared.join(nodes.select("node", "sig"), "node").select("k", "node", "sig")
    out = near.repartition("k").sortWithinPartitions("k", "node").mapInArrow(clump, "a bigint, b bigint")
    hot = sizes.where(F.col("n") > bucket_nodes)
    if hot.isEmpty():
        return out
    star = keyed.join(hot.select("k", "least"), "k").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return out.unionByName(star.distinct())


def _near_prints(nodes: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges ``a, b`` that join all texts (``node, print``) whose fingerprints are linked: texts
    of one fingerprint by a star around the least node, and one text of each linked fingerprint."""
    prints = checkpointed(nodes.groupBy("print").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    same = nodes.select("node", "print").join(bounded_if_small(prints.where("n > 1"), F.lit(24)), "print").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    edges, one = near(prints.select(F.col("print").alias("fp"))), prints.select("print", "least")
    a = edges.join(one.withColumnsRenamed({"print": "a", "least": "x"}), "a")
    return same.unionByName(a.join(one.withColumnsRenamed({"print": "b", "least": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def links(rows: DataFrame, docs: DataFrame, least: float = 0.8, width: int = 5, bucket_nodes: int = BUCKET_NODES, clump_bytes: int = CLUMP_BYTES, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges ``a, b`` over the nodes of ``rows`` (``node, size, print, keys, sig``) with the
    components of all pairs at ``least`` similarity or more; the texts are read from ``docs`` again.

    ``near`` gives the links of distinct fingerprints (``fp`` to ``a, b``); what they join is
    compared as well as what the bands join. Texts without words (node 0) are linked to none;
    repeated rows are one node; an empty table gives no edges. The limits only say where the work
    is done.
    """
    nodes = rows.where("node != 0").groupBy("node").agg(*(F.first(c).alias(c) for c in ("print", "keys", "sig", "size")))
    nodes = checkpointed(nodes)
    found = _candidates(nodes, bucket_nodes)
    clumps = connected_components(found if near is None else found.unionByName(_near_prints(nodes, near)))
    weighed = clumps.join(nodes.select("node", "size"), "node").groupBy("root").agg(F.sum("size").alias("size"))
    large = checkpointed(weighed.where(F.col("size") > clump_bytes).select("root"))
    any_large = not large.isEmpty()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingle_set(x.as_py(), width).tobytes() for x in b.column(2)], pa.binary())], names=["root", "node", "shingles"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(sets(batches)):
            a, b = exact_links([x[1] for x in run], [np.frombuffer(x[2], np.uint64) for x in run], least)
            if a:
                yield _edges(a, b)

    def bodies(which: DataFrame) -> DataFrame:
        """The text of each node once. Copies are dropped before a shuffle brings them together."""
        texts = with_nodes(docs.select("text")).select("node", text_bytes().alias("body"))
        one = texts.join(F.broadcast(which), "node").dropDuplicates(["node"]) if fits(which, F.lit(24)) else texts.dropDuplicates(["node"]).join(which, "node")
        return one.select("root", "node", "body")

    small = clumps.join(large, "root", "left_anti") if any_large else clumps
    out = bodies(small).repartition("root").sortWithinPartitions("root", "node").mapInArrow(exact, "a bigint, b bigint")
    if not any_large:
        return out
    spread = bodies(clumps.join(large, "root", "left_semi")).mapInArrow(sets, "root bigint, node bigint, shingles binary")
    return out.unionByName(spread_links(stored(spread, "shingle-sets"), least))


class Block:
    """Some shingle sets, by clump, for comparison with others: which sets have each shingle."""

    def __init__(self, rows: list[tuple[int, int, bytes]], least: float):
        self.least, self.clumps = least, {}
        for root in {r[0] for r in rows}:
            nodes = [n for r, n, _ in rows if r == root]
            own = [np.frombuffer(x, np.uint64) for r, _, x in rows if r == root]
            sizes = np.array([len(x) for x in own])
            members = np.repeat(np.arange(len(own)), sizes)
            flat = np.concatenate(own)
            order = np.argsort(flat, kind="stable")
            values, starts = np.unique(flat[order], return_index=True)
            group = np.arange(len(own))  # texts of one component answer for each other
            place = {n: i for i, n in enumerate(nodes)}
            for x, y in zip(*exact_links(nodes, own, least), strict=True):
                group[place[x]] = place[y]
            self.clumps[root] = (nodes, sizes, values, np.append(starts, len(flat)), members[order], group)

    def edges(self, root: int, node: int, shingles: bytes) -> list[tuple[int, int]]:
        """An edge to one text of each of the block's components that a text is linked to."""
        if root not in self.clumps:
            return []
        nodes, sizes, values, starts, members, group = self.clumps[root]
        own = np.frombuffer(shingles, np.uint64)
        at = np.searchsorted(values, own)
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == own)]
        if not len(at):
            return []
        counts = starts[at + 1] - starts[at]
        spots = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        both = np.bincount(members[spots], minlength=len(nodes))
        near = np.flatnonzero(both / (len(own) + sizes - both) >= self.least)
        found = {int(group[i]): nodes[i] for i in near if nodes[i] != node}
        return [(node, x) for x in found.values()]


def spread_links(sets: DataFrame, least: float, block_nodes: int = BLOCK_NODES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Edges ``a, b`` with the components of all pairs at ``least`` similarity or more inside
    clumps of any size (``root, node, shingles``, stored).

    Each round takes a block of texts that stand outside the largest component of their clump
    and have not been in a block, bounded in number and bytes, and compares it with every text
    of its clumps, where they lie. A family of copies is one component after the first round.
    """
    spark = sets.sparkSession
    state = checkpointed(sets.select("root", "node", F.col("node").alias("comp"), F.octet_length("shingles").alias("size"), F.lit(False).alias("asked")))
    while True:
        per = state.groupBy("root", "comp").agg(F.count("*").alias("n"))
        # the largest component needs no asking, nor does one that has been asked whole
        largest = per.groupBy("root").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"))
        todo = state.where(~F.col("asked")).join(largest, "root").where("comp <> largest")
        picked = todo.orderBy(F.xxhash64("node")).limit(block_nodes).select("node", "size").collect()  # a block
        if not picked:
            return state.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
        total, ids = 0, []
        for r in picked:
            total += r.size
            if ids and total > block_bytes:
                break
            ids.append(r.node)
        wanted = spark.createDataFrame([(i,) for i in ids], "node bigint")
        block = Block([tuple(r) for r in sets.join(F.broadcast(wanted), "node").select("root", "node", "shingles").collect()], least)

        def compare(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [e for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for e in block.edges(*row)]
                if found:
                    yield _edges([x for x, _ in found], [y for _, y in found])

        edges = sets.select("root", "node", "shingles").mapInArrow(compare, "a bigint, b bigint")
        edges = edges.unionByName(state.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")))
        joined = connected_components(edges).withColumnRenamed("root", "to")
        asked = F.broadcast(wanted.withColumn("now", F.lit(True)))
        state = state.join(joined, "node", "left").join(asked, "node", "left")
        state = checkpointed(state.select("root", "node", F.coalesce("to", "node").alias("comp"), "size", (F.col("asked") | F.coalesce("now", F.lit(False))).alias("asked")))


def components(docs: DataFrame, least: float = 0.8, width: int = 5, near: Callable[[DataFrame], DataFrame] | None = None, **limits: int) -> DataFrame:
    """``doc_id, fp, root`` for every row: the node of the text, and the least node reachable
    over links. Texts without words are one node, linked to no other. ``near`` and ``limits`` are
    those of ``links``."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [x.as_py() for x in b.column(1)]
            sets = [shingle_set(x, width) for x in bodies]
            found = [sketch(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([node(x) for x in bodies], pa.int64()), pa.array([len(x) for x in bodies], pa.int64()), pa.array([simhash(x) for x in sets], pa.int64()), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.binary())],
                names=["doc_id", "node", "size", "print", "keys", "sig"],
            )

    schema = "doc_id bigint, node bigint, size bigint, print bigint, keys array<bigint>, sig binary"
    rows = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(run, schema))
    linked = connected_components(links(rows, docs, least, width, near=near, **limits))
    found = rows.select("doc_id", "node").join(linked, "node", "left")
    return found.select("doc_id", F.col("node").alias("fp"), F.coalesce("root", "node").alias("root"))
