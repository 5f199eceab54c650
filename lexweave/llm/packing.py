"""Best-fit packing of token sequences with Martello-Toth reduction.

Items matter by length only, and there are no more lengths than tokens in a sequence. So the
corpus is reduced to a histogram of lengths (a table whose size does not depend on the
corpus), and the packing is worked out on it for all items of a length at once: first
Martello and Toth's reduction fixes sets of items that provably dominate whatever else could
share a sequence with them, then best-fit decreasing packs the rest. The plan says which
sequences take the k-th piece of a length; pieces are numbered per length without a sort, by a
running count in each task and a prefix sum over tasks, and so find their place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import checkpointed
from lexweave.llm.tokens import Encode, map_ids

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END_ID = 2048, 0


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello and Toth's reduction of a histogram: fixed patterns with how often, and the rest.

    For the largest open item all feasible sets hold at most k others (the k smallest still
    fit). Nothing fits: the item alone. The largest fitting partner fills the sequence, or k is
    1: that pair. k is 2: the pair if its partner is as large as the best couple, or the best
    couple if it contains that partner and no other couple could be exchanged for it. Items
    for which no set dominates stay for the next step.
    """
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            sizes.pop(bisect_left(sizes, size))

    def fix(pattern: tuple[int, ...], times: int) -> None:
        for size, n in Counter(pattern).items():
            take(size, n * times)
        fixed.append((pattern, times))

    top = len(sizes) - 1
    while top >= 0:
        w = sizes[top]
        while w in left:
            spare = capacity - w
            own = left[w]
            smallest = _smallest(sizes, left, w, 3)
            k, total = 0, 0
            for s in smallest:
                total += s
                if total > spare:
                    break
                k += 1
            if k == 0:
                fix((w,), own)
                continue
            partner = sizes[_fit(sizes, left, w, spare)]
            if k == 1 or partner == spare:
                fix((w, partner), own // 2 if partner == w else min(own, left[partner]))
                continue
            if k == 2:
                couple = _best_couple(sizes, left, w, spare)
                if couple is None or partner >= sum(couple):
                    fix((w, partner), own // 2 if partner == w else min(own, left[partner]))
                    continue
                a, b = couple
                if a == partner and _no_exchange(sizes, left, w, a, b, spare):
                    fix((w, a, b), 1)
                    continue
            break
        top = bisect_left(sizes, w) - 1
    return fixed, left


def _available(left: dict[int, int], size: int, w: int) -> int:
    return left.get(size, 0) - (size == w)


def _smallest(sizes: list[int], left: dict[int, int], w: int, n: int) -> list[int]:
    out: list[int] = []
    for s in sizes:
        out += [s] * min(n - len(out), _available(left, s, w))
        if len(out) == n:
            break
    return out


def _fit(sizes: list[int], left: dict[int, int], w: int, spare: int) -> int:
    """Index of the largest size that fits beside one item of size ``w``."""
    i = bisect_right(sizes, spare) - 1
    return i if _available(left, sizes[i], w) else i - 1


def _best_couple(sizes: list[int], left: dict[int, int], w: int, spare: int) -> tuple[int, int] | None:
    """Two items with the largest sum that fits, the larger first."""
    own = [s for s in sizes[: bisect_right(sizes, spare)] if _available(left, s, w)]
    best, lo, hi = None, 0, len(own) - 1
    while lo <= hi:
        a, b = own[hi], own[lo]
        if a + b > spare:
            hi -= 1
            continue
        if (a != b or _available(left, a, w) >= 2) and (best is None or a + b > sum(best)):
            best = (a, b)
        lo += 1
    return best


def _no_exchange(sizes: list[int], left: dict[int, int], w: int, a: int, b: int, spare: int) -> bool:
    """Whether at most one item lies between the couple in order of size, or the two items just
    above the smaller one are too large together."""
    above = [a] * (_available(left, a, w) - (a == b)) if a != b else []
    between = sum(_available(left, s, w) for s in sizes[bisect_right(sizes, b) : bisect_left(sizes, a)]) + max(0, len(above) - 1)
    if a == b or between <= 1:
        return True
    nxt = []
    for s in sizes[bisect_right(sizes, b) :]:
        nxt += [s] * min(2 - len(nxt), _available(left, s, w))
        if len(nxt) == 2:
            break
    return len(nxt) == 2 and sum(nxt) > spare


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: patterns with how often.

    Open sequences with the same contents are one entry, so that work depends on the number of
    different lengths and contents, not on the number of items.
    """
    open_: dict[int, list[list]] = {}  # room -> [pattern, times]
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], times: int, room: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([pattern, times])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                pattern, times, room = (), n, capacity
            else:
                room = rooms[i]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            each = room // size  # best fit fills one sequence before it turns to the next
            full = min(times, n // each)
            rest = n - full * each if full < times else 0
            if full:
                put(pattern + (size,) * each, full, room - each * size)
                n -= full * each
            if rest:
                put(pattern + (size,) * rest, 1, room - rest * size)
                n = 0
            if pattern and times - full - (rest > 0):
                put(pattern, times - full - (rest > 0), room)
    return [(p, t) for entries in open_.values() for p, t in entries]


@dataclass
class Plan:
    """Slots of each length: the k-th piece with ``first <= k`` of slot i has number
    ``sequence + (k - first) // run`` and offset ``offset + (k - first) % run * length``."""

    sequences: int = 0
    tokens: int = 0
    slots: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The whole packing of a histogram of piece lengths."""
    fixed, rest = reduce_dominated(counts, capacity)
    out = Plan(tokens=sum(s * n for s, n in counts.items()))
    used: Counter = Counter()
    for pattern, times in fixed + best_fit(rest, capacity):
        offset = 0
        for size, run in sorted(Counter(pattern).items(), reverse=True):
            out.slots.setdefault(size, []).append((used[size], out.sequences, run, offset))
            used[size] += run * times
            offset += run * size
        out.sequences += times
    return out


def pieces(docs: DataFrame, encoder: Callable[[], Encode], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32`` and, for numbering,
    ``task`` and ``nth`` (pieces of the same length before it in its task)."""

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple[dict, int]]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for (doc_id,), ids in pairs:
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            first = len(ids) % capacity or capacity
            start = 0
            for i, stop in enumerate(range(first, len(ids) + 1, capacity)):
                length = stop - start
                yield {"doc_id": doc_id, "piece": i, "start": start, "length": length, "ids_crc32": zlib.crc32(ids[start:stop].tobytes()), "task": task, "nth": seen[length]}, 64
                seen[length] += 1
                start = stop

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])
    return map_ids(docs, ["doc_id"], encoder, rows, schema, arrow)


def pack(docs: DataFrame, encoder: Callable[[], Encode], capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and the end id; only longer ones than a sequence are cut, the first
    piece takes the remainder. Null and empty texts are one piece of the end id alone; repeated
    rows are packed each; a null doc_id stays null; an empty table gives no rows; other
    columns are not read.
    """
    # the numbers per task hold for the stored rows, whatever is computed again later
    cut = checkpointed(pieces(docs.select("doc_id", "text"), encoder, capacity, end_id))
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = checkpointed(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    slots = {s: np.array(x, np.int64) for s, x in plan(counts, capacity).slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, k = b.column("length").to_numpy(), b.column("k").to_numpy()
            sequence, offset = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
            for size in np.unique(length):
                own = length == size
                table = slots[int(size)]
                first, seq, run, off = table[np.searchsorted(table[:, 0], k[own], "right") - 1].T
                sequence[own] = seq + (k[own] - first) // run
                offset[own] = off + (k[own] - first) % run * size
            columns = [b.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = cut.join(base.select("length", "task", "base"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("k"))
    return numbered.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
