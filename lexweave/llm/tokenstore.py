"""Token-id files: one concatenated id array per block, document boundaries in Elias-Fano code.

A block holds the ids of documents in ascending order and the ends of the documents among
them. Ends never decrease, so they are kept as unary high parts and packed low bits: about
2 + log2(ids / documents) bits a document instead of 64. ``select`` over the unary part gives
the i-th end without decoding the others. Blocks are bounded (a document longer than one gets
a block of its own) and lie in a shared table as binary values, in order of ``part, block``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import bound_batches, stored
from lexweave.llm.tokens import Encode, map_ids

#: Ids of a block; ones between two samples of the select structure; id that ends a document.
BLOCK_IDS, SAMPLE, END_ID = 1 << 17, 256, 2
_MAGIC, _HEAD = b"LXIDS1", struct.Struct("<6sBBQQ")


class EliasFano:
    """A non-decreasing sequence of unsigned integers in near-minimal space.

    Stored are the high parts in unary (a one for each value, after as many zeros as the high
    part grows), the low bits, and the place of every ``SAMPLE``-th one as 32 bits: an eighth
    of a bit a value. ``select`` starts at the sample before and counts ones byte by byte, so
    that no table of counts or offsets is ever built.
    """

    _HEAD = struct.Struct("<QBIII")

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros((int(places[-1]) + 1 if n else 0), np.uint8)
        ones[places] = 1
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, bits, low.tobytes(), np.packbits(ones, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        return self._HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, bits, *sizes = cls._HEAD.unpack_from(data, at)
        at += cls._HEAD.size
        parts = []
        for size in sizes:
            parts.append(bytes(data[at : at + size]))
            at += size
        return cls(n, bits, *parts), at

    def select(self, i: int) -> int:
        """Place of the i-th one in the unary part."""
        place = int.from_bytes(self.samples[i // SAMPLE * 4 : i // SAMPLE * 4 + 4], "little")
        byte, skip = place >> 3, place & 7
        bits = self.high[byte] >> skip << skip  # the sampled one and those after it
        rest = i % SAMPLE
        while (ones := bits.bit_count()) <= rest:
            rest -= ones
            byte += 1
            bits = self.high[byte]
        for _ in range(rest):
            bits &= bits - 1
        return 8 * byte + (bits & -bits).bit_length() - 1

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = i * self.low_bits
        low = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3], "little") >> (at & 7) & (1 << self.low_bits) - 1
        return self.select(i) - i << self.low_bits | low


def write_block(ids: list[np.ndarray], width: int) -> bytes:
    """Bytes of a block; ``width`` is the bytes of an id (2 or 4). An id that needs more raises."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    if len(flat) and int(flat.max()) >> 8 * width:
        raise ValueError(f"the id {flat.max()} does not fit in {width} bytes")
    return _HEAD.pack(_MAGIC, 1, width, len(ids), len(flat)) + EliasFano.of(ends).to_bytes() + flat.astype(f"<u{width}").tobytes()


class Block:
    """A block read back: ``span(i)`` and ``ids(i)`` of its i-th document, by select."""

    def __init__(self, data: bytes):
        magic, version, width, self.n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a block of token ids")
        self.ends, at = EliasFano.from_bytes(data, _HEAD.size)
        self.flat = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def span(self, i: int) -> tuple[int, int]:
        """First id and the id after the last of a document."""
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def ids(self, i: int) -> np.ndarray:
        first, end = self.span(i)
        return self.flat[first:end]


def write_ids(docs: DataFrame, encoder: Callable[[], Encode], end_id: int = END_ID, width: int = 2) -> DataFrame:
    """The stored blocks: ``part, block, before`` (ids in the part before the block), ``n_ids``,
    ``doc_ids array<bigint>``, ``payload binary``.

    Documents are dealt by range of doc_id (nulls first; rows of one doc_id by text), so parts
    and blocks follow each other in that order and each task writes its own part.
    """

    def rows(pairs: Iterator[tuple]) -> Iterator[tuple[dict, int]]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        size = 0
        for (doc_id,), ids in pairs:
            if held and size + len(ids) + 1 > BLOCK_IDS:
                payload = write_block(held, width)
                yield {"part": part, "block": block, "before": before, "n_ids": size, "doc_ids": doc_ids, "payload": payload}, len(payload)
                block, before, doc_ids, held, size = block + 1, before + size, [], [], 0
            doc_ids.append(doc_id)
            held.append(np.append(ids, np.uint32(end_id)))
            size += len(ids) + 1
        if held:
            payload = write_block(held, width)
            yield {"part": part, "block": block, "before": before, "n_ids": size, "doc_ids": doc_ids, "payload": payload}, len(payload)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part int, block int, before bigint, n_ids bigint, doc_ids array<bigint>, payload binary"
    arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
    return stored(map_ids(ordered, ["doc_id"], encoder, rows, schema, arrow), "token-ids")


def with_starts(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``base``: ids of all blocks before. One row a part is summed in order and
    broadcast: as many rows as tasks wrote."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    return blocks.join(F.broadcast(totals), "part").withColumn("base", F.col("ahead") + F.col("before"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """One row per document of stored blocks: ``doc_id, start, n_tokens, ids_crc32``.

    Where a document's ids lie comes from the block's select structure; a block is bounded but
    for a document that is longer itself.
    """
    bound_batches(blocks.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, doc_ids, payload in zip(*(b.column(i) for i in range(3)), strict=True):
                block, first = Block(payload.as_py()), base.as_py()
                spans = [block.span(i) for i in range(block.n_docs)]
                crc = [zlib.crc32(block.flat[i:j].astype("<u4").tobytes()) for i, j in spans]
                yield pa.RecordBatch.from_arrays([doc_ids.values.cast(pa.int64()), pa.array([first + i for i, _ in spans], pa.int64()), pa.array([j - i for i, j in spans], pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return blocks.select("base", "doc_ids", "payload").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, encoder: Callable[[], Encode], end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Writes the ids of all documents and gives what the files say about each.

    Null and empty texts are the end id alone; a null doc_id comes first; rows with one doc_id
    follow each other by text; an empty table gives no rows; other columns are not read.
    """
    return read_documents(with_starts(write_ids(docs, encoder, end_id, width)))
