"""Shared helpers of the training-data operators: inputs, shared storage, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to or from Python at a time (a longer row goes alone). Texts are
#: unbounded, so batches are kept short: this bounds worker memory and changes no result.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: Bytes up to which a stored table is broadcast.
BROADCAST_BYTES = 32 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster, where it has to be set; on one machine
    (tests) a temporary folder is set once for the session where it is not.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexweave-"))
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back (so its size is known)."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/lexweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fits(df: DataFrame, row_bytes: Column) -> bool:
    """Whether the sum of a stored table's rows' bytes is measured to be under ``BROADCAST_BYTES``."""
    return (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES


def bounded_if_small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """A stored table marked for broadcast if it ``fits``; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def bound_batches(spark: SparkSession) -> None:
    """Bounds what every Arrow function of this subpackage is handed at a time. All of them set
    the same values, so that it does not matter which was planned last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over Python dicts: ``rows`` streams a partition's rows to output rows.

    Output is cut into batches of ``BATCH_ROWS`` rows or ``BATCH_BYTES`` bytes, so neither side
    holds a partition.
    """
    spark = df.sparkSession
    bound_batches(spark)
    out = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in spark_schema(spark, schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[dict] = []
        size = 0
        for row in rows(r for b in batches for r in b.to_pylist()):
            pending.append(row)
            size += sum(len(v) for v in row.values() if isinstance(v, (bytes, str, list)))
            if len(pending) == BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(pending, schema=out)
                pending, size = [], 0
        if pending:
            yield pa.RecordBatch.from_pylist(pending, schema=out)

    return df.mapInArrow(run, schema)


def spark_schema(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _arrow(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(_arrow(name[6:-1]))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
        "double": pa.float64(), "boolean": pa.bool_(),
    }[name]


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes; null reads as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))
