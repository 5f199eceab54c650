"""Progressive search and device state as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexweave.functions.query import Options
from lexweave.operators import search as s
from lexweave.operators.state import latest_per_key


class ProgressiveSearch:
    """Top-k, total and processed shards, updated with each batch of arriving documents.

    The state is k rows; the batches' own top-k merge into it (an associative operation). A run
    stores it beside its checkpoint before a batch is committed, under the batch's number: a
    batch that comes again is known and left out, a new process goes on from what is stored.
    """

    def __init__(self, text: str, options: Options = Options(), limit: int = 50):
        self.options = options.normalized()
        s.compile_query(text, self.options)  # a query that cannot be read fails here
        self.text, self.limit = text, limit
        self.results: list[dict] = []
        self.total, self.batches, self.last = 0, 0, -1
        self._schema: StructType | None = None
        self._store: str | None = None

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Takes a batch in, unless its number (they grow) has been seen."""
        if batch_id <= self.last:
            return
        spark = batch.sparkSession
        found = s.matches(batch, self.text, self.options).cache()
        try:
            total = self.total + found.count()
            self._schema = found.schema
            top = found
            if self.results:
                top = top.unionByName(spark.createDataFrame(self.results, self._schema))
            results = [r.asDict(recursive=True) for r in top.orderBy(*s.order(self.options.sort)).limit(self.limit).collect()]  # k rows
        finally:
            found.unpersist()
        if self._store:
            spark.createDataFrame(results, self._schema).coalesce(1).write.mode("overwrite").parquet(f"{self._store}/top-{batch_id}")
            # the last step: a batch without this row is taken in anew
            spark.createDataFrame([(batch_id, total, self.batches + 1)], _DONE).write.mode("append").parquet(f"{self._store}/done")
        self.results, self.total, self.batches, self.last = results, total, self.batches + 1, batch_id

    def _restore(self, spark: SparkSession) -> None:
        try:
            done = spark.read.schema(_DONE).parquet(f"{self._store}/done").orderBy(F.desc("batch")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return  # the first run
        if done:
            top = spark.read.parquet(f"{self._store}/top-{done.batch}")
            self._schema = top.schema
            self.results = [r.asDict(recursive=True) for r in top.orderBy(*s.order(self.options.sort)).collect()]  # k rows
            self.last, self.total, self.batches = done.batch, done.total, done.batches

    def run(self, shards: DataFrame, checkpoint: str, on_batch: Callable[[ProgressiveSearch], None] | None = None):
        """Starts over a stream of documents; ``stop()`` on what it returns cancels."""
        self._store = f"{checkpoint.rstrip('/')}/search-state"
        self._restore(shards.sparkSession)

        def each(batch: DataFrame, batch_id: int) -> None:
            self.merge(batch, batch_id)
            if on_batch:
                on_batch(self)

        return shards.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_DONE = "batch bigint, total bigint, batches bigint"


def shard_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream over the files of a sharded document table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def recents_stream(events: DataFrame, user: str, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Newest record of each (user, key) of a stream of views, with event-time state clean-up."""
    return events.withWatermark(at, delay).groupBy(user, key).agg(F.max(at).alias("viewed_at"), F.count("*").alias("views"))


def recents_report(latest: DataFrame, user: str, key: str, limit: int = 20) -> DataFrame:
    """The list of each user from the stream's result table."""
    return latest_per_key(latest, user, key, [F.col("viewed_at"), F.col(key)], limit)
