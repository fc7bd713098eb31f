"""Structured Streaming: incremental ingestion, weekly counts, exactly-once logs and first closures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", files_each: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(fmt).load(folder)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """New files through the same transform as in batch, appended to Parquet; runs until all are read."""
    return transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(stream: DataFrame, keys: list[str], at: str = "reported_at", late: str = "14 days") -> DataFrame:
    """Counts in weeks from Monday; rows later than the watermark are dropped."""
    w = F.window(at, "7 days", "7 days", "4 days")  # the epoch was a Thursday
    return stream.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("y")).select(F.to_date("window.start").alias("week"), *keys, "y")


def once_each(stream: DataFrame, keys: list[str], at: str, within: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def first_closures(stream: DataFrame) -> DataFrame:
    """The first closure of each incident, in update mode."""
    return stream.where("status = 'closed'").groupBy("incident_id").agg(F.min("changed_at").alias("first_closed_at"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query has dropped so far because they came behind the watermark, as its progress reports tell."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def keep_closures(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """First closures in update mode: each batch's changed rows go to a folder of the batch's number, which a batch that runs again
    after a failure overwrites, so nothing is added twice. Read them with closures_of."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return first_closures(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closures_of(spark: SparkSession, out: str) -> DataFrame:
    """incident_id and first_closed_at over all batches so far: an incident's later batches only hold earlier times."""
    return spark.read.parquet(f"{out}/batch=*").groupBy("incident_id").agg(F.min("first_closed_at").alias("first_closed_at"))
