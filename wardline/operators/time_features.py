"""Local time by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_local(df: DataFrame, zones: list[tuple[str, str]]) -> DataFrame:
    """Adds `local`, the wall clock of the source's zone; NULL, never UTC, where the source has none."""
    dim = df.sparkSession.createDataFrame(zones, "_src string, _tz string")
    out = df.join(F.broadcast(dim), F.col("source_dataset") == F.col("_src"), "left")
    return out.withColumn("local", F.from_utc_timestamp("reported_at", F.col("_tz"))).drop("_src", "_tz")
