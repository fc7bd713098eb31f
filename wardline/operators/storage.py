"""Where intermediate tables go, lineage cuts, and joins that keep hot keys out of one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast only tables of at most so many rows (of a few dozen bytes each).
BROADCAST_ROWS = 200_000
#: A key with more rows than this is dealt over several tasks in a join.
HUB = 1_000
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a temporary one and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="wardline-")
    return _OWN[app]


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there, so that its lineage ends."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on df if it has at most `most` rows; else df, which then joins by a shuffle. df should be cut."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread_join(rows: DataFrame, per_key: DataFrame, keys: list[str], size: str, by: list[str], hub: int = HUB) -> DataFrame:
    """Inner equi-join of many rows with one row a key, which holds the key's number of rows in the column `size`.

    Rows of keys of more than `hub` rows are dealt by a hash of their columns `by`, and the key's one row is copied for each hand. Such
    keys are at most a share 1 / hub of all rows; their names and sizes alone are broadcast, after a count. `per_key` should be cut, as
    it is read twice. Null keys join with nothing."""
    hot = per_key.where(F.col(size) > hub).select(*keys, F.ceil(F.col(size) / hub).cast("int").alias("_hands"))
    if hot.isEmpty():
        return rows.join(per_key, keys)
    dealt = rows.join(small(hot), keys, "left").withColumn("_hand", F.when(F.col("_hands").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("_hands"))).cast("int"))
    copies = per_key.withColumn("_hand", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(size) / hub).cast("int") - 1, F.lit(0)))))
    return dealt.drop("_hands").join(copies, [*keys, "_hand"]).drop("_hand")
