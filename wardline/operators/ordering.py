"""Seeded orders of large groups, by blocks of the order's first digits, so that no task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.storage import cut, small

#: Hexadecimal digits that name a block: 4,096 blocks a group, in the order itself.
DIGITS = 3


def ranked(df: DataFrame, by: list[str], order: str, ties: list[str], out: str = "rn") -> DataFrame:
    """Numbers the rows of each group from 1 in the order of the hexadecimal column `order` and then of `ties`.

    Counts of earlier blocks (at most 4,096 rows a group) give a block's first number, a window over one block the rest."""
    df = df.withColumn("_block", F.substring(order, 1, DIGITS))
    ahead = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy(*by, "_block").agg(F.count("*").alias("_n")).select(*by, "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*by, "_block").orderBy(order, *ties)
    met = df.withColumn("_at", F.row_number().over(inside)).join(first, [*by, "_block"])
    return met.withColumn(out, F.col("_ahead") + F.col("_at")).drop("_block", "_ahead", "_at")


def leading(df: DataFrame, quota: DataFrame, by: list[str], order: str, ties: list[str]) -> DataFrame:
    """The first rows of each group in the order of the hexadecimal column `order` and then of `ties`, as many as its `quota` says (a row a
    group; groups without one give none). Only blocks that begin before the quota is full are sorted. df should be cut, as it is read twice."""
    df = df.withColumn("_block", F.substring(order, 1, DIGITS))
    ahead = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy(*by, "_block").agg(F.count("*").alias("_n")).select(*by, "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    first = cut(first.join(quota, by).where(F.col("_ahead") < F.col("quota")).select(*by, "_block", (F.col("quota") - F.col("_ahead")).alias("_left")))
    inside = Window.partitionBy(*by, "_block").orderBy(order, *ties)
    return df.join(small(first), [*by, "_block"]).withColumn("_at", F.row_number().over(inside)).where("_at <= _left").drop("_block", "_left", "_at")


def followed(df: DataFrame, by: list[str], order: str, ident: str, out: str = "b") -> DataFrame:
    """Adds the next row's `ident` in the order of the hexadecimal column `order` and then of `ident`; a group's last row gets NULL.

    A block's last row is followed by the first row of the next block that has any."""
    df = df.withColumn("_block", F.substring(order, 1, DIGITS))
    first = df.groupBy(*by, "_block").agg(F.min(F.struct(order, ident)).alias("_first"))
    first = first.select(*by, "_block", F.lead(F.col("_first")[ident]).over(Window.partitionBy(*by).orderBy("_block")).alias("_later"))
    inside = F.lead(ident).over(Window.partitionBy(*by, "_block").orderBy(order, ident))
    return df.withColumn("_inside", inside).join(first, [*by, "_block"]).withColumn(out, F.coalesce("_inside", "_later")).drop("_block", "_inside", "_later")


def sampled(df: DataFrame, by: str, order: str, ties: list[str], share: float) -> DataFrame:
    """The first `share` of each group (rounded, halves to even) in the order of the hexadecimal column `order`."""
    sizes = df.groupBy(by).agg(F.bround(F.count("*") * share, 0).alias("_take"))
    return ranked(df, [by], order, ties, "_rn").join(F.broadcast(sizes), by).where("_rn <= _take").drop("_rn", "_take")  # sizes: a row a group
