"""Chronological splits, folds and seeded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.quantiles import order_statistics, quantiles
from wardline.operators.storage import cut, small


def distinct_cuts(df: DataFrame, group: str | None, column: str | Column, shares: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """One row a group with three distinct values at least: the last values of the first two parts, by shares of the distinct values
    (rounded, halves to even), so that each part gets a value."""
    keys = [group] if group else []
    values = df.select(*keys, (F.col(column) if isinstance(column, str) else column).cast("double").alias("_x")).where("_x IS NOT NULL").distinct()
    n = F.col("_n")
    first = F.least(F.greatest(F.bround(n * F.lit(shares[0]), 0) - 1, F.lit(0)), n - 3)
    second = F.least(F.greatest(F.bround(n * F.lit(shares[1]), 0) - 1, first + 1), n - 2)
    return order_statistics(values, keys, "_x", {"cut_1": first, "cut_2": second}).where("n >= 3").drop("n")


def cut_points(df: DataFrame, group: str | None, dates: tuple[str, str] | None, least: int = 50, shares: tuple[float, float] = (0.70, 0.85), time: str = "reported_at") -> DataFrame:
    """One row a group: cut_1, cut_2 (microseconds; the earlier part holds its cut) and the mode: `dates` if all three parts have `least`
    rows, else `quantile` of the rows, else `distinct` (quantile of distinct times) if that fills the parts where quantiles do not."""
    keys = [group] if group else []
    rows = cut(df.where(F.col(time).isNotNull()).select(*keys, F.unix_micros(time).cast("double").alias("_us")))  # read by each step

    def smallest(low: Column, high: Column) -> Column:
        """Rows of the smallest part."""
        us = F.col("_us")
        return F.least(F.count_if(us <= low), F.count_if((us > low) & (us <= high)), F.count_if(us > high)).alias("_least")

    def filled(cuts: DataFrame) -> DataFrame:
        met = rows.join(small(cuts), keys) if keys else rows.crossJoin(F.broadcast(cuts))
        return cut(met.groupBy(*keys, "cut_1", "cut_2").agg(smallest(F.col("cut_1"), F.col("cut_2"))))

    out = []
    if dates:
        a, b = (F.unix_micros(F.lit(x).cast("timestamp")).cast("double") for x in dates)
        by_date = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n"), smallest(a, b)).where("_n > 0"))
        out.append(by_date.where(F.col("_least") >= least).select(*keys, a.alias("cut_1"), b.alias("cut_2"), F.lit("dates").alias("mode")))
        other = by_date.where(F.col("_least") < least)
        if other.isEmpty():
            return out[0]
        rows = rows.join(small(other.select(*keys)), keys) if keys else rows
    by_rows = filled(cut(quantiles(rows, keys, "_us", {"cut_1": shares[0], "cut_2": shares[1]}).where("n > 0").drop("n")))
    full, poor = by_rows.where(F.col("_least") >= least), by_rows.where(F.col("_least") < least)
    if not poor.isEmpty():
        if keys:
            rows = rows.join(small(poor.select(*keys)), keys)
        by_value = filled(cut(distinct_cuts(rows, group, "_us", shares))).where(F.col("_least") >= least)
        out.append(by_value.select(*keys, "cut_1", "cut_2", F.lit("distinct").alias("mode")))
        if keys:
            full = full.unionByName(poor.join(small(by_value.select(*keys)), keys, "left_anti"))
        elif by_value.isEmpty():
            full, out = poor, []
    return reduce(DataFrame.unionByName, [full.select(*keys, "cut_1", "cut_2", F.lit("quantile").alias("mode")), *out])


def part_of(time: Column) -> Column:
    """The part of a time beside cut_1 and cut_2: train, val or test; without a time, unassigned."""
    us = F.unix_micros(time)
    return F.when(us.isNull(), "unassigned").when(us <= F.col("cut_1"), "train").when(us <= F.col("cut_2"), "val").otherwise("test")


def chronological(df: DataFrame, group: str | None = None, dates: tuple[str, str] | None = None, out: str = "split", least: int = 50) -> DataFrame:
    """train, val or test by time within the group (or at large); without a time, or in a group without any, unassigned."""
    cuts = cut_points(df, group, dates, least)
    if group:
        met = df.join(small(cut(cuts)), group, "left")
    else:
        met = df.join(F.broadcast(cuts), F.lit(True), "left")  # one row, or none without any time
    return met.withColumn(out, F.when(F.col("cut_1").isNull(), "unassigned").otherwise(part_of(F.col("reported_at")))).drop("cut_1", "cut_2", "mode")


def rolling_folds(df: DataFrame, origins: list[str], days: int = 60) -> DataFrame:
    """One row for each fold and row with a role: train if the label was known before the origin, test in the days after it."""
    o = df.sparkSession.createDataFrame([(x,) for x in origins], "fold string").withColumn("_t", F.col("fold").cast("timestamp"))
    known = F.coalesce(F.col("closed_at") < F.col("_t"), F.lit(False))
    test = (F.col("reported_at") >= F.col("_t")) & (F.col("reported_at") < F.col("_t") + F.make_dt_interval(F.lit(days)))
    return df.crossJoin(F.broadcast(o)).withColumn("role", F.when(known & (F.col("reported_at") < F.col("_t")), "train").when(test, "test")).where("role IS NOT NULL").drop("_t")


def holdout_folds(df: DataFrame, column: str, held: list[str]) -> DataFrame:
    """Leave-one-out folds over the values of a column."""
    o = df.sparkSession.createDataFrame([(x,) for x in held], "fold string")
    return df.crossJoin(F.broadcast(o)).withColumn("role", F.when(F.col(column) == F.col("fold"), "test").otherwise("train"))


def weekly_folds(panel: DataFrame, origins: list[str]) -> DataFrame:
    """Train to two weeks before the origin, test from one week before it to nine after."""
    o = panel.sparkSession.createDataFrame([(x,) for x in origins], "fold string").withColumn("_o", F.col("fold").cast("date"))
    role = F.when(F.col("week") <= F.date_sub("_o", 14), "train").when((F.col("week") >= F.date_sub("_o", 7)) & (F.col("week") < F.date_add("_o", 63)), "test")
    return panel.crossJoin(F.broadcast(o)).withColumn("role", role).where("role IS NOT NULL").drop("_o")


def seeded(seed: str, key: Column) -> Column:
    """A stable random order: the same everywhere for one seed."""
    return F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))


def split_column(df: DataFrame, group: str) -> str:
    """The per-source split if there is one source only, or if some fold of the global one is empty."""
    row = df.agg(F.count_distinct(group).alias("s"), F.count_distinct("split").alias("f")).collect()[0]
    return "split_by_source" if row["s"] == 1 or row["f"] < 3 else "split"
