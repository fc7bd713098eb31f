"""Profiles and checks; every check is a row of (check_id, status, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.operators.quantiles import quantiles, with_quantiles


def checks(df: DataFrame, rules: dict[str, Column], whole: dict[str, Column] | None = None) -> DataFrame:
    """One pass over the table: each rule is a Column that is true for a row in order; NULL counts as out of order. `whole` has rules about
    the table as a whole: each is an aggregate that is true for a table in order."""
    bad = {n: F.count_if(~F.coalesce(ok, F.lit(False))) for n, ok in rules.items()}
    bad |= {n: F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1).cast("long") for n, ok in (whole or {}).items()}
    row = df.agg(*[b.alias(n) for n, b in bad.items()])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(f"`{n}`").alias("bad")) for n in bad])).alias("x")).select("x.*")
    return long.select("check_id", F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("status"), "bad")


def conditions(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rules about the table as a whole: each is an aggregate that is true for a table in order; NULL counts as out of order."""
    return checks(df, {}, rules)


def named(spark: SparkSession, rules: dict[str, list[str]]) -> DataFrame:
    """Rules about schemas and manifests: each has the names that break it."""
    rows = [(n, "FAIL" if names else "PASS", len(names)) for n, names in rules.items()]
    return spark.createDataFrame(rows, "check_id string, status string, bad long")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row a key with its number of rows on either side, from one shuffle: n_left and n_right are 1 where the sides agree."""
    tag = lambda df, a, b: df.select(key, F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = tag(left, 1, 0).unionByName(tag(right, 0, 1))
    return both.groupBy(key).agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"))


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, missing share, distinct values and a warning, in one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"{c}__k") for c in columns], *[F.count_distinct(c).alias(f"{c}__d") for c in columns])
    each = row.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__k").alias("known"), F.col(f"{c}__d").alias("distinct")) for c in columns])).alias("x")).select("n", "x.*")
    missing = F.round(1 - F.col("known") / F.col("n"), 6)
    warn = F.when(F.col("distinct") <= 1, "CONSTANT").when(missing > 0.9, "ALMOST_MISSING").when(F.col("distinct") > 1000, "HIGH_CARDINALITY")
    return each.select("column", "n", missing.alias("missing"), F.col("distinct").alias("n_distinct"), warn.alias("warning"))


def full_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """profile() with each column's type and, for numbers, the least, middle, 99th percentile and greatest value, all exact."""
    kinds = dict(df.dtypes)
    numbers = [c for c in columns if kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    out = profile(df, columns).withColumn("dtype", F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])[F.col("column")])
    if not numbers:
        return out.withColumns({c: F.lit(None).cast("double") for c in ("least", "p50", "p99", "most")})
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("v")) for c in numbers])).alias("x")).select("x.*")
    found = quantiles(long, ["_c"], "v", {"least": 0.0, "p50": 0.5, "p99": 0.99, "most": 1.0}).drop("n")
    return out.join(F.broadcast(found), F.col("column") == F.col("_c"), "left").drop("_c")  # a row a column


def numeric_summary(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    ends = [F.count(column).alias("n"), F.round(F.min(column), 4).alias("lo"), F.round(F.max(column), 4).alias("hi"), F.count_if(F.col(column) < 0).alias("negatives")]
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    g = with_quantiles(df, by, column, shares, ends)
    return g.select(*by, "n", "lo", *[F.round(c, 4).alias(c) for c in shares], "hi", "negatives")


def top_levels(df: DataFrame, column: str, top: int, other: str = "__OTHER__", missing: str = "__MISSING__") -> DataFrame:
    """Levels by count then name, the rest as one; NULL is a level of its own name."""
    c = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("level")).agg(F.count("*").alias("n"))
    first = c.orderBy(F.desc("n"), "level").limit(top)
    return c.join(F.broadcast(first.select(F.col("level").alias("_l"))), F.col("level") == F.col("_l"), "left").groupBy(F.when(F.col("_l").isNotNull(), F.col("level")).otherwise(other).alias("level")).agg(F.sum("n").alias("n"))


def lookup_encodings(df: DataFrame, category: str, numbers: list[str]) -> DataFrame:
    """Numbers that are constant within every level of a category: they only re-code it."""
    per = df.groupBy(category).agg(*[F.count_distinct(n).alias(n) for n in numbers])
    row = per.agg(*[F.max(n).alias(n) for n in numbers])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), (F.col(n) <= 1).alias("is_lookup")) for n in numbers])).alias("x")).select("x.*")


def near_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and the share of its most frequent value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    c = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    return c.groupBy("column").agg(F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))


def split_order(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Whether train ends before val begins, and val before test, in each group."""
    t = lambda f, s: f(F.when(F.col(split) == s, F.unix_micros("reported_at")))
    g = df.groupBy(group).agg(t(F.max, "train").alias("a"), t(F.min, "val").alias("b"), t(F.max, "val").alias("c"), t(F.min, "test").alias("d"))
    return g.select(group, (F.coalesce(F.col("a") < F.col("b"), F.lit(True)) & F.coalesce(F.col("c") < F.col("d"), F.lit(True))).alias("in_order"))


def ranks(df: DataFrame, by: list[str], order: list, out: str = "rn") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
