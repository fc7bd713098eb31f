"""Evaluation: regression and classification metrics, ranking metrics by cumulative sums, calibration, bootstrap, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.quantiles import quantiles, with_quantiles
from wardline.operators.storage import cut, small


def regression(df: DataFrame, by: list[str], y: str = "y", p: str = "p", low: str | None = None, high: str | None = None) -> DataFrame:
    """n, MAE, RMSE, median and p90 absolute errors, R2, errors in log1p, and coverage and width of an interval if given."""
    e, le = F.col(y) - F.col(p), F.log1p(y) - F.log1p(F.greatest(F.col(p), F.lit(0.0)))
    r = lambda c: F.round(c, 4)
    more = [] if low is None else [r(F.avg(F.col(y).between(F.col(low), F.col(high)).cast("double"))).alias("coverage"), r(F.avg(F.col(high) - F.col(low))).alias("width")]
    sums = [
        F.count("*").alias("n"), r(F.avg(F.abs(e))).alias("mae"), r(F.sqrt(F.avg(e * e))).alias("rmse"), r(1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"),
        r(F.sqrt(F.avg(le * le))).alias("rmse_log1p"), r(F.avg(F.abs(le))).alias("mae_log1p"), *more,
    ]
    return with_quantiles(df, by, F.abs(e), {"median_ae": 0.5, "p90_ae": 0.9}, sums).withColumns({c: r(c) for c in ("median_ae", "p90_ae")})


def classification(df: DataFrame, by: list[str], threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """Confusion, precision, recall, F1, Brier score, log loss and positive rate at a threshold."""
    yes, hit = F.col(y) == 1, F.col(p) >= threshold
    q = F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn"),
        F.round(F.avg(F.pow(F.col(p) - F.col(y), 2)), 6).alias("brier"), F.round(-F.avg(F.when(yes, F.log(q)).otherwise(F.log(1 - q))), 6).alias("log_loss"), F.round(F.avg(F.col(y).cast("double")), 6).alias("positive_rate"),
    )
    g = g.withColumn("precision", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6)).withColumn("recall", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6))
    return g.withColumn("f1", F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6))


def by_score(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """One row for each distinct score: positives and rows at or above it, and totals. y and `rows`, where given, may be weighted counts.

    Scores are added up first, then dealt by ranges of (group, score): sums of earlier ranges (a row for each group of each range) and a
    window within one range of one group make the running counts, so no task sorts a group."""
    rows = F.sum("rows") if "rows" in df.columns else F.count("*")
    s = df.groupBy(*by, F.col(p).alias("score")).agg(F.sum(y).cast("long").alias("pos"), rows.cast("long").alias("rows"))
    s = cut(s.repartitionByRange(*by, F.desc("score")).withColumn("_range", F.spark_partition_id()))  # ranges are sampled, so they are fixed before they are added up
    whole = Window.partitionBy(*by)
    ahead = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = s.groupBy(*by, "_range").agg(F.sum("pos").alias("_pos"), F.sum("rows").alias("_rows"))
    sums = [F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}_ahead") for c in ("pos", "rows")]
    parts = parts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_range").alias("_k"), *sums, F.sum("_pos").over(whole).alias("P"), F.sum("_rows").over(whole).alias("N"))
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc("score"))
    s = s.withColumns({"tp": F.sum("pos").over(inside), "at": F.sum("rows").over(inside)})
    met = s.join(small(cut(parts)), [F.col("_range") == F.col("_k"), *[F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]])
    return met.select(*by, "score", "pos", "rows", (F.col("tp") + F.col("_pos_ahead")).alias("tp"), (F.col("at") + F.col("_rows_ahead")).alias("at"), "P", "N")


def ranking(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Average precision (steps) and ROC-AUC (trapezoids), ties counted together."""
    s = by_score(df, by, y, p)
    neg = F.col("rows") - F.col("pos")
    ap = F.sum(F.col("pos") * F.col("tp") / F.col("at")) / F.nullif(F.max("P"), F.lit(0))
    auc = F.sum(neg * (F.col("tp") - F.col("pos") / 2.0)) / F.nullif(F.max("P") * (F.max("N") - F.max("P")), F.lit(0))
    return s.groupBy(*by).agg(F.round(ap, 6).alias("average_precision"), F.round(auc, 6).alias("roc_auc"))


def best_f1(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    s = by_score(df, by, y, p).withColumn("f1", F.round(2 * F.col("tp") / (F.col("at") + F.col("P")), 6))
    return s.groupBy(*by).agg(F.max_by("score", F.struct("f1", "score")).alias("threshold"), F.max("f1").alias("f1"))


def risk_bands(df: DataFrame, by: list[str], medium: float, precision: float = 0.9, y: str = "y", p: str = "p") -> DataFrame:
    """HIGH starts at the smallest score from which precision is enough; MEDIUM at the decision threshold."""
    s = by_score(df, by, y, p)
    return s.groupBy(*by).agg(F.min(F.when(F.col("tp") >= precision * F.col("at"), F.col("score"))).alias("high_from"), F.lit(medium).alias("medium_from"))


def calibration(df: DataFrame, by: list[str], bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.col(y).cast("double")), 6).alias("rate"))


def aggregate(train: DataFrame, by: list[str], y: str, name: str, how: str = "median") -> DataFrame:
    """One row a group: its columns and the median or mean of y."""
    return quantiles(train, by, y, {name: 0.5}).drop("n") if how == "median" else train.groupBy(*by).agg(F.avg(y).alias(name))


def overall(train: DataFrame, y: str, how: str = "median") -> DataFrame:
    """One row: the training aggregate of all rows."""
    return aggregate(train, [], y, "_g", how)


def lookup_prediction(train: DataFrame, test: DataFrame, keys: list[str], y: str, how: str = "median", overall: DataFrame | None = None) -> DataFrame:
    """The training aggregate of the key, else the global one (`overall`, if it is known already): adds p. Without keys, the global one alone.
    Keys may be NULL."""
    met = test.crossJoin(F.broadcast(aggregate(train, [], y, "_g", how) if overall is None else overall))  # one row
    if not keys:
        return met.withColumnRenamed("_g", "p")
    by_key = small(cut(aggregate(train, keys, y, "_k", how).withColumnsRenamed({k: f"_l_{k}" for k in keys})))
    met = met.join(by_key, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys], "left")
    return met.withColumn("p", F.coalesce("_k", "_g")).drop("_k", "_g", *[f"_l_{k}" for k in keys])


def tv_distance(df: DataFrame, column: str, side: Column, top: int = 40) -> DataFrame:
    """Total variation between the level shares of two sides (true and false), over the top levels of each."""
    c = df.where(F.col(column).isNotNull()).groupBy(side.alias("s"), F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("s"))).withColumn("rk", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "v"))).where(F.col("rk") <= top)
    p = c.groupBy("v").agg(F.coalesce(F.sum(F.when(F.col("s"), F.col("share"))), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(~F.col("s"), F.col("share"))), F.lit(0.0)).alias("b"))
    return p.agg(F.round(F.sum(F.abs(F.col("a") - F.col("b"))) / 2, 6).alias("tv"))


def psi(train: DataFrame, test: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index over the training deciles; values outside the training range are left out."""
    names = [f"e{i}" for i in range(bins + 1)]
    edges = cut(quantiles(train, [], column, {n: i / bins for i, n in enumerate(names)}).select(F.array(*names).alias("e")))

    def shares(df: DataFrame, name: str) -> DataFrame:
        x = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges))  # one row of edges
        inside = x.where((F.col(column) >= F.col("e")[0]) & (F.col(column) <= F.col("e")[bins]))
        b = inside.select(F.least(F.size(F.filter("e", lambda v: v <= F.col(column))) - 1, F.lit(bins - 1)).alias("b"))
        return b.groupBy("b").agg(F.count("*").alias(name))

    c = shares(train, "x").join(shares(test, "y"), "b", "full")
    whole = Window.partitionBy(F.lit(1))  # at most `bins` rows
    a, t = (F.greatest(F.coalesce(n, F.lit(0)) / F.sum(n).over(whole), F.lit(1e-6)) for n in ("x", "y"))
    return c.select(((t - a) * F.log(t / a)).alias("v")).agg(F.round(F.sum("v"), 6).alias("psi"))
