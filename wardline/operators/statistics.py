"""Statistics of task tables: drift of every predictor over the splits, findings with their severity, and error tables by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators import audit as A
from wardline.operators.quantiles import quantiles
from wardline.operators.storage import cut

SAFE, PREPARE, DANGER = "safe", "needs_preprocessing", "dangerous"
#: Distances from which on a predictor has drifted, the share that stands for a bin that is empty, and rows that a side needs at least.
TV_LIMIT, PSI_LIMIT, EMPTY, LEAST = 0.20, 0.25, 1e-6, 100


def _long(df: DataFrame, columns: list[str], kind: str, keep: list[str]) -> DataFrame:
    """column, v and the kept columns: a row for each row and named column whose value is known."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("v")) for c in columns])
    return df.select(*keep, F.explode(each).alias("x")).select(*keep, "x.column", "x.v").where("v IS NOT NULL")


def level_drift(df: DataFrame, columns: list[str], top: int = 40) -> DataFrame:
    """column, val and test: total variation between train's level shares and those of val and test, over levels that are among the `top`
    of either side. Levels are counted once for all columns, and the least frequent never meet one task: the top is taken by ranges."""
    n = _long(df, columns, "string", ["split"]).groupBy("column", "split", "v").agg(F.count("*").alias("n"))
    n = cut(n)
    total = n.groupBy("column", "split").agg(F.sum("n").alias("all"))
    share = n.join(F.broadcast(total), ["column", "split"])  # three rows a column
    rank = F.row_number().over(Window.partitionBy("column", "split").orderBy(F.desc("n"), "v"))
    first = n.withColumn("rk", rank).where(F.col("rk") <= top).select("column", "split", "v")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n") / F.col("all"))), F.lit(0.0))
    p = share.groupBy("column", "v").agg(of("train").alias("train"), of("val").alias("val"), of("test").alias("test"))
    out = []
    for s in ("val", "test"):
        levels = first.where(F.col("split").isin("train", s)).select("column", "v").distinct()  # at most 2 * top a column
        tv = F.round(F.sum(F.abs(F.col("train") - F.col(s))) / 2, 4).alias(s)
        out.append(p.join(F.broadcast(levels), ["column", "v"]).groupBy("column").agg(tv))
    return out[0].join(out[1], "column", "full").select("column", F.lit("total-variation").alias("metric"), "val", "test")


def number_drift(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """column, val and test: population stability index over train's distinct deciles, each share of a part's known values; values
    outside train's range count in the whole and in no bin. NULL where a part has under 100 values or train has a single bin."""
    rows = cut(_long(df, columns, "double", ["split"]))
    names = [f"e{i}" for i in range(bins + 1)]
    edges = quantiles(rows.where("split = 'train'"), ["column"], "v", {n: i / bins for i, n in enumerate(names)})
    edges = cut(edges.select("column", F.array_distinct(F.array(*names)).alias("e")))
    last = F.size("e") - 1
    at = F.least(F.size(F.filter("e", lambda x: x <= F.col("v"))), last) - 1
    inside = (F.col("v") >= F.get("e", F.lit(0))) & (F.col("v") <= F.element_at("e", -1))
    b = F.when(inside, at).otherwise(-1)
    counts = rows.join(F.broadcast(edges), "column").groupBy("column", "e", b.alias("b"), "split").agg(F.count("*").alias("n"))  # a row a column
    n = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0))
    by_bin = cut(counts.groupBy("column", "e", "b").agg(*[n(s).alias(s) for s in ("train", "val", "test")]))
    whole = by_bin.groupBy("column").agg(*[F.sum(s).alias(f"{s}_all") for s in ("train", "val", "test")])
    every = edges.where(F.size("e") >= 3).select("column", F.explode(F.sequence(F.lit(0), F.size("e") - 2)).alias("b"))
    met = every.join(by_bin.drop("e"), ["column", "b"], "left").join(whole, "column").na.fill(0, ["train", "val", "test"])
    part = lambda s: F.col(s) / F.col(f"{s}_all")
    step = lambda s: (part("train") - part(s)) * F.log((part("train") + EMPTY) / (part(s) + EMPTY))
    enough = lambda s: (F.min("train_all") >= LEAST) & (F.min(f"{s}_all") >= LEAST)
    psi = [F.round(F.when(enough(s), F.sum(step(s))), 4).alias(s) for s in ("val", "test")]
    found = met.groupBy("column").agg(*psi)
    return edges.select("column").join(found, "column", "left").select("column", F.lit("PSI").alias("metric"), "val", "test")


def drift(df: DataFrame, levels: list[str], numbers: list[str]) -> DataFrame:
    """column, metric, val, test and severity for every predictor; a chronological split makes some drift expected."""
    parts = ([level_drift(df, levels)] if levels else []) + ([number_drift(df, numbers)] if numbers else [])
    limit = F.when(F.col("metric") == "PSI", PSI_LIMIT).otherwise(TV_LIMIT)
    worst = F.greatest(F.coalesce("val", F.lit(0.0)), F.coalesce("test", F.lit(0.0)))
    return A.stacked(parts).withColumn("severity", F.when(worst > limit, PREPARE).otherwise(SAFE))


def column_findings(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """column, issue, severity and value of what is wrong with a column: no value, one value, nearly one value (over 0.995 of the known),
    mostly missing (over 0.9), many levels (over 1,000), or missing in nearly all of one group and nearly none of another."""
    n = df.agg(F.count("*").alias("rows"))
    levels = _long(df, columns, "string", []).groupBy("column", "v").agg(F.count("*").alias("n"))
    seen = levels.groupBy("column").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.sum("n").alias("known"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    h = names.join(seen, "column", "left").na.fill(0, ["kinds", "most", "known"]).crossJoin(F.broadcast(n))  # a row a column
    top, missing = F.col("most") / F.col("known"), 1 - F.col("known") / F.col("rows")
    issue = lambda ok, name, how, value: F.when(ok, F.struct(F.lit(name).alias("issue"), F.lit(how).alias("severity"), F.round(value.cast("double"), 4).alias("value")))
    kinds = F.col("kinds")
    found = h.select("column", F.explode(F.array_compact(F.array(
        issue(kinds == 0, "entirely null", DANGER, missing), issue(kinds == 1, "constant", DANGER, kinds),
        issue((kinds > 1) & (top > 0.995), "near-constant", PREPARE, top), issue((kinds > 1) & (missing > 0.9), "almost entirely missing", PREPARE, missing),
        issue(kinds > 1000, "high cardinality", PREPARE, kinds)))).alias("x")).select("column", "x.*")
    per = df.groupBy(group).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).unpivot([group], columns, "column", "m")
    tells = per.groupBy("column").agg(F.max("m").alias("hi"), F.min("m").alias("lo"), F.count("*").alias("k")).where("k > 1 AND hi > 0.99 AND lo < 0.01")
    gap = F.round(F.col("hi") - F.col("lo"), 4).alias("value")
    return found.unionByName(tells.select("column", F.lit(f"missingness tells {group}").alias("issue"), F.lit(PREPARE).alias("severity"), gap))


def target_findings(df: DataFrame, number: str, flag: str) -> DataFrame:
    """Findings of a numeric target (the greatest value is over 50 times the 99th percentile) and of a flag (one class, or under 0.05 or
    over 0.95 of one)."""
    q = quantiles(df, [], number, {"p99": 0.99, "top": 1.0}).select((F.col("top") / F.greatest(F.col("p99"), F.lit(1e-9))).alias("value"))
    tail = q.where("value > 50").select(F.lit(number).alias("column"), F.lit("extreme right tail").alias("issue"), F.lit(PREPARE).alias("severity"), F.round("value", 4).alias("value"))
    p = df.agg(F.avg(F.col(flag).cast("double")).alias("value")).where("value < 0.05 OR value > 0.95")
    one = F.col("value").isin(0.0, 1.0)
    rare = p.select(F.lit(flag).alias("column"), F.when(one, "one class only").otherwise("severe class imbalance").alias("issue"), F.when(one, DANGER).otherwise(PREPARE).alias("severity"), F.round("value", 4).alias("value"))
    return tail.unionByName(rare)


def repeated_features(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: rows, those that repeat an earlier feature vector, and vectors with more than one target value."""
    g = df.groupBy(*features).agg(F.count("*").alias("n"), F.min(target).alias("a"), F.max(target).alias("b"))
    return g.agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("n_repeated"), F.count_if(F.col("a") < F.col("b")).alias("n_contradictory"))


def error_table(df: DataFrame, by: dict[str, Column], y: str, p: str, base: str, lo: str, hi: str) -> DataFrame:
    """For each level of each grouping: rows, medians, errors beside the baseline's, its share of all rows and of the total error, the
    median signed error and the share of values within [lo, hi]. One row of `df` is one row a grouping; medians are exact."""
    keys = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("level")) for n, c in by.items()])
    rows = cut(df.select(F.col(y).alias("y"), F.col(p).alias("p"), F.col(base).alias("b"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.explode(keys).alias("k")).select("k.*", "y", "p", "b", "lo", "hi"))
    e, eb = F.abs(F.col("y") - F.col("p")), F.abs(F.col("y") - F.col("b"))
    g = rows.groupBy("dimension", "level").agg(
        F.count("*").alias("n"), F.avg(e).alias("mae"), F.avg(eb).alias("mae_baseline"), F.sum(e).alias("err"),
        F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"))
    whole = Window.partitionBy("dimension")  # levels of a grouping, which a table can show
    measures = {"true_median": F.col("y"), "predicted_median": F.col("p"), "median_error": e, "median_error_baseline": eb, "median_signed": F.col("p") - F.col("y")}
    long = rows.select("dimension", "level", F.explode(F.array(*[F.struct(F.lit(n).alias("m"), c.alias("v")) for n, c in measures.items()])).alias("x")).select("dimension", "level", "x.*")
    mid = quantiles(long, ["dimension", "level", "m"], "v", {"q": 0.5}).groupBy("dimension", "level").agg(*[F.max(F.when(F.col("m") == n, F.col("q"))).alias(n) for n in measures])
    g = g.withColumns({"share_rows": F.col("n") / F.sum("n").over(whole), "share_error": F.col("err") / F.sum("err").over(whole)}).drop("err")
    numbers = ["mae", "mae_baseline", "coverage", "share_rows", "share_error", *measures]
    return g.join(mid, ["dimension", "level"]).select("dimension", "level", "n", *numbers)
