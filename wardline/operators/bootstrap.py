"""Cluster bootstrap by replicate weights, and the gates that a candidate passes before it replaces the baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.metrics import by_score
from wardline.operators.storage import cut

#: Chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...: the weights of a cluster in a replicate.
POISSON = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582)
# Folds to win, and how much a multi-horizon candidate may lie behind the best one.
LEAST_WINS, TIE_PR_AUC, TIE_BRIER = 4, 0.01, 0.005


def weight(seed: str, cluster: Column, replicate: Column) -> Column:
    """How often a cluster is drawn in a replicate, by a hash of both: any engine and any partitioning give the same."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), cluster.cast("string"), replicate.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    out = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return out


def _replicated(df: DataFrame, cluster: str, replicates: int, seed: str) -> DataFrame:
    """Rows (already added up by cluster) of each replicate that draws them, with their weight _w."""
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight(seed, F.col(cluster), F.col("rep")))
    return out.where("_w > 0")


def _interval(each: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """The middle 95 % of each column over the replicates, which are few."""
    return each.groupBy(*by).agg(*[F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_{n}") for c in columns for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))])


def paired_bootstrap(df: DataFrame, cluster: str, gain: Column, replicates: int = 200, seed: str = "7") -> DataFrame:
    """Interval of the mean gain with whole clusters drawn anew. Rows are added up by cluster once, replicates weigh the sums."""
    sums = df.groupBy(cluster).agg(F.sum(gain).alias("s"), F.count("*").alias("n"))
    each = _replicated(sums, cluster, replicates, seed).groupBy("rep").agg((F.sum(F.col("_w") * F.col("s")) / F.sum(F.col("_w") * F.col("n"))).alias("gain"))
    return _interval(each, ["gain"], []).toDF("low", "mid", "high")


def classification_bootstrap(df: DataFrame, by: list[str], cluster: str, y: str, base: str, candidate: str, replicates: int = 100, seed: str = "7") -> DataFrame:
    """Intervals of what a candidate gains over the baseline in average precision and in Brier score, with whole clusters drawn anew.

    Both models' scores are added up by (cluster, score) before replicates weigh them; running counts of a replicate go by ranges of
    scores (metrics.by_score). Brier sums are added up by cluster."""
    long = df.select(*by, cluster, F.col(y).cast("long").alias("_y"), F.explode(F.array(F.struct(F.lit("base").alias("m"), F.col(base).alias("p")), F.struct(F.lit("cand").alias("m"), F.col(candidate).alias("p")))).alias("_x"))
    sums = long.groupBy(*by, cluster, "_x.m", "_x.p").agg(F.sum("_y").alias("pos"), F.count("*").alias("n"))
    reps = _replicated(sums, cluster, replicates, seed)
    counted = reps.select(*by, "rep", "m", "p", (F.col("_w") * F.col("pos")).alias("y"), (F.col("_w") * F.col("n")).alias("rows"))
    s = by_score(counted, [*by, "rep", "m"])
    ap = s.groupBy(*by, "rep", "m").agg((F.sum(F.col("pos") * F.col("tp") / F.col("at")) / F.nullif(F.max("P"), F.lit(0))).alias("ap"))
    ap = ap.groupBy(*by, "rep").agg((F.max(F.when(F.col("m") == "cand", F.col("ap"))) - F.max(F.when(F.col("m") == "base", F.col("ap")))).alias("pr_auc_gain"))
    square = F.pow(F.col(base) - F.col(y), 2) - F.pow(F.col(candidate) - F.col(y), 2)
    brier = _replicated(df.groupBy(*by, cluster).agg(F.sum(square).alias("s"), F.count("*").alias("n")), cluster, replicates, seed)
    brier = brier.groupBy(*by, "rep").agg((F.sum(F.col("_w") * F.col("s")) / F.sum(F.col("_w") * F.col("n"))).alias("brier_gain"))
    return _interval(cut(ap).join(brier, [*by, "rep"]), ["pr_auc_gain", "brier_gain"], by)


def gates(folds: DataFrame, intervals: DataFrame, multi: list[str], least_wins: int = LEAST_WINS) -> DataFrame:
    """One row a candidate: the gates s1 (mean average precision above the baseline's), s2 (mean Brier score below), s3 (folds won on
    each), s4 (both intervals above zero), passed, and chosen: of those that pass, the best by average precision, unless one of `multi`
    (candidates for any horizon) lies within the tolerances of it; ties go by name.

    folds: candidate, fold, pr_auc, brier, base_pr_auc, base_brier; intervals: candidate, pr_auc_gain_low, brier_gain_low."""
    wins = lambda c: F.count_if(c)
    g = folds.groupBy("candidate").agg(
        *[F.round(F.avg(c), 9).alias(c) for c in ("pr_auc", "brier", "base_pr_auc", "base_brier")],
        wins(F.col("pr_auc") > F.col("base_pr_auc")).alias("pr_wins"), wins(F.col("brier") < F.col("base_brier")).alias("brier_wins"),
    )
    g = g.join(intervals, "candidate", "left")
    g = g.select("*", (F.col("pr_auc") > F.col("base_pr_auc")).alias("s1"), (F.col("brier") < F.col("base_brier")).alias("s2"), ((F.col("pr_wins") >= least_wins) & (F.col("brier_wins") >= least_wins)).alias("s3"),
                 F.coalesce((F.col("pr_auc_gain_low") > 0) & (F.col("brier_gain_low") > 0), F.lit(False)).alias("s4"))
    g = g.withColumn("passed", F.expr("s1 AND s2 AND s3 AND s4")).withColumn("multi_horizon", F.col("candidate").isin(multi))
    every = Window.partitionBy(F.lit(1))  # a row a candidate
    best = F.max(F.when(F.col("passed"), F.struct("pr_auc", (-F.col("brier")).alias("b")))).over(every)
    g = g.withColumn("_best", best)
    near = F.col("passed") & F.col("multi_horizon") & (F.round(F.col("_best.pr_auc") - F.col("pr_auc"), 6) <= TIE_PR_AUC) & (F.round(F.col("brier") + F.col("_best.b"), 6) <= TIE_BRIER)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.coalesce(near, F.lit(False))), F.desc("passed"), F.desc("pr_auc"), "candidate")
    return g.withColumn("chosen", (F.row_number().over(order) == 1) & F.col("passed")).select("candidate", "pr_auc", "brier", "pr_wins", "brier_wins", "s1", "s2", "s3", "s4", "passed", "chosen")
