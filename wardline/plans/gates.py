"""Queries of cluster bootstraps and of the gates that candidates pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import bootstrap as B
from wardline.operators import metrics as M
from wardline.operators.storage import cut
from wardline.plans.base import INC, register, table, with_
from wardline.plans.evaluation import _SPLIT, _looked_up

#: Candidates: how their scores are made from a document's id and label. The last one is for any horizon.
CANDIDATES = [("alpha", 7919, 300), ("beta", 104729, 500), ("gamma", 31, 0), ("multi", 7907, 495)]
REPLICATES = 100


def _weight_sql(cluster: str) -> str:
    u = f"CAST('0x' || substr(md5(concat_ws('|', '7', CAST({cluster} AS VARCHAR), CAST(rep AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296e0"
    return "CASE " + " ".join(f"WHEN {u} < {x} THEN {k}" for k, x in enumerate(B.POISSON)) + f" ELSE {len(B.POISSON)} END"


def _interval_sql(column: str) -> str:
    return ", ".join(f"round(quantile_cont({column}, {q}), 6) AS {column}_{n}" for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975)))


_REPS = "reps AS (SELECT range AS rep FROM range(1, {}))"


@register("ag25_paired_bootstrap", with_(f"""
SELECT {_interval_sql("gain").replace("gain_", "")} FROM (SELECT rep, sum(w * s) / sum(w * n) AS gain FROM (SELECT rep, s, n, {_weight_sql("zone_id")} AS w FROM cl, reps) WHERE w > 0 GROUP BY rep)""",
    INC, _SPLIT, "tr AS (SELECT * FROM sp WHERE split = 'train' AND resolution_hours IS NOT NULL), te AS (SELECT * FROM sp WHERE split = 'test' AND resolution_hours IS NOT NULL)",
    """cl AS (SELECT t.zone_id, sum(abs(t.resolution_hours - 900) - abs(t.resolution_hours - coalesce(a.m, (SELECT median(resolution_hours) FROM tr)))) AS s, count(*) AS n
 FROM te t LEFT JOIN (SELECT category, median(resolution_hours) AS m FROM tr GROUP BY 1) a ON a.category = t.category GROUP BY 1)""", _REPS.format(201)))  # fmt: skip
def paired_bootstrap(spark, d):
    own = M.lookup_prediction(*_looked_up(spark, d), ["category"], "resolution_hours")
    return B.paired_bootstrap(own, "zone_id", F.abs(F.col("resolution_hours") - 900) - F.abs(F.col("resolution_hours") - F.col("p")))


_CAND = f"""cand AS (SELECT candidate, doc_id % 6 AS fold, doc_id % 29 AS day, toxic AS y, ((doc_id * 31) % 1000 + toxic * 150) / 1150e0 AS p_base, ((doc_id * a) % 1000 + toxic * b) / (1000e0 + b) AS p
 FROM labels, (VALUES {", ".join(f"('{c}', {a}, {b})" for c, a, b in CANDIDATES)}) AS v(candidate, a, b)),
long AS (SELECT candidate, fold, day, y, 'base' AS m, p_base AS p FROM cand UNION ALL SELECT candidate, fold, day, y, 'cand', p FROM cand)"""
_BOOT = f"""wl AS (SELECT *, {_weight_sql("day")} AS w FROM (SELECT candidate, day, m, p, sum(y) AS pos, count(*) AS n FROM long GROUP BY ALL), reps),
ws AS (SELECT candidate, rep, m, p, sum(w * pos) AS pos, sum(w * n) AS n FROM wl WHERE w > 0 GROUP BY ALL),
wc AS (SELECT *, sum(pos) OVER (PARTITION BY candidate, rep, m ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY candidate, rep, m ORDER BY p DESC) AS upto FROM ws),
wa AS (SELECT candidate, rep, m, sum(pos * 1e0 * tp / upto) / nullif(sum(pos), 0) AS ap FROM wc GROUP BY ALL),
wb AS (SELECT candidate, rep, sum(w * s) / sum(w * n) AS brier_gain FROM (SELECT candidate, day, rep, s, n, {_weight_sql("day")} AS w FROM
 (SELECT candidate, day, sum(pow(p_base - y, 2) - pow(p - y, 2)) AS s, count(*) AS n FROM cand GROUP BY ALL), reps) WHERE w > 0 GROUP BY ALL),
boot AS (SELECT candidate, {_interval_sql("pr_auc_gain")}, {_interval_sql("brier_gain")} FROM
 (SELECT candidate, rep, max(ap) FILTER (m = 'cand') - max(ap) FILTER (m = 'base') AS pr_auc_gain FROM wa GROUP BY ALL) JOIN wb USING (candidate, rep) GROUP BY 1)"""


def _candidates(spark, d):
    made = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(a).alias("a"), F.lit(b).alias("b")) for c, a, b in CANDIDATES]))
    rows = table(spark, d, "labels").select("doc_id", "toxic", made.alias("v")).select("doc_id", "toxic", "v.*")
    return rows.select(
        "candidate", (F.col("doc_id") % 6).alias("fold"), (F.col("doc_id") % 29).alias("day"), F.col("toxic").alias("y"), (((F.col("doc_id") * 31) % 1000 + F.col("toxic") * 150) / F.lit(1150.0)).alias("p_base"),
        (((F.col("doc_id") * F.col("a")) % 1000 + F.col("toxic") * F.col("b")) / (F.lit(1000.0) + F.col("b"))).alias("p"),
    )


@register("ag25_classification_bootstrap", with_("SELECT * FROM boot", _REPS.format(REPLICATES + 1), _CAND, _BOOT))
def classification_bootstrap(spark, d):
    return B.classification_bootstrap(_candidates(spark, d), ["candidate"], "day", "y", "p_base", "p", REPLICATES)


@register("ag50_sla_gates", with_(f"""
SELECT candidate, pr_auc, brier, pr_wins, brier_wins, s1, s2, s3, s4, passed, passed AND row_number() OVER (ORDER BY near DESC, passed DESC, pr_auc DESC, candidate) = 1 AS chosen FROM (
 SELECT *, passed AND candidate = 'multi' AND round(best - pr_auc, 6) <= {B.TIE_PR_AUC} AND round(brier - best_brier, 6) <= {B.TIE_BRIER} AS near FROM (
  SELECT *, max(pr_auc) FILTER (passed) OVER () AS best, arg_max(brier, pr_auc) FILTER (passed) OVER () AS best_brier FROM (
   SELECT *, s1 AND s2 AND s3 AND s4 AS passed FROM (
    SELECT candidate, pr_auc, brier, pr_wins, brier_wins, pr_auc > bp AS s1, brier < bb AS s2, pr_wins >= {B.LEAST_WINS} AND brier_wins >= {B.LEAST_WINS} AS s3, coalesce(pr_auc_gain_low > 0 AND brier_gain_low > 0, false) AS s4 FROM g JOIN boot USING (candidate)))))""",
    _REPS.format(REPLICATES + 1), _CAND, _BOOT,
    """fc AS (SELECT candidate, fold, m, p, sum(y) AS pos, count(*) AS n FROM long GROUP BY ALL),
fw AS (SELECT *, sum(pos) OVER (PARTITION BY candidate, fold, m ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY candidate, fold, m ORDER BY p DESC) AS upto FROM fc),
fa AS (SELECT candidate, fold, m, round(sum(pos * 1e0 * tp / upto) / nullif(sum(pos), 0), 6) AS ap FROM fw GROUP BY ALL),
fb AS (SELECT candidate, fold, m, round(avg(pow(p - y, 2)), 6) AS br FROM long GROUP BY ALL),
pf AS (SELECT candidate, fold, max(ap) FILTER (m = 'cand') AS pr, max(ap) FILTER (m = 'base') AS bpr, max(br) FILTER (m = 'cand') AS br, max(br) FILTER (m = 'base') AS bbr FROM fa JOIN fb USING (candidate, fold, m) GROUP BY ALL),
g AS (SELECT candidate, round(avg(pr), 9) AS pr_auc, round(avg(br), 9) AS brier, round(avg(bpr), 9) AS bp, round(avg(bbr), 9) AS bb, count(*) FILTER (pr > bpr) AS pr_wins, count(*) FILTER (br < bbr) AS brier_wins FROM pf GROUP BY 1)"""))  # fmt: skip
def sla_gates(spark, d):
    rows = cut(_candidates(spark, d))
    long = rows.select("candidate", "fold", "y", F.explode(F.array(F.struct(F.lit("cand").alias("m"), F.col("p")), F.struct(F.lit("base").alias("m"), F.col("p_base").alias("p")))).alias("x")).select("candidate", "fold", "y", "x.*")
    each = M.ranking(long, ["candidate", "fold", "m"]).join(long.groupBy("candidate", "fold", "m").agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("br")), ["candidate", "fold", "m"])
    of = lambda c, m: F.max(F.when(F.col("m") == m, F.col(c)))
    folds = each.groupBy("candidate", "fold").agg(of("average_precision", "cand").alias("pr_auc"), of("br", "cand").alias("brier"), of("average_precision", "base").alias("base_pr_auc"), of("br", "base").alias("base_brier"))
    intervals = B.classification_bootstrap(rows, ["candidate"], "day", "y", "p_base", "p", REPLICATES)
    return B.gates(folds, intervals.select("candidate", "pr_auc_gain_low", "brier_gain_low"), ["multi"])
