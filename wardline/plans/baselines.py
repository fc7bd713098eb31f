"""Queries of all published baselines side by side: resolution hours and SLA breach, with recent windows as of each report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wardline.operators import history, snapshots
from wardline.operators import metrics as M
from wardline.operators.storage import cut
from wardline.plans.asof import _OWN, _SPARSE, _late
from wardline.plans.base import INC, incidents, register, with_
from wardline.plans.evaluation import _SPLIT, splits

#: Baselines that look a key up; the department is the subcategory here.
KEYS = {"global": [], "category": ["category"], "category_city": ["category", "city"], "category_department": ["category", "subcategory"]}


def _lookup_sql(target: str, how: str) -> dict[str, str]:
    """p of each looked-up baseline for the test rows (te) from the training rows (tr)."""
    whole = f"(SELECT {how}({target}) FROM tr)"
    out = {}
    for name, keys in KEYS.items():
        if not keys:
            out[name] = f"SELECT t.incident_id, t.{target} AS y, {whole} AS p FROM te t"
        else:
            on = " AND ".join(f"a.{k} = t.{k}" for k in keys)
            out[name] = f"SELECT t.incident_id, t.{target} AS y, coalesce(a.m, {whole}) AS p FROM te t LEFT JOIN (SELECT {', '.join(keys)}, {how}({target}) AS m FROM tr GROUP BY ALL) a ON {on}"
    return out


def _looked_up(df, target: str, how: str):
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    return {n: M.lookup_prediction(train, test, keys, target, how).select("incident_id", F.col(target).alias("y"), "p") for n, keys in KEYS.items()}


def _stacked(parts: dict):
    return reduce(lambda a, b: a.unionByName(b), [p.select(F.lit(n).alias("baseline"), "y", "p") for n, p in parts.items()])


_RES = _lookup_sql("resolution_hours", "median")
_RECENT = f"""SELECT q.incident_id, CASE WHEN count(e.h) >= 10 THEN round(exp(median(ln(1 + e.h))) - 1, 4) END AS r
 FROM e q LEFT JOIN e ON {_OWN} AND e.h IS NOT NULL AND CAST(e.closed_at AS DATE) < CAST(q.reported_at AS DATE) AND CAST(e.closed_at AS DATE) >= CAST(q.reported_at AS DATE) - 30 GROUP BY 1"""


@register("fc4_resolution_baselines", with_(
    "SELECT baseline, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS baseline, y, p FROM ({x})" for n, x in _RES.items())
    + f" UNION ALL SELECT 'recent_30d', c.y, coalesce(r.r, c.p) FROM ({_RES['category']}) c JOIN ({_RECENT}) r USING (incident_id)) GROUP BY 1",
    INC, _SPLIT, _SPARSE, "tr AS (SELECT * FROM sp WHERE split = 'train' AND resolution_hours IS NOT NULL), te AS (SELECT * FROM sp WHERE split = 'test' AND resolution_hours IS NOT NULL)"))
def resolution_baselines(spark, d):
    i = cut(splits(spark, d).select("incident_id", "source_dataset", "category", "city", "subcategory", "split", "reported_at", "closed_at", "resolution_hours"))
    parts = _looked_up(i.where("resolution_hours IS NOT NULL"), "resolution_hours", "median")
    recent = snapshots.daily_snapshot(i, ["source_dataset", "category"], 30, least=10).select("incident_id", "median_hours")
    parts["recent_30d"] = parts["category"].join(recent, "incident_id").select("y", F.coalesce("median_hours", "p").alias("p"))
    e = F.col("y") - F.col("p")
    return _stacked(parts).groupBy("baseline").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


_SLA = _lookup_sql("breach", "avg")


@register("fc5_sla_baselines_recent", with_(
    "SELECT baseline, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS baseline, y, p FROM ({x})" for n, x in _SLA.items())
    + f" UNION ALL SELECT 'recent_30d', c.y, coalesce(r.breach_rate, c.p) FROM ({_SLA['category']}) c JOIN ({_late(_OWN, 'e', 72, 30)}) r USING (incident_id)) GROUP BY 1",
    INC, _SPLIT, _SPARSE, "st AS (SELECT *, CAST(NOT sla_met AS INT) AS breach FROM sp WHERE sla_met IS NOT NULL), tr AS (SELECT * FROM st WHERE split = 'train'), te AS (SELECT * FROM st WHERE split = 'test')"))
def sla_baselines_recent(spark, d):
    i = cut(splits(spark, d).select("incident_id", "source_dataset", "category", "city", "subcategory", "split", "reported_at", "closed_at", (~F.col("sla_met")).cast("int").alias("breach")))
    parts = _looked_up(i.where("breach IS NOT NULL"), "breach", "mean")
    recent = history.recent_breach_rate(i, ["source_dataset", "category"], 72, 30).select("incident_id", "breach_rate")
    parts["recent_30d"] = parts["category"].join(recent, "incident_id").select("y", F.coalesce("breach_rate", "p").alias("p"))
    return _stacked(parts).groupBy("baseline").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"))


@register("ag46_composite_baselines_all", with_("""SELECT keys, count(*) AS groups, round(min(m), 4) AS least_median, round(max(m), 4) AS most_median, round(sum(c * n) / sum(n), 4) AS mean_log_constant FROM ("""
    + " UNION ALL ".join(f"SELECT '{n}' AS keys, median(resolution_hours) AS m, exp(avg(ln(1 + resolution_hours))) - 1 AS c, count(*) AS n FROM tr {'GROUP BY ' + ', '.join(k) if k else ''}" for n, k in KEYS.items())
    + ") GROUP BY 1", INC, _SPLIT, "tr AS (SELECT * FROM sp WHERE split = 'train' AND resolution_hours IS NOT NULL)"))
def composite_baselines_all(spark, d):
    """Medians and log-mean constants of training rows by each composite key."""
    from wardline.operators.quantiles import with_quantiles

    train = cut(splits(spark, d).where("split = 'train' AND resolution_hours IS NOT NULL").select("category", "city", "subcategory", "resolution_hours"))
    sums = [F.expm1(F.avg(F.log1p("resolution_hours"))).alias("c"), F.count("*").alias("n")]
    parts = [with_quantiles(train, k, "resolution_hours", {"m": 0.5}, sums).select(F.lit(n).alias("keys"), "m", "c", "n") for n, k in KEYS.items()]
    g = reduce(lambda a, b: a.unionByName(b), parts).groupBy("keys")
    return g.agg(F.count("*").alias("groups"), F.round(F.min("m"), 4).alias("least_median"), F.round(F.max("m"), 4).alias("most_median"), F.round(F.sum(F.col("c") * F.col("n")) / F.sum("n"), 4).alias("mean_log_constant"))
