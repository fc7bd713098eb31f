"""Queries of task tables and audits that re-derive features in another way than the operators do."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import audit as A
from wardline.operators import duplicates as D
from wardline.operators import graph
from wardline.operators import panel as P
from wardline.plans.base import INC, incidents, register, with_
from wardline.plans.evaluation import _CS, _LEAD
from wardline.plans.hotspots import ALL, DAY, KEYS, W, day, panel


def _w(a: str, b: str) -> str:
    return W.format(f"ROWS BETWEEN {a} AND {b}")


def _as_checks(rules: dict[str, str]) -> str:
    """SQL for check rows from subqueries that count bad rows."""
    return " UNION ALL ".join(f"SELECT '{n}' AS check_id, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(bad AS BIGINT) AS bad FROM (SELECT ({x}) AS bad)" for n, x in rules.items())


LAGS = f""" lagged AS (SELECT city, zone_id, category, week, y, lag(y) OVER {W.format('')} AS lag_1, CAST(sum(y) OVER {_w('4 PRECEDING', '1 PRECEDING')} AS BIGINT) AS sum_4,
 avg(y) OVER {_w('4 PRECEDING', '1 PRECEDING')} AS m4, avg(y) OVER {_w('12 PRECEDING', '1 PRECEDING')} AS m12, lead(y) OVER {W.format('')} AS target FROM panel)"""


@register("prj29_hotspot_task", with_(f"""SELECT city, city || ':' || zone_id AS zone_key, zone_id, category, {DAY}, CAST(month(week) AS INT) AS month, CAST(year(week) AS INT) AS year, CAST(weekofyear(week) AS INT) AS week_of_year,
 y AS incident_count, lag_1 AS previous_period_count, sum_4 AS rolling_4w_count, round(m4, 6) AS rolling_4w_mean, round(m4 - m12, 6) AS trend_4w, target AS future_incident_count, target > 0 AS future_incident_flag
FROM lagged WHERE target IS NOT NULL""", *ALL, LAGS))  # fmt: skip
def hotspot_task(spark, d):
    """Hotspot rows with their calendar: ISO week, month and year of the week's Monday."""
    f = P.lag_features(panel(spark, d), KEYS)
    calendar = [F.month("week").alias("month"), F.year("week").alias("year"), F.weekofyear("week").alias("week_of_year")]
    names = {"y": "incident_count", "lag_1": "previous_period_count", "sum_4": "rolling_4w_count", "mean_4": "rolling_4w_mean", "trend": "trend_4w", "target": "future_incident_count", "target_active": "future_incident_flag"}
    return day(f.select("city", F.concat_ws(":", "city", "zone_id").alias("zone_key"), "zone_id", "category", "week", *calendar, *[F.col(a).alias(b) for a, b in names.items()]))


_HAV = """CASE WHEN q.latitude IS NOT NULL AND e.latitude IS NOT NULL THEN 2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(e.latitude - q.latitude) / 2), 2)
 + cos(radians(q.latitude)) * cos(radians(e.latitude)) * pow(sin(radians(e.longitude - q.longitude) / 2), 2))))) END"""


@register("prj30_duplicate_task", with_(f"""SELECT p.a AS incident_a, p.b AS incident_b, round({_HAV}, 3) AS distance_meters, round(abs(epoch_us(q.reported_at) - epoch_us(e.reported_at)) / 3.6e9, 4) AS time_difference_hours,
 q.category = e.category AS category_match, same_incident, negative_strategy, q.source_dataset, s.split
FROM (SELECT a, b, true AS same_incident, CAST(NULL AS VARCHAR) AS negative_strategy FROM pos UNION ALL SELECT a, b, false, 'N4' FROM ({_LEAD.format('source_dataset', 'n4', '')}) x
      WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pos WHERE (pos.a = x.a AND pos.b = x.b) OR (pos.a = x.b AND pos.b = x.a))) p
JOIN inc q ON q.incident_id = p.a JOIN inc e ON e.incident_id = p.b JOIN isp s ON s.incident_id = p.a JOIN isp t ON t.incident_id = p.b AND t.split = s.split""", INC, _CS))  # fmt: skip
def duplicate_task(spark, d):
    """Positive and unrelated pairs whose ends lie in one split, with the features that exist for them."""
    i = incidents(spark, d)
    pos = graph.cut(D.positives(i).select("a", "b"))
    split = graph.cut(D.component_splits(i, graph.components(pos), pos).select("incident_id", "split"))
    neg = D.without(D.permuted(i, "n4", ["source_dataset"]).select("a", "b"), pos)
    pairs = pos.select("a", "b", F.lit(True).alias("same_incident"), F.lit(None).cast("string").alias("negative_strategy")).unionByName(neg.select("a", "b", F.lit(False).alias("same_incident"), F.lit("N4").alias("negative_strategy")))
    side = lambda s: i.select(F.col("incident_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("latitude", "longitude", "reported_at", "category", "source_dataset")]).join(split.toDF(s, f"split_{s}"), s)
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("split_a = split_b")
    far = S.haversine_m(*[F.col(c) for c in ("latitude_a", "longitude_a", "latitude_b", "longitude_b")])
    apart = F.abs(S.hours_between(F.col("reported_at_a"), F.col("reported_at_b")))
    return met.select(
        F.col("a").alias("incident_a"), F.col("b").alias("incident_b"), F.round(far, 3).alias("distance_meters"), F.round(apart, 4).alias("time_difference_hours"),
        (F.col("category_a") == F.col("category_b")).alias("category_match"), "same_incident", "negative_strategy", F.col("source_dataset_a").alias("source_dataset"), F.col("split_a").alias("split"),
    )


_INT = {
    "INT-5": "SELECT count(*) FROM inc WHERE sla_target_hours IS NOT NULL AND rk > 1",
    "INT-6": "SELECT count(*) FROM inc WHERE resolution_hours < 0",
    "INT-7": "SELECT count(*) FROM inc WHERE latitude IS NOT NULL AND NOT (latitude BETWEEN 10 + 5 * rk AND 10 + 5 * rk + 0.181 AND longitude BETWEEN 20 AND 20.19)",
    "INT-8": "SELECT count(*) FROM (SELECT incident_id FROM inc GROUP BY 1 HAVING count(DISTINCT source_dataset) > 1)",
    "INT-9": "SELECT count(*) FROM (SELECT component FROM isp GROUP BY 1 HAVING count(DISTINCT split) > 1)",
    "DS-1": "SELECT count(*) FROM (SELECT incident_id FROM inc GROUP BY 1 HAVING count(*) > 1)",
    "TF-1": "SELECT count(*) FROM inc WHERE reported_at IS NULL",
    "TF-2": "SELECT count(*) FROM inc WHERE (status = 'closed') <> (closed_at IS NOT NULL)",
    "PR-1": "SELECT count(*) FROM inc WHERE is_instant_closure AND resolution_hours IS NOT NULL",
    "TG-1": "SELECT count(*) FROM inc WHERE sla_met IS NOT NULL AND (resolution_hours IS NULL OR sla_target_hours IS NULL)",
    "TG-2": "SELECT count(*) FROM inc WHERE resolution_hours > 87600",
    "LK-1": "SELECT count(*) FROM inc WHERE closed_at IS NULL AND (resolution_hours IS NOT NULL OR sla_met IS NOT NULL)",
}


@register("chk1_chk9_audit", with_(_as_checks(_INT), INC, _CS))
def integrity_audit(spark, d):
    i = incidents(spark, d)
    true = F.lit(True)
    box = F.col("latitude").between(10 + 5 * F.col("rk"), 10 + 5 * F.col("rk") + 0.181) & F.col("longitude").between(20, 20.19)
    rows = A.checks(i, {
        "INT-5": F.col("sla_target_hours").isNull() | (F.col("rk") <= 1), "INT-6": F.coalesce(F.col("resolution_hours") >= 0, true), "INT-7": F.coalesce(box, true),
        "TF-1": F.col("reported_at").isNotNull(), "TF-2": (F.col("status") == "closed") == F.col("closed_at").isNotNull(),
        "PR-1": ~F.coalesce(F.col("is_instant_closure"), F.lit(False)) | F.col("resolution_hours").isNull(),
        "TG-1": F.col("sla_met").isNull() | (F.col("resolution_hours").isNotNull() & F.col("sla_target_hours").isNotNull()), "TG-2": F.coalesce(F.col("resolution_hours") <= 87600, true),
        "LK-1": F.col("closed_at").isNotNull() | (F.col("resolution_hours").isNull() & F.col("sla_met").isNull()),
    })
    ids = i.groupBy("incident_id").agg(F.count("*").alias("n"), F.min("source_dataset").alias("a"), F.max("source_dataset").alias("b"))
    pos = D.positives(i)
    parts = D.component_splits(i, graph.components(pos), pos).groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return A.stacked([rows, A.checks(ids, {"INT-8": F.col("a") == F.col("b"), "DS-1": F.col("n") == 1}), A.checks(parts, {"INT-9": F.col("a") == F.col("b")})])


_LEAK = {
    "LEAK-2": "SELECT count(*) FROM lagged l LEFT JOIN panel p ON p.city = l.city AND p.zone_id = l.zone_id AND p.category = l.category AND p.week = l.week - 7 WHERE target IS NOT NULL AND lag_1 IS DISTINCT FROM p.y",
    "LEAK-3": "SELECT count(*) FROM lagged l LEFT JOIN panel p ON p.city = l.city AND p.zone_id = l.zone_id AND p.category = l.category AND p.week = l.week + 7 WHERE target IS NOT NULL AND target IS DISTINCT FROM p.y",
    "LEAK-2b": "SELECT count(*) FROM lagged l JOIN panel p ON p.city = l.city AND p.zone_id = l.zone_id AND p.category = l.category AND p.week = l.week - 7 WHERE target IS NOT NULL AND lag_1 = l.y AND p.y <> l.y",
}


@register("chk3_lags_rederived", with_(_as_checks(_LEAK), *ALL, LAGS))
def lags_rederived(spark, d):
    """The lag and the target of the feature table against the panel itself, joined by calendar week and not by order."""
    p = panel(spark, d)
    f = P.lag_features(p, KEYS).select(*KEYS, "week", "y", "lag_1", "target")
    other = lambda days, n: p.select(*KEYS, F.date_add("week", days).alias("week"), F.col("y").alias(n))
    met = f.join(other(7, "before"), [*KEYS, "week"], "left").join(other(-7, "after"), [*KEYS, "week"], "left")
    return A.checks(met, {
        "LEAK-2": F.col("lag_1").eqNullSafe(F.col("before")), "LEAK-3": F.col("target").eqNullSafe(F.col("after")),
        "LEAK-2b": ~F.coalesce((F.col("lag_1") == F.col("y")) & (F.col("before") != F.col("y")), F.lit(False)),
    })


_TL = {
    "TL-9": f"SELECT count(*) FROM (SELECT week - lag(week) OVER {W.format('')} AS gap FROM lagged WHERE target IS NOT NULL) WHERE gap <> 7",
    "TL-1": "SELECT count(*) FROM (SELECT 1 FROM lagged WHERE target IS NOT NULL GROUP BY city, zone_id, category, week HAVING count(*) > 1)",
    "TL-2": "SELECT count(*) FROM lagged WHERE target IS NOT NULL AND (y < 0 OR target < 0)",
    "TL-3": "SELECT count(*) FROM lagged WHERE target IS NOT NULL AND dayofweek(week) <> 1",
    "TASK-1": "SELECT count(*) FROM (SELECT city, zone_id, category FROM panel EXCEPT SELECT city, zone_id, category FROM lagged WHERE target IS NOT NULL)",
}


@register("chk10_task_audit", with_(_as_checks(_TL), *ALL, LAGS))
def task_audit(spark, d):
    p = panel(spark, d)
    f = P.lag_features(p, KEYS)
    series = F.lag("week").over(P._series(KEYS))
    rows = A.checks(f.withColumn("_gap", F.date_diff("week", series)), {
        "TL-9": F.coalesce(F.col("_gap") == 7, F.lit(True)), "TL-2": (F.col("y") >= 0) & (F.col("target") >= 0), "TL-3": F.dayofweek("week") == 2,
    })
    once = A.checks(f.groupBy(*KEYS, "week").agg(F.count("*").alias("n")), {"TL-1": F.col("n") == 1})
    seen = p.select(*KEYS).distinct().join(f.select(*KEYS, F.lit(True).alias("seen")).distinct(), KEYS, "left")
    return A.stacked([rows, once, A.checks(seen, {"TASK-1": F.col("seen").isNotNull()})])
