"""Queries of incident records, shadow evaluation, verdicts on folds, and a density audit by another way of counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import audit as A
from wardline.operators import geo, records
from wardline.plans.asof import _HAV
from wardline.plans.audits import _as_checks
from wardline.plans.base import INC, ORACLE, incidents, register, table, with_
from wardline.plans.evaluation import _SPLIT, splits
from wardline.plans.hotspots import _B, ALL, _baselines

# Lines of an order stand for its history; their flags A and R for closures.
_REC = """rec AS (SELECT i.incident_id, k, category, reported_at AS created_at, latitude, longitude, sla_target_hours AS sla_hours, first_closed_at FROM inc i
 LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_closed_at FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1) c ON c.l_orderkey = i.k)"""


def _records(spark, d, **limits):
    i = incidents(spark, d).select("incident_id", "k", "category", F.col("reported_at").alias("created_at"), "latitude", "longitude", F.col("sla_target_hours").alias("sla_hours"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("action"), F.col("l_shipdate").cast("timestamp").alias("at"))
    history = lines.join(i.select("k", "incident_id"), "k").drop("k")
    return records.incident_records(i, history, ["A", "R"], **limits)


@register("src10_incident_records", with_("SELECT incident_id, category, epoch_us(created_at) AS created_us, latitude, longitude, epoch_us(first_closed_at) AS closed_us FROM rec WHERE created_at <= TIMESTAMP '1996-06-30' AND latitude BETWEEN 10 AND 20.1e0 AND longitude BETWEEN 20 AND 20.1e0", INC, _REC))
def incident_records(spark, d):
    out = _records(spark, d, upto=F.lit("1996-06-30").cast("timestamp"), box=(10.0, 20.1, 20.0, 20.1))
    return out.select("incident_id", "category", F.unix_micros("created_at").alias("created_us"), "latitude", "longitude", F.unix_micros("first_closed_at").alias("closed_us"))


_NOW, _NOW_US = "1998-08-03", "epoch_us(TIMESTAMP '1998-08-03')"
_LOG = {"method": "CASE WHEN k % 2 = 0 THEN 'MODEL' ELSE 'LOOKUP' END", "status": "CASE WHEN k % 5 = 0 THEN 'FALLBACK' ELSE 'OK' END", "estimate_hours": "CASE WHEN k % 13 <> 0 THEN k % 2000 END", "probability": "CASE WHEN k % 13 <> 0 THEN (k % 11) / 1e1 END"}


@register("ag26_shadow_groups", with_(f"""SELECT task, method, status, count(*) AS n, {", ".join(f"count(*) FILTER (state = '{s}') AS n_{s.lower()}" for s in ("OBSERVED", "CENSORED", "BREACHED", "MET", "PENDING", "NO_SLA"))},
 round(avg(abs(hours - estimate_hours)) FILTER (state = 'OBSERVED'), 4) AS mae, count(*) FILTER (state = 'CENSORED' AND hours > estimate_hours) AS n_under,
 round(avg(pow(probability - CASE WHEN state = 'BREACHED' THEN 1e0 ELSE 0e0 END, 2)) FILTER (state IN ('BREACHED', 'MET')), 6) AS brier,
 CASE task WHEN 'sla' THEN count(probability) FILTER (state IN ('BREACHED', 'MET')) ELSE count(estimate_hours) FILTER (state = 'OBSERVED') END >= 30 AS enough FROM (
 SELECT *, CASE WHEN task = 'resolution' THEN greatest(end_us - epoch_us(created_at), 0) / 3.6e9 END AS hours,
  CASE WHEN task = 'resolution' THEN CASE WHEN first_closed_at IS NULL THEN 'CENSORED' ELSE 'OBSERVED' END WHEN sla_hours IS NULL THEN 'NO_SLA'
   WHEN end_us >= epoch_us(created_at) + sla_hours * 3.6e9 THEN 'BREACHED' WHEN first_closed_at IS NULL THEN 'PENDING' ELSE 'MET' END AS state
 FROM (SELECT *, {", ".join(f"{x} AS {n}" for n, x in _LOG.items())}, coalesce(epoch_us(first_closed_at), {_NOW_US}) AS end_us FROM rec, (VALUES ('resolution'), ('sla')) t(task))) GROUP BY task, method, status""", INC, _REC))  # fmt: skip
def shadow_groups(spark, d):
    log = _records(spark, d).selectExpr("*", *[f"{x} AS {n}" for n, x in _LOG.items()])
    return records.shadow_evaluation(log.withColumn("task", F.explode(F.array(F.lit("resolution"), F.lit("sla")))), F.lit(_NOW).cast("timestamp"))


_VAL, _TEST = "week >= DATE '1995-01-01' AND week < DATE '1996-01-01'", "week >= DATE '1996-01-01'"


@register("ag51_fold_verdict", with_(f"""SELECT *, CASE WHEN val_model < val_rolling AND test_model < test_rolling THEN 'both' WHEN test_model < test_rolling THEN 'test only' WHEN val_model < val_rolling THEN 'validation only' ELSE 'neither' END AS verdict
 FROM (SELECT city, {", ".join(f"round(avg(abs(target - {c})) FILTER ({w}), 4) AS {n}_{m}" for n, w in (("val", _VAL), ("test", _TEST)) for m, c in (("model", "ewma_30"), ("rolling", "roll_4")))} FROM base GROUP BY city)""", *ALL, _B))  # fmt: skip
def fold_verdict(spark, d):
    """Smoothing against the rolling four-week mean by city: derived from the errors on both folds, a tie is no win."""
    error = lambda fold, c: F.round(F.avg(F.when(F.expr(fold), F.abs(F.col("target") - F.col(c)))), 4)
    folds = {"val": _VAL, "test": _TEST}
    e = _baselines(spark, d).groupBy("city").agg(*[error(w, c).alias(f"{n}_{m}") for n, w in folds.items() for m, c in (("model", "ewma_30"), ("rolling", "roll_4"))])
    val, test = (F.coalesce(F.col(f"{n}_model") < F.col(f"{n}_rolling"), F.lit(False)) for n in folds)
    return e.withColumn("verdict", F.when(val & test, "both").when(test, "test only").when(val, "validation only").otherwise("neither"))


@register("ag14_breach_baselines", with_("SELECT category, round(sla_target_hours, 4) AS sla_hours, count(*) AS n, round(avg(CASE WHEN sla_met THEN 0e0 ELSE 1e0 END), 6) AS breach_rate FROM sp WHERE split = 'train' AND sla_met IS NOT NULL GROUP BY 1, 2", INC, _SPLIT))
def breach_baselines(spark, d):
    known = splits(spark, d).where("split = 'train' AND sla_met IS NOT NULL")
    return known.groupBy("category", F.round("sla_target_hours", 4).alias("sla_hours")).agg(F.count("*").alias("n"), F.round(F.avg((~F.col("sla_met")).cast("double")), 6).alias("breach_rate"))


@register("ag4_incident_ranges", with_("SELECT source_dataset, count(*) AS n, epoch_us(min(reported_at)) AS first_us, epoch_us(max(reported_at)) AS last_us, round(count(latitude) * 1e0 / count(*), 6) AS valid_share, count(*) - count(DISTINCT incident_id) AS n_repeated FROM inc GROUP BY 1", INC))
def incident_ranges(spark, d):
    """Repeats are counted over rows of an id, so that no task holds a source's ids."""
    ids = incidents(spark, d).groupBy("source_dataset", "incident_id").agg(F.count("*").alias("n"), F.min("reported_at").alias("a"), F.max("reported_at").alias("b"), F.count("latitude").alias("valid"))
    n = F.sum("n")
    return ids.groupBy("source_dataset").agg(n.alias("n"), F.unix_micros(F.min("a")).alias("first_us"), F.unix_micros(F.max("b")).alias("last_us"), F.round(F.sum("valid") / n, 6).alias("valid_share"), (n - F.count("*")).alias("n_repeated"))


#: Incidents whose density is counted again, by the least hashes of their ids.
SAMPLE = 200
_DENS = ORACLE["jn5_historical_density"].split("\nSELECT", 1)
_AGAIN = f"""SELECT count(*) FROM (SELECT q.incident_id, count(e.incident_id) AS n FROM (SELECT * FROM inc WHERE latitude IS NOT NULL ORDER BY md5(incident_id) LIMIT {SAMPLE}) q LEFT JOIN inc e ON e.category = q.category AND e.latitude IS NOT NULL
 AND e.reported_at < q.reported_at AND e.reported_at >= q.reported_at - INTERVAL 720 HOUR AND {_HAV} <= 250 GROUP BY 1) JOIN dens USING (incident_id) WHERE n <> n_30d"""


@register("chk4_density_audit", with_(_as_checks({
    "LEAK-4": _AGAIN, "DN-1": "SELECT count(*) FROM dens WHERE n_24h > n_7d OR n_7d > n_30d OR n_30d > all_30d", "DN-2": "SELECT count(*) FROM dens WHERE share_same < 0 OR share_same > 1",
    "DN-3": "SELECT count(*) FROM dens WHERE (hours_since IS NOT NULL) <> coalesce(all_30d > 0, false)",
}), INC, "dens AS (SELECT" + _DENS[1] + ")"))
def density_audit(spark, d):
    """Windows that only grow, shares within 0 and 1, a recency just where something was near, and a sample counted again without
    cells: its bounded rows meet all incidents of their category."""
    i = incidents(spark, d)
    dens = geo.historical_density(i)
    rows = A.checks(dens, {
        "DN-1": F.coalesce((F.col("n_24h") <= F.col("n_7d")) & (F.col("n_7d") <= F.col("n_30d")) & (F.col("n_30d") <= F.col("all_30d")), F.lit(True)),
        "DN-2": F.coalesce(F.col("share_same").between(0, 1), F.lit(True)), "DN-3": F.col("hours_since").isNotNull() == F.coalesce(F.col("all_30d") > 0, F.lit(False)),
    })
    place = ["category", "latitude", "longitude", F.unix_micros("reported_at").alias("us")]
    sample = i.where("latitude IS NOT NULL").orderBy(F.md5("incident_id")).limit(SAMPLE).select("incident_id", *place)
    e = i.where("latitude IS NOT NULL").select(*place).toDF("category", "lat", "lon", "eus")
    near = S.haversine_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")) <= 250.0
    met = e.join(F.broadcast(sample), "category").where((F.col("eus") < F.col("us")) & (F.col("us") - F.col("eus") <= 720 * 3_600_000_000) & near)
    again = sample.join(met.groupBy("incident_id").agg(F.count("*").alias("n")), "incident_id", "left").select("incident_id", F.coalesce("n", F.lit(0)).alias("n"))
    return A.stacked([rows, A.checks(again.join(dens, "incident_id"), {"LEAK-4": F.col("n") == F.col("n_30d")})])
