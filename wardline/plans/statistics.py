"""Queries of drift, findings, error tables, dashboard counters and forecasts with their reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import audit as A
from wardline.operators import panel as P
from wardline.operators import statistics as ST
from wardline.operators.quantiles import quantiles
from wardline.operators.storage import cut, small
from wardline.plans.base import IN_SCOPE, INC, incidents, register, with_
from wardline.plans.evaluation import _SPLIT, splits
from wardline.plans.hotspots import ALL, WEEK, _B, _baselines

LEVELS = ["city", "zone_id", "category", "subcategory", "status", "is_duplicate", "is_weekend"]
NUMBERS = ["month", "hour_utc", "day_of_week", "year", "sla_target_hours"]
_FEATURES = """ft AS MATERIALIZED (SELECT *, CAST(month(reported_at) AS DOUBLE) AS month, CAST(hour(reported_at) AS DOUBLE) AS hour_utc, CAST(isodow(reported_at) - 1 AS DOUBLE) AS day_of_week,
 CAST(year(reported_at) AS DOUBLE) AS year, isodow(reported_at) >= 6 AS is_weekend, CAST(NULL AS VARCHAR) AS image_url, 'v1' AS schema_version FROM sp)"""


def features(spark, d):
    at = F.col("reported_at")
    calendar = {"month": F.month(at), "hour_utc": F.hour(at), "day_of_week": F.weekday(at), "year": F.year(at), "is_weekend": F.weekday(at) >= 5}
    return splits(spark, d).withColumns(calendar).withColumns({"image_url": F.lit(None).cast("string"), "schema_version": F.lit("v1")})


def _tv(c: str) -> str:
    """Total variation of one column in SQL, over the union of both sides' forty top levels."""
    n = f"(SELECT CAST({c} AS VARCHAR) AS v, split, count(*) AS n FROM ft WHERE {c} IS NOT NULL GROUP BY 1, 2)"
    one = f"""(SELECT round(sum(abs(coalesce(a.n, 0) * 1e0 / (SELECT count({c}) FROM ft WHERE split = 'train') - coalesce(b.n, 0) * 1e0 / (SELECT count({c}) FROM ft WHERE split = '{{0}}'))) / 2, 4)
     FROM (SELECT DISTINCT v FROM (SELECT v, row_number() OVER (PARTITION BY split ORDER BY n DESC, v) AS rk FROM {n} WHERE split IN ('train', '{{0}}')) WHERE rk <= 40) k
     LEFT JOIN (SELECT * FROM {n} WHERE split = 'train') a USING (v) LEFT JOIN (SELECT * FROM {n} WHERE split = '{{0}}') b USING (v))"""
    return f"SELECT '{c}' AS column, 'total-variation' AS metric, {one.format('val')} AS val, {one.format('test')} AS test"


def _psi(c: str) -> str:
    """Population stability index of one column in SQL, over training's distinct deciles."""
    e = f"(SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{', '.join(f'{i / 10}e0' for i in range(11))}]))) AS e FROM ft WHERE split = 'train')"
    n = f"(SELECT split, least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) AS b, count(*) AS n FROM (SELECT split, CAST({c} AS DOUBLE) AS v, e FROM ft, {e}) WHERE v BETWEEN e[1] AND e[-1] GROUP BY 1, 2)"
    a, t = f"coalesce(x.n, 0) * 1e0 / (SELECT count({c}) FROM ft WHERE split = 'train')", f"coalesce(y.n, 0) * 1e0 / (SELECT count({c}) FROM ft WHERE split = '{{0}}')"
    enough = f"(SELECT count({c}) FROM ft WHERE split = 'train') >= 100 AND (SELECT count({c}) FROM ft WHERE split = '{{0}}') >= 100 AND (SELECT len(e) FROM {e}) >= 3"
    one = f"""(SELECT round(CASE WHEN {enough} THEN sum(({a} - {t}) * ln(({a} + 1e-6) / ({t} + 1e-6))) END, 4) FROM (SELECT unnest(range(1, len(e))) AS b FROM {e}) k
     LEFT JOIN (SELECT * FROM {n} WHERE split = 'train') x USING (b) LEFT JOIN (SELECT * FROM {n} WHERE split = '{{0}}') y USING (b))"""
    return f"SELECT '{c}' AS column, 'PSI' AS metric, {one.format('val')} AS val, {one.format('test')} AS test"


_DRIFT = " UNION ALL ".join([_tv(c) for c in LEVELS] + [_psi(c) for c in NUMBERS])
_DRIFTED = f"drifted AS (SELECT *, CASE WHEN greatest(coalesce(val, 0), coalesce(test, 0)) > CASE metric WHEN 'PSI' THEN 0.25e0 ELSE 0.2e0 END THEN 'needs_preprocessing' ELSE 'safe' END AS severity FROM ({_DRIFT}))"


@register("ag32_predictor_drift", with_("SELECT * FROM drifted", INC, _SPLIT, _FEATURES, _DRIFTED))
def predictor_drift(spark, d):
    """Every predictor from train to val and to test."""
    return ST.drift(features(spark, d).select("split", *LEVELS, *NUMBERS), LEVELS, NUMBERS)


_CHECKED = [*LEVELS, "image_url", "schema_version", "due_at", "parent_key", "incident_id"]


def _health(c: str) -> str:
    return f"SELECT '{c}' AS column, count(DISTINCT {c}) AS kinds, count({c}) AS known, count(*) AS n_rows, (SELECT max(n) FROM (SELECT count(*) AS n FROM ft WHERE {c} IS NOT NULL GROUP BY {c})) AS most FROM ft"


_FINDINGS = f"""health AS (SELECT *, most * 1e0 / known AS top, 1 - known * 1e0 / n_rows AS missing FROM ({' UNION ALL '.join(_health(c) for c in _CHECKED)})),
missed AS ({' UNION ALL '.join(f"SELECT '{c}' AS column, source_dataset, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS m FROM ft GROUP BY source_dataset" for c in _CHECKED)}),
found AS (SELECT "column", 'entirely null' AS issue, 'dangerous' AS severity, missing AS value FROM health WHERE kinds = 0
 UNION ALL SELECT "column", 'constant', 'dangerous', kinds FROM health WHERE kinds = 1 UNION ALL SELECT "column", 'near-constant', 'needs_preprocessing', top FROM health WHERE kinds > 1 AND top > 0.995e0
 UNION ALL SELECT "column", 'almost entirely missing', 'needs_preprocessing', missing FROM health WHERE kinds > 1 AND missing > 0.9e0 UNION ALL SELECT "column", 'high cardinality', 'needs_preprocessing', kinds FROM health WHERE kinds > 1000
 UNION ALL SELECT "column", 'missingness tells source_dataset', 'needs_preprocessing', max(m) - min(m) FROM missed GROUP BY "column" HAVING max(m) > 0.99e0 AND min(m) < 0.01e0
 UNION ALL SELECT 'resolution_hours', 'extreme right tail', 'needs_preprocessing', v FROM (SELECT max(resolution_hours) / greatest(quantile_cont(resolution_hours, 0.99e0), 1e-9) AS v FROM ft) WHERE v > 50
 UNION ALL SELECT 'is_duplicate', CASE WHEN v IN (0, 1) THEN 'one class only' ELSE 'severe class imbalance' END, CASE WHEN v IN (0, 1) THEN 'dangerous' ELSE 'needs_preprocessing' END, v
  FROM (SELECT avg(CASE WHEN is_duplicate THEN 1e0 ELSE 0e0 END) AS v FROM ft) WHERE v < 0.05 OR v > 0.95
 UNION ALL SELECT "column", 'distribution drift across splits', severity, greatest(coalesce(val, 0), coalesce(test, 0)) FROM drifted WHERE severity <> 'safe'
 UNION ALL SELECT '*', 'most rows are feature-duplicates', 'needs_preprocessing', share FROM (SELECT (sum(n) - count(*)) * 1e0 / sum(n) AS share FROM (SELECT count(*) AS n FROM ft GROUP BY {', '.join(LEVELS)})) WHERE share > 0.5)"""


@register("chk11_findings", with_('SELECT "column", issue, severity, round(CAST(value AS DOUBLE), 4) AS value FROM found', INC, _SPLIT, _FEATURES, _DRIFTED, _FINDINGS))
def findings(spark, d):
    """What is wrong with the columns of the task table, each with its severity: health, missingness, targets, drift, repeated rows."""
    ft = cut(features(spark, d).select("split", "source_dataset", "resolution_hours", *NUMBERS, *_CHECKED))
    moved = ST.drift(ft, LEVELS, NUMBERS).where(F.col("severity") != ST.SAFE)
    worst = F.greatest(F.coalesce("val", F.lit(0.0)), F.coalesce("test", F.lit(0.0)))
    moved = moved.select("column", F.lit("distribution drift across splits").alias("issue"), "severity", worst.alias("value"))
    again = ST.repeated_features(ft, LEVELS, "resolution_hours").select(F.round(F.col("n_repeated") / F.col("n_rows"), 4).alias("value")).where("value > 0.5")
    again = again.select(F.lit("*").alias("column"), F.lit("most rows are feature-duplicates").alias("issue"), F.lit(ST.PREPARE).alias("severity"), "value")
    return A.stacked([ST.column_findings(ft, _CHECKED, "source_dataset"), ST.target_findings(ft, "resolution_hours", "is_duplicate"), moved, again])


@register("ag33_repeated_features", with_(f"SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) - count(*) AS BIGINT) AS n_repeated, count(*) FILTER (k > 1) AS n_contradictory FROM (SELECT count(*) AS n, count(DISTINCT resolution_hours) AS k FROM ft GROUP BY {', '.join(LEVELS)})", INC, _SPLIT, _FEATURES))
def repeated_features(spark, d):
    return ST.repeated_features(features(spark, d), LEVELS, "resolution_hours")


# ---- error tables -------------------------------------------------------------------------------------------------

BINS = [(1, "a: <1h"), (24, "b: 1-24h"), (72, "c: 1-3d"), (168, "d: 3-7d"), (720, "e: 7-30d"), (2160, "f: 30-90d"), (8760, "g: 90d-1y")]
_BIN = "CASE " + " ".join(f"WHEN resolution_hours < {h} THEN '{n}'" for h, n in BINS) + " ELSE 'h: >1y' END"
_ERR = f"""tr AS (SELECT * FROM sp WHERE split = 'train' AND resolution_hours IS NOT NULL),
byc AS (SELECT category, median(resolution_hours) AS p, quantile_cont(resolution_hours, 0.1e0) AS lo, quantile_cont(resolution_hours, 0.9e0) AS hi FROM tr GROUP BY 1),
er AS (SELECT s.category, s.split, s.source_dataset, {_BIN} AS bin, resolution_hours AS y, p, lo, hi, (SELECT median(resolution_hours) FROM tr) AS b FROM sp s JOIN byc USING (category) WHERE split IN ('val', 'test') AND resolution_hours IS NOT NULL),
el AS (SELECT unnest(['duration', 'category', 'fold', 'source']) AS dimension, unnest([bin, category, split, source_dataset]) AS level, y, p, b, lo, hi FROM er)"""


@register("ag23_error_tables", with_("""SELECT dimension, level, count(*) AS n, round(avg(abs(y - p)) + 1e-9, 4) AS mae, round(avg(abs(y - b)) + 1e-9, 4) AS mae_baseline, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END) + 1e-9, 4) AS coverage,
 round(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY dimension) + 1e-9, 4) AS share_rows, round(sum(abs(y - p)) / sum(sum(abs(y - p))) OVER (PARTITION BY dimension) + 1e-9, 4) AS share_error, round(median(y) + 1e-9, 4) AS true_median,
 round(median(p) + 1e-9, 4) AS predicted_median, round(median(abs(y - p)) + 1e-9, 4) AS median_error, round(median(abs(y - b)) + 1e-9, 4) AS median_error_baseline, round(median(p - y) + 1e-9, 4) AS median_signed FROM el GROUP BY 1, 2""", INC, _SPLIT, _ERR))  # fmt: skip
def error_tables(spark, d):
    """Errors of the category median against the global median on val and test, by duration, category, fold and source, with the share of
    values between the category's 10th and 90th percentile in training."""
    s = cut(splits(spark, d).where("resolution_hours IS NOT NULL").select("category", "split", "source_dataset", "resolution_hours"))
    train, test = s.where("split = 'train'"), s.where("split IN ('val', 'test')")
    by = quantiles(train, ["category"], "resolution_hours", {"p": 0.5, "lo": 0.1, "hi": 0.9}).drop("n")
    base = quantiles(train, [], "resolution_hours", {"b": 0.5}).drop("n")
    met = test.join(small(cut(by)), "category").crossJoin(F.broadcast(base))  # one row
    groups = {"duration": F.expr(_BIN), "category": F.col("category"), "fold": F.col("split"), "source": F.col("source_dataset")}
    found = ST.error_table(met, groups, "resolution_hours", "p", "b", "lo", "hi")
    # Hours of whole seconds tie at four places: 1e-9 lets ties go up in both engines.
    return found.select("dimension", "level", "n", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in found.columns[3:]])


_SLA = """rate AS (SELECT category, avg(CASE WHEN sla_met THEN 0e0 ELSE 1e0 END) AS p FROM sp WHERE split = 'train' AND sla_met IS NOT NULL GROUP BY 1),
base AS (SELECT avg(CASE WHEN sla_met THEN 0e0 ELSE 1e0 END) AS b FROM sp WHERE split = 'train' AND sla_met IS NOT NULL)"""


@register("ag23_sla_error_table", with_("""SELECT category, split, count(*) AS n, round(avg(y), 4) AS positive_rate, round(avg(p), 4) AS mean_probability, round(avg(pow(p - y, 2)), 4) AS brier, round(avg(pow(b - y, 2)), 4) AS brier_baseline,
 count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn
 FROM (SELECT *, CASE WHEN sla_met THEN 0e0 ELSE 1e0 END AS y FROM sp JOIN rate USING (category), base WHERE split IN ('val', 'test') AND sla_met IS NOT NULL) GROUP BY 1, 2""", INC, _SPLIT, _SLA))  # fmt: skip
def sla_error_table(spark, d):
    s = splits(spark, d).where("sla_met IS NOT NULL").withColumn("y", (~F.col("sla_met")).cast("double"))
    train = s.where("split = 'train'")
    rate, base = train.groupBy("category").agg(F.avg("y").alias("p")), train.agg(F.avg("y").alias("b"))
    met = s.where("split IN ('val', 'test')").join(small(cut(rate)), "category").crossJoin(F.broadcast(base))  # one row
    hit, y, error = F.col("p") >= 0.5, F.col("y"), lambda c: F.round(F.avg(F.pow(F.col(c) - F.col("y"), 2)), 4)
    return met.groupBy("category", "split").agg(
        F.count("*").alias("n"), F.round(F.avg("y"), 4).alias("positive_rate"), F.round(F.avg("p"), 4).alias("mean_probability"), error("p").alias("brier"), error("b").alias("brier_baseline"),
        F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn"))


_COUNT_BIN = "CASE WHEN target < 1 THEN '0' WHEN target < 3 THEN '1-2' WHEN target < 6 THEN '3-5' WHEN target < 11 THEN '6-10' ELSE '>10' END"


@register("ag23_hotspot_error_table", with_(f"""SELECT {_COUNT_BIN} AS count_bin, city, count(*) AS n, round(avg(target) + 1e-9, 4) AS mean_count, round(avg(abs(target - ewma_30)) + 1e-9, 4) AS mae_ewma,
 round(avg(abs(target - roll_4)) + 1e-9, 4) AS mae_roll_4, round(avg(ewma_30 - target) + 1e-9, 4) AS bias_ewma FROM base GROUP BY ALL""", *ALL, _B))  # fmt: skip
def hotspot_error_table(spark, d):
    """Errors of smoothing and of the rolling mean by city and size of the next week's count, with the bias of smoothing."""
    mean = lambda x: F.round(F.avg(x) + 1e-9, 4)
    t, e = F.col("target"), F.col("ewma_30")
    return _baselines(spark, d).groupBy(F.expr(_COUNT_BIN).alias("count_bin"), "city").agg(
        F.count("*").alias("n"), mean(t).alias("mean_count"), mean(F.abs(t - e)).alias("mae_ewma"), mean(F.abs(t - F.col("roll_4"))).alias("mae_roll_4"), mean(e - t).alias("bias_ewma"))


# ---- dashboard ----------------------------------------------------------------------------------------------------

_NOW = "TIMESTAMP '1998-08-02 12:00:00'"
_LEFT = f"(epoch_us(due_at) - epoch_us({_NOW})) / 3.6e9"
_DASH = f"""board AS (SELECT *, CASE WHEN k % 3 <> 0 THEN k % 17 END AS agent, CASE WHEN due_at IS NULL THEN NULL WHEN {_LEFT} <= 0 THEN 'BREACHED' WHEN {_LEFT} < sla_target_hours * 0.2e0 THEN 'AT_RISK' ELSE 'ON_TRACK' END AS sla_status FROM inc)"""


@register("ag36_dashboard", with_("""SELECT city, count(*) AS n, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'closed') AS n_closed, count(*) FILTER (status = 'open' AND sla_status = 'BREACHED') AS n_breached,
 count(*) FILTER (status = 'open' AND sla_status = 'AT_RISK') AS n_at_risk, count(*) FILTER (status = 'open' AND agent IS NULL) AS n_unassigned FROM board GROUP BY 1""", INC, _DASH))  # fmt: skip
def dashboard(spark, d):
    """Counters of the board at a given time: open, closed, breached, at risk (under a fifth of the time left) and unassigned."""
    b = _board(spark, d)
    live = F.col("status") == "open"
    return b.groupBy("city").agg(
        F.count("*").alias("n"), F.count_if(live).alias("n_open"), F.count_if(F.col("status") == "closed").alias("n_closed"), F.count_if(live & (F.col("sla_status") == "BREACHED")).alias("n_breached"),
        F.count_if(live & (F.col("sla_status") == "AT_RISK")).alias("n_at_risk"), F.count_if(live & F.col("agent").isNull()).alias("n_unassigned"))


def _board(spark, d):
    now = F.lit("1998-08-02 12:00:00").cast("timestamp")
    i = incidents(spark, d).withColumn("agent", F.when(F.col("k") % 3 != 0, F.col("k") % 17))
    return i.withColumn("sla_status", S.sla_status(now, F.col("reported_at"), F.col("sla_target_hours"), F.col("due_at")))


@register("ag36_open_per_agent", with_("SELECT agent, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'open' AND sla_status = 'BREACHED') AS n_breached FROM board WHERE agent IS NOT NULL GROUP BY 1", INC, _DASH))
def open_per_agent(spark, d):
    """What is on each agent's plate; agents without open incidents count 0."""
    live = F.col("status") == "open"
    return _board(spark, d).where("agent IS NOT NULL").groupBy("agent").agg(F.count_if(live).alias("n_open"), F.count_if(live & (F.col("sla_status") == "BREACHED")).alias("n_breached"))


# ---- forecasts with reasons ---------------------------------------------------------------------------------------

AREAS = ["src0", "src1", "src2", "src3", "src4", "src9"]
AS_OF = ["1991-12-30", "1992-01-08", "1992-01-15", "1992-02-01", "1998-08-03"]
ASKED = [*IN_SCOPE, "UNMAPPED"]
_REASONS = f"""ask AS (SELECT a AS area, c AS category, t AS as_of, CAST(date_trunc('week', CAST(t AS DATE)) AS DATE) AS cur
 FROM (SELECT unnest({AREAS}) AS a), (SELECT unnest({ASKED}) AS c), (SELECT unnest({AS_OF}) AS t)),
firsts AS (SELECT ask.area, as_of, min({WEEK}) + 7 AS w0 FROM (SELECT DISTINCT area, as_of FROM ask) ask JOIN inc ON source_dataset = area AND latitude IS NOT NULL AND reported_at < CAST(as_of AS TIMESTAMP) GROUP BY 1, 2),
cells AS (SELECT a.area, a.category, a.as_of, count(DISTINCT (floor(i.latitude / 1e-2), floor(i.longitude / 1e-2))) AS n FROM ask a JOIN firsts f USING (area, as_of) JOIN inc i
 ON i.source_dataset = a.area AND i.category = a.category AND i.latitude IS NOT NULL AND i.reported_at < CAST(a.as_of AS TIMESTAMP) AND {WEEK.replace('reported_at', 'i.reported_at')} >= f.w0 AND {WEEK.replace('reported_at', 'i.reported_at')} < a.cur GROUP BY 1, 2, 3),
told AS (SELECT a.*, f.w0, CASE WHEN f.w0 IS NOT NULL THEN greatest((a.cur - 7 - f.w0) // 7 + 1, 0) ELSE 0 END AS weeks FROM ask a LEFT JOIN firsts f USING (area, as_of))"""


@register("fc1_forecast_reasons", with_(f"""SELECT area, category, as_of, CAST(weeks AS BIGINT) AS weeks, coalesce(n, 0) AS n_cells,
 CASE WHEN w0 IS NULL OR weeks = 0 THEN 'UNAVAILABLE' WHEN weeks < 4 OR category NOT IN {tuple(IN_SCOPE)} THEN 'EXPERIMENTAL' ELSE 'AVAILABLE' END AS status,
 CASE WHEN w0 IS NULL THEN 'NO_DATA' WHEN weeks = 0 THEN 'NO_COMPLETE_WEEKS' ELSE concat_ws(',', CASE WHEN weeks < 4 THEN 'INSUFFICIENT_HISTORY_WEEKS' END, CASE WHEN category NOT IN {tuple(IN_SCOPE)} THEN 'CATEGORY_NOT_EVALUATED' END) END AS reasons,
 strftime(w0, '%Y-%m-%d') AS first_complete_week, strftime(cur - 7, '%Y-%m-%d') AS last_complete_week FROM told LEFT JOIN cells USING (area, category, as_of)""", INC, _REASONS))  # fmt: skip
def forecast_reasons(spark, d):
    """Whether a forecast can be given for each area and category as of given days, and the codes of what stands against it."""
    return P.availability(incidents(spark, d), AREAS, ASKED, AS_OF, IN_SCOPE)
