"""Queries of weekly panels, smoothing and hotspot forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import panel as P
from wardline.plans.base import IN_SCOPE, INC, RAW, incidents, register, sparse, with_

KEYS = ["city", "zone_id", "category"]
WEEK = "CAST(date_trunc('week', reported_at) AS DATE)"
COUNTS = f" counts AS (SELECT city, zone_id, category, {WEEK} AS week, count(*) AS y FROM inc GROUP BY ALL)"
PANEL = """ span AS (SELECT city, min(week) + 7 AS a, max(week) - 7 AS b FROM counts GROUP BY city),
weeks AS (SELECT city, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week FROM span),
panel AS (SELECT s.city, s.zone_id, s.category, w.week, coalesce(c.y, 0) AS y FROM (SELECT DISTINCT city, zone_id, category FROM counts) s JOIN weeks w ON w.city = s.city
  LEFT JOIN counts c ON c.city = s.city AND c.zone_id = s.zone_id AND c.category = s.category AND c.week = w.week)"""
ALL = (INC, COUNTS, PANEL)
DAY = "strftime(week, '%Y-%m-%d') AS week"
W = "(PARTITION BY city, zone_id, category ORDER BY week {})"


def counts(spark, d):
    return P.weekly_counts(incidents(spark, d), KEYS)


def panel(spark, d):
    return P.complete(counts(spark, d), KEYS, "city")


def day(df):
    return df.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@register("ag1_weekly_counts", with_(f"SELECT city, zone_id, category, {DAY}, y FROM counts", INC, COUNTS))
def weekly(spark, d):
    return day(counts(spark, d))


@register("jn8_complete_panel", with_(f"SELECT city, zone_id, category, {DAY}, y FROM panel", *ALL))
def complete_panel(spark, d):
    return day(panel(spark, d)).select(*KEYS, "week", "y")


@register("jn9_active_series", with_(f"SELECT city, zone_id, category, {DAY}, y FROM counts c WHERE (SELECT sum(y) FROM counts s WHERE s.city = c.city AND s.zone_id = c.zone_id AND s.category = c.category) >= 8", INC, COUNTS))
def active_series(spark, d):
    return day(P.active(counts(spark, d), KEYS)).select(*KEYS, "week", "y")


def _w(a, b):
    return W.format(f"ROWS BETWEEN {a} AND {b}")


@register("wn1_lag_features", with_(f"""SELECT * EXCLUDE (week, m4, m12), {DAY}, round(m4, 6) AS mean_4, round(m12, 6) AS mean_12, round(m4 - m12, 6) AS trend, target > 0 AS target_active FROM (SELECT city, zone_id, category, week, y, lag(y) OVER {W.format('')} AS lag_1,
 CAST(sum(y) OVER {_w('4 PRECEDING', '1 PRECEDING')} AS BIGINT) AS sum_4, avg(y) OVER {_w('4 PRECEDING', '1 PRECEDING')} AS m4, avg(y) OVER {_w('12 PRECEDING', '1 PRECEDING')} AS m12, lead(y) OVER {W.format('')} AS target FROM panel) WHERE target IS NOT NULL""", *ALL))
def lag_features(spark, d):
    return day(P.lag_features(panel(spark, d), KEYS))


@register("wn2_rolling_baseline", with_(f"SELECT city, zone_id, category, {DAY}, round(avg(y) OVER {_w('3 PRECEDING', 'CURRENT ROW')}, 6) AS roll_4, round(avg(y) OVER {_w('4 PRECEDING', '1 PRECEDING')}, 6) AS roll_4_lagged FROM panel", *ALL))
def rolling_baseline(spark, d):
    w = Window.partitionBy(*KEYS).orderBy("week")
    return day(panel(spark, d)).select(*KEYS, "week", F.round(F.avg("y").over(w.rowsBetween(-3, 0)), 6).alias("roll_4"), F.round(F.avg("y").over(w.rowsBetween(-4, -1)), 6).alias("roll_4_lagged"))


@register("wn3_wn7_current_features", with_(f"""SELECT city, zone_id, category, {DAY}, y, lag(y, 1) OVER {W.format('')} AS lag_1, lag(y, 2) OVER {W.format('')} AS lag_2, lag(y, 3) OVER {W.format('')} AS lag_3,
 round(avg(y) OVER {_w('3 PRECEDING', 'CURRENT ROW')}, 6) AS roll_4, round(avg(y) OVER {_w('7 PRECEDING', 'CURRENT ROW')}, 6) AS roll_8, round(avg(y) OVER {_w('11 PRECEDING', 'CURRENT ROW')}, 6) AS roll_12,
 round(avg(y) OVER {_w('3 PRECEDING', 'CURRENT ROW')} - avg(y) OVER {_w('11 PRECEDING', 'CURRENT ROW')}, 6) AS trend_4_12, round(avg(CASE WHEN y = 0 THEN 1e0 ELSE 0e0 END) OVER {_w('11 PRECEDING', 'CURRENT ROW')}, 6) AS zero_share_12,
 CAST(row_number() OVER {W.format('')} AS INT) AS history FROM panel""", *ALL))
def current_features(spark, d):
    return day(P.current_features(panel(spark, d), KEYS))


def forecast_rows(spark, d):
    """Current features with next week's count as target."""
    p = panel(spark, d)
    ahead = p.select(*KEYS, F.date_sub("week", 7).alias("week"), F.col("y").alias("target"))
    return P.current_features(p, KEYS).join(ahead, [*KEYS, "week"])


_CELLS = f""" placed AS (SELECT * FROM inc WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND source_dataset = 'src2' AND category IN ({", ".join(f"'{c}'" for c in IN_SCOPE)})),
grid AS (SELECT min(latitude) AS lat0, min(longitude) AS lon0, median(latitude) AS ref FROM placed),
cells AS (SELECT p.* REPLACE (CAST(CAST(floor((longitude - lon0) * 111320.0 * cos(radians(ref)) / 1000.0) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor((latitude - lat0) * 110574.0 / 1000.0) AS BIGINT) AS VARCHAR) AS zone_id) FROM placed p, grid),
counts AS (SELECT city, zone_id, category, {WEEK} AS week, count(*) AS y FROM cells c
 WHERE (SELECT count(*) FROM cells s WHERE s.zone_id = c.zone_id AND s.category = c.category AND s.reported_at >= TIMESTAMP '1994-01-01') >= 8 GROUP BY ALL)"""


@register("fc2_metric_panel", with_(f"SELECT city, zone_id, category, {DAY}, y FROM panel", INC, _CELLS, PANEL))
def metric_panel(spark, d):
    """The weekly panel of one city's 1 km cells (panel C)."""
    rows = incidents(spark, d).where(F.col("source_dataset") == "src2").where(F.col("category").isin(IN_SCOPE))
    return day(P.complete(P.weekly_counts(P.metric_zones(rows, 1000.0, "1994-01-01"), KEYS), KEYS, "city")).select(*KEYS, "week", "y")


ALPHAS = [0.1, 0.2, 0.3, 0.5]
_FOLD = ", ".join(f"round(list_reduce(list_transform(p, lambda v: CAST(v AS DOUBLE)), lambda s, x: x * {a}e0 + s * {round(1 - a, 1)}e0), 6) AS ewma_{int(a * 100)}" for a in ALPHAS)


@register("wn4_ewma", with_(f"SELECT city, zone_id, category, {DAY}, y, {_FOLD} FROM (SELECT *, list(y) OVER {_w('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS p FROM panel)", *ALL))
def ewma(spark, d):
    return day(P.ewma(panel(spark, d), KEYS, ALPHAS))


TOT = f"""SELECT city, category, week, n, round(avg(n) OVER (PARTITION BY city, category ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS prev_4 FROM (SELECT city, category, week, CAST(sum(y) AS BIGINT) AS n FROM panel GROUP BY ALL)"""


@register("wn5_city_shock", with_(f"SELECT city, category, {DAY}, n AS city_total, prev_4, round(n / nullif(prev_4, 0), 4) AS shock FROM ({TOT})", *ALL))
def city_shock(spark, d):
    t = panel(spark, d).groupBy("city", "category", "week").agg(F.sum("y").alias("city_total"))
    w = Window.partitionBy("city", "category").orderBy("week").rowsBetween(-4, -1)
    t = t.withColumn("prev_4", F.round(F.avg("city_total").over(w), 6))
    return day(t.withColumn("shock", F.round(F.col("city_total") / F.nullif("prev_4", F.lit(0.0)), 4))).select("city", "category", "week", "city_total", "prev_4", "shock")


@register("wn6_zone_share", with_(f"""SELECT city, zone_id, category, {DAY}, round(s / nullif(sum(s) OVER (PARTITION BY city, category, week), 0), 6) AS zone_share FROM (SELECT *, sum(y) OVER {_w('11 PRECEDING', 'CURRENT ROW')} AS s FROM panel)""", *ALL))
def zone_share(spark, d):
    p = panel(spark, d).withColumn("s", F.sum("y").over(Window.partitionBy(*KEYS).orderBy("week").rowsBetween(-11, 0)))
    total = F.sum("s").over(Window.partitionBy("city", "category", "week"))
    return day(p.withColumn("zone_share", F.round(F.try_divide(F.col("s"), total), 6))).select(*KEYS, "week", "zone_share")


@register("wn7_series_id", with_("SELECT city, zone_id, category, CAST(dense_rank() OVER (ORDER BY city, zone_id, category) AS BIGINT) AS series_id FROM (SELECT DISTINCT city, zone_id, category FROM counts)", INC, COUNTS))
def series_id(spark, d):
    # Series are far fewer than rows: they are ranked within their city, and city offsets are added.
    s = counts(spark, d).select(*KEYS).distinct()
    n = s.groupBy("city").agg(F.count("*").alias("n"))
    off = n.alias("a").join(n.alias("b"), F.col("b.city") < F.col("a.city"), "left").groupBy("a.city").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("off"))
    return s.join(F.broadcast(off), "city").select(*KEYS, (F.col("off") + F.row_number().over(Window.partitionBy("city").orderBy("zone_id", "category"))).alias("series_id"))


@register("wn13_calendar_gap", with_(f"SELECT city, zone_id, category, {DAY}, CAST(week - lag(week) OVER {W.format('')} AS BIGINT) AS gap_days FROM counts", INC, COUNTS))
def calendar_gap(spark, d):
    c = counts(spark, d)
    return day(c.withColumn("gap_days", F.datediff("week", F.lag("week").over(Window.partitionBy(*KEYS).orderBy("week"))).cast("long"))).select(*KEYS, "week", "gap_days")


FC = f"""
f0 AS (SELECT source_dataset, category, latitude, longitude, {WEEK} AS week FROM inc WHERE latitude IS NOT NULL AND reported_at < date_trunc('week', TIMESTAMP '1998-08-03')),
o AS (SELECT source_dataset, min(latitude) AS lat0, min(longitude) AS lon0, max(latitude) AS ref, min(week) AS w0, max(week) AS w1 FROM f0 GROUP BY 1),
f1 AS (SELECT f.source_dataset, category, week, w0, w1, concat_ws('_', CAST(floor((longitude - lon0) * 111320e0 * cos(radians(ref)) / 1000) AS BIGINT) + 2, CAST(floor((latitude - lat0) * 110574e0 / 1000) AS BIGINT) + 2) AS cell_id FROM f0 f JOIN o ON o.source_dataset = f.source_dataset WHERE week > w0),
f2 AS (SELECT source_dataset, category, cell_id, w0, w1, week, count(*) AS y FROM f1 GROUP BY ALL),
f3 AS (SELECT s.source_dataset, s.category, s.cell_id, list(coalesce(y, 0) ORDER BY u.week) AS ys FROM (SELECT DISTINCT source_dataset, category, cell_id, w0, w1 FROM f2) s,
  LATERAL (SELECT CAST(unnest(generate_series(CAST(s.w0 + 7 AS TIMESTAMP), CAST(s.w1 AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week) u
  LEFT JOIN f2 ON f2.source_dataset = s.source_dataset AND f2.category = s.category AND f2.cell_id = s.cell_id AND f2.week = u.week GROUP BY ALL),
fc AS (SELECT source_dataset, category, cell_id, round(list_reduce(list_transform(ys, lambda v: CAST(v AS DOUBLE)), lambda s, x: x * 0.3e0 + s * 0.7e0), 6) AS forecast, ys[-1] AS last_week, CAST(len(ys) AS BIGINT) AS weeks, CAST(list_sum(ys) AS BIGINT) AS total,
  round(list_avg(ys[-4:]), 6) AS mean_4, CASE WHEN len(ys) >= 4 THEN 'AVAILABLE' WHEN len(ys) >= 1 THEN 'EXPERIMENTAL' ELSE 'UNAVAILABLE' END AS status FROM f3)"""


@register("fc1_hotspot_forecast", with_("SELECT * FROM fc", INC, FC))
def hotspot_forecast(spark, d):
    return P.forecast(incidents(spark, d))


@register("so3_top_cells", with_("SELECT * FROM fc ORDER BY forecast DESC, cell_id, source_dataset, category LIMIT 20", INC, FC))
def top_cells(spark, d):
    return P.forecast(incidents(spark, d)).orderBy(F.desc("forecast"), "cell_id", "source_dataset", "category").limit(20)


def _baselines(spark, d):
    p = panel(spark, d)
    e = P.ewma(p, KEYS, ALPHAS)
    w = Window.partitionBy(*KEYS).orderBy("week")
    e = e.join(P.current_features(p, KEYS).select(*KEYS, "week", "roll_4", "roll_8", "roll_12"), [*KEYS, "week"])
    return e.withColumn("target", F.lead("y").over(w)).where("target IS NOT NULL")


_B = f"""
hist AS (SELECT *, list(y) OVER {_w('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS p, lead(y) OVER {W.format('')} AS target, round(avg(y) OVER {_w('3 PRECEDING', 'CURRENT ROW')}, 6) AS roll_4, round(avg(y) OVER {_w('7 PRECEDING', 'CURRENT ROW')}, 6) AS roll_8, round(avg(y) OVER {_w('11 PRECEDING', 'CURRENT ROW')}, 6) AS roll_12 FROM panel),
base AS (SELECT * EXCLUDE (p), {_FOLD} FROM hist WHERE target IS NOT NULL)"""


@register("fc3_weekly_baselines", with_("SELECT city, count(*) AS n, " + ", ".join(f"round(avg(abs(target - {c})), 4) AS mae_{n}" for n, c in (("persistence", "y"), ("roll_4", "roll_4"), ("roll_8", "roll_8"), ("roll_12", "roll_12"), ("ewma_30", "ewma_30"))) + " FROM base GROUP BY city", *ALL, _B))
def weekly_baselines(spark, d):
    mae = [F.round(F.avg(F.abs(F.col("target") - F.col(c))), 4).alias(f"mae_{n}") for n, c in (("persistence", "y"), ("roll_4", "roll_4"), ("roll_8", "roll_8"), ("roll_12", "roll_12"), ("ewma_30", "ewma_30"))]
    return _baselines(spark, d).groupBy("city").agg(F.count("*").alias("n"), *mae)


@register("ag39_alpha_selection", with_("SELECT arg_min(a, mae) AS alpha, min(mae) AS mae FROM (" + " UNION ALL ".join(f"SELECT {a}e0 AS a, round(avg(abs(target - ewma_{int(a * 100)})), 4) AS mae FROM base WHERE week < DATE '1996-01-01'" for a in ALPHAS) + ")", *ALL, _B))
def alpha_selection(spark, d):
    e = _baselines(spark, d).where(F.col("week") < F.lit("1996-01-01").cast("date"))
    row = e.agg(*[F.round(F.avg(F.abs(F.col("target") - F.col(f"ewma_{int(a * 100)}"))), 4).alias(str(int(a * 100))) for a in ALPHAS])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(str(int(a * 100))).alias("mae")) for a in ALPHAS])).alias("x")).select("x.*")
    return long.agg(F.min_by("a", F.struct("mae", "a")).alias("alpha"), F.min("mae").alias("mae"))


@register("ag24_weekly_win_rate", with_("SELECT city, round(avg(CASE WHEN m < b THEN 1e0 ELSE 0e0 END), 6) AS win_rate, count(*) AS weeks FROM (SELECT city, week, round(avg(abs(target - ewma_30)), 6) AS m, round(avg(abs(target - y)), 6) AS b FROM base GROUP BY ALL) GROUP BY city", *ALL, _B))
def weekly_win_rate(spark, d):
    w = _baselines(spark, d).groupBy("city", "week").agg(F.round(F.avg(F.abs(F.col("target") - F.col("ewma_30"))), 6).alias("m"), F.round(F.avg(F.abs(F.col("target") - F.col("y"))), 6).alias("b"))
    return w.groupBy("city").agg(F.round(F.avg((F.col("m") < F.col("b")).cast("double")), 6).alias("win_rate"), F.count("*").alias("weeks"))


@register("ag17_poisson_deviance", with_("SELECT city, round(avg(2 * (CASE WHEN target > 0 THEN target * ln(target / greatest(roll_4, 1e-9)) ELSE 0 END - target + greatest(roll_4, 1e-9))), 4) AS deviance FROM base GROUP BY city", *ALL, _B))
def poisson_deviance(spark, d):
    p = F.greatest(F.col("roll_4"), F.lit(1e-9))
    dev = 2 * (F.when(F.col("target") > 0, F.col("target") * F.log(F.col("target") / p)).otherwise(0.0) - F.col("target") + p)
    return _baselines(spark, d).groupBy("city").agg(F.round(F.avg(dev), 4).alias("deviance"))


@register("ag42_top_decile_hit", with_("""SELECT city, round(avg(hit), 6) AS hit_rate, count(*) AS groups FROM (SELECT city, category, week, count(*) FILTER (ra <= k AND rp <= k) * 1e0 / max(k) AS hit FROM (SELECT *, ceil(count(*) OVER (PARTITION BY city, category, week) / 10e0) AS k, count(*) OVER (PARTITION BY city, category, week) AS n,
 row_number() OVER (PARTITION BY city, category, week ORDER BY target DESC, zone_id) AS ra, row_number() OVER (PARTITION BY city, category, week ORDER BY roll_4 DESC, zone_id) AS rp FROM base) WHERE n >= 5 GROUP BY ALL) GROUP BY city""", *ALL, _B))
def top_decile_hit(spark, d):
    g = Window.partitionBy("city", "category", "week")
    e = _baselines(spark, d).withColumn("n", F.count("*").over(g)).withColumn("k", F.ceil(F.col("n") / 10))
    e = e.withColumn("ra", F.row_number().over(g.orderBy(F.desc("target"), "zone_id"))).withColumn("rp", F.row_number().over(g.orderBy(F.desc("roll_4"), "zone_id"))).where("n >= 5")
    h = e.groupBy("city", "category", "week").agg((F.count_if((F.col("ra") <= F.col("k")) & (F.col("rp") <= F.col("k"))) / F.max("k")).alias("hit"))
    return h.groupBy("city").agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.count("*").alias("groups"))


@register("sp8_weekly_folds", with_(f"SELECT fold, role, count(*) AS n FROM (SELECT o AS fold, CASE WHEN week <= CAST(o AS DATE) - 14 THEN 'train' WHEN week >= CAST(o AS DATE) - 7 AND week < CAST(o AS DATE) + 63 THEN 'test' END AS role FROM panel, (VALUES ('1995-01-02'), ('1996-01-01'), ('1997-01-06')) AS t(o)) WHERE role IS NOT NULL GROUP BY ALL", *ALL))
def weekly_folds(spark, d):
    from wardline.operators.splits import weekly_folds as folds

    return folds(panel(spark, d), ["1995-01-02", "1996-01-01", "1997-01-06"]).groupBy("fold", "role").agg(F.count("*").alias("n"))


@register("wn15_zone_workload", with_("SELECT source_dataset, zone_id, category, count(*) AS n, CAST(count(*) FILTER (status = 'open') AS BIGINT) AS n_open FROM inc GROUP BY ALL", INC))
def zone_workload(spark, d):
    return incidents(spark, d).groupBy("source_dataset", "zone_id", "category").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("n_open"))


@register("wn9_group_extremes", with_("SELECT incident_id, CAST(epoch_us(min(reported_at) OVER (PARTITION BY source_dataset)) // 1000000 AS BIGINT) AS source_start_s, CAST(epoch_us(max(reported_at) OVER (PARTITION BY source_dataset)) // 1000000 AS BIGINT) AS extract_end_s FROM raw", RAW))
def group_extremes(spark, d):
    df = sparse(spark, d)
    g = df.groupBy("source_dataset").agg(F.min("reported_at").alias("a"), F.max("reported_at").alias("b"))
    return df.join(g, "source_dataset").selectExpr("incident_id", "unix_micros(a) div 1000000 AS source_start_s", "unix_micros(b) div 1000000 AS extract_end_s")
