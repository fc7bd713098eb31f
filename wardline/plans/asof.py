"""Queries of as-of history, space and dimension joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import geo, history, mapping, snapshots
from wardline.operators.quantiles import with_quantiles
from wardline.plans.base import DENSE, INC, MIN, RULES, dense, incidents, register, table, values, with_

E = (DENSE, f" e AS (SELECT *, {MIN.format('reported_at')} AS r, {MIN.format('closed_at')} AS c, CASE WHEN closed_at - reported_at >= INTERVAL 60 SECOND THEN (epoch_us(closed_at) - epoch_us(reported_at)) / 3.6e9 END AS h FROM dense)")


def _workload_sql(view: str, on: str, warm: str = "true") -> str:
    """Correlated counts over `view`, whose groups meet by `on`."""
    near = f"FROM {view} e WHERE {on}"
    recent = f"{near} AND e.c < q.r AND e.c >= q.r -"
    values = {
        "backlog": f"(SELECT count(*) {near} AND e.r < q.r) - (SELECT count(*) {near} AND least(coalesce(e.c, e.r + 129600), e.r + 129600) < q.r)",
        "intake_7d": f"(SELECT count(*) {near} AND e.r < q.r AND e.r >= q.r - 10080)",
        "intake_30d": f"(SELECT count(*) {near} AND e.r < q.r AND e.r >= q.r - 43200)",
        "closed_7d": f"(SELECT count(*) {recent} 10080)",
        "mean_log_7d": f"(SELECT CASE WHEN count(h) >= 10 THEN round(avg(ln(1 + h)), 6) END {recent} 10080)",
        "resolved_30d": f"(SELECT count(h) {recent} 43200)",
        "mean_log_30d": f"(SELECT CASE WHEN count(h) >= 10 THEN round(avg(ln(1 + h)), 6) END {recent} 43200)",
    }
    inner = ", ".join(f"{v} AS {n}" for n, v in values.items())
    outer = ", ".join(f"CASE WHEN {warm} THEN {n} END AS {n}" for n in values)
    days = "round(backlog * 30e0 / nullif(intake_30d, 0), 6)"
    return f"SELECT incident_id, {outer}, CASE WHEN {warm} THEN {days} END AS backlog_days FROM (SELECT q.incident_id, q.source_dataset, q.r, {inner} FROM {view} q) w"


_SPARSE = f" e AS (SELECT *, {MIN.format('reported_at')} AS r, {MIN.format('closed_at')} AS c, resolution_hours AS h FROM inc)"


@register("wn8_workload", with_(_workload_sql("e", "e.category = q.category"), *E))
def workload(spark, d):
    return history.workload(dense(spark, d), ["category"])


@register("wn8_workload_warm_up", with_(
    _workload_sql("e", "e.source_dataset = q.source_dataset AND e.category = q.category", "r - (SELECT min(r) FROM e WHERE e.source_dataset = w.source_dataset) >= 43200"), INC, _SPARSE))
def workload_warm_up(spark, d):
    return history.workload(incidents(spark, d), ["source_dataset", "category"], warm_up_days=30)


@register("wn10_recent_breach_rate", with_("""SELECT incident_id, CASE WHEN n >= 20 THEN round(l * 1e0 / n, 6) END AS breach_rate, n AS n_reports FROM (SELECT q.incident_id, count(e.incident_id) AS n, count(e.incident_id) FILTER (coalesce((epoch_us(e.closed_at) - epoch_us(e.reported_at)) / 3.6e9, 1e9) > 24) AS l
 FROM e q LEFT JOIN e ON e.category = q.category AND e.r >= q.r - 1440 - 10080 AND e.r < q.r - 1440 GROUP BY q.incident_id)""", *E))
def recent_breach_rate(spark, d):
    return history.recent_breach_rate(dense(spark, d), ["category"], 24)


_CELL = " g AS (SELECT *, CAST(round(longitude / 2e-4) AS BIGINT) AS ix, CAST(round(latitude / 2e-4) AS BIGINT) AS iy FROM e)"


@register("wn11_block_counts", with_("""
SELECT q.incident_id, count(e.incident_id) FILTER (e.r >= q.r - 10080) AS n_7d, count(e.incident_id) FILTER (e.r >= q.r - 43200) AS n_30d,
 count(e.incident_id) FILTER (e.r >= q.r - 129600) AS n_90d, count(e.incident_id) FILTER (e.c IS NULL OR e.c >= q.r) AS n_open
FROM g q LEFT JOIN g e ON e.category = q.category AND abs(e.ix - q.ix) <= 1 AND abs(e.iy - q.iy) <= 1 AND e.r < q.r GROUP BY q.incident_id""", *E, _CELL))
def block_counts(spark, d):
    return history.block_counts(dense(spark, d), ["category"])


@register("wn11_block_counts_all", with_("""
SELECT q.incident_id, count(e.incident_id) FILTER (e.r >= q.r - 10080) AS n_7d, count(e.incident_id) FILTER (e.r >= q.r - 43200) AS n_30d, count(e.incident_id) FILTER (e.c IS NULL OR e.c >= q.r) AS n_open
FROM g q LEFT JOIN g e ON abs(e.ix - q.ix) <= 1 AND abs(e.iy - q.iy) <= 1 AND e.r < q.r GROUP BY q.incident_id""", *E, _CELL))
def block_counts_all(spark, d):
    """Counts of all categories around each report."""
    return history.block_counts(dense(spark, d), [], days=(7, 30))


_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(e.latitude - q.latitude) / 2), 2) + cos(radians(q.latitude)) * cos(radians(e.latitude)) * pow(sin(radians(e.longitude - q.longitude) / 2), 2)))))"


@register("jn5_historical_density", with_(f"""SELECT q.incident_id, CASE WHEN q.latitude IS NOT NULL THEN coalesce(n_24h, 0) END AS n_24h, CASE WHEN q.latitude IS NOT NULL THEN coalesce(n_7d, 0) END AS n_7d, CASE WHEN q.latitude IS NOT NULL THEN coalesce(n_30d, 0) END AS n_30d,
 CASE WHEN q.latitude IS NOT NULL THEN coalesce(all_30d, 0) END AS all_30d, round_even(n_30d / nullif(all_30d, 0), 4) AS share_same, round_even((epoch_us(q.reported_at) - latest) / 3.6e9, 4) AS hours_since FROM inc q LEFT JOIN
 (SELECT q.incident_id, count(*) FILTER (e.category = q.category AND e.reported_at >= q.reported_at - INTERVAL 24 HOUR) AS n_24h, count(*) FILTER (e.category = q.category AND e.reported_at >= q.reported_at - INTERVAL 7 DAY) AS n_7d, count(*) FILTER (e.category = q.category) AS n_30d, count(*) AS all_30d, max(epoch_us(e.reported_at)) AS latest
  FROM inc q JOIN inc e ON abs(e.latitude - q.latitude) < 3e-3 AND e.reported_at < q.reported_at AND e.reported_at >= q.reported_at - INTERVAL 720 HOUR AND e.latitude IS NOT NULL AND q.latitude IS NOT NULL AND {_HAV} <= 250 GROUP BY 1) m ON m.incident_id = q.incident_id""", INC))
def historical_density(spark, d):
    return geo.historical_density(incidents(spark, d))


_POI = " poi AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'hospital' ELSE 'road' END AS layer, round(10 + 5 * (s_suppkey % 5) + 2e-2 * (s_suppkey % 11), 6) AS latitude, round(20 + 2e-2 * (s_suppkey % 7), 6) AS longitude FROM supplier WHERE s_suppkey % 13 <> 0)"


def _layers(spark, d):
    from wardline.sources.poi import poi_layer

    layer = F.when(F.col("s_suppkey") % 3 == 0, "school").when(F.col("s_suppkey") % 3 == 1, "hospital").otherwise("road")
    return poi_layer(table(spark, d, "supplier")).select(layer.alias("layer"), "lat", "lon").distinct()


@register("jn6_nearest_point", with_(f"""SELECT q.incident_id, l.layer, round(min(CASE WHEN dist <= 1500 THEN dist END), 3) AS distance_m, CASE WHEN any_value(q.lat) IS NOT NULL THEN coalesce(bool_or(dist <= 1500), false) END AS near FROM (SELECT incident_id, latitude AS lat FROM inc) q CROSS JOIN (SELECT DISTINCT layer FROM poi) l
 LEFT JOIN (SELECT q.incident_id, e.layer, {_HAV} AS dist FROM inc q JOIN (SELECT DISTINCT * FROM poi) e ON e.latitude BETWEEN q.latitude - 0.1 AND q.latitude + 0.1) m ON m.incident_id = q.incident_id AND m.layer = l.layer GROUP BY 1, 2""", INC, _POI))
def nearest_point(spark, d):
    return geo.nearest(incidents(spark, d), _layers(spark, d), 1500.0).withColumn("distance_m", F.round("distance_m", 3))


@register("jn7_null_provider", with_("SELECT incident_id, CAST(NULL AS DOUBLE) AS dist_school_m, CAST(NULL AS BOOLEAN) AS near_school FROM inc", INC))
def null_provider(spark, d):
    from wardline.sources.poi import PROVIDERS

    return PROVIDERS["null"](incidents(spark, d).select("incident_id"), ["school"])


_SNAP = """SELECT q.incident_id, round(exp(median(ln(1 + e.h))) - 1, 4) AS median_hours, count(e.h) AS n_closures FROM e q LEFT JOIN e ON {on} AND CAST(e.closed_at AS DATE) < CAST(q.reported_at AS DATE) AND CAST(e.closed_at AS DATE) >= CAST(q.reported_at AS DATE) - 7 AND e.h IS NOT NULL GROUP BY 1"""


@register("jn15_daily_snapshot", with_(_SNAP.format(on="e.category = q.category"), *E))
def daily_snapshot(spark, d):
    return snapshots.daily_snapshot(dense(spark, d), ["source_dataset", "category"], 7)


@register("fc6_fallback_cascade", with_(f"""SELECT a.incident_id, CASE WHEN a.n_closures >= 10 THEN a.median_hours WHEN b.n_closures >= 10 THEN b.median_hours ELSE 100e0 END AS predicted_hours, CASE WHEN a.n_closures >= 10 THEN 'category_median' WHEN b.n_closures >= 10 THEN 'all_median' ELSE 'training_median' END AS method
 FROM ({_SNAP.format(on='e.category = q.category')}) a JOIN ({_SNAP.format(on='true')}) b USING (incident_id)""", *E))
def fallback_cascade(spark, d):
    return snapshots.cascade(dense(spark, d), 100.0)


@register("fc7_sla_cascade", with_("""SELECT q.incident_id, CASE WHEN count(e.r) FILTER (e.r >= q.r - 11520) >= 20 THEN round(count(e.r) FILTER (e.r >= q.r - 11520 AND e.late) * 1e0 / count(e.r) FILTER (e.r >= q.r - 11520), 6) WHEN count(e.r) >= 20 THEN round(count(e.r) FILTER (e.late) * 1e0 / count(e.r), 6) ELSE 0.5e0 END AS p_breach,
 CASE WHEN count(e.r) FILTER (e.r >= q.r - 11520) >= 20 THEN 'recent' WHEN count(e.r) >= 20 THEN 'any_age' ELSE 'training' END AS method
 FROM e q LEFT JOIN (SELECT *, coalesce((epoch_us(closed_at) - epoch_us(reported_at)) / 3.6e9, 1e9) > 24 AS late FROM e) e ON e.category = q.category AND e.r < q.r - 1440 GROUP BY q.incident_id, q.r""", *E))
def sla_cascade(spark, d):
    recent = history.recent_breach_rate(dense(spark, d), ["category"], 24, 7).toDF("incident_id", "p1", "n1")
    ever = history.recent_breach_rate(dense(spark, d), ["category"], 24, None).toDF("incident_id", "p2", "n2")
    method = F.when(F.col("p1").isNotNull(), "recent").when(F.col("p2").isNotNull(), "any_age").otherwise("training")
    return recent.join(ever, "incident_id").select("incident_id", F.coalesce("p1", "p2", F.lit(0.5)).alias("p_breach"), method.alias("method"))


def _late(view_on: str, view: str, hours: int, days: int) -> str:
    """Share of late closures among reports of a window that ended `hours` before each report."""
    return f"""SELECT incident_id, CASE WHEN n >= 20 THEN round(l * 1e0 / n, 6) END AS breach_rate, n AS n_reports FROM (
 SELECT q.incident_id, count(e.incident_id) AS n, count(e.incident_id) FILTER (coalesce((epoch_us(e.closed_at) - epoch_us(e.reported_at)) / 3.6e9, 1e9) > {hours}) AS l
 FROM {view} q LEFT JOIN {view} e ON {view_on} AND e.r >= q.r - {hours * 60} - {days * 1440} AND e.r < q.r - {hours * 60} GROUP BY q.incident_id)"""


_OWN = "e.source_dataset = q.source_dataset AND e.category = q.category"


@register("wn10_recent_breach_rate_30d", with_(_late(_OWN, "e", 72, 30), INC, _SPARSE))
def recent_breach_rate_30d(spark, d):
    return history.recent_breach_rate(incidents(spark, d), ["source_dataset", "category"], 72, 30)


@register("jn15_daily_snapshot_30d", with_(f"""
SELECT q.incident_id, CASE WHEN count(e.h) >= 10 THEN round(exp(median(ln(1 + e.h))) - 1, 4) END AS median_hours, count(e.h) AS n_closures
FROM e q LEFT JOIN e ON {_OWN} AND e.h IS NOT NULL AND CAST(e.closed_at AS DATE) < CAST(q.reported_at AS DATE) AND CAST(e.closed_at AS DATE) >= CAST(q.reported_at AS DATE) - 30
GROUP BY 1""", INC, _SPARSE))  # fmt: skip
def daily_snapshot_30d(spark, d):
    return snapshots.daily_snapshot(incidents(spark, d), ["source_dataset", "category"], 30, least=10)


_LOCAL = "SELECT q.incident_id, q.category, median(e.h) AS m, count(e.h) AS n FROM e q LEFT JOIN e ON {on} e.c < q.r AND e.h IS NOT NULL GROUP BY 1, 2"


@register("fc6_local_cascade", with_(f"""
SELECT a.incident_id, round(CASE WHEN a.n >= 10 THEN a.m WHEN b.n >= 10 THEN b.m ELSE t.m END, 4) AS predicted_hours,
 CASE WHEN a.n >= 10 THEN a.n WHEN b.n >= 10 THEN b.n ELSE coalesce(t.n, 0) END AS sample_size,
 CASE WHEN a.n >= 10 THEN 'local_category_median' WHEN b.n >= 10 THEN 'local_median' WHEN t.m IS NOT NULL THEN 'training_category_median' ELSE 'UNAVAILABLE' END AS method
FROM ({_LOCAL.format(on="e.category = q.category AND")}) a JOIN ({_LOCAL.format(on="")}) b USING (incident_id)
LEFT JOIN (SELECT category, median(resolution_hours) AS m, count(*) AS n FROM inc WHERE resolution_hours IS NOT NULL AND source_dataset <> 'src0' GROUP BY 1) t ON t.category = a.category""",
    f"""{INC}, e AS (SELECT *, {MIN.format('reported_at')} AS r, {MIN.format('greatest(closed_at, reported_at)')} AS c, resolution_hours AS h FROM inc WHERE source_dataset = 'src0')"""))
def local_cascade(spark, d):
    """One city's reports against what the city had closed; the other cities are the training corpus."""
    i = incidents(spark, d)
    trained = i.where("resolution_hours IS NOT NULL AND source_dataset <> 'src0'")
    medians = with_quantiles(trained, ["category"], "resolution_hours", {"median_hours": 0.5}, [F.count("*").alias("n")])
    return snapshots.local_cascade(i.where("source_dataset = 'src0'"), medians)


# ---- dimension joins ----------------------------------------------------------------------------------------------


@register("jn1_two_tier_lookup", with_("SELECT source_category_raw, subcategory, category, count(*) AS n FROM inc GROUP BY ALL", INC))
def two_tier_lookup(spark, d):
    return incidents(spark, d).groupBy("source_category_raw", "subcategory", "category").agg(F.count("*").alias("n"))


_R = f" rules AS (SELECT * FROM {values(RULES)} AS t(ord, src, raw, sub, cat, conf)), fm AS (SELECT i.*, (SELECT arg_min(r.ord, r.ord) FROM rules r WHERE r.src = i.source_dataset AND r.raw = i.source_category_raw AND (r.sub = '*' OR r.sub = i.subcategory)) AS ord FROM inc i)"


@register("jn2_first_match_rules", with_("SELECT f.incident_id, r.cat AS app_category, r.conf AS confidence, CAST(f.ord AS INT) AS rule_order FROM fm f LEFT JOIN rules r ON r.ord = f.ord", INC, _R))
def first_match_rules(spark, d):
    return mapping.first_match(incidents(spark, d), RULES).select("incident_id", "app_category", "confidence", "rule_order")


@register("ag11_rule_evidence", with_("SELECT CAST(f.ord AS INT) AS rule_order, count(*) AS n, round(median(resolution_hours), 4) AS median_hours FROM fm f GROUP BY f.ord", INC, _R))
def rule_evidence(spark, d):
    found = with_quantiles(mapping.first_match(incidents(spark, d), RULES), ["rule_order"], "resolution_hours", {"median_hours": 0.5}, [F.count("*").alias("n")])
    return found.withColumn("median_hours", F.round("median_hours", 4))


@register("ag12_category_alignment", with_("SELECT r.cat AS app_category, r.conf AS confidence, f.source_dataset, count(*) AS n, round(median(f.resolution_hours), 4) AS median_hours, round(avg(CASE WHEN f.sla_met THEN 1e0 WHEN NOT f.sla_met THEN 0e0 END), 6) AS share_within FROM fm f JOIN rules r ON r.ord = f.ord GROUP BY ALL", INC, _R))
def category_alignment(spark, d):
    df = mapping.first_match(incidents(spark, d), RULES).where("app_category IS NOT NULL")
    sums = [F.count("*").alias("n"), F.round(F.avg(F.col("sla_met").cast("double")), 6).alias("share_within")]
    found = with_quantiles(df, ["app_category", "confidence", "source_dataset"], "resolution_hours", {"median_hours": 0.5}, sums)
    return found.withColumn("median_hours", F.round("median_hours", 4))


@register("ag13_geography_summary", with_("SELECT source_dataset, round(min(latitude), 6) AS south, round(max(latitude), 6) AS north, round(avg(longitude), 4) AS mean_lon, CAST(count(*) FILTER (latitude BETWEEN 10 AND 20) AS BIGINT) AS n_box, count(latitude) AS n_located FROM inc GROUP BY 1", INC))
def geography_summary(spark, d):
    box = F.col("latitude").between(10, 20)
    return incidents(spark, d).groupBy("source_dataset").agg(F.round(F.min("latitude"), 6).alias("south"), F.round(F.max("latitude"), 6).alias("north"), F.round(F.avg("longitude"), 4).alias("mean_lon"), F.count_if(box).alias("n_box"), F.count("latitude").alias("n_located"))


@register("jn3_feature_join", with_("SELECT i.incident_id, i.category, o.o_custkey, c.c_mktsegment FROM inc i JOIN orders o ON o.o_orderkey = i.k LEFT JOIN customer c ON c.c_custkey = o.o_custkey", INC))
def feature_join(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return incidents(spark, d).join(o, "k").join(c, "o_custkey", "left").select("incident_id", "category", "o_custkey", "c_mktsegment")


@register("jn12_first_closure", ("SELECT e.event_type AS category, e.user_id, CAST(epoch_us(min(e.ts)) // 1000000 AS BIGINT) AS first_s, CAST(epoch_us(m.t) // 1000000 AS BIGINT) AS first_purchase_s FROM events e LEFT JOIN (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1) m ON m.user_id = e.user_id GROUP BY e.event_type, e.user_id, m.t"))
def first_closure(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    m = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("t"))
    g = e.groupBy(F.col("event_type").alias("category"), "user_id").agg(F.min("ts").alias("a"))
    return g.join(m, "user_id", "left").selectExpr("category", "user_id", "unix_micros(a) div 1000000 AS first_s", "unix_micros(t) div 1000000 AS first_purchase_s")


@register("jn14_fuzzy_candidates", """WITH t AS (SELECT p_partkey, p_name, p_brand, p_type, list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN ('and','for','from','the','with','other','general','request','service')) AS tok FROM part),
u AS (SELECT DISTINCT p_name AS value, p_brand AS publisher, tok FROM t WHERE p_partkey % 20 = 0), k AS (SELECT DISTINCT p_name AS text, p_brand AS publisher, p_type AS category, tok FROM t WHERE p_partkey % 20 <> 0),
s AS (SELECT value, category, max(len(list_intersect(u.tok, k.tok)) * 1e0 / len(list_distinct(list_concat(u.tok, k.tok))) * CASE WHEN u.publisher = k.publisher THEN 1.25e0 ELSE 1e0 END) AS score FROM u JOIN k ON len(list_intersect(u.tok, k.tok)) > 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, category) AS rn FROM s),
g AS (SELECT value, max(CASE WHEN rn = 1 THEN category END) AS best, max(CASE WHEN rn = 1 THEN score END) AS score, coalesce(max(CASE WHEN rn = 2 THEN score END), 0) AS second, string_agg(CASE WHEN rn BETWEEN 2 AND 4 THEN category END, '|' ORDER BY rn) AS alternatives FROM r GROUP BY 1)
SELECT value, best, round(score, 6) AS score, round(second, 6) AS second, coalesce(alternatives, '') AS alternatives, CASE WHEN score >= 0.5 AND score - second >= 0.1e0 THEN 'high' WHEN score >= 0.3e0 AND score - second >= 0.05e0 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS tier FROM g""")
def fuzzy_candidates(spark, d):
    p = table(spark, d, "part").withColumn("tokens", S.token_set(F.col("p_name")))
    u = p.where("p_partkey % 20 = 0").select(F.col("p_name").alias("value"), F.col("p_brand").alias("publisher"), "tokens").distinct()
    k = p.where("p_partkey % 20 <> 0").select(F.col("p_name").alias("text"), F.col("p_brand").alias("publisher"), F.col("p_type").alias("category"), "tokens").distinct()
    return mapping.fuzzy_candidates(u, k).select("value", "best", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"), "alternatives", "tier")


@register("jn16_row_enrichment", "SELECT o_orderkey, c_name, n_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def row_enrichment(spark, d):
    o, c, n, li = (table(spark, d, t) for t in ("orders", "customer", "nation", "lineitem"))
    lines = li.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    df = o.join(c, o.o_custkey == c.c_custkey, "left").join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").join(lines, o.o_orderkey == lines.l_orderkey, "left")
    return df.select("o_orderkey", "c_name", "n_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@register("jn13_prediction_log", with_("""SELECT l.incident_id, l.predicted, round(i.resolution_hours, 4) AS actual, epoch_us(c.first_at) AS closed_us, CASE WHEN c.first_at IS NULL THEN 'CENSORED' ELSE 'OBSERVED' END AS state
 FROM (SELECT incident_id, k % 500 AS predicted FROM inc WHERE k % 3 = 0) l JOIN inc i ON i.incident_id = l.incident_id
 LEFT JOIN (SELECT incident_id, min(closed_at) AS first_at FROM inc WHERE closed_at >= reported_at GROUP BY 1) c ON c.incident_id = l.incident_id""", INC))  # fmt: skip
def prediction_log(spark, d):
    """A log of predictions beside what came of them: incidents by id, and first closures where there are any."""
    i = incidents(spark, d)
    log = i.where("k % 3 = 0").select("incident_id", (F.col("k") % 500).alias("predicted"))
    first = i.where("closed_at >= reported_at").groupBy("incident_id").agg(F.min("closed_at").alias("first_at"))
    met = log.join(i.select("incident_id", "resolution_hours"), "incident_id").join(first, "incident_id", "left")
    state = F.when(F.col("first_at").isNull(), "CENSORED").otherwise("OBSERVED")
    return met.select("incident_id", "predicted", F.round("resolution_hours", 4).alias("actual"), F.unix_micros("first_at").alias("closed_us"), state.alias("state"))
