"""Queries of policy scoring, profiles, audits, task tables, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import audit as A
from wardline.operators import priority as P
from wardline.operators.quantiles import with_quantiles
from wardline.operators.storage import cut
from wardline.plans.base import IN_SCOPE, INC, RAW, incidents, register, sparse, table, with_
from wardline.plans.evaluation import _SPLIT, splits

_W, _N = P.POLICY["weights"], P.POLICY["within_m"]
# Inputs made from the order key, the same text in both engines; some of each are unknown.
_INPUTS = {P.POLICY["distance"][n]: f"CASE WHEN k % {j + 3} <> 0 THEN CAST((k * {13 + 2 * j}) % {2 * m} AS DOUBLE) END" for j, (n, m) in enumerate(_N.items())} | {
    "metro_city": "CASE WHEN rk <> 4 THEN rk < 2 END", "urban_area": "CASE WHEN k % 6 <> 0 THEN k % 2 = 0 END",
    "local_incident_density": "CASE WHEN latitude IS NOT NULL THEN (k * 7) % 80 END", "nearby_similar_incidents_30d": "CASE WHEN latitude IS NOT NULL THEN (k * 11) % 50 END",
}
# Orders of one source know next to nothing, so that all tiers of confidence come.
_INPUTS = {n: f"CASE WHEN rk <> 3 THEN {x} END" for n, x in _INPUTS.items()}
_SIG = f"sig AS (SELECT incident_id, city, category, {', '.join(f'{x} AS {n}' for n, x in _INPUTS.items())} FROM inc)"


def _signal_sql(n: str) -> str:
    if n == "category":
        return "CASE WHEN category IS NOT NULL THEN CASE category " + " ".join(f"WHEN '{c}' THEN {v}e0" for c, v in P.POLICY["category"].items()) + " ELSE 0.35e0 END END"
    if n in _N:
        x = P.POLICY["distance"][n]
        return f"CASE WHEN {x} IS NOT NULL THEN least(1e0, greatest(0e0, 1 - {x} / {_N[n]}e0)) END"
    if n in P.POLICY["saturation"]:
        return f"CASE WHEN {n} IS NOT NULL THEN least(1e0, greatest(0e0, {n} / {P.POLICY['saturation'][n]}e0)) END"
    return f"CASE WHEN {n} THEN 1e0 WHEN NOT {n} THEN 0e0 END"


def _half_even(x: str) -> str:
    """x rounded to four places, halves to the even digit, in integers: the engines' doubles differ at halves."""
    v = f"CAST(round({x} * 1e10) AS BIGINT)"
    return f"(({v} // 1000000 + CASE WHEN {v} % 1000000 > 500000 OR ({v} % 1000000 = 500000 AND {v} // 1000000 % 2 = 1) THEN 1 ELSE 0 END) / 1e4)"


_PRI = f"""s1 AS (SELECT *, {", ".join(f"{_signal_sql(n)} AS s_{n}" for n in _W)} FROM sig),
s2 AS (SELECT *, category = 'OPEN_MANHOLE' AS fixed, {" + ".join(f"CASE WHEN s_{n} IS NOT NULL THEN s_{n} * {w}e0 ELSE 0e0 END" for n, w in _W.items())} AS top,
 {" + ".join(f"CASE WHEN s_{n} IS NOT NULL THEN {w}e0 ELSE 0e0 END" for n, w in _W.items())} AS below, {" + ".join(f"CASE WHEN s_{n} IS NOT NULL THEN 1 ELSE 0 END" for n in _W)} AS cnt FROM s1),
s3 AS (SELECT *, CASE WHEN fixed THEN 1e0 WHEN below > 0 THEN top / below END AS raw_score, CASE WHEN fixed THEN 1e0 ELSE round(below / {sum(_W.values())}e0, 10) END AS cover,
 CAST(CASE WHEN fixed THEN 1 ELSE cnt END AS INT) AS n_signals FROM s2),
pri AS (SELECT *, {_half_even('cover')} AS coverage, {_half_even('raw_score')} AS final_score, CASE WHEN round(raw_score, 12) >= 0.75e0 THEN 'P1' WHEN round(raw_score, 12) >= 0.55e0 THEN 'P2' WHEN round(raw_score, 12) >= 0.3e0 THEN 'P3' WHEN raw_score IS NOT NULL THEN 'P4' END AS band,
 CASE WHEN fixed THEN 'HIGH' WHEN n_signals >= 8 AND cover >= 0.7e0 THEN 'HIGH' WHEN n_signals >= 3 AND cover >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s3)"""


def prioritised(spark, d):
    i = incidents(spark, d)
    return P.score(i.selectExpr("incident_id", "city", "category", *[f"{x} AS {n}" for n, x in _INPUTS.items()]))


@register("pe1_signals", with_("SELECT incident_id, " + ", ".join(f"round(s_{n}, 6) AS s_{n}" for n in _W) + " FROM pri", INC, _SIG, _PRI))
def signals(spark, d):
    return prioritised(spark, d).select("incident_id", *[F.round(f"s_{n}", 6).alias(f"s_{n}") for n in _W])


@register("pe2_pe5_priority_score", with_("SELECT incident_id, final_score AS score, coverage, n_signals, band, confidence, CASE band WHEN 'P1' THEN 30 WHEN 'P2' THEN 50 WHEN 'P3' THEN 72 WHEN 'P4' THEN 90 END AS policy_hours, false AS is_ground_truth FROM pri", INC, _SIG, _PRI))
def priority_score(spark, d):
    return prioritised(spark, d).select("incident_id", "score", "coverage", "n_signals", "band", "confidence", "policy_hours", "is_ground_truth")


_LABEL = {n: "'category ' || category" if n == "category" else f"'{P.POLICY['labels'][n]}'" for n in _W}
_PART = ", ".join(f"{{'n': {_LABEL[n]}, 'i': {i}, 'v': round(s_{n} * {w}e0, 6)}}" for i, (n, w) in enumerate(_W.items()))
_BEST = f"list_sort(list_transform(list_filter([{_PART}], lambda x: x.v >= 0.03e0), lambda x: {{'v': -x.v, 'i': x.i, 'n': x.n}}))[1:5]"


@register("pe6_so5_str6_reasons", with_(f"""SELECT incident_id, CASE WHEN fixed THEN 'category rule: incident category ' || category || ' is an unconditional immediate hazard' WHEN below > 0 THEN
 concat_ws(' | ', nullif(array_to_string(list_transform({_BEST}, lambda x: x.n || ' (' || printf('%.2f', round_even(-x.v, 2)) || ')'), ' | '), ''),
  CASE WHEN confidence <> 'HIGH' THEN confidence || ' CONFIDENCE: only ' || n_signals || ' of {len(_W)} inputs available' END) ELSE 'no scoring inputs available' END AS reasons FROM pri""", INC, _SIG, _PRI))  # fmt: skip
def reasons(spark, d):
    return prioritised(spark, d).select("incident_id", "reasons")


@register("ag44_score_distribution", with_("SELECT band, confidence, count(*) AS n, min(final_score) AS lo, round(median(final_score), 4) AS mid, max(final_score) AS hi FROM pri GROUP BY ALL", INC, _SIG, _PRI))
def score_distribution(spark, d):
    return with_quantiles(
        prioritised(spark, d), ["band", "confidence"], "score", {"mid": 0.5}, [F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")]
    ).withColumn("mid", F.round("mid", 4))


@register("prj31_prj35_priority_table", with_("SELECT i.incident_id, i.city, i.category, p.band, 'policy' AS strategy, CAST(NULL AS VARCHAR) AS priority_label FROM pri p JOIN inc i USING (incident_id)", INC, _SIG, _PRI))
def priority_table(spark, d):
    from wardline.sources.schema import assert_null_fields_empty

    df = prioritised(spark, d).select("incident_id", "city", "category", "band", F.lit("policy").alias("strategy"), F.lit(None).cast("string").alias("priority_label"))
    return assert_null_fields_empty(df, ["priority_label"])


# ---- aggregates ---------------------------------------------------------------------------------------------------


@register("ag2_union_summary", with_("SELECT source_dataset, category, count(*) AS n, count(latitude) AS n_located, count(closed_at) AS n_closed FROM inc GROUP BY GROUPING SETS ((source_dataset), (category), ())", INC))
def union_summary(spark, d):
    i = incidents(spark, d)
    g = i.groupingSets([[F.col("source_dataset")], [F.col("category")], []], "source_dataset", "category")
    return g.agg(F.count("*").alias("n"), F.count("latitude").alias("n_located"), F.count("closed_at").alias("n_closed")).select("source_dataset", "category", "n", "n_located", "n_closed")


@register("ag3_unmapped_values", with_("SELECT source_dataset, coalesce(source_category_raw, '<NULL>') AS value, count(*) AS n FROM inc WHERE category = 'UNMAPPED' GROUP BY ALL ORDER BY n DESC, 1, 2", INC))
def unmapped_values(spark, d):
    return incidents(spark, d).where("category = 'UNMAPPED'").groupBy("source_dataset", F.coalesce("source_category_raw", F.lit("<NULL>")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_dataset", "value")


@register("ag4_so7_incident_profile", with_("SELECT category, status, count(*) AS n, round(1 - count(latitude) * 1e0 / count(*), 6) AS missing_location, count(*) - count(DISTINCT incident_id) AS n_repeated FROM inc GROUP BY ALL ORDER BY n DESC, category, status LIMIT 40", INC))
def incident_profile(spark, d):
    g = incidents(spark, d).groupBy("category", "status").agg(F.count("*").alias("n"), F.round(1 - F.count("latitude") / F.count("*"), 6).alias("missing_location"), (F.count("*") - F.count_distinct("incident_id")).alias("n_repeated"))
    return g.orderBy(F.desc("n"), "category", "status").limit(40)


_NS = "round(quantile_cont({0}, {1}e0), 4) AS {2}"


@register("ag5_numeric_summary", with_("SELECT category, count(raw_hours) AS n, round(min(raw_hours), 4) AS lo, " + ", ".join(_NS.format("raw_hours", q, n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"))) + ", round(max(raw_hours), 4) AS hi, CAST(count(*) FILTER (raw_hours < 0) AS BIGINT) AS negatives FROM inc GROUP BY 1", INC))
def numeric_summary(spark, d):
    return A.numeric_summary(incidents(spark, d), "raw_hours", ["category"])


_PC = ["l_returnflag", "l_quantity", "l_partkey", "l_linestatus"]


@register("ag6_column_profile", "SELECT c AS column, n, round(1 - k * 1e0 / n, 6) AS missing, dd AS n_distinct, CASE WHEN dd <= 1 THEN 'CONSTANT' WHEN round(1 - k * 1e0 / n, 6) > 0.9 THEN 'ALMOST_MISSING' WHEN dd > 1000 THEN 'HIGH_CARDINALITY' END AS warning FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS dd FROM lineitem" for c in _PC) + ")")
def column_profile(spark, d):
    return A.profile(table(spark, d, "lineitem"), _PC)


_NUM = ("l_quantity", "l_partkey")


@register("ag6_full_profile", "SELECT c AS column, n, round(1 - k * 1e0 / n, 6) AS missing, dd AS n_distinct, CASE WHEN dd <= 1 THEN 'CONSTANT' WHEN round(1 - k * 1e0 / n, 6) > 0.9 THEN 'ALMOST_MISSING' WHEN dd > 1000 THEN 'HIGH_CARDINALITY' END AS warning, round(q[1], 4) AS least, round(q[2], 4) AS p50, round(q[3], 4) AS p99, round(q[4], 4) AS most FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS dd, {f'quantile_cont(CAST({c} AS DOUBLE), [0, 0.5e0, 0.99e0, 1])' if c in _NUM else 'CAST(NULL AS DOUBLE[])'} AS q FROM lineitem" for c in _PC) + ")")
def full_profile(spark, d):
    """Types aside (they differ between engines), the whole profile."""
    return A.full_profile(table(spark, d, "lineitem"), _PC).drop("dtype").withColumns({c: F.round(c, 4) for c in ("least", "p50", "p99", "most")})


@register("ag7_split_profile", with_("SELECT split, category, count(*) AS n, CAST(epoch_us(min(reported_at)) // 1000000 AS BIGINT) AS first_s, CAST(epoch_us(max(reported_at)) // 1000000 AS BIGINT) AS last_s FROM sp GROUP BY ROLLUP (split, category)", INC, _SPLIT))
def split_profile(spark, d):
    return splits(spark, d).rollup("split", "category").agg(F.count("*").alias("n"), F.expr("unix_micros(min(reported_at)) div 1000000").alias("first_s"), F.expr("unix_micros(max(reported_at)) div 1000000").alias("last_s"))


@register("ag8_effective_predictors", with_("SELECT c AS predictor, CASE WHEN dd = 0 THEN 'null' WHEN dd = 1 THEN 'constant' ELSE 'usable' END AS state FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS dd FROM sp WHERE split = 'train'" for c in ("category", "zone_type", "sla_target_hours", "subcategory")) + ")", INC, _SPLIT))
def effective_predictors(spark, d):
    cols = ["category", "zone_type", "sla_target_hours", "subcategory"]
    p = A.profile(splits(spark, d).where("split = 'train'"), cols)
    return p.select(F.col("column").alias("predictor"), F.when(F.col("n_distinct") == 0, "null").when(F.col("n_distinct") == 1, "constant").otherwise("usable").alias("state"))


@register("ag9_cleaning_counters", with_("SELECT source_dataset, rule, CAST(n AS BIGINT) AS n FROM (UNPIVOT (SELECT source_dataset, count(*) FILTER (latitude IS NULL) AS null_location, count(*) FILTER (raw_hours < 0) AS negative_duration, count(*) FILTER (is_instant_closure) AS instant_closure FROM inc GROUP BY 1) ON null_location, negative_duration, instant_closure INTO NAME rule VALUE n)", INC))
def cleaning_counters(spark, d):
    rules = {"null_location": F.col("latitude").isNull(), "negative_duration": F.col("raw_hours") < 0, "instant_closure": F.col("is_instant_closure")}
    g = incidents(spark, d).groupBy("source_dataset").agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return g.unpivot("source_dataset", list(rules), "rule", "n")


@register("ag10_time_summary", with_("SELECT source_dataset, hour(reported_at) AS hour, count(*) AS n, round(avg(CASE WHEN isodow(reported_at) >= 6 THEN 1e0 ELSE 0e0 END), 6) AS weekend_share FROM raw GROUP BY ALL", RAW))
def time_summary(spark, d):
    c = S.calendar(F.col("reported_at"))
    return sparse(spark, d).groupBy("source_dataset", c["hour"].cast("long").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg(c["is_weekend"].cast("double")), 6).alias("weekend_share"))


@register("ag14_training_baselines", with_("SELECT category, round(median(resolution_hours), 4) AS median_hours, count(resolution_hours) AS n, round(avg(CASE WHEN sla_met THEN 0e0 WHEN NOT sla_met THEN 1e0 END), 6) AS breach_rate, count(sla_met) AS n_sla FROM sp WHERE split = 'train' GROUP BY 1", INC, _SPLIT))
def training_baselines(spark, d):
    breach = F.round(F.avg((~F.col("sla_met")).cast("double")), 6).alias("breach_rate")
    counts = [F.count("resolution_hours").alias("n"), breach, F.count("sla_met").alias("n_sla")]
    trained = splits(spark, d).where("split = 'train'")
    return with_quantiles(trained, ["category"], "resolution_hours", {"median_hours": 0.5}, counts).withColumn("median_hours", F.round("median_hours", 4))


@register("ag15_feature_ranges", "SELECT f AS feature, round(quantile_cont(v, 0.01e0), 4) AS p01, round(quantile_cont(v, 0.99e0), 4) AS p99, round(1 - count(v) * 1e0 / count(*), 6) AS missing FROM (SELECT 'quantity' AS f, CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'price', CAST(l_extendedprice AS DOUBLE) FROM lineitem) GROUP BY f")
def feature_ranges(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"))
    long = li.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in ("quantity", "price")])).alias("x")).select("x.*")
    found = with_quantiles(long, ["feature"], "v", {"p01": 0.01, "p99": 0.99}, [F.round(1 - F.count("v") / F.count("*"), 6).alias("missing")])
    return found.withColumns({c: F.round(c, 4) for c in ("p01", "p99")})


@register("ag23_error_table", with_("SELECT bin, count(*) AS n, round(avg(e), 4) AS mae, round(avg(s), 4) AS signed, round(sum(e) / sum(sum(e)) OVER (), 6) AS share FROM (SELECT CASE WHEN resolution_hours < 24 THEN 'a_day' WHEN resolution_hours < 168 THEN 'b_week' WHEN resolution_hours < 720 THEN 'c_month' ELSE 'd_more' END AS bin, abs(resolution_hours - 900) AS e, 900 - resolution_hours AS s FROM inc WHERE resolution_hours IS NOT NULL) GROUP BY bin", INC))
def error_table(spark, d):
    h = F.col("resolution_hours")
    g = incidents(spark, d).where(h.isNotNull()).groupBy(F.when(h < 24, "a_day").when(h < 168, "b_week").when(h < 720, "c_month").otherwise("d_more").alias("bin"))
    g = g.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(h - 900)), 4).alias("mae"), F.round(F.avg(900 - h), 4).alias("signed"), F.sum(F.abs(h - 900)).alias("e"))
    return g.withColumn("share", F.round(F.col("e") / F.sum("e").over(Window.partitionBy(F.lit(1))), 6)).drop("e")  # four rows


@register("ag26_shadow_evaluation", with_("SELECT category, count(*) AS n, CAST(count(*) FILTER (resolution_hours IS NOT NULL) AS BIGINT) AS observed, round(avg(CASE WHEN resolution_hours IS NOT NULL THEN abs(resolution_hours - k % 500) END), 4) AS mae, CAST(count(*) FILTER (resolution_hours IS NOT NULL AND resolution_hours > 2 * (k % 500)) AS BIGINT) AS under, count(*) FILTER (resolution_hours IS NOT NULL) >= 30 AS enough FROM inc GROUP BY 1", INC))
def shadow_evaluation(spark, d):
    p, h = F.col("k") % 500, F.col("resolution_hours")
    return incidents(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.count(h).alias("observed"), F.round(F.avg(F.abs(h - p)), 4).alias("mae"), F.count_if(h > 2 * p).alias("under"), (F.count(h) >= 30).alias("enough"))


@register("ag29_column_health", "SELECT \"column\", round(max(n) * 1e0 / sum(n), 6) AS top_share FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 2" for c in ("l_returnflag", "l_linestatus", "l_suppkey")) + ") GROUP BY \"column\"")
def column_health(spark, d):
    return A.near_constant(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"])


@register("ag30_missing_by_group", with_("SELECT source_dataset, round(avg(CASE WHEN due_at IS NULL THEN 1e0 ELSE 0e0 END), 6) AS due_missing, round(avg(CASE WHEN closed_at IS NULL THEN 1e0 ELSE 0e0 END), 6) AS closed_missing, avg(CASE WHEN due_at IS NULL THEN 1e0 ELSE 0e0 END) IN (0, 1) AS perfect FROM inc GROUP BY 1", INC))
def missing_by_group(spark, d):
    m = lambda c: F.avg(F.col(c).isNull().cast("double"))
    return incidents(spark, d).groupBy("source_dataset").agg(F.round(m("due_at"), 6).alias("due_missing"), F.round(m("closed_at"), 6).alias("closed_missing"), m("due_at").isin(0.0, 1.0).alias("perfect"))


@register("ag31_target_health", with_("SELECT category, round(avg(CASE WHEN sla_met THEN 1e0 WHEN NOT sla_met THEN 0e0 END), 6) AS positive_rate, round(quantile_cont(resolution_hours, 0.99e0) / nullif(median(resolution_hours), 0), 4) AS tail, round(avg(CASE WHEN resolution_hours < 1 THEN 1e0 WHEN resolution_hours >= 1 THEN 0e0 END), 6) AS zero_share FROM inc GROUP BY 1", INC))
def target_health(spark, d):
    h = F.col("resolution_hours")
    means = [F.round(F.avg(F.col("sla_met").cast("double")), 6).alias("positive_rate"), F.round(F.avg((h < 1).cast("double")), 6).alias("zero_share")]
    found = with_quantiles(incidents(spark, d), ["category"], "resolution_hours", {"p99": 0.99, "p50": 0.5}, means)
    return found.select("category", "positive_rate", F.round(F.col("p99") / F.nullif(F.col("p50"), F.lit(0.0)), 4).alias("tail"), "zero_share")


@register("ag33_duplicate_rows", "SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n_rows, CAST(count(*) FILTER (k > 1) AS BIGINT) AS contradictory FROM (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_suppkey, l_quantity HAVING count(*) > 1)")
def duplicate_rows(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("k")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("n_rows"), F.count_if(F.col("k") > 1).alias("contradictory"))


@register("ag34_corpus_balance", with_("SELECT source_dataset, count(*) AS n, round(count(*) * 1e0 / sum(count(*)) OVER (), 6) AS share, round(count(*) FILTER (category = 'UNMAPPED') * 1e0 / count(*), 6) AS unmapped_share, CAST(date_diff('day', CAST(min(reported_at) AS DATE), CAST(max(reported_at) AS DATE)) AS BIGINT) AS span_days FROM inc GROUP BY 1", INC))
def corpus_balance(spark, d):
    g = incidents(spark, d).groupBy("source_dataset").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("category") == "UNMAPPED") / F.count("*"), 6).alias("unmapped_share"), F.datediff(F.to_date(F.max("reported_at")), F.to_date(F.min("reported_at"))).cast("long").alias("span_days"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6)).select("source_dataset", "n", "share", "unmapped_share", "span_days")  # a row a source


@register("ag36_dashboard_counters", with_("SELECT city, count(*) AS n, CAST(count(*) FILTER (status = 'open') AS BIGINT) AS n_open, CAST(count(*) FILTER (due_at < TIMESTAMP '1996-01-01' AND closed_at IS NULL) AS BIGINT) AS n_breached, CAST(count(*) FILTER (k % 3 = 0 AND status = 'open') AS BIGINT) AS n_unassigned FROM inc GROUP BY 1", INC))
def dashboard_counters(spark, d):
    open_ = F.col("status") == "open"
    late = (F.col("due_at") < F.lit("1996-01-01").cast("timestamp")) & F.col("closed_at").isNull()
    return incidents(spark, d).groupBy("city").agg(F.count("*").alias("n"), F.count_if(open_).alias("n_open"), F.count_if(late).alias("n_breached"), F.count_if(open_ & (F.col("k") % 3 == 0)).alias("n_unassigned"))


@register("ag38_on_time_reconciliation", with_("SELECT source_dataset, CAST(count(*) FILTER (flag = sla_met) AS BIGINT) AS agree, CAST(count(*) FILTER (flag <> sla_met) AS BIGINT) AS disagree, CAST(count(*) FILTER (flag IS NULL OR sla_met IS NULL) AS BIGINT) AS not_comparable FROM (SELECT *, CASE WHEN k % 3 = 0 THEN true WHEN k % 3 = 1 THEN false END AS flag FROM inc) GROUP BY 1", INC))
def on_time_reconciliation(spark, d):
    flag = F.when(F.col("k") % 3 == 0, True).when(F.col("k") % 3 == 1, False)
    return incidents(spark, d).withColumn("flag", flag).groupBy("source_dataset").agg(F.count_if(F.col("flag") == F.col("sla_met")).alias("agree"), F.count_if(F.col("flag") != F.col("sla_met")).alias("disagree"), F.count_if(F.col("flag").isNull() | F.col("sla_met").isNull()).alias("not_comparable"))


@register("ag41_data_sufficiency", with_("SELECT category, count(resolution_hours) AS n, count(DISTINCT date_trunc('week', reported_at)) AS weeks, count(resolution_hours) >= 500 AND count(DISTINCT date_trunc('week', reported_at)) >= 26 AS sufficient FROM inc GROUP BY 1", INC))
def data_sufficiency(spark, d):
    g = incidents(spark, d).groupBy("category").agg(F.count("resolution_hours").alias("n"), F.count_distinct(S.week_start(F.col("reported_at"))).alias("weeks"))
    return g.withColumn("sufficient", (F.col("n") >= 500) & (F.col("weeks") >= 26))


@register("ag43_class_balance", with_("SELECT split, CAST(count(*) FILTER (status = 'open') AS BIGINT) AS open, CAST(count(*) FILTER (status = 'closed') AS BIGINT) AS closed FROM sp GROUP BY 1", INC, _SPLIT))
def class_balance(spark, d):
    return splits(spark, d).groupBy("split").pivot("status", ["open", "closed"]).count().fillna(0)


@register("ag45_lookup_encoding", "SELECT 'n_regionkey' AS column, max(a) <= 1 AS is_lookup FROM (SELECT count(DISTINCT n_regionkey) AS a FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name) UNION ALL SELECT 'c_custkey', max(a) <= 1 FROM (SELECT count(DISTINCT c_custkey) AS a FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)")
def lookup_encoding(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.lookup_encodings(c, "n_name", ["n_regionkey", "c_custkey"])


# ---- checks -------------------------------------------------------------------------------------------------------


@register("chk1_chk9_integrity", with_("SELECT c AS check_id, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(bad AS BIGINT) AS bad FROM (SELECT 'no_negative_duration' AS c, count(*) FILTER (resolution_hours < 0) AS bad FROM inc UNION ALL SELECT 'closed_after_reported', count(*) FILTER (NOT coalesce(closed_at >= reported_at, true)) FROM inc UNION ALL SELECT 'sla_only_where_due', count(*) FILTER (NOT (sla_target_hours IS NULL OR rk <= 1)) FROM inc UNION ALL SELECT 'id_has_source', count(*) FILTER (NOT starts_with(incident_id, source_dataset)) FROM inc UNION ALL SELECT 'located_in_range', count(*) FILTER (NOT coalesce(latitude BETWEEN -90 AND 90, true)) FROM inc)", INC))
def integrity(spark, d):
    t = F.lit(True)
    return A.checks(incidents(spark, d), {
        "no_negative_duration": F.coalesce(F.col("resolution_hours") >= 0, t), "closed_after_reported": F.coalesce(F.col("closed_at") >= F.col("reported_at"), t), "sla_only_where_due": F.col("sla_target_hours").isNull() | (F.col("rk") <= 1),
        "id_has_source": F.col("incident_id").startswith(F.col("source_dataset")), "located_in_range": F.coalesce(F.col("latitude").between(-90, 90), t),
    })


@register("chk5_split_order", with_("SELECT source_dataset, coalesce(max(CASE WHEN split = 'train' THEN reported_at END) < min(CASE WHEN split = 'val' THEN reported_at END), true) AND coalesce(max(CASE WHEN split = 'val' THEN reported_at END) < min(CASE WHEN split = 'test' THEN reported_at END), true) AS in_order FROM sp GROUP BY 1", INC, _SPLIT))
def split_order(spark, d):
    return A.split_order(splits(spark, d), "source_dataset")


@register("chk6_one_split_each", with_("SELECT zone_id, count(DISTINCT split) AS n_splits, count(DISTINCT split) > 1 AS leaks FROM sp GROUP BY 1", INC, _SPLIT))
def one_split_each(spark, d):
    return splits(spark, d).groupBy("zone_id").agg(F.count_distinct("split").alias("n_splits")).withColumn("leaks", F.col("n_splits") > 1)


@register("st4_key_set_equality", with_("SELECT (SELECT count(*) FROM (SELECT k FROM inc EXCEPT ALL SELECT o_orderkey FROM orders)) AS missing, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT k FROM inc)) AS extra", INC))
def key_set_equality(spark, d):
    a, b = incidents(spark, d).select("k"), table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    n = lambda x, name: x.agg(F.count("*").alias(name))
    return n(a.exceptAll(b), "missing").crossJoin(n(b.exceptAll(a), "extra"))  # one row each


# ---- task tables, sorts, sets -------------------------------------------------------------------------------------


@register("prj25_prj27_resolution_task", with_("SELECT incident_id, category, city, split, round(ln(1 + resolution_hours), 6) AS target_log1p, resolution_hours IS NULL AND NOT coalesce(is_instant_closure, false) AS censored FROM sp WHERE resolution_hours IS NOT NULL", INC, _SPLIT))
def resolution_task(spark, d):
    from wardline.sources.schema import assert_allowed

    df = splits(spark, d).where("resolution_hours IS NOT NULL").select("incident_id", "category", "city", "split", F.round(F.log1p("resolution_hours"), 6).alias("target_log1p"), (F.col("resolution_hours").isNull() & ~F.coalesce("is_instant_closure", F.lit(False))).alias("censored"))
    return assert_allowed(df, set(df.columns), {"closed_at", "resolution_hours"})


@register("prj25_consolidated_table", with_("""
SELECT incident_id, source_dataset, category, city, subcategory, split, resolution_hours, sla_met, closed_at IS NULL AS censored, CAST(row_number() OVER (ORDER BY reported_at, incident_id) AS BIGINT) AS place FROM sp""", INC, _SPLIT))  # fmt: skip
def consolidated_table(spark, d):
    """Identifiers, predictors and targets of all incidents with their place in time; repeated ids are refused."""
    from wardline.operators.workflow import stable_order
    from wardline.sources.schema import assert_unique

    columns = ["incident_id", "source_dataset", "category", "city", "subcategory", "split", "resolution_hours", "sla_met", F.col("closed_at").isNull().alias("censored"), "reported_at"]
    df = cut(splits(spark, d).select(*columns))
    return stable_order(assert_unique(df, "incident_id"), ["reported_at", "incident_id"]).drop("reported_at")


@register("prj26_column_roles", with_("SELECT c AS column, CAST(n AS BIGINT) AS known, CASE WHEN c = 'incident_id' THEN 'identifier' WHEN c = 'resolution_hours' THEN 'target' ELSE 'predictor' END AS role, c NOT IN ('incident_id', 'resolution_hours') AND n > 0 AS usable FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count({c}) AS n FROM inc" for c in ("incident_id", "category", "sla_target_hours", "resolution_hours")) + ")", INC))
def column_roles(spark, d):
    cols = ["incident_id", "category", "sla_target_hours", "resolution_hours"]
    role = F.when(F.col("column") == "incident_id", "identifier").when(F.col("column") == "resolution_hours", "target").otherwise("predictor")
    return incidents(spark, d).agg(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "column", "known").select("column", "known", role.alias("role"), ((role == "predictor") & (F.col("known") > 0)).alias("usable"))


@register("prj28_sla_task", with_("SELECT incident_id, category, split, sla_target_hours, NOT sla_met AS breached FROM sp WHERE sla_met IS NOT NULL", INC, _SPLIT))
def sla_task(spark, d):
    return splits(spark, d).where("sla_met IS NOT NULL").select("incident_id", "category", "split", "sla_target_hours", (~F.col("sla_met")).alias("breached"))


@register("prj32_resolution_v2_population", with_(f"SELECT incident_id FROM inc WHERE status = 'closed' AND NOT is_duplicate AND raw_hours BETWEEN 1e0 / 60 AND 87600 AND category IN {tuple(IN_SCOPE)}", INC))
def resolution_v2_population(spark, d):
    return incidents(spark, d).where((F.col("status") == "closed") & ~F.col("is_duplicate") & F.col("raw_hours").between(1 / 60, 87600) & F.col("category").isin(IN_SCOPE)).select("incident_id")


@register("prj33_sla_v2_population", with_("SELECT incident_id, CASE WHEN resolution_hours IS NOT NULL THEN resolution_hours >= sla_target_hours ELSE true END AS breached FROM (SELECT *, max(reported_at) OVER (PARTITION BY source_dataset) AS extract_end FROM inc) WHERE sla_target_hours IS NOT NULL AND (resolution_hours IS NOT NULL OR (closed_at IS NULL AND due_at < extract_end))", INC))
def sla_v2_population(spark, d):
    i = incidents(spark, d)
    end = i.groupBy("source_dataset").agg(F.max("reported_at").alias("extract_end"))
    i = i.join(F.broadcast(end), "source_dataset").where("sla_target_hours IS NOT NULL AND (resolution_hours IS NOT NULL OR (closed_at IS NULL AND due_at < extract_end))")
    return i.select("incident_id", F.when(F.col("resolution_hours").isNotNull(), F.col("resolution_hours") >= F.col("sla_target_hours")).otherwise(True).alias("breached"))


@register("prj34_resolution_accounting", with_(f"SELECT source_dataset, CAST(count(*) FILTER (resolution_hours IS NOT NULL) AS BIGINT) AS kept, CAST(count(*) FILTER (is_instant_closure) AS BIGINT) AS instant, CAST(count(*) FILTER (resolution_hours IS NULL AND NOT coalesce(is_instant_closure, false)) AS BIGINT) AS open_or_invalid FROM inc WHERE category IN {tuple(IN_SCOPE)} GROUP BY 1", INC))
def resolution_accounting(spark, d):
    instant = F.coalesce("is_instant_closure", F.lit(False))
    return incidents(spark, d).where(F.col("category").isin(IN_SCOPE)).groupBy("source_dataset").agg(F.count("resolution_hours").alias("kept"), F.count_if(instant).alias("instant"), F.count_if(F.col("resolution_hours").isNull() & ~instant).alias("open_or_invalid"))


@register("so4_top_levels", "SELECT CASE WHEN rn <= 20 THEN level ELSE '__OTHER__' END AS level, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, level) AS rn FROM (SELECT coalesce(p_type, '__MISSING__') AS level, count(*) AS n FROM part GROUP BY 1)) GROUP BY 1")
def top_levels(spark, d):
    return A.top_levels(table(spark, d, "part"), "p_type", 20)


@register("st1_union_sources", with_("SELECT source_dataset, count(*) AS n FROM (SELECT source_dataset FROM raw UNION ALL SELECT 'evt' FROM events) GROUP BY 1", RAW))
def union_sources(spark, d):
    from wardline.plans.base import dense

    both = sparse(spark, d).select("source_dataset", "incident_id", "reported_at").unionByName(dense(spark, d).select("source_dataset", "incident_id", "reported_at", "event_id"), allowMissingColumns=True)
    return both.groupBy("source_dataset").agg(F.count("*").alias("n"))


@register("st2_stacked_horizons", with_("SELECT h AS horizon, count(*) AS n, CAST(count(*) FILTER (resolution_hours > h) AS BIGINT) AS n_late FROM inc, (VALUES (4), (24), (72), (168)) AS t(h) WHERE resolution_hours IS NOT NULL GROUP BY 1", INC))
def stacked_horizons(spark, d):
    x = incidents(spark, d).where("resolution_hours IS NOT NULL").select("resolution_hours", F.explode(F.array(*[F.lit(h) for h in (4, 24, 72, 168)])).alias("horizon"))
    return x.groupBy("horizon").agg(F.count("*").alias("n"), F.count_if(F.col("resolution_hours") > F.col("horizon")).alias("n_late"))


@register("st6_shared_values", "SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_values(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("key")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@register("wn12_keep_first", "SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def keep_first(spark, d):
    from wardline.sources.feeds import first_rows

    return first_rows(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_partkey")


@register("snk4_proportional_sample", with_("SELECT split, count(*) AS n, min(md5('7|' || incident_id)) AS first_md5 FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('7|' || incident_id)) AS rn, count(*) OVER (PARTITION BY split) AS c FROM sp) WHERE rn <= round_even(c * 0.05e0, 0) GROUP BY 1", INC, _SPLIT))
def proportional_sample(spark, d):
    from wardline.operators.ordering import sampled
    from wardline.operators.splits import seeded

    rows = splits(spark, d).select("split", "incident_id", seeded("7", F.col("incident_id")).alias("m"))
    s = sampled(rows, "split", "m", ["incident_id"], 0.05)
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("m").alias("first_md5"))
