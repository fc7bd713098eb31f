"""Queries of the pipeline's audits: data set, time, places, density, priority, targets, leakage, outputs, tasks, mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import audit as A
from wardline.operators import geo
from wardline.operators import panel as P
from wardline.operators import priority
from wardline.operators import task_audit as T
from wardline.operators.storage import cut
from wardline.operators.time_features import to_local
from wardline.plans.asof import _HAV
from wardline.plans.audits import _as_checks, duplicate_task, hotspot_task
from wardline.plans.base import IN_SCOPE, INC, ORACLE, ZONES, incidents, register, table, values, with_
from wardline.plans.evaluation import _CS, _SPLIT, splits
from wardline.plans.tables import _INPUTS, _PRI, _SIG, consolidated_table

# Columns of outer layers that no source fills, and columns of the tables as they are made.
PLACES = [*priority.POLICY["distance"].values(), "metro_city", "urban_area"]
PRIORITY_COLUMNS = ["incident_id", "city", "category", "band", "strategy", "priority_label", "priority_label_source"]
PREDICTORS = ["category", "city", "subcategory"]
TARGETS = ["resolution_hours", "sla_met", "censored"]


def _in(names: list[str], bad: list[str]) -> str:
    """SQL that counts names that are among the bad ones."""
    return f"SELECT count(*) FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in names)}) n(c) WHERE c IN ({', '.join(f'{chr(39)}{b}{chr(39)}' for b in bad)})"


def _dens() -> str:
    return f"dens AS MATERIALIZED ({ORACLE['jn5_historical_density']})"


_WIDE = f"""wide AS MATERIALIZED (SELECT i.*, p.band, p.confidence, p.final_score AS score, p.coverage, p.n_signals, z.tz, 'policy' AS strategy,
 (i.reported_at AT TIME ZONE 'UTC') AT TIME ZONE z.tz AS local, hour(local) AS hour, isodow(local) - 1 AS dow, month(local) AS month, hour(i.reported_at) AS hour_utc
 FROM inc i JOIN pri p USING (incident_id) LEFT JOIN (SELECT * FROM {values(ZONES)} AS t(src, tz)) z ON z.src = i.source_dataset)"""


def wide(spark, d) -> DataFrame:
    """Incidents with their local calendar and policy score, one row each; nothing is joined but small dimensions."""
    i = to_local(incidents(spark, d), ZONES)
    calendar = [c.alias(n) for n, c in S.calendar(F.col("local")).items()]
    zone = F.create_map(*[F.lit(x) for z in ZONES for x in z])[F.col("source_dataset")]
    i = i.select("*", *calendar, F.hour("reported_at").alias("hour_utc"), zone.alias("tz"), F.lit("policy").alias("strategy"))
    label = [F.lit(None).cast("string").alias(n) for n in ("priority_label", "priority_label_source")]
    return priority.score(i.selectExpr("*", *[f"{x} AS {n}" for n, x in _INPUTS.items()])).select("*", *label)


_PIPELINE = {
    "DS-1": """SELECT count(*) FROM (SELECT source_dataset AS s, count(*) AS n FROM inc GROUP BY 1) a FULL JOIN
     (SELECT 'src' || n_regionkey AS s, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) b USING (s) WHERE a.n IS DISTINCT FROM b.n""",
    "DS-2": "SELECT count(*) FROM (SELECT 1 FROM inc GROUP BY incident_id HAVING count(*) > 1)",
    "DS-3": "SELECT count(*) FROM (SELECT 1 FROM inc GROUP BY incident_id HAVING count(DISTINCT source_dataset) > 1)",
    "DS-4": "SELECT count(*) FROM inc WHERE source_dataset IS NULL OR city IS NULL",
    "DS-5/geo": """SELECT count(*) FROM (SELECT incident_id, count(*) AS n FROM inc GROUP BY 1) a
     FULL JOIN (SELECT incident_id, count(*) AS n FROM dens GROUP BY 1) b USING (incident_id) WHERE a.n IS DISTINCT FROM 1 OR b.n IS DISTINCT FROM 1""",
    "DS-5/time": """SELECT count(*) FROM (SELECT incident_id, count(*) AS n FROM inc GROUP BY 1) a
     FULL JOIN (SELECT incident_id, count(*) AS n FROM wide GROUP BY 1) b USING (incident_id) WHERE a.n IS DISTINCT FROM 1 OR b.n IS DISTINCT FROM 1""",
    "TF-1": "SELECT count(*) FROM wide WHERE reported_at IS NOT NULL AND hour IS NULL",
    "TF-2": "SELECT count(*) FROM wide WHERE NOT coalesce(hour BETWEEN 0 AND 23 AND dow BETWEEN 0 AND 6 AND month BETWEEN 1 AND 12, tz IS NULL)",
    "TF-3": "SELECT count(*) FROM wide WHERE (hour >= 22 OR hour < 6) <> (hour NOT BETWEEN 6 AND 21)",
    "TF-4": "SELECT count(*) FROM wide WHERE (isodow(local) >= 6) <> (dow IN (5, 6))",
    "TF-5": "SELECT count(*) FROM wide WHERE tz IS NOT NULL AND hour <> hour((reported_at AT TIME ZONE 'UTC') AT TIME ZONE tz)",
    "TF-6": "SELECT CASE WHEN count(*) FILTER (hour IS DISTINCT FROM hour_utc) > 0.9e0 * count(*) THEN 0 ELSE 1 END FROM wide",
    "SP-1": "SELECT 0", "SP-2": "SELECT 0",
    "SP-3": "SELECT count(*) FROM inc WHERE NOT coalesce(latitude BETWEEN -90 AND 90, true) OR NOT coalesce(longitude BETWEEN -180 AND 180, true)",
    "PR-1": "SELECT count(*) FROM wide WHERE band IS NULL",
    "PR-2": "SELECT CASE WHEN min(band) < max(band) THEN 0 ELSE 1 END FROM wide",
    "PR-3": "SELECT count(*) FROM wide WHERE NOT coalesce(score BETWEEN 0 AND 1, true)",
    "PR-4": """SELECT count(*) FROM wide WHERE NOT (confidence = CASE WHEN n_signals >= 8 AND coverage >= 0.7e0 THEN 'HIGH'
     WHEN n_signals >= 3 AND coverage >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END OR (score = 1 AND band = 'P1'))""",
    "PR-5": "SELECT count(*) FROM wide WHERE strategy IS NULL",
    "PR-6": "SELECT 0",
    "PR-7": "SELECT CASE WHEN avg(CASE WHEN a < b THEN 1e0 ELSE 0e0 END) > 0.5e0 THEN 0 ELSE 1 END FROM (SELECT min(score) AS a, max(score) AS b FROM wide GROUP BY category)",
    "TG-1": "SELECT 0", "TG-2": "SELECT 0", "TG-3": "SELECT 0",
    "TG-4": "SELECT count(*) FROM wide WHERE strategy IS NULL",
    "TG-5": "SELECT CASE WHEN count(resolution_hours) > 0 THEN 0 ELSE 1 END FROM inc",
    "TG-6": "SELECT count(*) FROM inc WHERE sla_target_hours IS NOT NULL AND source_dataset NOT IN ('src0', 'src1')",
    "LK-1": _in(PRIORITY_COLUMNS, T.POST_RESOLUTION),
    "LK-2": "SELECT count(*) FROM inc WHERE reported_at > TIMESTAMP '2020-01-01'",
    "LK-3": _in([c for c in ("incident_id", "source_dataset", *PREDICTORS, "split", *TARGETS, "place")], [c for c in T.POST_RESOLUTION if c not in TARGETS]),
    "LK-4": _in(PREDICTORS, [*TARGETS, "sla_breach", "sla_target_hours"]),
    "LK-5": f"SELECT count(*) FROM (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in PREDICTORS)}) n(c) WHERE starts_with(c, '{T.POLICY_PREFIX}')",
    "LK-6": _in(PREDICTORS, T.RAW_PLACES),
    "LK-7": _in(["incident_id", *PREDICTORS, *TARGETS], ["priority_target"]),
    "LK-8": "SELECT count(*) FROM inc WHERE reported_at > TIMESTAMP '2020-01-01'",
}


@register("chk9_pipeline_audit", with_(_as_checks(_PIPELINE), INC, _SIG, _PRI, _WIDE, _dens()))
def pipeline_audit(spark, d):
    """All rules on all rows. Sources without a zone have no local time, which TF-1 counts."""
    w = cut(wide(spark, d).select(
        "incident_id", "source_dataset", "city", "category", "subcategory", "latitude", "longitude", "reported_at", "local", "hour", "day_of_week", "month", "is_weekend", "is_night", "hour_utc", "tz",
        "band", "score", "coverage", "n_signals", "confidence", "strategy", "is_ground_truth", "resolution_hours", "sla_target_hours", "priority_label", "priority_label_source"))
    late = F.lit("2020-01-01").cast("timestamp")
    true, hour = F.lit(True), F.col("hour")
    again = F.hour(F.convert_timezone(F.lit("UTC"), F.col("tz"), F.col("reported_at").cast("timestamp_ntz")))
    tier = F.when((F.col("n_signals") >= 8) & (F.col("coverage") >= 0.7), "HIGH").when((F.col("n_signals") >= 3) & (F.col("coverage") >= 0.3), "MEDIUM").otherwise("LOW")
    layers = w.select(*[F.lit(None).cast("double").alias(c) for c in PLACES])  # what the null provider gives
    rows = A.checks(w, {
        "DS-4": F.col("source_dataset").isNotNull() & F.col("city").isNotNull(), "TF-1": F.col("reported_at").isNull() | hour.isNotNull(),
        "TF-2": F.coalesce(hour.between(0, 23) & F.col("day_of_week").between(0, 6) & F.col("month").between(1, 12), F.col("tz").isNull()),
        "TF-3": F.coalesce(F.col("is_night") == ~hour.between(6, 21), true), "TF-4": F.coalesce(F.col("is_weekend") == F.col("day_of_week").isin(5, 6), true),
        "TF-5": F.coalesce(hour == again, F.col("tz").isNull()),
        "SP-3": F.coalesce(F.col("latitude").between(-90, 90), true) & F.coalesce(F.col("longitude").between(-180, 180), true),
        "PR-1": F.col("band").isNotNull(), "PR-3": F.coalesce(F.col("score").between(0, 1), true),
        "PR-4": (F.col("confidence") == tier) | ((F.col("score") == 1) & (F.col("band") == "P1")), "PR-5": F.col("strategy").isNotNull(), "PR-6": ~F.col("is_ground_truth"),
        "TG-1": F.col("priority_label").isNull(), "TG-2": F.col("priority_label_source").isNull(), "TG-3": ~F.col("is_ground_truth"), "TG-4": F.col("strategy").isNotNull(),
        "TG-6": F.col("sla_target_hours").isNull() | F.col("source_dataset").isin("src0", "src1"), "LK-2": ~F.coalesce(F.col("reported_at") > late, F.lit(False)),
        "LK-8": ~F.coalesce(F.col("reported_at") > late, F.lit(False)),
    })
    whole = A.conditions(w, {
        "TF-6": F.count_if(~hour.eqNullSafe(F.col("hour_utc"))) > 0.9 * F.count("*"), "PR-2": F.min("band") < F.max("band"), "TG-5": F.count("resolution_hours") > 0,
    })
    moves = w.groupBy("category").agg((F.min("score") < F.max("score")).alias("moves"))
    ids = w.groupBy("incident_id").agg(F.count("*").alias("n"), F.min("source_dataset").alias("a"), F.max("source_dataset").alias("b"))
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    home = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    per = lambda df, side: df.groupBy("s").agg(F.count("*").alias(side))
    sizes = per(w.select(F.col("source_dataset").alias("s")), "a").join(per(home.select(F.concat(F.lit("src"), "n_regionkey").alias("s")), "b"), "s", "full")
    once = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    i = incidents(spark, d)
    ml = consolidated_table(spark, d).columns
    among = lambda names, bad: [x for x in names if x in bad]
    return A.stacked([
        rows, whole, A.conditions(moves, {"PR-7": F.avg(F.coalesce(F.col("moves"), F.lit(False)).cast("double")) > 0.5}),
        A.checks(sizes, {"DS-1": F.col("a").eqNullSafe(F.col("b"))}), A.checks(ids, {"DS-2": F.col("n") == 1, "DS-3": F.col("a") == F.col("b")}),
        A.checks(A.coverage(i, w, "incident_id"), {"DS-5/time": once}), A.checks(A.coverage(w, geo.historical_density(i), "incident_id"), {"DS-5/geo": once}),
        A.conditions(layers, {"SP-2": sum((F.count(x) for x in PLACES), F.lit(0)) == 0}),
        A.named(spark, {
            "SP-1": [x for x in PLACES if x not in layers.columns], "LK-1": among([x for x in PRIORITY_COLUMNS if x in w.columns], T.POST_RESOLUTION),
            "LK-3": [x for x in among(ml, T.POST_RESOLUTION) if x not in TARGETS], "LK-4": among(PREDICTORS, [*TARGETS, "sla_breach", "sla_target_hours"]),
            "LK-5": [x for x in PREDICTORS if x.startswith(T.POLICY_PREFIX)], "LK-6": among(PREDICTORS, T.RAW_PLACES), "LK-7": among(ml, ["priority_target"]),
        }),
    ])


# ---- integrity ----------------------------------------------------------------------------------------------------

_SCHEMA = [("incident_id", "string"), ("severity", "int"), ("occurred_at", "timestamp"), ("response_time_hours", "double"), ("priority_label", "string"), ("is_ground_truth", "boolean")]
_EMPTY = {
    "INT-1": "SELECT 0", "INT-2": "SELECT 0", "INT-3": "SELECT 0", "INT-4": "SELECT 0", "INT-4b": "SELECT 0",
    "INT-9b": "SELECT 0 FROM (SELECT count(*) FROM pos)",
}


@register("chk1_null_by_design", with_(_as_checks(_EMPTY), INC, _CS))
def null_by_design(spark, d):
    """Columns of the conformed tables that no source fills hold nothing: severity, occurrence, first response, labels, image likeness."""
    from wardline.operators.duplicates import positives
    from wardline.sources.schema import conform

    i = incidents(spark, d)
    c = conform(i, _SCHEMA)
    pairs = conform(positives(i), [("a", "string"), ("b", "string"), ("image_similarity", "double")])
    rows = A.checks(c, {
        "INT-1": F.col("severity").isNull(), "INT-2": F.col("occurred_at").isNull(), "INT-3": F.col("response_time_hours").isNull(),
        "INT-4": ~F.coalesce("is_ground_truth", F.lit(False)), "INT-4b": F.col("priority_label").isNull(),
    })
    return A.stacked([rows, A.checks(pairs, {"INT-9b": F.col("image_similarity").isNull()})])


# ---- density ------------------------------------------------------------------------------------------------------

_DN = {
    "DN-1": "SELECT count(*) FROM inc JOIN dens USING (incident_id) WHERE (latitude IS NULL) <> (n_24h IS NULL)",
    "DN-2": "SELECT count(*) FROM dens WHERE n_24h > n_7d OR n_7d > n_30d",
    "DN-3": "SELECT count(*) FROM dens WHERE n_30d > all_30d",
    "DN-4": "SELECT count(*) FROM dens WHERE NOT coalesce(share_same BETWEEN 0 AND 1, true)",
    "DN-5": "SELECT CASE WHEN count(all_30d) < 5000 OR count(DISTINCT all_30d) > 10 THEN 0 ELSE 1 END FROM dens",
    "DN-6": "SELECT count(*) FROM again WHERE s_24h <> n_24h OR s_7d <> n_7d OR s_30d <> n_30d OR s_all <> all_30d",
    "DN-7": "SELECT count(*) FROM again WHERE n_30d > s_30d + f_30d OR all_30d > s_all + f_all",
    "DN-8": "SELECT count(*) FROM dens WHERE NOT coalesce(hours_since BETWEEN 0 AND 720, true)",
    "DN-9": "SELECT count(*) FROM dens WHERE coalesce(all_30d > 0, false) <> (hours_since IS NOT NULL)",
}
#: Incidents that are counted again, by the least hashes of their ids: a sample is what these two rules are about.
AGAIN = 200
_BACK = "e.reported_at < q.reported_at AND e.reported_at >= q.reported_at - INTERVAL"
_AGAIN = f"""again AS MATERIALIZED (SELECT d.*, s.* EXCLUDE (incident_id) FROM dens d JOIN (SELECT q.incident_id,
 count(*) FILTER ({_BACK} 24 HOUR AND e.category = q.category) AS s_24h, count(*) FILTER ({_BACK} 168 HOUR AND e.category = q.category) AS s_7d,
 count(*) FILTER ({_BACK} 720 HOUR AND e.category = q.category) AS s_30d, count(*) FILTER ({_BACK} 720 HOUR) AS s_all,
 count(*) FILTER (e.reported_at > q.reported_at AND e.category = q.category) AS f_30d, count(*) FILTER (e.reported_at > q.reported_at) AS f_all
 FROM (SELECT * FROM inc WHERE latitude IS NOT NULL ORDER BY md5(incident_id) LIMIT {AGAIN}) q JOIN inc e ON e.latitude IS NOT NULL AND {_HAV} <= 250
  AND e.reported_at >= q.reported_at - INTERVAL 720 HOUR AND e.reported_at <= q.reported_at + INTERVAL 720 HOUR GROUP BY 1) s USING (incident_id))"""


@register("chk4_density_rules", with_(_as_checks(_DN), INC, _dens(), _AGAIN))
def density_rules(spark, d):
    """Density and recency of all rows, and every count of a sample again by plain distances: those rows are of a fixed number, and meet the
    incidents of their lines of latitude and spans of time."""
    i = cut(incidents(spark, d).select("incident_id", "category", "latitude", "longitude", "reported_at"))
    dens = cut(geo.historical_density(i))
    f, true = F.lit(False), F.lit(True)
    rows = A.checks(dens, {
        "DN-2": F.coalesce((F.col("n_24h") <= F.col("n_7d")) & (F.col("n_7d") <= F.col("n_30d")), true), "DN-3": F.coalesce(F.col("n_30d") <= F.col("all_30d"), true),
        "DN-4": F.coalesce(F.col("share_same").between(0, 1), true), "DN-8": F.coalesce(F.col("hours_since").between(0, 720), true),
        "DN-9": F.coalesce(F.col("all_30d") > 0, f) == F.col("hours_since").isNotNull(),
    })
    # Distinct densities are counted by grouping first: the distinct values of a count are few.
    kinds = dens.where("all_30d IS NOT NULL").groupBy("all_30d").agg(F.count("*").alias("n"))
    varied = A.conditions(kinds, {"DN-5": F.coalesce(F.sum("n") < 5000, true) | (F.count("*") > 10)})
    placed = A.checks(i.select("incident_id", "latitude").join(dens, "incident_id"), {"DN-1": F.col("latitude").isNull() == F.col("n_24h").isNull()})
    at = i.where("latitude IS NOT NULL")
    counted = geo.counted_again(at, at.orderBy(F.md5("incident_id")).limit(AGAIN))
    again = dens.join(F.broadcast(counted), "incident_id")  # a row for each of AGAIN
    same = [F.col(a) == F.col(b) for a, b in (("s_24h", "n_24h"), ("s_7d", "n_7d"), ("s_30d", "n_30d"), ("s_all", "all_30d"))]
    fits = (F.col("n_30d") <= F.col("s_30d") + F.col("f_30d")) & (F.col("all_30d") <= F.col("s_all") + F.col("f_all"))
    return A.stacked([rows, varied, placed, A.checks(again, {"DN-6": same[0] & same[1] & same[2] & same[3], "DN-7": fits})])


# ---- tasks --------------------------------------------------------------------------------------------------------

_NOW, _BEFORE = "at intake", "from earlier reports"
TASKS = {
    "resolution": T.Task(
        "resolution", {"category": _NOW, "city": _NOW, "subcategory": _NOW, "month": _NOW, "hour_utc": _NOW, "n_7d": _BEFORE, "n_30d": _BEFORE, "hours_since": _BEFORE},
        "resolution_hours", ["category", "city", "subcategory"], ["month", "hour_utc", "n_7d", "n_30d", "hours_since"], ["subcategory"], "source_dataset", "reported_at", ["incident_id"]),
    "sla": T.Task(
        "sla", {"category": _NOW, "city": _NOW, "subcategory": _NOW, "month": _NOW, "sla_target_hours": "set at intake"}, "breached", ["category", "city", "subcategory"],
        ["month", "sla_target_hours"], ["subcategory", "sla_target_hours"], "source_dataset", "reported_at", ["incident_id"], ["sla_target_hours"]),
    "hotspot": T.Task(
        "hotspot", {"zone_key": _NOW, "category": _NOW, "incident_count": _NOW, "previous_period_count": _BEFORE, "rolling_4w_count": _BEFORE, "month": _NOW, "week_of_year": _NOW},
        "future_incident_count", ["zone_key", "category", "city"], ["incident_count", "previous_period_count", "month", "week_of_year"], ["zone_key"]),
    "duplicate": T.Task(
        "duplicate", {"distance_meters": _NOW, "time_difference_hours": _NOW, "category_match": _NOW}, "same_incident", [], [], [], None, None, ["incident_a", "incident_b"]),
}
_HIST = ["n_7d", "n_30d", "hours_since"]
_TASK_TABLES = f"""t_resolution AS MATERIALIZED (SELECT s.incident_id, s.source_dataset, category, city, subcategory, month(reported_at) AS month, hour(reported_at) AS hour_utc, n_7d, n_30d, hours_since,
  resolution_hours, split, reported_at FROM sp s JOIN dens USING (incident_id) WHERE resolution_hours IS NOT NULL),
t_sla AS MATERIALIZED (SELECT incident_id, source_dataset, category, city, subcategory, month(reported_at) AS month, sla_target_hours, NOT sla_met AS breached, split, reported_at FROM sp WHERE sla_met IS NOT NULL),
t_hotspot AS MATERIALIZED ({ORACLE['prj29_hotspot_task']}), t_duplicate AS MATERIALIZED ({ORACLE['prj30_duplicate_task']})"""
_TASK_COLUMNS = {
    "resolution": ["incident_id", "source_dataset", "category", "city", "subcategory", "month", "hour_utc", *_HIST, "resolution_hours", "split", "reported_at"],
    "sla": ["incident_id", "source_dataset", "category", "city", "subcategory", "month", "sla_target_hours", "breached", "split", "reported_at"],
    "hotspot": ["city", "zone_key", "zone_id", "category", "week", "month", "year", "week_of_year", "incident_count", "previous_period_count", "rolling_4w_count", "rolling_4w_mean", "trend_4w", "future_incident_count", "future_incident_flag"],
    "duplicate": ["incident_a", "incident_b", "distance_meters", "time_difference_hours", "category_match", "same_incident", "negative_strategy", "source_dataset", "split"],
}


def _task_sql(t: T.Task) -> dict[str, str]:
    """The rules of one task in SQL, over lists of its columns and over its table."""
    tab, p = f"t_{t.name}", list(t.known)
    lists = lambda rows, cond: f"SELECT count(*) FROM (VALUES {', '.join(rows)}) n(c) WHERE {cond}"
    names = [f"('{c}')" for c in p]
    inside = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    out = {
        "TASK-1": lists(names, f"c NOT IN {inside(_TASK_COLUMNS[t.name])}"), "TASK-3": "SELECT 0",
        "TL-1": lists(names, f"starts_with(c, '{t.target}')"), "TL-2": lists(names, f"c IN {inside(T.POST_RESOLUTION)}"),
        "TL-3": lists(names, f"starts_with(c, '{T.POLICY_PREFIX}') OR c IN {inside(T.POLICY_OUTPUT)}"), "TL-4": lists(names, f"c IN {inside(T.RAW_PLACES)}"),
        "TL-5a": lists(names, " OR ".join(f"contains(c, '{m}')" for m in T.ENCODING_MARKS)), "TL-6": lists([f"('{w}')" for w in t.known.values()], "c = ''"),
        "TL-10": lists(names, f"c IN {inside(T.SOURCE_SPECIFIC)} AND c NOT IN {inside([*t.caveats, ''])}"),
        "TL-12": lists(names, f"c = 'sla_target_hours' AND c NOT IN {inside([*t.late_targets, ''])}"),
        "TASK-2": f"SELECT {' + '.join(f'CASE WHEN min({c}) < max({c}) THEN 0 ELSE 1 END' for c in p)} FROM {tab}",
        "TASK-4": f"SELECT CASE WHEN count({t.target}) > 0 THEN 0 ELSE 1 END FROM {tab}",
    }
    if t.levels:
        one = "(SELECT CASE WHEN count(*) > 3 AND count(*) FILTER (a <> b) = 0 AND count(DISTINCT a) >= 0.9e0 * count(*) THEN 1 ELSE 0 END FROM (SELECT min({n}) AS a, max({n}) AS b FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}))"
        out["TL-5"] = "SELECT " + " + ".join(one.format(n=n, c=c, t=tab) for c in t.levels for n in t.numbers)
    if "split" in _TASK_COLUMNS[t.name]:
        out["TL-11"] = f"SELECT CASE WHEN count(*) FILTER (split IN ('train', 'val', 'test')) > 0 THEN 0 ELSE 1 END FROM {tab}"
        out |= {f"TL-11/{s}": f"SELECT CASE WHEN count(*) FILTER (split = '{s}') > 0 THEN 0 ELSE 1 END FROM {tab}" for s in ("train", "val", "test")}
        ends = " UNION ALL ".join(f"SELECT {c} AS e, split FROM {tab}" for c in t.ends)
        out["TL-8"] = f"SELECT count(*) FROM (SELECT e FROM ({ends}) GROUP BY e HAVING count(DISTINCT split) > 1)"
    if t.group:
        at = lambda f, s: f"{f}(CASE WHEN split = '{s}' THEN {t.time} END)"
        out["TL-11b"] = f"""SELECT count(*) FROM (SELECT {at('max', 'train')} AS a, {at('min', 'val')} AS b, {at('max', 'val')} AS c, {at('min', 'test')} AS d FROM {tab} GROUP BY {t.group})
         WHERE a > b OR c > d"""
    return out


_TASK_RULES = {f"{n}|{k}": x for n, t in TASKS.items() for k, x in _task_sql(t).items()} | {
    "resolution|TL-7": f"SELECT count(*) FROM t_resolution t LEFT JOIN dens d USING (incident_id) WHERE {' OR '.join(f't.{c} IS DISTINCT FROM d.{c}' for c in _HIST)}",
    "hotspot|TL-9": "SELECT count(*) FROM (SELECT CAST(week AS DATE) - lag(CAST(week AS DATE)) OVER (PARTITION BY city, zone_id, category ORDER BY week) AS gap FROM t_hotspot) WHERE gap <> 7",
    "hotspot|TL-9b": "SELECT CASE WHEN count(*) FILTER (future_incident_count = 0) > 0 THEN 0 ELSE 1 END FROM t_hotspot",
    "hotspot|TL-9c": "SELECT CASE WHEN bool_or(future_incident_flag) AND NOT bool_and(future_incident_flag) THEN 0 ELSE 1 END FROM t_hotspot",
}


@register("chk10_task_rules", with_(
    f"SELECT split_part(check_id, '|', 1) AS task, split_part(check_id, '|', 2) AS check_id, status, bad FROM ({_as_checks(_TASK_RULES)})", INC, _SPLIT, _dens(), _TASK_TABLES))
def task_rules(spark, d):
    """The four task tables against their manifests."""
    dens = cut(geo.historical_density(incidents(spark, d)).select("incident_id", *_HIST))
    s = splits(spark, d).withColumns({"month": F.month("reported_at"), "hour_utc": F.hour("reported_at"), "breached": ~F.col("sla_met")})
    s = cut(s.where("resolution_hours IS NOT NULL OR sla_met IS NOT NULL").select(*dict.fromkeys([*(c for c in _TASK_COLUMNS["resolution"] if c not in _HIST), *_TASK_COLUMNS["sla"]])))
    made = {
        "resolution": s.where("resolution_hours IS NOT NULL").join(dens, "incident_id").select(*_TASK_COLUMNS["resolution"]),
        "sla": s.where("breached IS NOT NULL").select(*_TASK_COLUMNS["sla"]),
        "hotspot": hotspot_task(spark, d), "duplicate": duplicate_task(spark, d),
    }
    made = {n: cut(df) for n, df in made.items()}
    hot = made["hotspot"].withColumn("_gap", F.date_diff(F.to_date("week"), F.lag(F.to_date("week")).over(P._series(["city", "zone_id", "category"]))))
    flag = F.col("future_incident_flag")
    calendar = A.stacked([
        A.checks(hot, {"TL-9": F.coalesce(F.col("_gap") == 7, F.lit(True))}),
        A.conditions(hot, {"TL-9b": F.count_if(F.col("future_incident_count") == 0) > 0, "TL-9c": F.bool_or(flag) & ~F.bool_and(flag)}),
    ])
    as_task = lambda df, n: df.select(F.lit(n).alias("task"), "check_id", "status", "bad")
    joined = as_task(T.agrees(made["resolution"], dens, "incident_id", _HIST), "resolution")
    return A.stacked([*[T.audit(made[n], t) for n, t in TASKS.items()], joined, as_task(calendar, "hotspot")])


# ---- outputs ------------------------------------------------------------------------------------------------------

_OUT = {
    "OUT-1/hotspot": "SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM t_hotspot", "OUT-1/resolution": "SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM t_resolution",
    "OUT-1/duplicate": "SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM t_duplicate", "OUT-1/priority": "SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM pri",
    "OUT-4b": "SELECT CASE WHEN count(*) FILTER (same_incident) > 0 AND count(*) FILTER (NOT same_incident) > 0 THEN 0 ELSE 1 END FROM t_duplicate",
    "OUT-7": "SELECT count(*) FROM t_resolution WHERE NOT coalesce(resolution_hours >= 0, false)", "OUT-7b": _in(_TASK_COLUMNS["resolution"], ["sla_met"]),
    "OUT-8": "SELECT 0", "OUT-8b": "SELECT 0", "OUT-8c": "SELECT CASE WHEN count(n_30d) > 0 THEN 0 ELSE 1 END FROM dens",
    "OUT-10": """SELECT count(*) FROM (SELECT previous_period_count AS p, lag(incident_count) OVER (PARTITION BY city, zone_id, category ORDER BY week) AS l,
     row_number() OVER (PARTITION BY city, zone_id, category ORDER BY week) AS n FROM t_hotspot) WHERE p IS DISTINCT FROM l""",
}


@register("chk7_output_rules", with_(_as_checks(_OUT), INC, _SPLIT, _SIG, _PRI, _dens(), _TASK_TABLES))
def output_rules(spark, d):
    """The tables that the pipeline gives: none is empty, targets are whole, derived targets and outer layers are left out, lags are lags."""
    from wardline.plans.tables import prioritised

    dens = cut(geo.historical_density(incidents(spark, d)).select("incident_id", *_HIST))
    res = splits(spark, d).where("resolution_hours IS NOT NULL").withColumns({"month": F.month("reported_at"), "hour_utc": F.hour("reported_at")})
    res = res.join(dens, "incident_id").select(*_TASK_COLUMNS["resolution"])
    dup, pri, hot = duplicate_task(spark, d), prioritised(spark, d), cut(hotspot_task(spark, d))
    some = lambda n: {f"OUT-1/{n}": F.count("*") > 0}
    lag = F.lag("incident_count").over(P._series(["city", "zone_id", "category"]))
    layers = pri.select(*[F.lit(None).cast("double").alias(c) for c in PLACES], "is_ground_truth")
    return A.stacked([
        A.conditions(dup, some("duplicate") | {"OUT-4b": (F.count_if("same_incident") > 0) & (F.count_if(~F.col("same_incident")) > 0)}),
        A.checks(res, {"OUT-7": F.col("resolution_hours") >= 0}, some("resolution")), A.named(spark, {"OUT-7b": [c for c in res.columns if c == "sla_met"]}),
        A.checks(layers, {"OUT-8": ~F.col("is_ground_truth")}, some("priority") | {"OUT-8b": sum((F.count(x) for x in PLACES), F.lit(0)) == 0}),
        A.conditions(dens, {"OUT-8c": F.count("n_30d") > 0}),
        A.checks(hot.withColumn("_l", lag), {"OUT-10": F.col("previous_period_count").eqNullSafe(F.col("_l"))}, some("hotspot")),
    ])


# ---- mapping ------------------------------------------------------------------------------------------------------

SENTINELS = ["UNMAPPED", "OUT_OF_SCOPE"]
CANONICAL = [*IN_SCOPE, "FALLEN_TREE"]
_TRUST = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}
_DIM = f"""dim AS (SELECT source_dataset, source_category_raw AS source_category, any_value(coalesce(m.cat, 'UNMAPPED')) AS category,
 any_value(CASE source_category_raw {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TRUST.items())} ELSE 'none' END) AS confidence,
 any_value(CASE WHEN source_category_raw = '5-LOW' AND rk < 3 THEN 'please review' ELSE '' END) AS notes FROM inc LEFT JOIN cmap m ON m.raw = source_category_raw GROUP BY 1, 2)"""
_MAP = {
    "MAP-1": f"SELECT count(*) FROM dim WHERE category NOT IN {(*CANONICAL, *SENTINELS)}",
    "MAP-2": "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM dim GROUP BY source_dataset, source_category HAVING count(*) > 1)",
    "MAP-3": "SELECT count(*) FROM dim WHERE confidence NOT IN ('high', 'medium', 'low', 'none', '')",
    "MAP-4": f"SELECT count(*) FROM dim WHERE confidence IN ('low', 'none') AND category NOT IN {tuple(SENTINELS)} AND NOT contains(upper(notes), 'REVIEW')",
    "MAP-5": "SELECT count(*) FROM dim WHERE source_category = '5-LOW' AND category = 'OPEN_MANHOLE'",
    "MAP-6": f"SELECT count(*) FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in CANONICAL)}) n(c) WHERE c NOT IN (SELECT category FROM dim)",
}


def dimension(spark, d) -> DataFrame:
    """The mapping by source and raw value as the sources use it, with the map's trust and notes."""
    from wardline.plans.base import CATEGORY_MAP

    one = lambda pairs: F.create_map(*[F.lit(x) for p in pairs for x in p])[F.col("source_category")]
    used = incidents(spark, d).select("source_dataset", F.col("source_category_raw").alias("source_category"), "rk").distinct()
    note = F.when((F.col("source_category") == "5-LOW") & (F.col("rk") < 3), "please review").otherwise("")
    return used.select(
        "source_dataset", "source_category", F.coalesce(one(CATEGORY_MAP), F.lit("UNMAPPED")).alias("category"), F.coalesce(one(_TRUST.items()), F.lit("none")).alias("confidence"), note.alias("notes"))


@register("ag37_mapping_rules", with_(f"SELECT check_id, CASE WHEN check_id = 'MAP-6' AND bad > 0 THEN 'COVERAGE_GAP' ELSE status END AS status, bad FROM ({_as_checks(_MAP)})", INC, _DIM))
def mapping_rules(spark, d):
    from wardline.operators.mapping import audit

    return audit(dimension(spark, d), CANONICAL, SENTINELS, [("5-LOW", "OPEN_MANHOLE")])


@register("ag37_coverage", with_(f"""SELECT c AS category, count(i.incident_id) AS n_rows, CASE WHEN n_rows = 0 THEN 'NONE' WHEN n_rows < 100 THEN 'WEAK' ELSE 'COVERED' END AS coverage
FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in CANONICAL)}) n(c) LEFT JOIN inc i ON i.category = c GROUP BY 1""", INC))  # fmt: skip
def canonical_coverage(spark, d):
    """Rows seen of each canonical category: categories without any row, and those of under 100."""
    named = spark.createDataFrame([(c,) for c in CANONICAL], "category string")
    n = incidents(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    rows = F.coalesce("n", F.lit(0))
    return named.join(n, "category", "left").select("category", rows.alias("n_rows"), F.when(rows == 0, "NONE").when(rows < 100, "WEAK").otherwise("COVERED").alias("coverage"))
