"""Queries of the city feeds, on feeds derived from the provided tables, and of the remaining task tables and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wardline.operators import audit as A
from wardline.operators import metrics as M
from wardline.plans.base import CATEGORY_MAP, IN_SCOPE, INC, incidents, register, table, with_
from wardline.plans.evaluation import _SPLIT, splits
from wardline.sources.cities import canonical_feed

_OUT = "incident_id, description, status, channel, image_url, is_duplicate, parent_id, source_category_raw, due_raw"
_PICK = ["incident_id", "description", "status", "channel", "image_url", "is_duplicate", "parent_id", "source_category_raw", "due_raw"]


@register("prj2_sf_feed", "SELECT 'sf311:' || doc_id AS incident_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'D' || doc_id END AS description, CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'closed' END AS status, 'mobile' AS channel, CASE WHEN doc_id % 3 = 0 THEN 'http://x/' || doc_id END AS image_url, doc_id % 23 = 0 AS is_duplicate, CAST(NULL AS VARCHAR) AS parent_id, source AS source_category_raw, CAST(NULL AS VARCHAR) AS due_raw FROM documents")
def sf_feed(spark, d):
    raw = table(spark, d, "documents").selectExpr(
        "concat(' ', doc_id) AS `CaseID`", "source AS Category", "IF(doc_id % 4 = 0, 'N/A', concat('<b>D', doc_id, '</b>')) AS `Request Details`", "IF(doc_id % 2 = 0, 'Open', 'Closed') AS Status", "'Mobile Device' AS Source",
        "IF(doc_id % 3 = 0, concat('{\"url\": \"http://x/', doc_id, '\"}'), '') AS `Media URL`", "IF(doc_id % 23 = 0, 'Case is a Duplicate of 1', NULL) AS `Status Notes`",
    )
    return canonical_feed(raw, "sf311").select(*_PICK)


@register("prj3_chicago_feed", "SELECT 'chicago311:' || o_orderkey AS incident_id, CAST(NULL AS VARCHAR) AS description, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, 'phone' AS channel, CAST(NULL AS VARCHAR) AS image_url, o_orderkey % 7 = 0 AS is_duplicate, CASE WHEN o_orderkey % 7 = 0 THEN 'chicago311:' || (o_orderkey - 7) END AS parent_id, o_orderpriority AS source_category_raw, CAST(NULL AS VARCHAR) AS due_raw FROM orders")
def chicago_feed(spark, d):
    raw = table(spark, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS SR_NUMBER", "o_orderpriority AS SR_TYPE", "IF(o_orderstatus = 'F', 'Completed', 'Open') AS STATUS", "'phone call' AS X", "'Phone' AS ORIGIN", "IF(o_orderkey % 7 = 0, 'true', 'false') AS DUPLICATE", "IF(o_orderkey % 7 = 0, CAST(o_orderkey - 7 AS STRING), ' ') AS PARENT_SR_NUMBER")
    return canonical_feed(raw, "chicago311").select(*_PICK)


@register("prj4_nyc_feed", "SELECT 'nyc311:' || event_id AS incident_id, 'done' AS description, 'closed' AS status, 'web' AS channel, CAST(NULL AS VARCHAR) AS image_url, false AS is_duplicate, CAST(NULL AS VARCHAR) AS parent_id, event_type AS source_category_raw, CASE WHEN event_id % 3 <> 0 THEN 'soon' END AS due_raw FROM events")
def nyc_feed(spark, d):
    raw = table(spark, d, "events").selectExpr("CAST(event_id AS STRING) AS `Unique Key`", "event_type AS Problem", "' done&nbsp;' AS `Resolution Description`", "'Closed' AS status", "'ONLINE' AS open_data_channel_type", "IF(event_id % 3 = 0, '', 'soon') AS `Due Date`")
    return canonical_feed(raw, "nyc311").select(*_PICK)


@register("prj5_boston_feed", "SELECT 'boston311:' || p_partkey AS incident_id, CASE p_partkey % 3 WHEN 0 THEN p_name || '. fixed' WHEN 1 THEN p_name ELSE 'fixed' END AS description, 'open' AS status, 'other' AS channel, 'http://y' AS image_url, false AS is_duplicate, CAST(NULL AS VARCHAR) AS parent_id, p_type AS source_category_raw, CAST(NULL AS VARCHAR) AS due_raw FROM part")
def boston_feed(spark, d):
    raw = table(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS CASE_ENQUIRY_ID", "IF(p_partkey % 3 = 2, NULL, p_name) AS CASE_TITLE", "IF(p_partkey % 3 = 1, ' ', 'fixed') AS CLOSURE_REASON", "'Open' AS CASE_STATUS", "'Fax' AS source", "' http://y ' AS SubmittedPhoto", "p_type AS REASON", "'' AS TARGET_DT")
    return canonical_feed(raw, "boston311").select(*_PICK)


@register("ag37_mapping_validation", with_("SELECT t.cat AS category, count(DISTINCT t.raw) AS n_rules, coalesce(max(c.n), 0) AS n_rows, t.cat IN ('OPEN_MANHOLE', 'TRAFFIC_SIGNAL_FAULT', 'POTHOLE', 'GARBAGE_DUMPING') AS canonical FROM cmap t LEFT JOIN (SELECT category, count(*) AS n FROM inc GROUP BY 1) c ON c.category = t.cat GROUP BY t.cat", INC))
def mapping_validation(spark, d):
    rules = spark.createDataFrame(CATEGORY_MAP, "raw string, category string").groupBy("category").agg(F.count_distinct("raw").alias("n_rules"))
    rows = incidents(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    return rules.join(rows, "category", "left").select("category", "n_rules", F.coalesce("n", F.lit(0)).alias("n_rows"), F.col("category").isin(IN_SCOPE).alias("canonical"))


@register("ag40_fold_summary", with_("SELECT predictor, round(avg(mae), 4) AS mean_mae, bool_and(mae < 1200) AS gate FROM (SELECT city, 'constant' AS predictor, round(avg(abs(resolution_hours - 900)), 4) AS mae FROM inc WHERE resolution_hours IS NOT NULL GROUP BY city UNION ALL SELECT city, 'zero', round(avg(resolution_hours), 4) FROM inc WHERE resolution_hours IS NOT NULL GROUP BY city) GROUP BY predictor", INC))
def fold_summary(spark, d):
    h = F.col("resolution_hours")
    g = incidents(spark, d).where(h.isNotNull()).groupBy("city").agg(F.round(F.avg(F.abs(h - 900)), 4).alias("constant"), F.round(F.avg(h), 4).alias("zero"))
    return g.unpivot("city", ["constant", "zero"], "predictor", "mae").groupBy("predictor").agg(F.round(F.avg("mae"), 4).alias("mean_mae"), F.bool_and(F.col("mae") < 1200).alias("gate"))


_TT = "tr AS (SELECT * FROM sp WHERE split = 'train' AND resolution_hours IS NOT NULL), te AS (SELECT * FROM sp WHERE split = 'test' AND resolution_hours IS NOT NULL)"


@register("ag46_composite_baselines", with_("SELECT 'log_mean' AS baseline, round((SELECT exp(avg(ln(1 + resolution_hours))) - 1 FROM tr), 4) AS value, round(avg(abs(resolution_hours - (SELECT exp(avg(ln(1 + resolution_hours))) - 1 FROM tr))), 4) AS mae FROM te", INC, _SPLIT, _TT))
def composite_baselines(spark, d):
    df = splits(spark, d).where("resolution_hours IS NOT NULL")
    v = df.where("split = 'train'").agg(F.expm1(F.avg(F.log1p("resolution_hours"))).alias("value"))
    return df.where("split = 'test'").crossJoin(F.broadcast(v)).agg(F.lit("log_mean").alias("baseline"), F.round(F.max("value"), 4).alias("value"), F.round(F.avg(F.abs(F.col("resolution_hours") - F.col("value"))), 4).alias("mae"))  # one row


@register("ag48_beats_baseline", with_("SELECT round(avg(CASE WHEN abs(resolution_hours - m) < abs(resolution_hours - 900) THEN 1e0 ELSE 0e0 END), 6) AS beats, round(avg(CASE WHEN abs(resolution_hours - m) = abs(resolution_hours - 900) THEN 1e0 ELSE 0e0 END), 6) AS ties, count(*) AS n FROM te LEFT JOIN (SELECT category, median(resolution_hours) AS m FROM tr GROUP BY 1) USING (category)", INC, _SPLIT, _TT))
def beats_baseline(spark, d):
    df = splits(spark, d).where("resolution_hours IS NOT NULL")
    p = M.lookup_prediction(df.where("split = 'train'"), df.where("split = 'test'"), ["category"], "resolution_hours")
    a, b = F.abs(F.col("resolution_hours") - F.col("p")), F.abs(F.col("resolution_hours") - 900)
    return p.agg(F.round(F.avg((a < b).cast("double")), 6).alias("beats"), F.round(F.avg((a == b).cast("double")), 6).alias("ties"), F.count("*").alias("n"))


@register("fc5_sla_baselines", with_("SELECT baseline, round(avg(pow(p - y, 2)), 6) AS brier, count(*) AS n FROM (SELECT 'base_rate' AS baseline, CAST(NOT sla_met AS INT) AS y, (SELECT avg(CAST(NOT sla_met AS INT)) FROM sp WHERE split = 'train' AND sla_met IS NOT NULL) AS p FROM sp WHERE split = 'test' AND sla_met IS NOT NULL UNION ALL SELECT 'category', CAST(NOT sla_met AS INT), coalesce(m, (SELECT avg(CAST(NOT sla_met AS INT)) FROM sp WHERE split = 'train' AND sla_met IS NOT NULL)) FROM sp LEFT JOIN (SELECT category, avg(CAST(NOT sla_met AS INT)) AS m FROM sp WHERE split = 'train' AND sla_met IS NOT NULL GROUP BY 1) USING (category) WHERE split = 'test' AND sla_met IS NOT NULL) GROUP BY 1", INC, _SPLIT))
def sla_baselines(spark, d):
    df = splits(spark, d).where("sla_met IS NOT NULL").withColumn("y", (~F.col("sla_met")).cast("int")).withColumn("all", F.lit(1))
    parts = [M.lookup_prediction(df.where("split = 'train'"), df.where("split = 'test'"), [k], "y", "mean").select(F.lit(n).alias("baseline"), "y", "p") for n, k in (("base_rate", "all"), ("category", "category"))]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("baseline").agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"), F.count("*").alias("n"))


@register("ag32_chk11_drift_findings", with_("SELECT 'zone_id' AS predictor, tv, CASE WHEN tv > 0.2 THEN 'danger' WHEN tv > 0.1 THEN 'prep' ELSE 'safe' END AS severity FROM (SELECT round(sum(abs(a - b)) / 2, 6) AS tv FROM (SELECT zone_id, count(*) FILTER (split = 'train') * 1e0 / (SELECT count(*) FROM sp WHERE split = 'train') AS a, count(*) FILTER (split <> 'train') * 1e0 / (SELECT count(*) FROM sp WHERE split <> 'train') AS b FROM sp GROUP BY 1)) UNION ALL SELECT 'category', tv, CASE WHEN tv > 0.2 THEN 'danger' WHEN tv > 0.1 THEN 'prep' ELSE 'safe' END FROM (SELECT round(sum(abs(a - b)) / 2, 6) AS tv FROM (SELECT category, count(*) FILTER (split = 'train') * 1e0 / (SELECT count(*) FROM sp WHERE split = 'train') AS a, count(*) FILTER (split <> 'train') * 1e0 / (SELECT count(*) FROM sp WHERE split <> 'train') AS b FROM sp GROUP BY 1))", INC, _SPLIT))
def drift_findings(spark, d):
    df = splits(spark, d)
    parts = [M.tv_distance(df, c, F.col("split") == "train").select(F.lit(c).alias("predictor"), "tv") for c in ("zone_id", "category")]
    return A.stacked(parts).withColumn("severity", F.when(F.col("tv") > 0.2, "danger").when(F.col("tv") > 0.1, "prep").otherwise("safe"))


@register("st3_st5_entities", with_("SELECT entity, count(*) AS n_pairs FROM (SELECT c.incident_id AS entity FROM inc c JOIN inc p ON p.k = c.parent_key WHERE c.is_duplicate UNION ALL SELECT p.incident_id FROM inc c JOIN inc p ON p.k = c.parent_key WHERE c.is_duplicate) GROUP BY 1", INC))
def entities(spark, d):
    from wardline.operators.duplicates import positives

    p = positives(incidents(spark, d))
    return p.select(F.col("a").alias("entity")).unionByName(p.select(F.col("b").alias("entity"))).groupBy("entity").agg(F.count("*").alias("n_pairs"))


@register("chk7_output_validation", with_("SELECT check_id, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(bad AS BIGINT) AS bad FROM (SELECT 'split_known' AS check_id, count(*) FILTER (split NOT IN ('train', 'val', 'test')) AS bad FROM sp UNION ALL SELECT 'target_positive', count(*) FILTER (NOT coalesce(resolution_hours > 0, true)) FROM sp UNION ALL SELECT 'category_known', count(*) FILTER (category = 'UNMAPPED') FROM sp)", INC, _SPLIT))
def output_validation(spark, d):
    return A.checks(splits(spark, d), {"split_known": F.col("split").isin("train", "val", "test"), "target_positive": F.coalesce(F.col("resolution_hours") > 0, F.lit(True)), "category_known": F.col("category") != "UNMAPPED"})
