"""Queries of event logs, logs and backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import workflow as W
from wardline.plans.base import INC, incidents, register, table, with_

_EV = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events), s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS previous FROM e)"
_OK = ", ".join(f"('{a}', '{b}')" for a, b in W.TRANSITIONS)


def log(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@register("ev1_transition_validity", with_(f"SELECT event_id, previous, event_type FROM s WHERE previous IS NOT NULL AND previous <> event_type AND (previous, event_type) NOT IN ({_OK})", _EV))
def transition_validity(spark, d):
    return W.invalid_transitions(log(spark, d), "user_id", "event_type", ["us", "event_id"]).select("event_id", "previous", "event_type")


@register("ev2_event_types", with_("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_type = 'purchase' THEN 'milestone' WHEN previous = 'purchase' THEN 'reopened' WHEN previous <> event_type THEN 'status_changed' ELSE 'noted' END AS kind FROM s) GROUP BY 1", _EV))
def event_types(spark, d):
    return W.event_types(log(spark, d), "user_id", "event_type", ["us", "event_id"], ["purchase"], ["purchase"]).groupBy("kind").agg(F.count("*").alias("n"))


@register("ev3_current_state", with_("SELECT user_id, arg_max(event_type, us * 1000000 + event_id) AS state, count(*) AS n_events FROM (SELECT user_id, event_type, us - (SELECT min(us) FROM e) AS us, event_id FROM e) GROUP BY 1", _EV))
def current_state(spark, d):
    return W.current_state(log(spark, d), "user_id", "event_type", ["us", "event_id"])


@register("ev4_fan_out", "WITH ch AS (SELECT c_custkey AS agent, c_custkey % 3 AS seq, c_custkey % 2 = 0 AS available FROM customer UNION ALL SELECT c_custkey, 10, c_custkey % 4 = 0 FROM customer), r AS (SELECT *, lag(available) OVER (PARTITION BY agent ORDER BY seq) AS was FROM ch) SELECT agent, o_orderkey, available FROM r JOIN orders ON o_custkey = agent AND o_orderstatus = 'O' WHERE was IS NULL OR was <> available")
def fan_out(spark, d):
    c = table(spark, d, "customer")
    ch = c.selectExpr("c_custkey AS agent", "c_custkey % 3 AS seq", "c_custkey % 2 = 0 AS available").union(c.selectExpr("c_custkey", "CAST(10 AS BIGINT)", "c_custkey % 4 = 0"))
    open_ = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("agent"), "o_orderkey")
    return W.fan_out(ch, open_, "agent").select("agent", "o_orderkey", "available")


@register("snk5_idempotent_log", with_("SELECT count(*) AS n_new, count(DISTINCT dedupe_key) AS n_keys FROM (SELECT DISTINCT incident_id, concat_ws('|', 'sla', category, status) AS dedupe_key FROM inc WHERE k % 2 = 0)", INC))
def idempotent_log(spark, d):
    e = incidents(spark, d).select("incident_id", F.concat_ws("|", F.lit("sla"), "category", "status").alias("dedupe_key"), "k")
    keys = ["incident_id", "dedupe_key"]
    return W.new_entries(e, e.where("k % 2 = 1"), keys).agg(F.count("*").alias("n_new"), F.count_distinct("dedupe_key").alias("n_keys"))


@register("snk6_backfill_events", "SELECT o_orderkey AS incident_id, c_name AS actor, 'opened' AS action FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def backfill_events(spark, d):
    o, c, li = (table(spark, d, t) for t in ("orders", "customer", "lineitem"))
    none = o.join(li, o.o_orderkey == li.l_orderkey, "left_anti")
    return none.join(c, none.o_custkey == c.c_custkey, "left").select(F.col("o_orderkey").alias("incident_id"), F.col("c_name").alias("actor"), F.lit("opened").alias("action"))


@register("snk7_backfill_sla", with_("SELECT incident_id, coalesce(epoch_us(due_at), epoch_us(reported_at) + 3600000000 * CASE category WHEN 'OPEN_MANHOLE' THEN 4 WHEN 'TRAFFIC_SIGNAL_FAULT' THEN 24 ELSE 168 END) // 1000000 AS due_s FROM inc", INC))
def backfill_sla(spark, d):
    h = F.when(F.col("category") == "OPEN_MANHOLE", 4).when(F.col("category") == "TRAFFIC_SIGNAL_FAULT", 24).otherwise(168)
    due = F.coalesce("due_at", F.timestamp_add("HOUR", h, "reported_at"))
    return incidents(spark, d).select("incident_id", due.alias("due")).selectExpr("incident_id", "unix_micros(due) div 1000000 AS due_s")


@register("wn14_longest_idle_agent", "SELECT c_nationkey, agent FROM (SELECT c_nationkey, c_custkey AS agent, row_number() OVER (PARTITION BY c_nationkey ORDER BY m ASC NULLS FIRST, c_custkey) AS rn FROM customer LEFT JOIN (SELECT o_custkey, max(epoch_us(o_orderdate)) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0) WHERE rn = 1")
def longest_idle_agent(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("agent")).agg(F.max("o_orderdate").alias("last_assigned"))
    a = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("agent"), (F.col("c_custkey") % 3 != 0).alias("available"))
    return W.longest_idle(a.join(last, "agent", "left"), ["c_nationkey"]).select("c_nationkey", "agent")


@register("prj22_role_filtered_timeline", "SELECT conv_id, turn, role FROM conversations WHERE role NOT IN ('system') ")
def role_filtered_timeline(spark, d):
    return table(spark, d, "conversations").where(~F.col("role").isin("system")).orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@register("so1_stable_order", with_("SELECT incident_id, CAST(row_number() OVER (ORDER BY reported_at, incident_id) AS BIGINT) AS place FROM inc", INC))
def stable_order(spark, d):
    """All incidents in their total order."""
    return total_order(spark, d)


@register("so1_total_order", with_("SELECT incident_id, CAST(row_number() OVER (ORDER BY reported_at, incident_id) AS BIGINT) AS place FROM inc", INC))
def total_order(spark, d):
    return W.stable_order(incidents(spark, d).select("reported_at", "incident_id"), ["reported_at", "incident_id"]).select("incident_id", "place")


@register("so6_runner_up", "SELECT p_brand, max(CASE WHEN rn = 1 THEN p_partkey END) AS best, max(CASE WHEN rn = 2 THEN p_partkey END) AS second, string_agg(CAST(p_partkey AS VARCHAR), '|' ORDER BY rn) FILTER (rn BETWEEN 3 AND 5) AS alternatives FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) GROUP BY 1")
def runner_up(spark, d):
    from wardline.operators.audit import ranks

    r = ranks(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"]).where("rn <= 5")
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("p_partkey")))
    more = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") >= 3, F.struct("rn", "p_partkey")))), lambda x: x["p_partkey"].cast("string")), "|")
    return r.groupBy("p_brand").agg(at(1).alias("best"), at(2).alias("second"), F.nullif(more, F.lit("")).alias("alternatives"))
