"""Incidents with their first closure, and what came of predictions about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: fewer known outcomes are too few for a metric.
ENOUGH = 30


def incident_records(incidents: DataFrame, history: DataFrame, actions: list[str], upto=None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Incidents (incident_id, category, created_at, latitude, longitude, ...) with first_closed_at, the time of their first action in
    `actions` of the history (incident_id, action, at), NULL where there is none. `upto` keeps incidents created by then, `box` (south,
    north, west, east) those inside it; unlocated ones are in no box. The history is reduced to a row an incident before the join."""
    if upto is not None:
        incidents = incidents.where(F.col("created_at") <= upto)
    if box is not None:
        south, north, west, east = box
        incidents = incidents.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    first = history.where(F.col("action").isin(actions)).groupBy("incident_id").agg(F.min("at").alias("first_closed_at"))
    return incidents.join(first, "incident_id", "left")


def outcomes(log: DataFrame, now) -> DataFrame:
    """Adds `state` and `hours` at the time `now` to predictions (task, created_at, first_closed_at, sla_hours).

    resolution: OBSERVED with the hours to the first closure, or CENSORED with the hours so far, neither below 0. sla: NO_SLA, or
    BREACHED or MET by the closure against the deadline, or for open incidents BREACHED or PENDING."""
    us = lambda c: F.unix_micros(c)
    known, end = F.col("first_closed_at").isNotNull(), F.coalesce(F.col("first_closed_at"), now)
    late = us(end) >= us("created_at") + F.col("sla_hours") * F.lit(3.6e9)
    sla = F.when(F.col("sla_hours").isNull(), "NO_SLA").when(late, "BREACHED").when(known, "MET").otherwise("PENDING")
    state = F.when(F.col("task") == "resolution", F.when(known, "OBSERVED").otherwise("CENSORED")).otherwise(sla)
    hours = F.greatest(us(end) - us("created_at"), F.lit(0)) / F.lit(3.6e9)
    return log.select("*", state.alias("state"), F.when(F.col("task") == "resolution", hours).alias("hours"))


def shadow_evaluation(log: DataFrame, now) -> DataFrame:
    """Predictions (task, method, status, estimate_hours, probability, and what outcomes() takes) by task, method and status: how many
    are in each state, the mean error of observed ones, censored ones that are certainly under-estimated, the Brier score of settled
    ones, and whether there are enough outcomes. One aggregation, combined before the shuffle."""
    estimate, p, state = F.col("estimate_hours"), F.col("probability"), F.col("state")
    error = F.when(state == "OBSERVED", F.abs(F.col("hours") - estimate))
    settled = (F.col("task") == "sla") & state.isin("BREACHED", "MET")
    square = F.when(settled, F.pow(p - (state == "BREACHED").cast("double"), 2))
    counts = [F.count_if(state == s).alias(f"n_{s.lower()}") for s in ("OBSERVED", "CENSORED", "BREACHED", "MET", "PENDING", "NO_SLA")]
    known = F.when(F.col("task") == "resolution", F.count(error)).otherwise(F.count(square))
    g = outcomes(log, now).groupBy("task", "method", "status")
    return g.agg(
        F.count("*").alias("n"), *counts, F.round(F.avg(error), 4).alias("mae"), F.count_if((state == "CENSORED") & (F.col("hours") > estimate)).alias("n_under"),
        F.round(F.avg(square), 6).alias("brier"), (known >= ENOUGH).alias("enough"),
    )
