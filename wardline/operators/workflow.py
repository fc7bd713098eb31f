"""Event logs of incidents: allowed transitions, event types, current states, fan-out, idempotent logs and backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.graph import cut

# Allowed transitions of states.
TRANSITIONS = [("view", "cart"), ("cart", "purchase"), ("view", "purchase"), ("purchase", "view"), ("cart", "view"), ("click", "view"), ("view", "click"), ("click", "cart")]


def with_previous(log: DataFrame, entity: str, state: str, at: list[str]) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(*at)
    return log.withColumn("previous", F.lag(state).over(w))


def invalid_transitions(log: DataFrame, entity: str, state: str, at: list[str], allowed: list[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """Events whose step from the entity's previous state is not allowed; first events and repeats of a state are."""
    edges = log.sparkSession.createDataFrame(allowed, "previous string, _to string")
    steps = with_previous(log, entity, state, at).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))
    return steps.join(F.broadcast(edges.withColumnRenamed("_to", state)), ["previous", state], "left_anti")


def event_types(log: DataFrame, entity: str, state: str, at: list[str], milestones: list[str], reopened_from: list[str]) -> DataFrame:
    kind = F.when(F.col(state).isin(milestones), "milestone").when(F.col("previous").isin(reopened_from), "reopened").when(F.col("previous") != F.col(state), "status_changed").otherwise("noted")
    return with_previous(log, entity, state, at).withColumn("kind", kind)


def current_state(log: DataFrame, entity: str, state: str, at: list[str]) -> DataFrame:
    """The last event's state of each entity, ties by the last order column: one aggregation, no window."""
    return log.groupBy(entity).agg(F.max_by(state, F.struct(*at)).alias("state"), F.count("*").alias("n_events"))


def fan_out(changes: DataFrame, incidents: DataFrame, agent: str) -> DataFrame:
    """One event for each open incident of an agent whose availability really changed."""
    w = Window.partitionBy(agent).orderBy("seq")
    real = changes.withColumn("_was", F.lag("available").over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col("available"))).drop("_was")
    return real.join(incidents, agent)


def new_entries(entries: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that the log lacks, one for each key: appending them twice changes nothing."""
    return entries.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti")


def longest_idle(agents: DataFrame, by: list[str]) -> DataFrame:
    """The available agent of each group who was assigned last the longest ago; never assigned ones first."""
    w = Window.partitionBy(*by).orderBy(F.col("last_assigned").asc_nulls_first(), "agent")
    return agents.where("available").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def stable_order(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds place, from 1, of every row in the total order. No task sorts more than its range: counts of the earlier ranges give its first place."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)  # ranges are sampled, so they are fixed before they are counted
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_at", inside).join(F.broadcast(first), "_range").withColumn("place", (F.col("_first") + F.col("_at")).cast("long")).drop("_range", "_first", "_at")
