"""Leak-free history features: what was known at strictly earlier minutes, by running sums in blocks of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import nearby

DAY = 1440
BACKLOG_DAYS, LEAST_EVENTS, RATE_EVENTS = 90, 10, 20
#: Minutes of a block: a task sorts one block of one group, however long the history is.
BLOCK = 7 * DAY
#: Logs are summed as decimals, so that differences of running sums are exact.
LOG = "decimal(28,15)"


def prior_sums(events: DataFrame, asks: DataFrame, keys: list[str], sums: list[str], lags: dict[str, int], block: int = BLOCK, latest: bool = False) -> DataFrame:
    """For each distinct (keys, minute) of `asks` the sums of all events at strictly earlier minutes than minute - lag, as `<sum>_<lag name>`.

    Events are added by (keys, minute), then by blocks of time. Running sums over the blocks (a row a block) give what lies before a
    block, and a window within one block of one group the rest, so no frame slides and no task holds a group. A window of time is
    the difference of two lags. An ask before all events gets zeros. `latest` adds latest_<lag name>, the last such minute with an event."""
    added = events.groupBy(*keys, "minute").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("_b", F.floor(F.col("minute") / block))
    lag = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(int(m)).cast("long").alias("m")) for n, m in lags.items()]))
    wanted = asks.select(*keys, "minute").distinct().select(*keys, F.col("minute").alias("_ask"), lag.alias("_l"))
    wanted = wanted.select(*keys, "_ask", F.col("_l.name").alias("_lag"), (F.col("_ask") - F.col("_l.m")).alias("minute")).withColumn("_b", F.floor(F.col("minute") / block))
    if latest:
        added = added.withColumn("_t", F.col("minute"))
    zeros = [F.lit(0).cast(added.schema[c].dataType).alias(c) for c in sums]
    # Asks come before the events of their own minute.
    last, none = (["_t"], [F.lit(None).cast("long").alias("_t")]) if latest else ([], [])
    rows = added.select(*keys, "_b", "minute", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_ask"), F.lit(None).cast("string").alias("_lag"), *sums, *last)
    rows = rows.unionByName(wanted.select(*keys, "_b", "minute", F.lit(0).alias("_kind"), "_ask", "_lag", *zeros, *none))
    inside = Window.partitionBy(*keys, "_b").orderBy("minute", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "_b", "_ask", "_lag", *[F.sum(c).over(inside).alias(c) for c in sums], *[F.max(c).over(inside).alias(c) for c in last]).where("_ask IS NOT NULL")
    # Blocks of asks without events need a row of their own.
    blocks = added.select(*keys, "_b", *sums, *last).unionByName(wanted.select(*keys, "_b", *zeros, *none))
    blocks = blocks.groupBy(*keys, "_b").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in last])
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_b", *[F.sum(c).over(ahead).alias(f"_{c}") for c in sums], *[F.max(c).over(ahead).alias(f"_{c}") for c in last])
    same = [rows[c].eqNullSafe(blocks[c]) for c in keys] + [rows["_b"] == blocks["_b"]]
    met = rows.join(blocks, same)
    met = met.select(*[rows[c] for c in keys], "_ask", "_lag", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums], *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in last])
    out = [F.sum(F.when(F.col("_lag") == n, F.col(c))).alias(f"{c}_{n}") for n in lags for c in sums]
    out += [F.max(F.when(F.col("_lag") == n, F.col(c))).alias(f"latest_{n}") for n in lags for c in last]
    return met.groupBy(*keys, F.col("_ask").alias("minute")).agg(*out)


def _ask(base: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Incidents with what was found for their group and minute."""
    own = [*keys, "minute"]
    found = found.withColumnsRenamed({c: f"_f_{c}" for c in own})
    same = [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in keys] + [F.col("minute") == F.col("_f_minute")]
    return base.join(found, same).drop(*[f"_f_{c}" for c in own])


def workload(df: DataFrame, keys: list[str], warm_up_days: int = 0, source: str = "source_dataset") -> DataFrame:
    """For each incident, of strictly earlier minutes within its group: open backlog (reports of at most 90 days), intake of 7 and 30
    days, closures of 7 days, closures with a valid duration of 30 days, mean log1p hours of both (of ten at least), and the backlog in
    days of the 30 days' mean intake. Within `warm_up_days` of its source's first report all is NULL."""
    rep, close = S.minutes(F.col("reported_at")), S.minutes(F.col("closed_at"))
    hours = S.resolution_hours(S.hours_between(F.col("closed_at"), F.col("reported_at")))
    base = df.select("incident_id", F.col(source).alias("_source"), *keys, rep.alias("minute"), close.alias("c"), hours.alias("h"))
    leave = F.least(F.coalesce("c", F.col("minute") + BACKLOG_DAYS * DAY), F.col("minute") + BACKLOG_DAYS * DAY)
    one, nil, none = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast(LOG)
    event = lambda m, r, x, c, n, lg: base.select(*keys, m.alias("minute"), r.alias("rep"), x.alias("exits"), c.alias("closed"), n.alias("dn"), lg.alias("dl"))
    logs = F.coalesce(F.log1p("h"), F.lit(0.0)).cast(LOG)
    events = event(F.col("minute"), one, nil, nil, nil, none).unionByName(event(leave, nil, one, nil, nil, none))
    events = events.unionByName(event(F.col("c"), nil, nil, one, F.col("h").isNotNull().cast("long"), logs)).where("minute IS NOT NULL")
    found = prior_sums(events, base, keys, ["rep", "exits", "closed", "dn", "dl"], {"now": 0, "7": 7 * DAY, "30": 30 * DAY})
    met = _ask(base.select("incident_id", "_source", *keys, "minute"), found, keys)
    since = lambda c, d: F.col(f"{c}_now") - F.col(f"{c}_{d}")
    mean = lambda d: F.when(since("dn", d) >= LEAST_EVENTS, F.round(since("dl", d).cast("double") / since("dn", d), 6))
    backlog = F.col("rep_now") - F.col("exits_now")
    out = {
        "backlog": backlog, "intake_7d": since("rep", 7), "intake_30d": since("rep", 30), "closed_7d": since("closed", 7), "mean_log_7d": mean(7),
        "resolved_30d": since("dn", 30), "mean_log_30d": mean(30), "backlog_days": F.when(since("rep", 30) > 0, F.round(backlog * 30.0 / since("rep", 30), 6)),
    }
    if warm_up_days:
        first = base.groupBy("_source").agg(F.min("minute").alias("_first"))
        met = met.join(F.broadcast(first), "_source")  # a row for each source
        out = {n: F.when(F.col("minute") - F.col("_first") >= warm_up_days * DAY, c) for n, c in out.items()}
    return met.select("incident_id", *[c.alias(n) for n, c in out.items()])


def recent_breach_rate(df: DataFrame, keys: list[str], horizon_hours: int, days: int | None = 7) -> DataFrame:
    """Share of the reports of [t - X - days, t - X) that were not closed within X hours; NULL under twenty reports. No days: of any age."""
    x = horizon_hours * 60
    hours = S.hours_between(F.col("closed_at"), F.col("reported_at"))
    base = df.select("incident_id", *keys, S.minutes(F.col("reported_at")).alias("minute"), (F.coalesce(hours, F.lit(1e9)) > horizon_hours).cast("long").alias("late"), F.lit(1).cast("long").alias("n"))
    lags = {"until": x} | ({} if days is None else {"from": x + days * DAY})
    met = _ask(base.select("incident_id", *keys, "minute"), prior_sums(base, base, keys, ["late", "n"], lags), keys)
    late, n = (F.col(f"{c}_until") - (F.lit(0) if days is None else F.col(f"{c}_from")) for c in ("late", "n"))
    return met.select("incident_id", F.when(n >= RATE_EVENTS, F.round(late / n, 6)).alias("breach_rate"), n.alias("n_reports"))


def block_counts(df: DataFrame, keys: list[str], size: float = 0.0002, days: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Earlier reports in the 3 x 3 cells around each incident, by windows of days, and those of all that are open at its time (n_open).

    Tiles of cells are counted by sorted times (nearby.cell_counts): a row is copied to the tiles that its neighbours lie in, mostly one.
    Incidents without coordinates give no row."""
    cell = [F.round(F.col("longitude") / F.lit(size)).cast("long").alias("ix"), F.round(F.col("latitude") / F.lit(size)).cast("long").alias("iy")]
    base = df.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("incident_id", *keys, *cell, S.minutes(F.col("reported_at")).alias("minute"), S.minutes(F.col("closed_at")).alias("closed"))
    return nearby.cell_counts(base, keys, {f"n_{d}d": d * DAY for d in days})
