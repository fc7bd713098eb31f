"""Exact order statistics of large groups: histogram passes narrow the range of each wanted rank until what is left fits one task."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.history import prior_sums
from wardline.operators.storage import cut, small, spread_join

#: Rows of one group that one task may sort; beyond it, bins of a histogram say where the wanted ranks lie.
SORTED = 100_000
#: Bins of a group's range (fewer where there are many groups, so that bins stay few).
BINS, ALL_BINS = 4_096, 4_000_000


def _inside(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie in a range of their group, with that range as _r. Ranges of many groups meet their rows by a dealt join."""
    if state.limit(SORTED + 1).count() <= SORTED:
        met = values.join(F.broadcast(state), keys) if keys else values.crossJoin(F.broadcast(state))  # without keys: one row
    else:
        met = spread_join(values, state, keys, "_n", ["_v"])
    met = met.withColumn("_r", F.get(F.filter("_ranges", lambda r: (F.col("_v") >= r["lo"]) & (F.col("_v") <= r["hi"])), F.lit(0)))
    return met.where("_r IS NOT NULL").select(*keys, "_n", "_v", "_r")


def order_statistics(df: DataFrame, by: list[str], column: str | Column, ranks: dict[str, Column]) -> DataFrame:
    """One row a group (one row without `by`): its columns, n (values that are not NULL) and, for each name, the value at a rank from 0,
    an expression of the group's number of values _n; NULL beyond them, or for a group without values.

    No task holds a group. Groups of at most SORTED values sort them; for larger ones each pass counts bins between the least and
    greatest value of the ranges that hold wanted ranks, so rows shuffle as partial counts of bins, and the next range is a bin's own
    least and greatest value. Equal values are counted together, so a value with most rows is one row. Keys may be NULL."""
    keys = [f"_k{i}" for i in range(len(by))]
    # A NULL key is a group: keys travel as structs, which joins compare as values.
    rows = df.select(*[F.struct(F.col(c)).alias(k) for c, k in zip(by, keys, strict=True)], (F.col(column) if isinstance(column, str) else column).cast("double").alias("_v"))
    groups = cut(rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    most, n_groups = groups.agg(F.coalesce(F.max("_n"), F.lit(0)), F.count("*")).collect()[0]
    values = rows.where("_v IS NOT NULL")
    whole = F.array(F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.lit(0).cast("long").alias("base"), F.col("_n").alias("rows")))
    state = groups.where("_n > 0").select(*keys, "_n", whole.alias("_ranges"))
    if most > SORTED:
        values = cut(values)
        bins = max(16, min(BINS, ALL_BINS // n_groups))
        wide = F.exists("_ranges", lambda r: (r["rows"] > SORTED) & (r["lo"] < r["hi"]))
        while not state.where(wide).isEmpty():
            state = cut(_narrowed(_inside(values, state, keys), keys, list(ranks.values()), bins))
        values = _inside(values, state, keys)
    else:
        values = values.join(small(state.select(*keys, "_n")), keys) if keys else values.crossJoin(F.broadcast(state.select("_n")))
        values = values.withColumn("_r", F.struct(F.lit(0).cast("long").alias("base")))
    counted = values.groupBy(*keys, F.col("_r.base").alias("_base"), "_v").agg(F.count("*").alias("_c"), F.any_value("_n").alias("_n"))
    ahead = Window.partitionBy(*keys, "_base").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_to", F.sum("_c").over(ahead) + F.col("_base")).withColumn("_from", F.col("_to") - F.col("_c"))
    held = [F.max(F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("_v"))).alias(name) for name, r in ranks.items()]
    found = placed.groupBy(*keys).agg(*held)
    every = groups.select(*keys, F.col("_n").alias("n"))
    met = every.join(found, keys, "left") if keys else every.crossJoin(F.broadcast(found))
    return met.select(*[F.col(k)[c].alias(c) for c, k in zip(by, keys, strict=True)], "n", *ranks)


def _narrowed(inside: DataFrame, keys: list[str], ranks: list[Column], bins: int) -> DataFrame:
    """The ranges of the bins that hold a wanted rank, for each group: at most one for each rank."""
    r = F.col("_r")
    spread = (F.col("_v") - r["lo"]) / (r["hi"] - r["lo"])
    b = F.when(r["lo"] < r["hi"], F.least(F.floor(spread * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = inside.groupBy(*keys, "_n", r["base"].alias("_base"), b.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    ahead = Window.partitionBy(*keys, "_base").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("base", F.sum("_c").over(ahead) - F.col("_c") + F.col("_base"))
    held = F.exists(F.array(*[k.cast("long") for k in ranks]), lambda k: (k >= F.col("base")) & (k < F.col("base") + F.col("_c")))
    return counts.where(held).groupBy(*keys, "_n").agg(F.collect_list(F.struct("lo", "hi", "base", F.col("_c").alias("rows"))).alias("_ranges"))


def quantiles(df: DataFrame, by: list[str], column: str | Column, shares: dict[str, float]) -> DataFrame:
    """One row a group (one row without `by`): its columns, n and the exact quantile of each share, by linear interpolation between
    neighbours, as percentile() gives; NULL for a group without values. See order_statistics."""
    ends = {}
    for name, s in shares.items():
        at = F.lit(float(s)) * (F.col("_n") - 1)
        ends |= {f"_low_{name}": F.floor(at), f"_high_{name}": F.ceil(at)}
    found = order_statistics(df, by, column, ends)
    out = []
    for name, s in shares.items():
        at, low, high = F.lit(float(s)) * (F.col("n") - 1), F.col(f"_low_{name}"), F.col(f"_high_{name}")
        out.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    return found.select(*by, "n", *out)


def with_quantiles(df: DataFrame, by: list[str], column: str | Column, shares: dict[str, float], aggregates: list[Column]) -> DataFrame:
    """groupBy(by).agg(aggregates) with exact quantiles of a column beside them. Both sides have one row a group."""
    plain = df.groupBy(*by).agg(*aggregates)
    found = quantiles(df, by, column, shares).drop("n")
    if not by:
        return plain.crossJoin(F.broadcast(found))  # one row each
    found = found.withColumnsRenamed({c: f"_q_{c}" for c in by})
    return plain.join(found, [plain[c].eqNullSafe(found[f"_q_{c}"]) for c in by]).drop(*[f"_q_{c}" for c in by])


# ---- quantiles of what was known before a moment -------------------------------------------------------------------

#: Digits of a value's rank that one pass resolves.
DIGITS = 16
#: Events of a group, and asks beside them, that one task may hold; beyond it, passes over digits narrow what is looked at.
FIT = 1_000_000


def prior_quantile(events: DataFrame, asks: DataFrame, keys: list[str], value: str, since: int | None = None, share: float = 0.5, block: int | None = None) -> DataFrame:
    """For each distinct (keys, minute) of `asks`: n, and the exact quantile q of the events' values at minutes in [minute - since, minute)
    (of any age without `since`); n is 0 and q NULL where there are none.

    Groups of at most FIT events are answered by one task each for some asks at a time (between): times are positions, and one bit of the
    values' order after the other tells where the wanted value lies. In larger groups distinct values get ranks, and a rank is a few
    digits to the base DIGITS. A pass counts each ask's events by one digit, as differences of running sums (history.prior_sums), which
    tells the digit of the wanted rank and the rank among the events that share it; the next pass looks at those only, until they
    fit. No event is copied to the times that it counts for, and no task holds a larger group. `minute` may be in any unit (minutes, days)."""
    block = {} if block is None else {"block": block}
    lags = {"until": 0} | ({} if since is None else {"from": since})
    known = events.where(F.col(value).isNotNull() & F.col("minute").isNotNull()).select(*keys, "minute", F.col(value).cast("double").alias("_v"))
    known = cut(known.groupBy(*keys, "minute", "_v").agg(F.count("*").alias("_c")))
    wanted = cut(asks.select(*keys, "minute").distinct())
    if _most(known.groupBy(*keys).count()) <= FIT:
        return _between(known, wanted, keys, since, share, "n long, q double")
    values = cut(_numbered_values(known.select("_v").distinct()))
    n_values = values.count()
    levels = max(1, math.ceil(math.log(max(2, n_values)) / math.log(DIGITS) - 1e-9))
    while DIGITS**levels < n_values:
        levels += 1
    known = cut(known.join(small(values), "_v"))
    state = wanted.select("*", F.lit(0).cast("long").alias("_path"), F.lit(None).cast("string").alias("_side"), F.lit(None).cast("long").alias("_k"), F.lit(None).cast("long").alias("_n"))
    found = None
    for level in range(levels):
        unit = DIGITS ** (levels - 1 - level)
        digit = F.expr(f"(_rank div {unit}) % {DIGITS}")
        sums = [f"_d{i}" for i in range(DIGITS)]
        at = [*keys, "_path"]
        if level:
            held = known.withColumn("_path", F.expr(f"_rank div {unit * DIGITS}"))
            held = cut(_met(held, cut(state.groupBy(*at).count()), at).drop("_asks"))
            if _most(held.groupBy(*at).count()) <= FIT:
                found = _between(held, state, at, since, share, "_v double").drop("_path")
                break
            known = held.drop("_path")
        seen = known.select(*keys, F.expr(f"_rank div {unit * DIGITS}").alias("_path"), "minute", *[F.when(digit == i, F.col("_c")).otherwise(F.lit(0).cast("long")).alias(s) for i, s in enumerate(sums)])
        got = prior_sums(seen, state.select(*at, "minute"), at, sums, lags, **block)
        counts = F.array(*[F.coalesce(F.col(f"{s}_until"), F.lit(0)) - (F.coalesce(F.col(f"{s}_from"), F.lit(0)) if since is not None else F.lit(0)) for s in sums])
        got = got.select(*[F.col(c).alias(f"_g_{c}") for c in [*at, "minute"]], counts.alias("_counts"))
        state = state.join(got, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in [*at, "minute"]]).drop(*[f"_g_{c}" for c in [*at, "minute"]])
        if level == 0:
            total = F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
            place = F.lit(float(share)) * (F.col("_n") - 1)
            sides = F.array(F.struct(F.lit("low").alias("side"), F.floor(place).alias("k")), F.struct(F.lit("high").alias("side"), F.ceil(place).alias("k")))
            state = state.withColumn("_n", total).where("_n > 0").withColumn("_s", F.explode(sides)).withColumns({"_side": F.col("_s.side"), "_k": F.col("_s.k").cast("long")}).drop("_s")
        # The running count over digits gives the digit whose events hold the rank.
        start = F.struct(F.lit(-1).alias("digit"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"))
        step = lambda a, c: F.struct(
            F.when((a["digit"] < 0) & (F.col("_k") < a["sum"] + c), a["i"]).otherwise(a["digit"]).alias("digit"),
            F.when((a["digit"] < 0) & (F.col("_k") < a["sum"] + c), a["sum"]).otherwise(a["before"]).alias("before"), (a["sum"] + c).alias("sum"), (a["i"] + 1).alias("i"))
        state = state.withColumn("_at", F.aggregate("_counts", start, step))
        state = cut(state.withColumns({"_path": F.col("_path") * DIGITS + F.col("_at.digit"), "_k": F.col("_k") - F.col("_at.before")}).drop("_at", "_counts"))
    if found is None:
        found = state.join(small(values.withColumnRenamed("_rank", "_path")), "_path")
    place = F.lit(float(share)) * (F.col("_n") - 1)
    weight = F.when(F.floor(place) == F.ceil(place), F.when(F.col("_side") == "low", 1.0).otherwise(0.0)).otherwise(F.when(F.col("_side") == "low", F.ceil(place) - place).otherwise(place - F.floor(place)))
    found = found.groupBy(*keys, "minute").agg(F.max("_n").alias("n"), F.sum(weight * F.col("_v")).alias("q"))
    found = found.select(*[F.col(c).alias(f"_g_{c}") for c in [*keys, "minute"]], "n", "q")
    met = wanted.join(found, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in [*keys, "minute"]], "left")
    return met.select(*keys, "minute", F.coalesce("n", F.lit(0)).alias("n"), "q")


def _most(groups: DataFrame) -> int:
    return groups.agg(F.coalesce(F.max("count"), F.lit(0))).collect()[0][0]


def _met(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose group is among the groups (keys, count; cut), with its count. Keys may be NULL."""
    told = small(groups.select(*[F.col(c).alias(f"_g_{c}") for c in keys], F.col("count").alias("_asks")))
    if not keys:
        return rows.crossJoin(told)  # one row
    return rows.join(told, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in keys]).drop(*[f"_g_{c}" for c in keys])


def _between(events: DataFrame, asks: DataFrame, keys: list[str], since: int | None, share: float, out: str) -> DataFrame:
    """asks with what between() gives from the events (keys, minute, _v, _c) of their group. A group's asks are dealt, FIT to a task, and
    its events go to each of these tasks."""
    asked = cut(asks.groupBy(*keys).count().where("count > 0"))
    hands = F.ceil(F.col("_asks") / FIT).cast("int")
    given = _met(events.select(*keys, "minute", "_v", "_c"), asked, keys).withColumn("_hand", F.explode(F.sequence(F.lit(0), hands - 1))).drop("_asks")
    dealt = _met(asks, asked, keys).withColumn("_hand", F.pmod(F.xxhash64("minute"), hands).cast("int")).drop("_asks")
    rows = dealt.withColumn("_ask", F.lit(True)).unionByName(given.withColumn("_ask", F.lit(False)), allowMissingColumns=True)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asks.schema)
    return rows.groupBy(*keys, "_hand").applyInArrow(between(asks.columns, since, share), f"{kind}, {out}")


def between(columns: list[str], since: int | None, share: float) -> Callable[[pa.Table], pa.Table]:
    """The columns of a group's asks, each with the value _v at rank _k among the events of [minute - since, minute); without _k, with their
    number n and the quantile q."""

    def answer(table: pa.Table) -> pa.Table:
        minute, ask = pc.fill_null(table["minute"], -(2**62)).to_numpy(), table["_ask"].to_numpy(zero_copy_only=False)
        mine, other = np.flatnonzero(ask), np.flatnonzero(~ask)
        other = other[np.argsort(minute[other], kind="stable")]
        values, rank = np.unique(table["_v"].take(pa.array(other)).to_numpy(), return_inverse=True)
        weight = table["_c"].take(pa.array(other)).to_numpy()
        asked = table.take(pa.array(mine)).select(columns)
        high = np.searchsorted(minute[other], minute[mine])
        low = np.zeros_like(high) if since is None else np.searchsorted(minute[other], minute[mine] - since)
        if "_k" in columns:
            at = weighted_rank(rank, weight, low, high, asked["_k"].to_numpy())
            return asked.append_column("_v", pa.array(values[np.minimum(at, len(values) - 1)]))
        ahead = np.concatenate([[0], np.cumsum(weight)])
        n = ahead[high] - ahead[low]
        q = np.zeros(len(mine))
        if len(values):
            place = share * np.maximum(n - 1, 0)
            first, last = np.floor(place), np.ceil(place)
            a, b = (values[np.minimum(weighted_rank(rank, weight, low, high, k.astype(np.int64)), len(values) - 1)] for k in (first, last))
            q = np.where(first == last, a, (last - place) * a + (place - first) * b)
        return asked.append_column("n", pa.array(n, pa.int64())).append_column("q", pa.array(q, mask=n == 0))

    return answer


def weighted_rank(rank: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each span of positions [low, high), the rank whose elements, in order and by their weights, hold the place k from 0.

    Bit by bit from the highest: elements without the bit come first, in their order, so a span is two spans, one of either side."""
    found = np.zeros(len(low), np.int64)
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        one = (rank >> bit) & 1 == 1
        zeros, held = np.concatenate([[0], np.cumsum(~one)]), np.concatenate([[0], np.cumsum(np.where(one, 0, weight))])
        below = held[high] - held[low]
        right = k >= below
        k = np.where(right, k - below, k)
        low, high = (np.where(right, zeros[-1] + x - zeros[x], zeros[x]) for x in (low, high))
        found |= right.astype(np.int64) << bit
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        rank, weight = rank[order], weight[order]
    return found


def _numbered_values(distinct: DataFrame) -> DataFrame:
    """_v, _rank from 0 in the order of the values, by ranges."""
    ranged = cut(distinct.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()))  # ranges are sampled, so they are fixed before they are counted
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_v"))
    return ranged.withColumn("_at", inside).join(F.broadcast(first), "_range").select("_v", (F.col("_first") + F.col("_at") - 1).cast("long").alias("_rank"))
