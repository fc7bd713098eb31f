"""Which cells of a grid lie within a radius of each other as a whole, so that hot places are counted by sums and not in pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators.storage import cut, small, spread_join

#: A cell's parts along each axis at the next level, levels beyond the first, and pairs of rows above which a pair of cells is split.
SPLIT, DEEPER, HEAVY = 8, 2, 1_000_000
#: Rows of a cell in a bucket of time up to which pairs cost less than running sums.
FEW = 64
#: Bounds of distances give way by so much, for rounding at cells' edges.
SLACK = 1e-6


def grid_size(radius_m: float) -> float:
    """Degrees of a cell whose eight neighbours lie within the radius as a whole at the equator, where degrees are widest."""
    return 0.999 * radius_m / (2 * math.sqrt(2) * S.LON_M_PER_DEG)


def at_level(fine: Column, level: int) -> Column:
    """The cell of a level that holds a cell of the finest one."""
    return F.floor(fine / F.lit(SPLIT ** (DEEPER - level))).cast("long")


def fine_cell(x: Column, size: float) -> Column:
    return S.cell(x, size / SPLIT**DEEPER)


def _apart(dlat: Column, dlon: Column, cosine: Column) -> Column:
    a = F.pow(F.sin(F.radians(dlat) / 2), 2) + cosine * cosine * F.pow(F.sin(F.radians(dlon) / 2), 2)
    return 2 * S.EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _judged(pairs: DataFrame, radius_m: float, size: float) -> DataFrame:
    """Pairs of cells (oy, ox) and (sy, sx) with `inside`: whether all their points are within the radius. Pairs that are apart go."""
    dy, dx = F.abs(F.col("oy") - F.col("sy")), F.abs(F.col("ox") - F.col("sx"))
    low, high = F.least("oy", "sy") * size, (F.greatest("oy", "sy") + 1) * size
    nearest = F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
    most, least = F.cos(F.radians(nearest)), F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(high)))))
    gap = lambda d: F.greatest(d - 1, F.lit(0)) * size
    pairs = pairs.withColumn("inside", _apart((dy + 1) * size, (dx + 1) * size, most) <= radius_m * (1 - SLACK))
    return pairs.where(_apart(gap(dy), gap(dx), least) <= radius_m * (1 + SLACK))


def relations(points: DataFrame, radius_m: float, size: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of occupied cells (level, oy, ox, sy, sx) of points (fy, fx: finest cells, b: bucket of time): those wholly inside the radius,
    and border pairs, whose points need their distances.

    A cell counts with the most rows that it has in a bucket. A pair inside the radius with FEW rows to look at goes to the border pairs,
    as pairs are cheaper then. A border pair of more than HEAVY pairs of rows in a bucket is split into pairs of its parts, twice at
    most, so two hot places are compared at cells of a few thousandths of the radius."""
    points = cut(points.groupBy("fy", "fx", "b").agg(F.count("*").alias("n")))
    inside, border, parents = [], [], None
    for level in range(DEEPER + 1):
        own = size / SPLIT**level
        cells = points.groupBy(at_level(F.col("fy"), level).alias("y"), at_level(F.col("fx"), level).alias("x"), "b").agg(F.sum("n").alias("n"))
        cells = cut(cells.groupBy("y", "x").agg(F.max("n").alias("n")))
        if parents is None:
            ns, ew = S.required_rings((F.col("y") + 0.5) * own, radius_m, own)
            ring = cells.select(F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("n").alias("on"), F.explode(F.sequence(-ns - 1, ns + 1)).alias("dy"), ew.alias("ew"))
            ring = ring.select("oy", "ox", "on", (F.col("oy") + F.col("dy")).alias("sy"), F.explode(F.sequence(F.col("ox") - F.col("ew") - 1, F.col("ox") + F.col("ew") + 1)).alias("sx"))
            pairs = ring.join(cells.toDF("sy", "sx", "sn"), ["sy", "sx"])
        else:
            part = lambda a, b: cells.select(F.floor(F.col("y") / SPLIT).alias(f"{a}p"), F.floor(F.col("x") / SPLIT).alias(f"{b}p"), F.col("y").alias(a), F.col("x").alias(b), F.col("n").alias(a[0] + "n"))
            up = parents.select(*[F.col(c).alias(f"{c}p") for c in ("oy", "ox", "sy", "sx")])
            pairs = up.join(part("oy", "ox"), ["oyp", "oxp"]).join(part("sy", "sx"), ["syp", "sxp"])
        found = cut(_judged(pairs.select("oy", "ox", "on", "sy", "sx", "sn"), radius_m, own))
        found = found.withColumn("inside", F.col("inside") & (F.col("sn") > FEW))
        heavy = ~F.col("inside") & (F.col("on") * F.col("sn") > HEAVY) if level < DEEPER else F.lit(False)
        name = lambda df: df.select(F.lit(level).alias("level"), "oy", "ox", "sy", "sx")  # noqa: E731, B023
        inside.append(name(found.where("inside")))
        border.append(name(found.where(~F.col("inside") & ~heavy)))
        parents = found.where(heavy)
        if level == DEEPER or parents.isEmpty():
            break
    return union(inside), union(border)


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def levels_of(table: DataFrame) -> list[int]:
    return sorted(r[0] for r in table.select("level").distinct().collect())  # three at most


def with_cell(rows: DataFrame, level: int, y: str, x: str) -> DataFrame:
    return rows.withColumns({y: at_level(F.col("fy"), level), x: at_level(F.col("fx"), level)})


def copies(base: DataFrame, inside: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of base beside each cell (level, oy, ox) that they are within the radius of as a whole; hot cells are dealt over tasks."""
    out = []
    for k in levels_of(inside):
        rows = with_cell(base, k, "sy", "sx")
        own = inside.where(F.col("level") == k).groupBy("sy", "sx").agg(F.collect_list(F.struct("oy", "ox")).alias("_to"))  # nine a cell, or a split cell's parts
        sizes = rows.groupBy("sy", "sx").agg(F.count("*").alias("_size"))
        met = spread_join(rows.select("sy", "sx", *columns), cut(own.join(sizes, ["sy", "sx"])), ["sy", "sx"], "_size", columns)
        out.append(met.select(F.lit(k).alias("level"), F.explode("_to").alias("_c"), *columns).select("level", "_c.oy", "_c.ox", *columns))
    return cut(union(out))


def asking(base: DataFrame, inside: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of base with their own cell at each level (level, oy, ox) that has copies."""
    out = []
    for k in levels_of(inside):
        rows = with_cell(base, k, "oy", "ox").select(*columns, F.lit(k).alias("level"), "oy", "ox")
        out.append(rows if k == 0 else rows.join(small(cut(inside.where(F.col("level") == k).select("oy", "ox").distinct())), ["oy", "ox"]).select(*columns, "level", "oy", "ox"))
    return cut(union(out))
