"""Calendar-complete weekly panels, their lags, rolling means and exponential smoothing, and hotspot forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators.quantiles import quantiles
from wardline.operators.storage import cut, small


def weekly_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, S.week_start(F.col("reported_at")).alias("week")).agg(F.count("*").cast("long").alias("y"))


def complete(counts: DataFrame, keys: list[str], region: str, trim: bool = True) -> DataFrame:
    """Each series of a region in every week of that region, without its first and last week; absent weeks count 0."""
    span = counts.groupBy(region).agg(F.min("week").alias("a"), F.max("week").alias("b"))
    if trim:
        span = span.select(region, F.date_add("a", 7).alias("a"), F.date_sub("b", 7).alias("b")).where("a <= b")
    weeks = span.select(region, F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week"))
    grid = counts.select(*keys).distinct().join(weeks, region)
    return grid.join(counts, [*keys, "week"], "left").withColumn("y", F.coalesce("y", F.lit(0)).cast("long"))


def metric_zones(df: DataFrame, cell_m: float, clean_from: str, least: int = 8) -> DataFrame:
    """Rows with coordinates and zone_id, their cell "x_y" of a metric grid from the least latitude and longitude at the median latitude,
    of those (cell, category) that have `least` rows since `clean_from`; the other cells are structural zeros."""
    placed = df.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    ref = quantiles(placed, [], "latitude", {"_ref": 0.5}).select("_ref")
    grid = placed.agg(F.min("latitude").alias("_lat0"), F.min("longitude").alias("_lon0")).crossJoin(F.broadcast(ref))  # one row each
    placed = placed.crossJoin(F.broadcast(cut(grid)))
    ix = F.floor((F.col("longitude") - F.col("_lon0")) * S.LON_M_PER_DEG * F.cos(F.radians("_ref")) / cell_m)
    iy = F.floor((F.col("latitude") - F.col("_lat0")) * S.LAT_M_PER_DEG / cell_m)
    placed = placed.withColumn("zone_id", F.concat_ws("_", ix.cast("string"), iy.cast("string"))).drop("_lat0", "_lon0", "_ref")
    clean = placed.where(F.col("reported_at") >= F.lit(clean_from).cast("timestamp")).groupBy("zone_id", "category").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return placed.join(small(cut(clean.drop("_n"))), ["zone_id", "category"], "left_semi")


def active(counts: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """Rows of the series with at least so many reports in all."""
    return counts.join(counts.groupBy(*keys).agg(F.sum("y").alias("_n")).where(F.col("_n") >= least), keys, "left_semi")


def _series(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("week")


def lag_features(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Lag and trailing sums without the current week; next week's target and flag; weeks without a next one go."""
    w = _series(keys)
    m4, m12 = F.avg("y").over(w.rowsBetween(-4, -1)), F.avg("y").over(w.rowsBetween(-12, -1))
    out = panel.select(
        *keys, "week", "y", F.lag("y", 1).over(w).alias("lag_1"), F.sum("y").over(w.rowsBetween(-4, -1)).alias("sum_4"), F.round(m4, 6).alias("mean_4"),
        F.round(m12, 6).alias("mean_12"), F.round(m4 - m12, 6).alias("trend"), F.lead("y", 1).over(w).alias("target"),
    )
    return out.where("target IS NOT NULL").withColumn("target_active", F.col("target") > 0)


def current_features(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Lags, rolling means with the current week, trend, share of empty weeks, length of history, dense series number."""
    w = _series(keys)
    roll = lambda n: F.avg("y").over(w.rowsBetween(1 - n, 0))
    return panel.select(
        *keys, "week", "y", *[F.lag("y", k).over(w).alias(f"lag_{k}") for k in (1, 2, 3)], *[F.round(roll(n), 6).alias(f"roll_{n}") for n in (4, 8, 12)],
        F.round(roll(4) - roll(12), 6).alias("trend_4_12"), F.round(F.avg((F.col("y") == 0).cast("double")).over(w.rowsBetween(-11, 0)), 6).alias("zero_share_12"),
        F.row_number().over(w).alias("history"),
    )


def smoothed(y: Column, alpha: float) -> Column:
    """Exponential smoothing of an array from its first element."""
    return F.aggregate(y, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x.cast("double")).otherwise(x * alpha + s * (1 - alpha)))


def ewma(panel: DataFrame, keys: list[str], alphas: list[float]) -> DataFrame:
    """The smoothed value at every week: one array a series, and one pass over it that emits every step."""
    weeks = panel.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("week", "y"))).alias("_ys"))
    names = [f"ewma_{int(a * 100)}" for a in alphas]
    last = lambda n: f"element_at(s, -1).{n}"
    step = ", ".join(f"'{n}', IF(size(s) = 0, cast(x.y AS double), x.y * {a!r}D + {last(n)} * {1 - a!r}D)" for n, a in zip(names, alphas))
    kind = f"array<struct<week:date,y:bigint,{','.join(f'{n}:double' for n in names)}>>"
    rows = F.expr(f"aggregate(_ys, cast(array() AS {kind}), (s, x) -> array_append(s, named_struct('week', x.week, 'y', x.y, {step})))")
    out = weeks.select(*keys, F.inline(rows))
    return out.select(*keys, "week", "y", *[F.round(n, 6).alias(n) for n in names])


def forecast(df: DataFrame, cell_m: float = 1000.0, alpha: float = 0.3, now: str = "1998-08-03") -> DataFrame:
    """Next week's expected reports for each source, category and cell: the first partial and the current week of the source go,
    empty weeks count 0, and the smoothed last value is the forecast, with the last week, the 4-week mean and a status."""
    df = df.where(F.col("latitude").isNotNull() & (F.col("reported_at") < F.date_trunc("week", F.lit(now).cast("timestamp"))))
    o = df.groupBy("source_dataset").agg(F.min("latitude").alias("lat0"), F.min("longitude").alias("lon0"), F.max("latitude").alias("ref"), F.min(S.week_start(F.col("reported_at"))).alias("w0"), F.max(S.week_start(F.col("reported_at"))).alias("w1"))
    df = df.join(o, "source_dataset")
    ix, iy = S.metric_cell(*[F.col(c) for c in ("latitude", "longitude", "lat0", "lon0", "ref")], cell_m)
    df = df.withColumn("cell_id", F.concat_ws("_", ix, iy)).where(S.week_start(F.col("reported_at")) > F.col("w0"))
    keys = ["source_dataset", "category", "cell_id"]
    counts = df.groupBy(*keys, "w0", "w1", S.week_start(F.col("reported_at")).alias("week")).agg(F.count("*").alias("y"))
    # One array a series, in week order: weeks before its source's second week don't exist, later ones without reports are 0.
    arr = counts.groupBy(*keys, "w0", "w1").agg(F.map_from_entries(F.collect_list(F.struct("week", "y"))).alias("m"))
    arr = arr.withColumn("ys", F.expr("transform(sequence(date_add(w0, 7), w1, INTERVAL 7 DAYS), d -> coalesce(m[d], 0L))"))
    n = F.size("ys")
    status = F.when(n >= 4, "AVAILABLE").when(n >= 1, "EXPERIMENTAL").otherwise("UNAVAILABLE")
    return arr.select(
        *keys, F.round(smoothed(F.col("ys"), alpha), 6).alias("forecast"), F.element_at("ys", -1).alias("last_week"), n.cast("long").alias("weeks"), F.aggregate("ys", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.round(F.aggregate(F.slice("ys", -F.least(n, F.lit(4)), 4), F.lit(0).cast("long"), lambda a, x: a + x) / F.least(n, F.lit(4)), 6).alias("mean_4"), status.alias("status"),
    )


def availability(df: DataFrame, areas: list[str], categories: list[str], as_of: list[str], evaluated: list[str], cell: float = 0.01, least: int = 4) -> DataFrame:
    """For each area (source), category and day: complete weeks of history of the area, cells with reports of the category in them, the
    status of a forecast and its reasons. NO_DATA: the area has no report yet; NO_COMPLETE_WEEKS: the first, partial week and the current
    one are all there is; then INSUFFICIENT_HISTORY_WEEKS and CATEGORY_NOT_EVALUATED, which leave an experimental forecast.

    The questions are given, so they are few; reports meet those of their area."""
    spark = df.sparkSession
    one = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    days = one(as_of, "as_of").withColumn("cur", S.week_start(F.col("as_of").cast("timestamp")).cast("date"))
    asked = one(areas, "area").crossJoin(days)  # given lists
    week = S.week_start(F.col("reported_at")).cast("date")
    placed = df.where("latitude IS NOT NULL").select(F.col("source_dataset").alias("area"), "category", "reported_at", week.alias("week"), F.floor(F.col("latitude") / cell).alias("y"), F.floor(F.col("longitude") / cell).alias("x"))
    # First report of an area: before a day there is a report if and only if the first is.
    first = placed.groupBy("area").agg(F.min("reported_at").alias("first"), F.date_add(F.min("week"), 7).alias("w0"))
    told = asked.join(first, (asked.area == first.area) & (first["first"] < F.col("as_of").cast("timestamp")), "left").select(asked.area, "as_of", "cur", "w0")
    told = cut(told.withColumn("weeks", F.when(F.col("w0").isNotNull(), F.greatest(F.floor(F.date_diff(F.date_sub("cur", 7), "w0") / 7) + 1, F.lit(0))).otherwise(0).cast("long")))
    each = placed.groupBy("area", "category", "y", "x", "week").agg(F.min("reported_at").alias("at"))
    met = each.join(F.broadcast(told.where("w0 IS NOT NULL")), "area").where((F.col("at") < F.col("as_of").cast("timestamp")) & (F.col("week") >= F.col("w0")) & (F.col("week") < F.col("cur")))
    cells = met.groupBy("area", "category", "as_of", "y", "x").agg(F.lit(1)).groupBy("area", "category", "as_of").agg(F.count("*").alias("n"))
    out = told.crossJoin(F.broadcast(one(categories, "category"))).join(cells, ["area", "category", "as_of"], "left")
    known, none = F.col("category").isin(evaluated), F.col("w0").isNull()
    codes = F.concat_ws(",", F.when(F.col("weeks") < least, "INSUFFICIENT_HISTORY_WEEKS"), F.when(~known, "CATEGORY_NOT_EVALUATED"))
    return out.select(
        "area", "category", "as_of", "weeks", F.coalesce("n", F.lit(0)).alias("n_cells"),
        F.when(none | (F.col("weeks") == 0), "UNAVAILABLE").when((F.col("weeks") < least) | ~known, "EXPERIMENTAL").otherwise("AVAILABLE").alias("status"),
        F.when(none, "NO_DATA").when(F.col("weeks") == 0, "NO_COMPLETE_WEEKS").otherwise(codes).alias("reasons"),
        F.date_format("w0", "yyyy-MM-dd").alias("first_complete_week"), F.date_format(F.date_sub("cur", 7), "yyyy-MM-dd").alias("last_complete_week"))
