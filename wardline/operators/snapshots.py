"""What was known locally before a report: medians of closures and the cascade of predictions that rests on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators.quantiles import prior_quantile
from wardline.operators.storage import small

#: Closures that a local median needs.
LEAST = 10
#: Days, or minutes, of a block of running sums.
DAY_BLOCK, MINUTE_BLOCK = 64, 7 * 1440


def _hours() -> Column:
    return S.resolution_hours(S.hours_between(F.col("closed_at"), F.col("reported_at")))


def _back(asks: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of asks with what was found for their group and time."""
    own = [*keys, "minute"]
    found = found.select(*[F.col(c).alias(f"_f_{c}") for c in own], "n", "q")
    return asks.join(found, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in own]).drop(*[f"_f_{c}" for c in own])


def daily_snapshot(df: DataFrame, keys: list[str], days: int = 30, least: int = 1) -> DataFrame:
    """Median hours (of log1p, taken back) of the closures on the `days` days before each report's day, within its group, and their
    number; NULL under `least` closures. Reports of one day and group share the value."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    closed = df.where("closed_at IS NOT NULL").select(*keys, day("closed_at").alias("minute"), F.log1p(_hours()).alias("l"))
    asks = df.select("incident_id", *keys, day("reported_at").alias("minute"))
    met = _back(asks, prior_quantile(closed, asks, keys, "l", days, block=DAY_BLOCK), keys)
    return met.select("incident_id", F.when(F.col("n") >= least, F.round(F.expm1("q"), 4)).alias("median_hours"), F.col("n").alias("n_closures"))


def cascade(df: DataFrame, training_median: float, least: int = LEAST, days: int = 7) -> DataFrame:
    """Prediction by the first source with enough closures known before the report's day: the category's, all categories', training's."""
    own = daily_snapshot(df, ["source_dataset", "category"], days).toDF("incident_id", "own", "n_own")
    all_ = daily_snapshot(df, ["source_dataset"], days).toDF("incident_id", "every", "n_every")
    met = own.join(all_, "incident_id")
    value = F.when(F.col("n_own") >= least, F.col("own")).when(F.col("n_every") >= least, F.col("every")).otherwise(F.lit(training_median))
    method = F.when(F.col("n_own") >= least, "category_median").when(F.col("n_every") >= least, "all_median").otherwise("training_median")
    return met.select("incident_id", value.alias("predicted_hours"), method.alias("method"))


def local_cascade(df: DataFrame, training: DataFrame, least: int = LEAST) -> DataFrame:
    """For each report, the median duration of what was closed at strictly earlier minutes, of any age: of its category if there are
    `least`, else of all categories, else training's median of the category (category, median_hours, n), else UNAVAILABLE.

    incident_id, predicted_hours, sample_size, method."""
    base = df.select("incident_id", "category", S.minutes(F.col("reported_at")).alias("minute"), S.minutes(F.greatest("closed_at", "reported_at")).alias("c"), _hours().alias("h"), F.col("closed_at").isNotNull().alias("closed"))
    events = base.where("closed").select("category", F.col("c").alias("minute"), "h")
    asks = base.select("incident_id", "category", "minute")
    own = _back(asks, prior_quantile(events, asks, ["category"], "h", block=MINUTE_BLOCK), ["category"]).select("incident_id", "category", "minute", F.col("n").alias("n_own"), F.col("q").alias("own"))
    met = _back(own, prior_quantile(events.drop("category"), asks, [], "h", block=MINUTE_BLOCK), [])
    met = met.join(small(training.select("category", F.col("median_hours").alias("t"), F.col("n").alias("n_t"))), "category", "left")
    first = lambda a, b, c, d: F.when(F.col("n_own") >= least, a).when(F.col("n") >= least, b).when(F.col("t").isNotNull(), c).otherwise(d)
    return met.select(
        "incident_id", F.round(first(F.col("own"), F.col("q"), F.col("t"), F.lit(None)), 4).alias("predicted_hours"),
        first(F.col("n_own"), F.col("n"), F.col("n_t"), F.lit(0)).cast("long").alias("sample_size"), first(*[F.lit(x) for x in ("local_category_median", "local_median", "training_category_median", "UNAVAILABLE")]).alias("method"),
    )
