"""Reference points and the registry of providers of point features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVIDERS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {}


def poi_layer(supplier: DataFrame) -> DataFrame:
    """Suppliers as points; coordinates come as text, and rows without numeric ones go."""
    lat = F.when(F.col("s_suppkey") % 13 != 0, (10 + 5 * (F.col("s_suppkey") % 5) + F.lit(2e-2) * (F.col("s_suppkey") % 11)).cast("string")).otherwise("n/a")
    lon = (20 + F.lit(2e-2) * (F.col("s_suppkey") % 7)).cast("string")
    df = supplier.select("s_suppkey", F.round(lat.try_cast("double"), 6).alias("lat"), F.round(lon.try_cast("double"), 6).alias("lon"))
    return df.dropna(subset=["lat", "lon"])


def provider(name: str):
    def add(f):
        PROVIDERS[name] = f
        return f

    return add


@provider("null")
def null_provider(df: DataFrame, layers: list[str]) -> DataFrame:
    """Every declared column as a typed NULL."""
    return df.select("*", *[c for k in layers for c in (F.lit(None).cast("double").alias(f"dist_{k}_m"), F.lit(None).cast("boolean").alias(f"near_{k}"))])
