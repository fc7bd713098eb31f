"""All queries of the civic-incident operators with their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.plans import base

for _name in ("normalise", "hotspots", "asof", "evaluation", "tables", "workflow", "cities", "learned", "audits", "monitoring", "gates", "feeds", "baselines", "pipeline_audit", "statistics"):
    importlib.import_module(f"wardline.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return base.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["so3_top_cells"](spark, sf_dir)
