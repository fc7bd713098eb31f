"""Audits of task tables against their manifests: which columns are predictors, when each is known, and what the data must show."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import audit as A

# Columns that are only known after a case is resolved, policy outputs, raw places, and marks of encodings.
POST_RESOLUTION = [
    "closed_at", "status", "sla_met", "description", "resolution_description", "status_notes", "resolution_hours", "target_log1p", "censored", "is_instant_closure",
]
POLICY_PREFIX = "priority_"
POLICY_OUTPUT = ["policy_hours"]
RAW_PLACES = ["latitude", "longitude", "lat_grid", "lon_grid", "geo_grid"]
ENCODING_MARKS = ["_frequency", "_freq", "_target_enc", "_te", "_mean_target", "_woe"]
SOURCE_SPECIFIC = ["zone_key", "zone_id", "department", "report_channel", "subcategory", "sla_target_hours"]


@dataclass(frozen=True)
class Task:
    """A task table's manifest. known: each predictor and when its value is known ("" if not stated); caveats: columns whose meaning by
    source is documented; group and time: splits must be in order of time within the group; ends: columns of entity ids."""

    name: str
    known: dict[str, str]
    target: str | None
    levels: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    caveats: list[str] = field(default_factory=list)
    group: str | None = None
    time: str | None = None
    ends: list[str] = field(default_factory=list)
    late_targets: list[str] = field(default_factory=list)


def manifest_rules(task: Task, columns: list[str]) -> dict[str, list[str]]:
    """The names that break each rule of the manifest."""
    p = list(task.known)
    return {
        "TASK-1": [c for c in p if c not in columns],
        "TASK-3": [] if task.target else ["target"],
        "TL-1": [c for c in p if task.target and c.startswith(task.target)],
        "TL-2": [c for c in p if c in POST_RESOLUTION],
        "TL-3": [c for c in p if c.startswith(POLICY_PREFIX) or c in POLICY_OUTPUT],
        "TL-4": [c for c in p if c in RAW_PLACES],
        "TL-5a": [c for c in p if any(m in c for m in ENCODING_MARKS)],
        "TL-6": [c for c, when in task.known.items() if not when],
        "TL-10": [c for c in p if c in SOURCE_SPECIFIC and c not in task.caveats],
        "TL-12": [c for c in p if c == "sla_target_hours" and c not in task.late_targets],
    }


def lookups(df: DataFrame, levels: list[str], numbers: list[str]) -> DataFrame:
    """check_id TL-5: pairs of a categorical column and a number that is only a table over its levels: constant within each of more than
    three levels and, unlike a number that merely goes with them, of nearly as many values as levels (0.9).

    One aggregation by levels for each categorical column, over all rows; no task holds a level's rows."""
    parts = []
    for c in levels:
        ends = [x for n in numbers for x in (F.min(n).alias(f"{n}__a"), F.max(n).alias(f"{n}__b"))]
        per = df.where(F.col(c).isNotNull()).groupBy(c).agg(*ends)
        bad = []
        for n in numbers:
            same, values = F.count_if(F.col(f"{n}__a") != F.col(f"{n}__b")) == 0, F.count_distinct(f"{n}__a")
            bad.append(((F.count("*") > 3) & same & (values >= 0.9 * F.count("*"))).cast("long").alias(n))
        row = per.agg(*bad)
        parts.append(row.select(sum((F.col(n) for n in numbers), F.lit(0)).alias("bad")))
    total = A.stacked(parts).agg(F.sum("bad").alias("bad"))
    return total.select(F.lit("TL-5").alias("check_id"), F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("status"), F.col("bad").cast("long").alias("bad"))


def data_rules(df: DataFrame, task: Task) -> DataFrame:
    """The rules that need the rows: predictors vary (least and greatest value differ, so no distinct values are held), the target has
    values, no predictor is a table over a category, parts are not empty and follow each other, no entity is in two parts."""
    have = [c for c in task.known if c in df.columns]
    varies = [F.when(F.min(c) < F.max(c), 0).otherwise(1) for c in have]
    row = df.agg(sum(varies, F.lit(0)).cast("long").alias("TASK-2"), F.when(F.count(task.target) > 0, 0).otherwise(1).cast("long").alias("TASK-4"))
    bad = F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(f"`{n}`").alias("bad")) for n in ("TASK-2", "TASK-4")])
    found = row.select(F.explode(bad).alias("x")).select("x.*")
    parts = [found.select("check_id", F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("status"), "bad")]
    if task.levels and task.numbers:
        parts.append(lookups(df, task.levels, task.numbers))
    if "split" in df.columns:
        parts.append(A.conditions(df, {"TL-11": F.count_if(F.col("split").isin("train", "val", "test")) > 0, **{
            f"TL-11/{s}": F.count_if(F.col("split") == s) > 0 for s in ("train", "val", "test")}}))
        if task.ends:
            ends = A.stacked([df.select(F.col(c).alias("entity"), "split") for c in task.ends])
            spans = ends.groupBy("entity").agg(F.min("split").alias("a"), F.max("split").alias("b"))
            parts.append(A.checks(spans, {"TL-8": F.col("a") == F.col("b")}))
        if task.group and task.time:
            at = lambda f, s: f(F.when(F.col("split") == s, F.col(task.time)))
            g = df.groupBy(task.group).agg(at(F.max, "train").alias("a"), at(F.min, "val").alias("b"), at(F.max, "val").alias("c"), at(F.min, "test").alias("d"))
            in_order = F.coalesce(F.col("a") <= F.col("b"), F.lit(True)) & F.coalesce(F.col("c") <= F.col("d"), F.lit(True))
            parts.append(A.checks(g, {"TL-11b": in_order}))
    return A.stacked(parts)


def agrees(df: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """check_id TL-7: joined features are those of their feature table, row by row (NULL equals NULL)."""
    src = source.select(key, *[F.col(c).alias(f"{c}__src") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"{c}__src")) for c in columns]
    ok = same[0]
    for s in same[1:]:
        ok = ok & s
    return A.checks(df.select(key, *columns).join(src, key, "left"), {"TL-7": ok})


def audit(df: DataFrame, task: Task) -> DataFrame:
    """task, check_id, status and bad for all rules of a task table."""
    rows = A.stacked([A.named(df.sparkSession, manifest_rules(task, df.columns)), data_rules(df, task)])
    return rows.select(F.lit(task.name).alias("task"), "check_id", "status", "bad")
