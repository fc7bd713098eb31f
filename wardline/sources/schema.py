"""Schemas with provenance: conforming frames to them and guarding columns that must stay empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conform(df: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """The schema's columns in order, try-cast; absent ones are typed NULLs."""
    return df.select(*[(F.col(n).try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in schema])


class ProvenanceError(ValueError):
    """A column that no source can fill holds values."""


def assert_null_fields_empty(df: DataFrame, fields: list[str]) -> DataFrame:
    """df itself, if every field is entirely NULL; else an error with the counts."""
    have = [f for f in fields if f in df.columns]
    if have:
        row = df.agg(*[F.count(f).alias(f) for f in have]).collect()[0].asDict()
        if bad := {f: n for f, n in row.items() if n}:
            raise ProvenanceError(f"fields without provenance hold values: {bad}")
    return df


def assert_allowed(df: DataFrame, allowed: set[str], forbidden: set[str] = frozenset()) -> DataFrame:
    """df itself, if its columns are all registered as known at prediction time and none is forbidden."""
    bad = sorted(c for c in df.columns if c in forbidden or c not in allowed)
    if bad:
        raise ValueError(f"columns not allowed as predictors: {bad}")
    return df


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df itself, if no value of the key occurs twice; else an error that names the first ones. NULL keys count as one value."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key).limit(5).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {[r[key] for r in twice]}")
    return df


def attacked(df: DataFrame, fields: dict[str, Column], guarded: list[str]) -> DataFrame:
    """One row for each attack: a field without provenance that is filled by an expression, the rows that it fills, and whether the
    guard on `guarded` rejects it. A field that no attack fills is the passive check: it must be empty as it is.

    All attacks are counted in one pass, each on the frame as it would be with that one field filled."""
    blank = [F.count(F.col(f)).alias(f"_own_{f}") if f in df.columns else F.lit(0).cast("long").alias(f"_own_{f}") for f in guarded]
    row = df.agg(*blank, *[F.count(e).alias(f"_hit_{f}") for f, e in fields.items()])
    rest = lambda f: [F.col(f"_own_{g}") for g in guarded if g != f]
    checks = [F.struct(F.lit(f"passive:{f}").alias("attack"), F.col(f"_own_{f}").alias("n_filled"), (F.col(f"_own_{f}") > 0).alias("rejected")) for f in guarded]
    for f in fields:
        filled = F.col(f"_hit_{f}") if f in guarded else F.lit(0).cast("long")
        others = reduce(lambda a, b: a + b, rest(f), F.lit(0).cast("long"))
        checks.append(F.struct(F.lit(f"active:{f}").alias("attack"), F.col(f"_hit_{f}").alias("n_filled"), (filled + others > 0).alias("rejected")))
    out = row.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
    # A passive check passes if nothing is rejected; an attack that fills rows passes if it is.
    ok = F.when(F.col("attack").startswith("passive"), ~F.col("rejected")).otherwise((F.col("n_filled") == 0) | F.col("rejected"))
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))
