"""Dimension lookups: two-tier category maps, ordered rules with wildcards, fuzzy candidates by token overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators import audit as A


def map_categories(df: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """`raw|sub` before `raw`, else UNMAPPED; the map is a small dimension given by the caller."""
    dim = df.sparkSession.createDataFrame(mapping, "_raw string, _cat string")
    pair, single = dim.select(F.col("_raw").alias("_r2"), F.col("_cat").alias("_c2")), dim.select(F.col("_raw").alias("_r1"), F.col("_cat").alias("_c1"))
    out = df.join(F.broadcast(pair), F.concat("source_category_raw", F.lit("|"), "subcategory") == F.col("_r2"), "left")
    out = out.join(F.broadcast(single), F.col("source_category_raw") == F.col("_r1"), "left")
    return out.withColumn("category", F.coalesce("_c2", "_c1", F.lit("UNMAPPED"))).drop("_r1", "_r2", "_c1", "_c2")


def first_match(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """The first rule (order, source, raw, sub or `*`, category, confidence) that fits; none leaves NULL, which is not UNSUPPORTED."""
    dim = df.sparkSession.createDataFrame(rules, "_ord int, _src string, _raw string, _sub string, _cat string, _conf string")
    # One row for each (source, raw value), its rules in order: the join keeps one row an incident.
    dim = dim.groupBy("_src", "_raw").agg(F.array_sort(F.collect_list(F.struct("_ord", "_sub", "_cat", "_conf"))).alias("_rules"))
    out = df.join(F.broadcast(dim), (F.col("source_dataset") == F.col("_src")) & (F.col("source_category_raw") == F.col("_raw")), "left")
    hit = F.expr("get(filter(_rules, r -> r._sub = '*' OR r._sub = subcategory), 0)")
    return out.withColumn("_hit", hit).select(*df.columns, F.col("_hit._cat").alias("app_category"), F.col("_hit._conf").alias("confidence"), F.col("_hit._ord").alias("rule_order"))


def fuzzy_candidates(unmapped: DataFrame, known: DataFrame, margin: float = 0.1) -> DataFrame:
    """Best category for each unmapped value by Jaccard of tokens (1.25 times for the same publisher), with tier and alternatives.

    unmapped: value, publisher, tokens; known: text, publisher, category, tokens. Only pairs that share a token meet."""
    u = unmapped.select("value", F.col("publisher").alias("up"), F.col("tokens").alias("ut"), F.explode("tokens").alias("tok"))
    k = known.select("text", F.col("publisher").alias("kp"), "category", F.col("tokens").alias("kt"), F.explode("tokens").alias("tok"))
    met = u.join(k, "tok").drop("tok").distinct()
    jac = F.size(F.array_intersect("ut", "kt")) / F.size(F.array_union("ut", "kt"))
    met = met.withColumn("score", jac * F.when(F.col("up") == F.col("kp"), 1.25).otherwise(1.0))
    best = met.groupBy("value", "category").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rn", F.row_number().over(Window.partitionBy("value").orderBy(F.desc("score"), "category")))
    top = ranked.where("rn <= 5").groupBy("value").agg(
        F.max(F.when(F.col("rn") == 1, F.col("category"))).alias("best"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"),
        F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn").between(2, 4), F.struct("rn", "category")))), lambda x: x["category"]), "|").alias("alternatives"),
    )
    gap = F.col("score") - F.col("second")
    tier = F.when((F.col("score") >= 0.5) & (gap >= margin), "high").when((F.col("score") >= 0.3) & (gap >= margin / 2), "medium").when(F.col("score") > 0, "low").otherwise("none")
    return top.withColumn("tier", tier)


def audit(dim: DataFrame, canonical: list[str], sentinels: list[str], never: list[tuple[str, str]]) -> DataFrame:
    """MAP-1 to MAP-6 over a mapping dimension (source_dataset, source_category, category, confidence, notes): known targets, one row a
    source and value, valid confidence, weak mappings reviewed or sent to a sentinel, pairs that must never occur. Canonical categories
    that no source reaches are a COVERAGE_GAP, which is a fact about the sources and no failure."""
    weak = F.col("confidence").isin("low", "none") & ~F.col("category").isin(sentinels)
    wrong = F.lit(False)
    for value, category in never:
        wrong = wrong | ((F.col("source_category") == value) & (F.col("category") == category))
    rows = A.checks(dim, {
        "MAP-1": F.col("category").isin([*canonical, *sentinels]), "MAP-3": F.col("confidence").isin("high", "medium", "low", "none", ""),
        "MAP-4": ~weak | F.upper(F.coalesce("notes", F.lit(""))).contains("REVIEW"), "MAP-5": ~F.coalesce(wrong, F.lit(False)),
    })
    twice = dim.groupBy("source_dataset", "source_category").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("bad"))
    want = dim.sparkSession.createDataFrame([(c,) for c in canonical], "category string")
    gaps = want.join(dim.select("category").distinct(), "category", "left_anti").agg(F.count("*").alias("bad"))
    one = lambda df, n, status: df.select(F.lit(n).alias("check_id"), F.when(F.col("bad") == 0, "PASS").otherwise(status).alias("status"), "bad")
    return A.stacked([rows, one(twice, "MAP-2", "FAIL"), one(gaps, "MAP-6", "COVERAGE_GAP")])
