"""Pairs of incidents: near and random negatives equal brute force, rows move once, and quotas sort only what they take."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wardline.operators import duplicates as D
from wardline.operators import graph
from wardline.operators.ordering import leading, ranked
from wardline.operators.storage import cut


def rows_of(spark, n=240):
    k = F.col("id")
    df = spark.range(n).select(F.concat(F.lit("i"), k).alias("incident_id"), F.concat(F.lit("s"), k % 2).alias("split"), (k % 3 == 0).alias("linked"), F.concat(F.lit("c"), k % 4).alias("category"),
                               F.when(k % 29 > 0, 10 + 4e-4 * (k % 7)).alias("latitude"), F.when(k % 29 > 0, 20 + 4e-4 * (k % 5)).alias("longitude"), F.timestamp_seconds((k * 7919 % 300) * 86400).alias("reported_at"))
    return cut(df)


def beside_by_hand(rows, rounds=4, size=0.0018):
    groups, out = {}, set()
    for r in rows:
        if r["latitude"] is not None:
            groups.setdefault((r["split"], round(r["latitude"] / size), round(r["longitude"] / size)), []).append(r["incident_id"])
    for ids in groups.values():
        for k in range(rounds):
            line = sorted(ids, key=lambda i: (hashlib.md5(f"7{k}|{i}".encode()).hexdigest(), i))  # noqa: B023
            out |= {(min(p), max(p)) for p in zip(line, line[1:])}
    return out


@pytest.mark.parametrize("together", [1_000_000, 20, 1])
def test_rows_beside_each_other_equal_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(D, "TOGETHER", together)
    rows = rows_of(spark)
    got = {(r[0], r[1]) for r in D.beside(rows, ["split"], "7").select("_a.incident_id", "_b.incident_id").collect()}
    assert got == beside_by_hand(rows.collect())


def test_rows_move_once_for_all_orders_and_pairs_bring_their_features(spark):
    plan = D.beside(rows_of(spark), ["split"], "7")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


def test_a_quota_sorts_only_blocks_that_it_takes_from(spark):
    df = cut(spark.range(9000).select(F.concat(F.lit("g"), F.col("id") % 2).alias("g"), F.col("id"), F.md5(F.col("id").cast("string")).alias("o")))
    quota = spark.createDataFrame([("g0", 100), ("g1", 99_999), ("g2", 5)], "g string, quota long")
    want = {tuple(r) for r in ranked(df, ["g"], "o", ["id"]).join(quota, "g").where("rn <= quota").select("g", "id").collect()}
    found = leading(df, quota, ["g"], "o", ["id"])
    assert {tuple(r) for r in found.select("g", "id").collect()} == want and len(want) == 4600


def test_components_of_few_edges_move_once_a_step(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i // 3:03}") for i in range(1, 200)] + [("x2", "x1"), ("x3", "x2")], "a string, b string")
    plan = graph._starred(edges)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2 and "Join" not in plan
    for hub in (1_000, 2):
        assert {r["node"]: r["component"] for r in graph.components(edges, hub).collect()} == {**{f"n{i:03}": "n000" for i in range(200)}, "x1": "x1", "x2": "x1", "x3": "x1"}


def test_random_negatives_look_no_split_up(spark):
    rows = rows_of(spark).withColumn("g", F.lit("one"))
    known = spark.createDataFrame([("i1", "i2")], "a string, b string")
    found = D.random_negatives(rows, known, "n4", "g", ["category"])
    split = {r["incident_id"]: r["split"] for r in rows.collect()}
    cat = {r["incident_id"]: r["category"] for r in rows.collect()}
    line = sorted(split, key=lambda i: (hashlib.md5(f"n4|{i}".encode()).hexdigest(), i))
    want = {(a, b, split[a], cat[a], cat[b]) for a, b in zip(line, line[1:]) if split[a] == split[b] and {a, b} != {"i1", "i2"}}
    assert {tuple(r) for r in found.collect()} == want


def test_splits_of_lone_and_linked_rows_and_of_no_pairs(spark):
    rows = rows_of(spark).drop("linked", "split")
    pairs = spark.createDataFrame([(f"i{i}", f"i{i - 2}") for i in range(2, 200, 4)], "a string, b string")
    at = {r["incident_id"]: r["reported_at"] for r in rows.collect()}
    got = {r["incident_id"]: r for r in D.component_splits(rows, graph.components(pairs), pairs, ["category"]).collect()}
    assert len(got) == 240 and sum(r["linked"] for r in got.values()) == 100 and all(r["category"] for r in got.values())
    assert all(r["first_at"] == min(at[i] for i in at if got[i]["component"] == r["component"]) for r in got.values())
    none = D.component_splits(rows, graph.components(pairs.limit(0)), pairs.limit(0)).select("split").distinct().collect()
    assert [r["split"] for r in none] == ["unassigned"]
