"""Audits find what is planted: each fault is counted under its own rule, and tables in order pass."""

import pytest

from wardline.operators import audit as A
from wardline.operators import mapping
from wardline.operators import panel as P
from wardline.operators import statistics as ST
from wardline.operators import task_audit as T

TASK = T.Task("t", {"kind": "at intake", "size": "at intake"}, "hours", ["kind"], ["size"], [], "src", "at", ["id"])


def rows(spark, faulty=False):
    data = [(i, "s", "abcde"[i % 5], float((i * 7) % 11), float(i), "train" if i < 12 else "val" if i < 16 else "test", i) for i in range(20)]
    if faulty:
        data.append((0, "s", "a", 3.0, 1.0, "test", 0))  # an entity in two parts, and a test row before training ends
    return spark.createDataFrame(data, "id long, src string, kind string, size double, hours double, split string, at long")


def result(df):
    return {r.check_id: (r.status, r.bad) for r in df.collect()}


def test_task_in_order_passes(spark):
    assert {s for s, _ in result(T.audit(rows(spark), TASK)).values()} == {"PASS"}


def test_planted_faults_fail_their_own_rules(spark):
    got = result(T.audit(rows(spark, True), TASK))
    assert {n for n, (s, _) in got.items() if s == "FAIL"} == {"TL-8", "TL-11b"}
    bad = T.Task("t", {"kind": "", "gone": "x", "hours_log": "x", "latitude": "x", "priority_band": "x", "closed_at": "x", "kind_freq": "x", "zone_id": "x", "sla_target_hours": "x"}, "hours")
    m = T.manifest_rules(bad, rows(spark).columns)
    assert m["TL-6"] == ["kind"] and m["TL-1"] == ["hours_log"] and m["TL-2"] == ["closed_at"] and m["TL-3"] == ["priority_band"]
    assert m["TL-4"] == ["latitude"] and m["TL-5a"] == ["kind_freq"] and m["TL-10"] == ["zone_id", "sla_target_hours"] and m["TL-12"] == ["sla_target_hours"]


@pytest.mark.parametrize("value, bad", [("kind_no * 1.5", 1), ("kind_no div 3", 0), ("id * 1.0", 0)])
def test_lookup_is_told_from_what_merely_goes_along(spark, value, bad):
    df = spark.range(60).selectExpr("id", "id % 6 AS kind_no", "concat('k', id % 6) AS kind").selectExpr("kind", f"CAST({value} AS DOUBLE) AS n")
    assert T.lookups(df, ["kind"], ["n"]).collect()[0].bad == bad


def test_joined_features_must_agree(spark):
    src = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "id long, n double")
    used = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (4, 1.0)], "id long, n double")
    assert result(T.agrees(used, src, "id", ["n"])) == {"TL-7": ("FAIL", 2)}


def test_coverage_counts_missing_and_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,), (2,), (2,)], "id long"), spark.createDataFrame([(1,), (3,)], "id long")
    got = {r.id: (r.n_left, r.n_right) for r in A.coverage(left, right, "id").collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (0, 1)}


def test_tables_without_rows(spark):
    empty = rows(spark).where("id < 0")
    got = result(T.audit(empty, TASK))
    assert got["TASK-4"] == ("FAIL", 1) and got["TASK-2"] == ("FAIL", 2) and got["TL-8"] == ("PASS", 0)
    assert ST.level_drift(empty, ["kind"]).count() == 0 and ST.number_drift(empty, ["size"]).count() == 0


def test_mapping_rules(spark):
    dim = spark.createDataFrame([
        ("s", "a", "POTHOLE", "high", ""), ("s", "a", "POTHOLE", "low", None), ("s", "b", "NEW", "sure", ""), ("s", "d", "OPEN", "high", ""), ("t", "e", "UNMAPPED", "none", "")],
        "source_dataset string, source_category string, category string, confidence string, notes string")
    got = result(mapping.audit(dim, ["POTHOLE", "OPEN", "TREE"], ["UNMAPPED"], [("d", "OPEN")]))
    assert got == {"MAP-1": ("FAIL", 1), "MAP-2": ("FAIL", 2), "MAP-3": ("FAIL", 1), "MAP-4": ("FAIL", 1), "MAP-5": ("FAIL", 1), "MAP-6": ("COVERAGE_GAP", 1)}


def test_drift_needs_values_and_finds_a_shift(spark):
    df = spark.range(1200).selectExpr(
        "CASE WHEN id < 600 THEN 'train' WHEN id < 900 THEN 'val' ELSE 'test' END AS split", "IF(id >= 900, 'new', concat('l', id % 3)) AS level",
        "CAST(id % 50 + IF(id >= 900, 25, 0) AS DOUBLE) AS moved", "CAST(id % 50 AS DOUBLE) AS still", "IF(id % 300 < 50, 1D, NULL) AS rare")
    got = {r["column"]: r for r in ST.drift(df, ["level"], ["moved", "still", "rare"]).collect()}
    assert (got["level"].val, got["level"].test, got["level"].severity) == (0.0, 1.0, ST.PREPARE)
    assert got["moved"].val < 0.01 and got["moved"].test > 0.25 and got["moved"].severity == ST.PREPARE
    assert got["still"].severity == ST.SAFE and got["rare"].val is None


def test_findings(spark):
    df = spark.range(1000).selectExpr("concat('g', id % 2) AS g", "CAST(NULL AS STRING) AS nothing", "'x' AS same", "IF(id = 0, 'a', 'b') AS nearly", "IF(id % 2 = 0, id, NULL) AS tells", "id % 7 AS fine")
    got = {(r["column"], r.issue, r.severity) for r in ST.column_findings(df, ["nothing", "same", "nearly", "tells", "fine"], "g").collect()}
    assert got == {("nothing", "entirely null", ST.DANGER), ("same", "constant", ST.DANGER), ("nearly", "near-constant", ST.PREPARE), ("tells", "missingness tells g", ST.PREPARE)}


def test_reasons_of_forecasts(spark):
    df = spark.createDataFrame([("a", "P", "2024-01-03 10:00:00", 1.0, 2.0), ("a", "P", "2024-01-10 10:00:00", 1.0, 2.0)], "source_dataset string, category string, t string, latitude double, longitude double")
    df = df.selectExpr("source_dataset", "category", "CAST(t AS TIMESTAMP) AS reported_at", "latitude", "longitude")
    got = {(r.area, r.category, r.as_of): (r.status, r.reasons, r.weeks, r.n_cells) for r in P.availability(df, ["a", "b"], ["P", "Q"], ["2024-01-10", "2024-01-20", "2024-03-01"], ["P"]).collect()}
    assert got["b", "P", "2024-03-01"] == ("UNAVAILABLE", "NO_DATA", 0, 0)
    assert got["a", "P", "2024-01-10"] == ("UNAVAILABLE", "NO_COMPLETE_WEEKS", 0, 0)
    assert got["a", "P", "2024-01-20"] == ("EXPERIMENTAL", "INSUFFICIENT_HISTORY_WEEKS", 1, 1)  # the week of 8 January is whole
    assert got["a", "P", "2024-03-01"] == ("AVAILABLE", "", 7, 1)
    assert got["a", "Q", "2024-03-01"][:2] == ("EXPERIMENTAL", "CATEGORY_NOT_EVALUATED")


def test_outputs_are_audited_without_counting_density_again(spark, sf):
    from wardline.plans import pipeline_audit

    plan = pipeline_audit.output_rules(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan


def test_task_rules_keep_only_the_columns_of_the_tasks(spark, sf, monkeypatch):
    from wardline.plans import pipeline_audit

    kept = []
    monkeypatch.setattr(pipeline_audit, "cut", lambda df: kept.append(set(df.columns)) or df)
    pipeline_audit.task_rules(spark, sf)
    assert kept and not any(c & {"closed_at", "zone_id", "is_duplicate", "parent_key", "n_24h"} for c in kept if "zone_key" not in c)


def test_density_is_counted_again_without_meeting_all_rows(spark, sf):
    from wardline.plans import pipeline_audit

    plan = pipeline_audit.density_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
