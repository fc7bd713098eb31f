"""Readers, guards, clocks and graphs on small planted inputs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import bootstrap, duplicates, graph, metrics, workflow
from wardline.sources import feeds, schema


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json_lines_drop_or_keep_broken_rows(spark, tmp_path):
    p = tmp_path / "feed.jsonl"
    p.write_text('{"id": 1, "name": "a"}\n\n{"id": broken\n{"id": 2, "name": "b"}\n')
    assert rows(feeds.read_feed(spark, str(p), columns=["id", "name"])) == [("1", "a"), ("2", "b")]
    kept = feeds.read_feed(spark, str(p), columns=["id", "name"], keep_corrupt=True).cache()
    assert kept.where("_corrupt_record IS NOT NULL").count() == 1


def test_text_formats_and_gzip_give_strings(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Id\tName\n1\tx\n")
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("Id,Name\n2,y\n")
    (tmp_path / "a.json").write_text(json.dumps([{"id": 3, "name": "z"}]))
    assert rows(feeds.read_feed(spark, str(tmp_path / "a.tsv"))) == [("1", "x")]
    assert rows(feeds.read_feed(spark, str(tmp_path / "a.csv.gz"))) == [("2", "y")]
    assert rows(feeds.read_feed(spark, str(tmp_path / "a.json"))) == [("3", "z")]


def test_yearly_files_with_drifting_headers(spark, tmp_path):
    (tmp_path / "2020.csv").write_text("CASE ID,Type\n1,a\n")
    (tmp_path / "2021.csv").write_text("case_id,Ward\n2,w\n")
    df = feeds.read_yearly(spark, [str(tmp_path / "2020.csv"), str(tmp_path / "2021.csv")])
    assert {tuple(r[c] for c in ("case_id", "type", "ward")) for r in df.collect()} == {("1", "a", None), ("2", None, "w")}


def test_quarantine_keeps_every_row_with_a_reason(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "id int, x double")
    good, bad = feeds.quarantine(df, {"positive": F.col("x") > 0})
    assert rows(good) == [(1, 5.0)] and sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_locked_append_and_metadata(spark, tmp_path):
    want = [("id", "bigint"), ("x", "double"), ("source_dataset", "string")]
    feeds.append(spark.createDataFrame([("1", "2.5", "s")], "id string, x string, source_dataset string"), str(tmp_path / "t"), want)
    feeds.append(spark.createDataFrame([("7", "s")], "id string, source_dataset string"), str(tmp_path / "t"), want)
    assert rows(spark.read.parquet(str(tmp_path / "t")).select("id", F.coalesce("x", F.lit(0.0)))) == [(1, 2.5), (7, 0.0)]
    meta = feeds.write_with_meta(spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string"), str(tmp_path), "m").collect()[0]
    assert (meta["rows"], meta["splits"]) == (2, "test,train")


def test_provenance_guard_rejects_invented_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, severity string")
    assert schema.assert_null_fields_empty(df, ["severity"]) is df
    with pytest.raises(schema.ProvenanceError):
        schema.assert_null_fields_empty(df.withColumn("severity", F.lit("high")), ["severity"])
    with pytest.raises(ValueError):
        schema.assert_allowed(df, {"id"})


def test_local_times_in_gaps_and_overlaps(spark):
    df = spark.createDataFrame([("2021-03-14 02:30:00",), ("2021-11-07 01:30:00",), ("2021-06-01 12:00:00",), ("soon",), ("1999-01-01 00:00:00",)], "t string")
    got = [r[0] for r in df.select(F.date_format(S.parse_local(F.col("t"), F.lit("America/New_York"), "2022-01-01"), "MM-dd HH:mm")).collect()]
    assert got == ["03-14 07:00", "11-07 05:30", "06-01 16:00", None, None]


def test_unknown_stays_unknown(spark):
    df = spark.createDataFrame([(None, None)], "h double, s string")
    assert tuple(df.select(S.instant_closure(F.col("h")), S.resolution_hours(F.col("h")), S.normalise_status(F.col("s")), S.clean_text(F.lit("N/A"))).collect()[0]) == (None, None, "other", None)


def test_components_follow_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_known_pairs_are_removed_in_either_order(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    known = spark.createDataFrame([("b", "a")], "a string, b string")
    assert rows(duplicates.without(pairs, known).select("a", "b")) == [("c", "d")]


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.9), ("x", 1, 0.4), ("x", 0, 0.1)], "g string, y int, p double")
    r = metrics.ranking(df, ["g"]).collect()[0]
    assert r["roc_auc"] == 0.625 and abs(r["average_precision"] - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-6


def test_bootstrap_interval_holds_its_middle(spark):
    df = spark.range(500).selectExpr("id % 50 AS c", "CAST(id % 7 AS double) AS g")
    r = bootstrap.paired_bootstrap(df, "c", F.col("g")).collect()[0]
    assert r["low"] <= r["mid"] <= r["high"] and 2 < r["mid"] < 4


def test_every_row_has_its_place_in_the_total_order(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 50 AS at", "id", "'x' AS other").repartition(7)
    out = workflow.stable_order(df, ["at", "id"])
    assert out.columns == ["at", "id", "other", "place"]
    assert [r["place"] for r in sorted(out.collect(), key=lambda r: (r["at"], r["id"]))] == list(range(1, 5001))
    assert workflow.stable_order(df.limit(0), ["at", "id"]).count() == 0


def test_each_planted_value_is_told_from_the_others(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, name string, blank string")
    got = {r["attack"]: (r["n_filled"], r["rejected"], r["status"]) for r in schema.attacked(df, {"blank": F.col("name"), "gone": F.lit(1), "id": F.lit(3)}, ["blank", "gone"]).collect()}
    assert got == {"passive:blank": (0, False, "PASS"), "passive:gone": (0, False, "PASS"), "active:blank": (1, True, "PASS"), "active:gone": (2, True, "PASS"), "active:id": (2, False, "FAIL")}
    assert {r["status"] for r in schema.attacked(df, {}, ["name"]).collect()} == {"FAIL"}


def test_repeated_ids_are_refused(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    assert schema.assert_unique(df, "id") is df
    with pytest.raises(ValueError, match="2"):
        schema.assert_unique(df.union(df.where("id = 2")), "id")
