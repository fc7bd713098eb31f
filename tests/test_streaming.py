"""Streams over small files give what the batch gives."""

import datetime as dt

from pyspark.sql import functions as F

from wardline.streaming import feeds

DAY = dt.datetime(2024, 1, 1)  # a Monday


def drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def parquet(spark, path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return f"{path}/*"


def test_ingestion_runs_once_for_each_file(spark, tmp_path):
    src = parquet(spark, str(tmp_path / "in"), [[(1, "Open")], [(2, "CLOSED")]], "id int, status string")
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        feeds.ingest(feeds.file_stream(spark, src, schema), lambda df: df.withColumn("status", F.lower("status")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "open"), (2, "closed")]


def test_weeks_start_on_monday(spark, tmp_path):
    src = parquet(spark, str(tmp_path / "in"), [[(DAY, "a"), (DAY + dt.timedelta(days=6), "a"), (DAY + dt.timedelta(days=7), "a")]], "reported_at timestamp, cell string")
    drain(feeds.weekly_counts(feeds.file_stream(spark, src, spark.read.parquet(src).schema), ["cell"]), "complete", "weekly")
    assert sorted((str(r["week"]), r["y"]) for r in spark.table("weekly").collect()) == [("2024-01-01", 2), ("2024-01-08", 1)]


def test_log_rows_come_once_and_first_closures_are_earliest(spark, tmp_path):
    src = parquet(spark, str(tmp_path / "log"), [[("i", "k", DAY), ("i", "k", DAY)], [("i", "k", DAY), ("j", "k", DAY)]], "incident_id string, dedupe_key string, at timestamp")
    drain(feeds.once_each(feeds.file_stream(spark, src, spark.read.parquet(src).schema, files_each=1), ["incident_id", "dedupe_key"], "at"), "append", "once")
    assert sorted(r[0] for r in spark.table("once").collect()) == ["i", "j"]
    src = parquet(spark, str(tmp_path / "st"), [[("i", "closed", DAY + dt.timedelta(1)), ("i", "open", DAY), ("i", "closed", DAY + dt.timedelta(3))]], "incident_id string, status string, changed_at timestamp")
    drain(feeds.first_closures(feeds.file_stream(spark, src, spark.read.parquet(src).schema)), "complete", "closures")
    assert spark.table("closures").collect()[0]["first_closed_at"] == DAY + dt.timedelta(1)


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    at = lambda d: DAY + dt.timedelta(days=d)
    src = parquet(spark, str(tmp_path / "late"), [[(at(1), "a"), (at(2), "a")], [(at(60), "a")], [(at(61), "a")], [(at(3), "a"), (at(55), "a")], [(at(120), "a")], [(at(121), "a")]], "reported_at timestamp, cell string")
    q = feeds.weekly_counts(feeds.file_stream(spark, src, spark.read.parquet(src).schema, files_each=1), ["cell"]).writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r["week"]): r["y"] for r in spark.table("late").collect()}
    assert got["2024-01-01"] == 2 and feeds.late_rows(q) == 1  # day 3 came after day 60 had moved the watermark past its week, and a batch had seen that
    assert got["2024-02-19"] == 1 and got["2024-02-26"] == 2  # day 55 was in time


def test_first_closures_in_update_mode_survive_a_restart(spark, tmp_path):
    schema = "incident_id string, status string, changed_at timestamp"
    out, ck, src = str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "st")
    at = lambda d: DAY + dt.timedelta(days=d)
    parquet(spark, src, [[("i", "closed", at(5)), ("j", "open", at(1))]], schema)
    read = lambda: feeds.file_stream(spark, src + "/*", spark.read.parquet(src + "/*").schema, files_each=1)
    feeds.keep_closures(read(), out, ck).awaitTermination()
    spark.createDataFrame([("i", "closed", at(2)), ("j", "closed", at(4))], schema).coalesce(1).write.parquet(f"{src}/9")
    for _ in range(2):  # goes on where it stopped; a run without new files changes nothing
        feeds.keep_closures(read(), out, ck).awaitTermination()
        assert {r["incident_id"]: r["first_closed_at"] for r in feeds.closures_of(spark, out).collect()} == {"i": at(2), "j": at(4)}
    feeds.first_closures(spark.read.parquet(f"{src}/9")).write.mode("overwrite").parquet(f"{out}/batch=1")  # the last batch once more
    assert feeds.closures_of(spark, out).count() == 2
