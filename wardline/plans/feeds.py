"""Queries of feeds and sinks: tables written in each format to the shared folder and read back, quarantine, provenance attacks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline.operators.storage import cut, shared_folder
from wardline.plans.base import INC, incidents, register, table, with_
from wardline.plans.evaluation import _SPLIT, splits
from wardline.sources import feeds
from wardline.sources.schema import attacked


def _folder(spark) -> str:
    """A new folder for one query's files. It must outlive the query's plan, so it goes with the checkpoint folder."""
    return f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"


_FORMATS = ["jsonl", "json_gz", "csv", "csv_gz", "tsv", "parquet"]


@register("src1_src6_formats", f"""SELECT f.format, CAST(p_partkey AS VARCHAR) AS part, p_name AS name, CAST(p_size AS VARCHAR) AS size
FROM part, (VALUES {", ".join(f"('{f}')" for f in _FORMATS)}) AS f(format)""")
def formats(spark, d):
    """Every part as it comes back from each text format, plain and compressed, and from Parquet, all as strings."""
    folder = _folder(spark)
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("part"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("size"))
    columns, out = p.columns, None
    for f in _FORMATS:
        path, zipped = f"{folder}/{f}", f.endswith("_gz")
        kind = f.removesuffix("_gz").replace("jsonl", "json")
        writer = p.write.option("compression", "gzip" if zipped else "none" if kind != "parquet" else "snappy")
        if kind in ("csv", "tsv"):
            writer.options(header=True, escape='"', sep="\t" if kind == "tsv" else ",").csv(path)
        else:
            writer.format(kind).save(path)
        back = feeds.read_feed(spark, path, "jsonl" if kind == "json" else kind, columns=columns).select(F.lit(f).alias("format"), *columns)
        out = back if out is None else out.unionByName(back)
    return out


@register("src7_drifting_headers", """SELECT o_orderkey % 3 + 2020 AS feed_year, CAST(o_orderkey AS VARCHAR) AS case_id, o_orderstatus AS case_status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS ward FROM orders""")
def drifting_headers(spark, d):
    """Yearly files whose headers differ in case, spaces and columns, as one table."""
    folder = _folder(spark)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    heads = [["CASE ID", "Case-Status"], ["case_id", "case_status", "Ward"], ["Case Id", "CASE_STATUS", "WARD"]]
    for i, names in enumerate(heads):
        o.where(F.col("k") % 3 == i).select("k", "s", "p").toDF("k", "s", "p").select(*[F.col(c).alias(n) for c, n in zip("ksp", names)]).write.option("header", True).csv(f"{folder}/{2020 + i}")
    df = feeds.read_yearly(spark, [f"{folder}/{2020 + i}" for i in range(3)])
    return df.select((F.col("case_id").cast("long") % 3 + 2020).alias("feed_year"), "case_id", "case_status", "ward")


_LOCKED = [("incident_id", "string"), ("source_dataset", "string"), ("resolution_hours", "double"), ("k", "bigint")]


@register("snk1_locked_schema", with_("SELECT incident_id, source_dataset, resolution_hours, k FROM inc", INC))
def locked_schema(spark, d):
    """Three chunks with drifting types and columns, appended under the first one's schema, by source."""
    path = f"{_folder(spark)}/incidents"
    i = cut(incidents(spark, d).select("incident_id", "source_dataset", "resolution_hours", "k"))
    chunks = [i.where("k % 3 = 0"), i.where("k % 3 = 1").withColumns({"k": F.col("k").cast("string"), "extra": F.lit("x")}), i.where("k % 3 = 2").withColumn("resolution_hours", F.col("resolution_hours").cast("string"))]
    for c in chunks:
        feeds.append(c, path, _LOCKED)
    return spark.read.schema(", ".join(f"{n} {t}" for n, t in _LOCKED)).parquet(path)


@register("snk2_quarantine", with_("""SELECT coalesce(nullif(concat_ws(',', CASE WHEN latitude IS NULL THEN 'location' END, CASE WHEN raw_hours < 0 THEN 'duration' END, CASE WHEN category = 'UNMAPPED' THEN 'category' END), ''), 'kept') AS reason, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM inc GROUP BY 1""", INC))
def quarantine_sink(spark, d):
    """Rows that break rules, written by reason and read back, beside the kept ones: nothing is lost."""
    path = _folder(spark)
    i = cut(incidents(spark, d).select("k", "latitude", "raw_hours", "category", "source_dataset"))
    good, bad = feeds.quarantine(i, {"location": F.col("latitude").isNotNull(), "duration": F.coalesce(F.col("raw_hours") >= 0, F.lit(True)), "category": F.col("category") != "UNMAPPED"})
    good.write.parquet(f"{path}/kept")
    bad.write.partitionBy("source_dataset", "_quarantine_reason").parquet(f"{path}/quarantine")
    back = spark.read.parquet(f"{path}/quarantine").select(F.col("_quarantine_reason").cast("string").alias("reason"), "k")
    return back.unionByName(spark.read.parquet(f"{path}/kept").select(F.lit("kept").alias("reason"), "k")).groupBy("reason").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@register("snk3_table_metadata", with_("SELECT 'resolution' AS name, count(*) AS rows, CAST(3 AS INT) AS columns, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM sp", INC, _SPLIT))
def table_metadata(spark, d):
    return feeds.write_with_meta(splits(spark, d).select("incident_id", "split", "resolution_hours"), _folder(spark), "resolution")


_GUARDED = ["severity", "occurred_at", "response_time_hours"]


@register("chk8_provenance_attacks", with_("""
SELECT attack, CAST(n AS BIGINT) AS n_filled, rejected, CASE WHEN starts_with(attack, 'passive') THEN CASE WHEN rejected THEN 'FAIL' ELSE 'PASS' END WHEN n = 0 OR rejected THEN 'PASS' ELSE 'FAIL' END AS status FROM (
 SELECT 'passive:' || f AS attack, 0 AS n, false AS rejected FROM (VALUES ('severity'), ('occurred_at'), ('response_time_hours')) AS v(f)
 UNION ALL SELECT 'active:severity', count(*) FILTER (category = 'POTHOLE'), count(*) FILTER (category = 'POTHOLE') > 0 FROM inc UNION ALL SELECT 'active:occurred_at', count(reported_at), count(reported_at) > 0 FROM inc
 UNION ALL SELECT 'active:response_time_hours', count(resolution_hours), count(resolution_hours) > 0 FROM inc)""", INC))  # fmt: skip
def provenance_attacks(spark, d):
    """Fields that no source can fill: empty as they are, and rejected once filled."""
    attacks = {"severity": F.when(F.col("category") == "POTHOLE", 3), "occurred_at": F.col("reported_at"), "response_time_hours": F.col("resolution_hours")}
    return attacked(incidents(spark, d), attacks, _GUARDED)
