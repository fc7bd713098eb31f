"""Feed readers by format, column aliases, and sinks with quarantine."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _plain(name: str) -> str:
    return re.sub(r"[\s-]+", "_", name.strip().lower())


def resolve(df: DataFrame, aliases: list[str]) -> Column:
    """The first alias that the frame has, whatever its case, spaces or hyphens; else a NULL text."""
    have = {}
    for c in df.columns:
        have.setdefault(_plain(c), c)
    hit = next((have[_plain(a)] for a in aliases if _plain(a) in have), None)
    return F.col(f"`{hit}`") if hit else F.lit(None).cast("string")


def read_feed(spark: SparkSession, path: str, fmt: str | None = None, columns: list[str] | None = None, keep_corrupt: bool = False) -> DataFrame:
    """JSON lines, JSON array, CSV, TSV or Parquet, compressed or not, by extension or `fmt`; text formats give strings only."""
    fmt = fmt or next((f for e, f in ((".jsonl", "jsonl"), (".ndjson", "jsonl"), (".json", "json"), (".csv", "csv"), (".tsv", "tsv"), (".parquet", "parquet")) if path.removesuffix(".gz").endswith(e)), "csv")
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.select(*columns) if columns else df
    if fmt in ("csv", "tsv"):
        return spark.read.options(header=True, inferSchema=False, sep="\t" if fmt == "tsv" else ",", escape='"', multiLine=False).csv(path)
    reader = spark.read.option("primitivesAsString", True).option("multiLine", fmt == "json")
    if columns:
        corrupt = [StructField("_corrupt_record", StringType())] if keep_corrupt else []
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns] + corrupt))
    return reader.option("mode", "PERMISSIVE" if keep_corrupt else "DROPMALFORMED").json(path)


def read_yearly(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one feed whose headers drift in case: names are made plain, and absent columns are NULL."""
    frames = [(df := read_feed(spark, p)).toDF(*[_plain(c) for c in df.columns]) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first in the given order; rows without a key all stay."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col(key).isNull() | (F.col("_rn") == 1)).drop("_rn")


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, rows that break one with _quarantine_reason); a rule that is NULL is broken."""
    reason = F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    marked = df.withColumn("_quarantine_reason", reason)
    return marked.where("_quarantine_reason = ''").drop("_quarantine_reason"), marked.where("_quarantine_reason <> ''")


def append(df: DataFrame, path: str, schema: list[tuple[str, str]], by: str = "source_dataset") -> None:
    """Appends to Parquet with a locked schema."""
    from wardline.sources.schema import conform

    conform(df, schema).write.mode("append").partitionBy(by).parquet(path)


def write_with_meta(df: DataFrame, path: str, name: str) -> DataFrame:
    """Writes a table and returns one row about it: rows, columns and splits."""
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    back = df.sparkSession.read.parquet(f"{path}/{name}")
    splits = F.array_join(F.array_sort(F.collect_set("split")), ",") if "split" in back.columns else F.lit(None).cast("string")
    return back.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(len(back.columns)).alias("columns"), splits.alias("splits"))
