"""The provided tables as canonical incidents, in Spark and as common table expressions for the oracle; the register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import scalars as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The category map, ordered rules, zones of the sources, and what each category gets by default.
CATEGORY_MAP = [("1-URGENT", "OPEN_MANHOLE"), ("2-HIGH", "TRAFFIC_SIGNAL_FAULT"), ("3-MEDIUM", "POTHOLE"), ("5-LOW", "GARBAGE_DUMPING"), ("5-LOW|BUILDING", "OUT_OF_SCOPE")]
RULES = [
    (1, "src0", "5-LOW", "BUILDING", "UNSUPPORTED", "NONE"),
    *[(2 + i, f"src{i}", "5-LOW", "*", "GARBAGE", "EXACT") for i in range(4)],
    *[(6 + i, f"src{i}", "3-MEDIUM", "*", "POTHOLE", "EXACT") for i in range(4)],
    (10, "src1", "2-HIGH", "FURNITURE", "STREETLIGHT", "STRONG"),
]
ZONES = [("src0", "America/Los_Angeles"), ("src1", "America/New_York"), ("src2", "America/Chicago"), ("src3", "America/New_York")]
IN_SCOPE = ["OPEN_MANHOLE", "TRAFFIC_SIGNAL_FAULT", "POTHOLE", "GARBAGE_DUMPING"]


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if not isinstance(x, str) else "'" + x + "'" for x in r) + ")" for r in rows) + ")"


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw incidents from orders: 6.6 years, five sources, 25 zones."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    place = n.join(r, n.n_regionkey == r.r_regionkey)  # 25 rows
    b = o.join(c, c.c_custkey == o.o_custkey).join(F.broadcast(place), c.c_nationkey == n.n_nationkey)
    b = b.selectExpr(
        "o_orderkey AS k", "o_orderstatus AS st", "o_orderpriority AS pr", "c_mktsegment AS seg", "n_name AS zone", "r_name AS city", "r_regionkey AS rk",
        "timestampadd(SECOND, (o_orderkey * 7919) % 86400, CAST(o_orderdate AS TIMESTAMP)) AS reported_at",
        "CASE WHEN o_orderkey % 97 = 0 THEN -3600 WHEN o_orderkey % 89 = 0 THEN 20 ELSE 3600 + (o_orderkey * 104729) % 7776000 END AS dur_s",
    )
    return b.selectExpr(
        "k", "rk", "concat('src', rk, ':', k) AS incident_id", "concat('src', rk) AS source_dataset", "city", "zone AS zone_id", "'nation' AS zone_type",
        "pr AS source_category_raw", "seg AS subcategory", "CASE WHEN st = 'O' THEN 'open' ELSE 'closed' END AS status", "reported_at",
        "CASE WHEN st <> 'O' THEN timestampadd(SECOND, dur_s, reported_at) END AS closed_at",
        "CASE WHEN rk <= 1 THEN timestampadd(SECOND, CASE pr WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 24 WHEN '3-MEDIUM' THEN 72 ELSE 168 END * 3600, reported_at) END AS due_at",
        "CASE WHEN k % 41 = 0 THEN 0e0 ELSE 1e1 + 5e0 * rk + 2e-2 * (k % 10) + 2e-6 * ((k * 37) % 1000) END AS latitude_raw",
        "CASE WHEN k % 41 = 0 THEN 0e0 ELSE 2e1 + 2e-2 * (k % 10) + 2e-6 * ((k * 53) % 1000) END AS longitude_raw",
        "(k % 7 = 0 AND k % 50 <> 0) AS is_duplicate",
        "CASE WHEN k % 7 = 0 AND k % 50 <> 0 THEN CASE WHEN k % 14 = 0 AND k % 50 >= 8 THEN k - 7 ELSE 50 * (k DIV 50) END END AS parent_key",
    )


RAW = """
b AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, c_mktsegment AS seg, n_name AS zone, r_name AS city, r_regionkey AS rk,
  o_orderdate + to_seconds(CAST((o_orderkey * 7919) % 86400 AS BIGINT)) AS reported_at,
  CASE WHEN o_orderkey % 97 = 0 THEN -3600 WHEN o_orderkey % 89 = 0 THEN 20 ELSE 3600 + (o_orderkey * 104729) % 7776000 END AS dur_s
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
raw AS (SELECT k, rk, 'src' || rk || ':' || k AS incident_id, 'src' || rk AS source_dataset, city, zone AS zone_id, 'nation' AS zone_type,
  pr AS source_category_raw, seg AS subcategory, CASE WHEN st = 'O' THEN 'open' ELSE 'closed' END AS status, reported_at,
  CASE WHEN st <> 'O' THEN reported_at + to_seconds(CAST(dur_s AS BIGINT)) END AS closed_at,
  CASE WHEN rk <= 1 THEN reported_at + to_seconds(CAST(CASE pr WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 24 WHEN '3-MEDIUM' THEN 72 ELSE 168 END * 3600 AS BIGINT)) END AS due_at,
  CASE WHEN k % 41 = 0 THEN 0e0 ELSE 1e1 + 5e0 * rk + 2e-2 * (k % 10) + 2e-6 * ((k * 37) % 1000) END AS latitude_raw,
  CASE WHEN k % 41 = 0 THEN 0e0 ELSE 2e1 + 2e-2 * (k % 10) + 2e-6 * ((k * 53) % 1000) END AS longitude_raw,
  (k % 7 = 0 AND k % 50 <> 0) AS is_duplicate,
  CASE WHEN k % 7 = 0 AND k % 50 <> 0 THEN CASE WHEN k % 14 = 0 AND k % 50 >= 8 THEN k - 7 ELSE 50 * (k // 50) END END AS parent_key FROM b)"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical table: clean coordinates, mapped category, durations and SLA fields."""
    return canonical(sparse(spark, sf_dir))


def canonical(raw: DataFrame) -> DataFrame:
    lat, lon = S.clean_coordinates(F.col("latitude_raw"), F.col("longitude_raw"))
    hours, sla = S.hours_between(F.col("closed_at"), F.col("reported_at")), S.hours_between(F.col("due_at"), F.col("reported_at"))
    df = raw.select("*", lat.alias("latitude"), lon.alias("longitude"), hours.alias("raw_hours"), S.sla_target_hours(sla).alias("sla_target_hours"))
    df = df.withColumn("is_instant_closure", S.instant_closure(F.col("raw_hours"))).withColumn("resolution_hours", S.resolution_hours(F.col("raw_hours")))
    df = df.withColumn("sla_met", F.col("resolution_hours") <= F.col("sla_target_hours"))
    from wardline.operators.mapping import map_categories

    return map_categories(df, CATEGORY_MAP).drop("latitude_raw", "longitude_raw")


INC = (
    RAW
    + f""",
cmap AS (SELECT * FROM {values(CATEGORY_MAP)} AS t(raw, cat)),
inc AS (SELECT r.* EXCLUDE (latitude_raw, longitude_raw), coalesce(m2.cat, m1.cat, 'UNMAPPED') AS category,
  CASE WHEN NOT (abs(latitude_raw) < 1e-4 AND abs(longitude_raw) < 1e-4) AND latitude_raw BETWEEN -90 AND 90 AND longitude_raw BETWEEN -180 AND 180 THEN latitude_raw END AS latitude,
  CASE WHEN NOT (abs(latitude_raw) < 1e-4 AND abs(longitude_raw) < 1e-4) AND latitude_raw BETWEEN -90 AND 90 AND longitude_raw BETWEEN -180 AND 180 THEN longitude_raw END AS longitude,
  raw_hours, CASE WHEN raw_hours IS NOT NULL THEN raw_hours >= 0 AND raw_hours * 3600 < 60 END AS is_instant_closure,
  CASE WHEN raw_hours >= 0 AND raw_hours * 3600 >= 60 AND raw_hours <= 87600 THEN raw_hours END AS resolution_hours,
  CASE WHEN sla_raw >= 0 THEN sla_raw END AS sla_target_hours,
  (CASE WHEN raw_hours >= 0 AND raw_hours * 3600 >= 60 AND raw_hours <= 87600 THEN raw_hours END) <= (CASE WHEN sla_raw >= 0 THEN sla_raw END) AS sla_met
  FROM (SELECT *, (epoch_us(closed_at) - epoch_us(reported_at)) / 3.6e9 AS raw_hours, (epoch_us(due_at) - epoch_us(reported_at)) / 3.6e9 AS sla_raw FROM raw) r
  LEFT JOIN cmap m2 ON m2.raw = r.source_category_raw || '|' || r.subcategory LEFT JOIN cmap m1 ON m1.raw = r.source_category_raw)"""
)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents from events: 30 days, for windows of minutes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf_dir, "events").selectExpr(
        "concat('evt:', event_id) AS incident_id", "'evt' AS source_dataset", "event_type AS category", "CAST(ts AS TIMESTAMP) AS reported_at",
        "CASE WHEN event_id % 20 <> 0 THEN timestampadd(SECOND, 60 + (event_id * 104729) % 864000, CAST(ts AS TIMESTAMP)) END AS closed_at",
        "129e-1 + 2e-4 * CAST(get_json_object(props, '$.k') AS INT) AS latitude", "776e-1 + 2e-4 * (user_id % 10) AS longitude", "event_id",
    )


DENSE = """
dense AS (SELECT 'evt:' || event_id AS incident_id, 'evt' AS source_dataset, event_type AS category, ts AS reported_at,
  CASE WHEN event_id % 20 <> 0 THEN ts + to_seconds(CAST(60 + (event_id * 104729) % 864000 AS BIGINT)) END AS closed_at,
  129e-1 + 2e-4 * CAST(json_extract_string(props, '$.k') AS INT) AS latitude, 776e-1 + 2e-4 * (user_id % 10) AS longitude, event_id FROM events)"""
#: Columns of orders as the oracle sees them; minutes since 2009-01-01.
MIN = "CAST(floor((epoch_us({}) - 1230768000000000) / 60000000) AS BIGINT)"


def with_(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body.strip()
