"""Queries of normalisation: projections, time, text and geometry scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.operators import mapping
from wardline.plans.base import CATEGORY_MAP, IN_SCOPE, INC, DENSE, RAW, RULES, ZONES, dense, incidents, register, sparse, table, values, with_

EPOCH = "CAST(epoch_us({}) // 1000000 AS BIGINT)"
NOW = "1998-09-01 00:00:00"


def secs(c: str):
    return F.expr(f"unix_micros({c}) div 1000000")


@register("prj10_canonical_incidents", with_(f"SELECT incident_id, source_dataset, city, category, status, {EPOCH.format('reported_at')} AS reported_s, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(resolution_hours, 6) AS resolution_hours, is_instant_closure, sla_met FROM inc", INC))
def canonical_incidents(spark, d):
    return incidents(spark, d).select("incident_id", "source_dataset", "city", "category", "status", secs("reported_at").alias("reported_s"), F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.round("resolution_hours", 6).alias("resolution_hours"), "is_instant_closure", "sla_met")


@register("src8_column_subset", with_("SELECT source_dataset, zone_id, count(*) AS n FROM raw GROUP BY ALL", RAW))
def column_subset(spark, d):
    return sparse(spark, d).groupBy("source_dataset", "zone_id").agg(F.count("*").alias("n"))


@register("src9_mapping_dimension", "SELECT trim(o_orderpriority) AS source_category_raw, count(*) AS n, trim(o_orderpriority) IN ('1-URGENT','2-HIGH','3-MEDIUM','5-LOW') AS allowed FROM orders WHERE NOT starts_with(o_orderpriority, '#') GROUP BY ALL")
def mapping_dimension(spark, d):
    o = table(spark, d, "orders").where(~F.col("o_orderpriority").startswith("#"))
    known = [k for k, _ in CATEGORY_MAP if "|" not in k]
    return o.groupBy(F.trim("o_orderpriority").alias("source_category_raw")).agg(F.count("*").alias("n")).withColumn("allowed", F.col("source_category_raw").isin(known))


@register("src11_poi_layer", "SELECT s_suppkey, round(10 + 5 * (s_suppkey % 5) + 2e-2 * (s_suppkey % 11), 6) AS lat, round(20 + 2e-2 * (s_suppkey % 7), 6) AS lon FROM supplier WHERE s_suppkey % 13 <> 0")
def poi_layer(spark, d):
    from wardline.sources.poi import poi_layer as load

    return load(table(spark, d, "supplier"))


@register("prj1_alias_resolution", "SELECT l_orderkey AS order_id, l_quantity AS quantity, CAST(NULL AS VARCHAR) AS absent FROM lineitem")
def alias_resolution(spark, d):
    from wardline.sources.feeds import resolve

    odd = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("L-OrderKey"), F.col("l_quantity").alias("L_Quantity"))
    return odd.select(resolve(odd, ["orderkey", "l_orderkey"]).alias("order_id"), resolve(odd, ["l quantity"]).alias("quantity"), resolve(odd, ["nothing"]).alias("absent"))


@register("prj6_extract_url", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN nullif(trim(url), '') WHEN page_id % 3 = 1 THEN nullif(trim(url), '') END AS media_url FROM pages")
def extract_url(spark, d):
    p = table(spark, d, "pages")
    raw = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct(F.col("url").alias("url")))).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), "url", F.lit(" "))).otherwise(F.lit("  "))
    return p.select("page_id", S.extract_url(raw).alias("media_url"))


def _words(key: str, words: list[str]) -> str:
    """SQL for a word of a list by an integer key, the same in both engines."""
    return f"CASE {key} % {len(words) + 1} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


# What feeds write, with case and blanks as they come; the last ones are in no list.
_STATES = [" Closed", "COMPLETED", "Completed - Dup", "closed - testing", "Resolved ", "open", "Pending", "Assigned", "In Progress", "Started", "Unassigned", "Open - Dup", "Draft", "Email Sent", "Scheduled", "Canceled", "cancelled", "transferred", ""]
_CHANNELS = ["Phone", "PHONE CALL", "Constituent Call", "web", "Online", "Internet", " Website", "Mobile", "Mobile Device", "Mobile/Open311", "Salesforce Mobile App", "Citizens Connect App", "City Worker App", "Twitter", "Email", "In Person", "Walk-In", "Mail ", "fax"]
_STATE_SQL = """CASE WHEN w IN ('closed', 'completed', 'completed - dup', 'closed - testing', 'resolved') THEN 'closed'
 WHEN w IN ('open', 'pending', 'assigned', 'in progress', 'started', 'unassigned', 'open - dup', 'draft', 'email sent', 'scheduled') THEN 'open'
 WHEN w IN ('canceled', 'cancelled') THEN 'cancelled' ELSE 'other' END"""
_CHANNEL_SQL = """CASE WHEN w IN ('phone', 'phone call', 'constituent call') THEN 'phone' WHEN w IN ('web', 'online', 'internet', 'website') THEN 'web'
 WHEN w IN ('mobile', 'mobile device', 'mobile/open311', 'salesforce mobile app', 'citizens connect app', 'city worker app') THEN 'mobile'
 WHEN w = 'twitter' THEN 'social' WHEN w = 'email' THEN 'email' WHEN w IN ('in person', 'walk-in') THEN 'walk_in' WHEN w = 'mail' THEN 'mail' ELSE 'other' END"""


@register("prj7_normalise_status", f"SELECT o_orderkey, {_STATE_SQL} AS status FROM (SELECT o_orderkey, lower(trim({_words('o_orderkey', _STATES)})) AS w FROM orders)")
def normalise_status(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.normalise_status(F.expr(_words("o_orderkey", _STATES))).alias("status"))


@register("prj8_normalise_channel", f"SELECT o_orderkey, {_CHANNEL_SQL} AS channel FROM (SELECT o_orderkey, lower(trim({_words('o_orderkey', _CHANNELS)})) AS w FROM orders)")
def normalise_channel(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.normalise_channel(F.expr(_words("o_orderkey", _CHANNELS))).alias("channel"))


@register("prj9_global_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'ord:' || o_orderkey END AS incident_id FROM orders")
def global_id(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("ord:"), F.trim(raw)).alias("incident_id"))


@register("prj11_conform", "SELECT CAST(user_id AS BIGINT) AS user_id, event_type, try_cast(event_type AS DOUBLE) AS severity, CAST(NULL AS BOOLEAN) AS is_closed FROM events")
def conform(spark, d):
    from wardline.sources.schema import conform as fit

    return fit(table(spark, d, "events").withColumn("severity", F.col("event_type")).select("event_type", "user_id", "severity"), [("user_id", "bigint"), ("event_type", "string"), ("severity", "double"), ("is_closed", "boolean")])


@register("prj14_zone_key", with_("SELECT incident_id, city || ':' || CASE WHEN k % 9 <> 0 THEN zone_id END AS zone_key FROM inc", INC))
def zone_key(spark, d):
    return incidents(spark, d).select("incident_id", F.concat("city", F.lit(":"), F.when(F.col("k") % 9 != 0, F.col("zone_id"))).alias("zone_key"))


@register("prj15_in_scope", with_(f"SELECT category, count(*) AS n FROM inc WHERE category IN {tuple(IN_SCOPE)} GROUP BY category", INC))
def in_scope(spark, d):
    return incidents(spark, d).where(F.col("category").isin(IN_SCOPE)).groupBy("category").agg(F.count("*").alias("n"))


@register("prj16_excluded_types", with_("SELECT source_dataset, CAST(sum(CASE WHEN source_category_raw = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS BIGINT) AS n_excluded, CAST(sum(CASE WHEN source_category_raw <> '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS BIGINT) AS n_kept FROM raw GROUP BY 1", RAW))
def excluded_types(spark, d):
    out = F.col("source_category_raw").isin("4-NOT SPECIFIED")
    return sparse(spark, d).groupBy("source_dataset").agg(F.count_if(out).alias("n_excluded"), F.count_if(~out).alias("n_kept"))


@register("prj17_clean_period", with_("SELECT source_dataset, CAST(count(*) FILTER (source_dataset <> 'src2' OR reported_at >= TIMESTAMP '1994-01-01') AS BIGINT) AS n_clean, count(*) AS n FROM raw GROUP BY 1", RAW))
def clean_period(spark, d):
    ok = (F.col("source_dataset") != "src2") | (F.col("reported_at") >= F.lit("1994-01-01").cast("timestamp"))
    return sparse(spark, d).groupBy("source_dataset").agg(F.count_if(ok).alias("n_clean"), F.count("*").alias("n"))


@register("prj18_clean_coordinates", with_("SELECT incident_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, CASE WHEN latitude IS NOT NULL THEN latitude BETWEEN 10 + 5 * rk AND 10 + 5 * rk + 0.181e0 AND longitude BETWEEN 20 AND 20.19e0 END AS in_city_box FROM inc", INC))
def clean_coordinates(spark, d):
    low = F.lit(10) + 5 * F.col("rk")
    box = F.col("latitude").between(low, low + F.lit(0.181)) & F.col("longitude").between(20, 20.19)
    return incidents(spark, d).select("incident_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.when(F.col("latitude").isNotNull(), box).alias("in_city_box"))


@register("prj19_service_area", with_("SELECT incident_id, CASE WHEN latitude BETWEEN 9 AND 12 THEN 'south' WHEN latitude BETWEEN 9 AND 22 THEN 'middle' WHEN latitude BETWEEN 20 AND 40 THEN 'north' END AS area FROM inc", INC))
def service_area(spark, d):
    from wardline.operators.geo import assign_area

    return assign_area(incidents(spark, d), [("south", 9, 12, 0, 90), ("middle", 9, 22, 0, 90), ("north", 20, 40, 0, 90)]).select("incident_id", "area")


_SEV = {"OPEN_MANHOLE": ("CRITICAL", 4, 4), "TRAFFIC_SIGNAL_FAULT": ("HIGH", 3, 24), "POTHOLE": ("MEDIUM", 2, 72), "GARBAGE_DUMPING": ("LOW", 1, 168)}
_CASE = lambda i: "CASE category " + " ".join(f"WHEN '{k}' THEN {repr(v[i])}" for k, v in _SEV.items()) + " END"


@register("prj20_category_defaults", with_(f"SELECT incident_id, {_CASE(0)} AS priority, CAST({_CASE(1)} AS INT) AS severity, CAST({_CASE(2)} AS INT) AS sla_hours FROM inc", INC))
def category_defaults(spark, d):
    cols = [F.expr(_CASE(i)).alias(n) for i, n in enumerate(("priority", "severity", "sla_hours"))]
    return incidents(spark, d).select("incident_id", *cols)


@register("prj21_filtered_listing", with_(f"SELECT incident_id, status, category, {EPOCH.format('reported_at')} AS reported_s FROM inc WHERE status = 'open' AND category = 'POTHOLE' ORDER BY reported_at DESC, incident_id LIMIT 50 OFFSET 20", INC))
def filtered_listing(spark, d):
    df = incidents(spark, d).where("status = 'open' AND category = 'POTHOLE'").orderBy(F.desc("reported_at"), "incident_id").offset(20).limit(50)
    return df.select("incident_id", "status", "category", secs("reported_at").alias("reported_s"))


@register("prj23_model_category", with_("""SELECT incident_id, CASE WHEN cat IS NOT NULL AND cat <> 'UNSUPPORTED' THEN cat ELSE category END AS model_category FROM
 (SELECT i.incident_id, i.category, (SELECT arg_min(r.cat, r.ord) FROM rules r WHERE r.src = i.source_dataset AND r.raw = i.source_category_raw AND (r.sub = '*' OR r.sub = i.subcategory)) AS cat FROM inc i)""", INC, f" rules AS (SELECT * FROM {values(RULES)} AS t(ord, src, raw, sub, cat, conf))"))
def model_category(spark, d):
    df = mapping.first_match(incidents(spark, d), RULES)
    return df.select("incident_id", F.when(F.col("app_category") != "UNSUPPORTED", F.col("app_category")).otherwise(F.col("category")).alias("model_category"))


@register("prj36_validity_rules", "SELECT p_partkey, length(p_name) BETWEEN 3 AND 200 AS ok_title, p_size BETWEEN 1 AND 40 AS ok_size, p_retailprice BETWEEN 1 AND 1500 AS ok_price, concat_ws(',', CASE WHEN NOT length(p_name) BETWEEN 3 AND 200 THEN 'title' END, CASE WHEN NOT p_size BETWEEN 1 AND 40 THEN 'size' END, CASE WHEN NOT p_retailprice BETWEEN 1 AND 1500 THEN 'price' END) AS reasons FROM part")
def validity_rules(spark, d):
    rules = {"title": F.length("p_name").between(3, 200), "size": F.col("p_size").between(1, 40), "price": F.col("p_retailprice").between(1, 1500)}
    reasons = F.concat_ws(",", *[F.when(~c, F.lit(n)) for n, c in rules.items()])
    return table(spark, d, "part").select("p_partkey", *[c.alias(f"ok_{n}") for n, c in rules.items()], reasons.alias("reasons"))


# ---- time ---------------------------------------------------------------------------------------------------------


@register("dt1_parse_timestamps", with_("""SELECT incident_id, CASE WHEN t IS NULL THEN NULL ELSE CAST(epoch_us(t) // 1000000 AS BIGINT) END AS reported_s FROM (SELECT incident_id, CASE WHEN k % 19 = 0 THEN NULL WHEN reported_at < TIMESTAMP '1993-01-01' OR reported_at > TIMESTAMP '1998-01-02' THEN NULL ELSE reported_at END AS t FROM raw)""", RAW))
def parse_timestamps(spark, d):
    text = F.when(F.col("k") % 19 == 0, F.lit("soon")).otherwise(F.date_format("reported_at", "yyyy-MM-dd HH:mm:ss"))
    df = sparse(spark, d).select("incident_id", S.parse_local(text, F.lit("UTC"), "1998-01-01 00:00:00", "1993-01-01").alias("t"))
    return df.select("incident_id", secs("t").alias("reported_s"))


_LOCAL = f"SELECT r.*, (r.reported_at AT TIME ZONE 'UTC') AT TIME ZONE z.tz AS local FROM raw r LEFT JOIN (SELECT * FROM {values(ZONES)} AS t(src, tz)) z ON z.src = r.source_dataset"


def _local(spark, d):
    from wardline.operators.time_features import to_local

    return to_local(sparse(spark, d), ZONES)


@register("dt2_local_time", with_(f"SELECT incident_id, strftime(local, '%Y-%m-%d %H:%M:%S') AS reported_local FROM ({_LOCAL})", RAW))
def local_time(spark, d):
    return _local(spark, d).select("incident_id", F.date_format("local", "yyyy-MM-dd HH:mm:ss").alias("reported_local"))


_CAL = "CAST(hour({0}) AS INT) AS hour, CAST(isodow({0}) - 1 AS INT) AS day_of_week, CAST(month({0}) AS INT) AS month, CAST(year({0}) AS INT) AS year, isodow({0}) >= 6 AS is_weekend, hour({0}) >= 22 OR hour({0}) < 6 AS is_night"


@register("dt3_time_features", with_(f"SELECT incident_id, {_CAL.format('local')}, CAST(hour(reported_at) AS INT) AS hour_utc, strftime(local, '%Y-%m-%d') AS date_local FROM ({_LOCAL})", RAW))
def time_features(spark, d):
    cal = [c.alias(n) for n, c in S.calendar(F.col("local")).items()]
    return _local(spark, d).select("incident_id", *cal, F.hour("reported_at").alias("hour_utc"), F.date_format("local", "yyyy-MM-dd").alias("date_local"))


@register("dt4_fixed_zone_calendar", with_(f"SELECT incident_id, {_CAL.format('local')} FROM (SELECT *, (reported_at AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Kolkata' AS local FROM dense)", DENSE))
def fixed_zone_calendar(spark, d):
    df = dense(spark, d).withColumn("local", F.from_utc_timestamp("reported_at", "Asia/Kolkata"))
    return df.select("incident_id", *[c.alias(n) for n, c in S.calendar(F.col("local")).items()])


@register("dt5_dt7_durations", with_("SELECT incident_id, round(raw_hours, 6) AS raw_hours, is_instant_closure, round(resolution_hours, 6) AS resolution_hours, raw_hours IS NULL AND NOT coalesce(is_instant_closure, false) AS censored FROM inc", INC))
def durations(spark, d):
    return incidents(spark, d).select("incident_id", F.round("raw_hours", 6).alias("raw_hours"), "is_instant_closure", F.round("resolution_hours", 6).alias("resolution_hours"), (F.col("raw_hours").isNull() & ~F.coalesce("is_instant_closure", F.lit(False))).alias("censored"))


@register("dt8_dt10_sla_fields", with_("SELECT incident_id, round(sla_target_hours, 6) AS sla_target_hours, sla_met, resolution_hours > sla_target_hours AS breached FROM inc", INC))
def sla_fields(spark, d):
    return incidents(spark, d).select("incident_id", F.round("sla_target_hours", 6).alias("sla_target_hours"), "sla_met", (F.col("resolution_hours") > F.col("sla_target_hours")).alias("breached"))


@register("dt11_target_censoring", with_("SELECT source_dataset, CAST(count(*) FILTER (resolution_hours IS NULL AND NOT coalesce(is_instant_closure, false)) AS BIGINT) AS n_censored, count(*) AS n FROM inc GROUP BY 1", INC))
def target_censoring(spark, d):
    c = F.col("resolution_hours").isNull() & ~F.coalesce("is_instant_closure", F.lit(False))
    return incidents(spark, d).groupBy("source_dataset").agg(F.count_if(c).alias("n_censored"), F.count("*").alias("n"))


@register("dt12_minutes", with_("SELECT incident_id, CAST(floor((epoch_us(reported_at) - 1230768000000000) / 60000000) AS BIGINT) AS minute FROM dense", DENSE))
def minute_keys(spark, d):
    return dense(spark, d).select("incident_id", S.minutes(F.col("reported_at")).alias("minute"))


@register("dt13_week_start", with_("SELECT incident_id, strftime(date_trunc('week', reported_at), '%Y-%m-%d') || '/' || strftime(date_trunc('week', reported_at) + INTERVAL 6 DAY, '%Y-%m-%d') AS week FROM raw", RAW))
def week_start(spark, d):
    return sparse(spark, d).select("incident_id", S.week_label(F.col("reported_at")).alias("week"))


_LEFT = "(epoch_us(due_at) - epoch_us({now})) / 3.6e9"
_STATUS = "CASE WHEN due_at IS NULL THEN NULL WHEN {left} <= 0 THEN 'BREACHED' WHEN {left} < sla_target_hours * 0.2e0 THEN 'AT_RISK' ELSE 'ON_TRACK' END"


@register("dt14_sla_status", with_(f"SELECT incident_id, {_STATUS.format(left=_LEFT.format(now='(TIMESTAMP ' + chr(39) + '1995-06-01 12:00:00' + chr(39) + ')'))} AS sla_status FROM inc", INC))
def sla_status(spark, d):
    now = F.lit("1995-06-01 12:00:00").cast("timestamp")
    return incidents(spark, d).select("incident_id", S.sla_status(now, F.col("reported_at"), F.col("sla_target_hours"), F.col("due_at")).alias("sla_status"))


@register("dt15_sla_freeze", with_(f"SELECT incident_id, {_STATUS.format(left=_LEFT.format(now='coalesce(closed_at, TIMESTAMP ' + chr(39) + NOW + chr(39) + ')'))} AS sla_status FROM inc", INC))
def sla_freeze(spark, d):
    now = F.coalesce("closed_at", F.lit(NOW).cast("timestamp"))
    return incidents(spark, d).select("incident_id", S.sla_status(now, F.col("reported_at"), F.col("sla_target_hours"), F.col("due_at")).alias("sla_status"))


@register("dt16_reanchored_window", with_(f"SELECT incident_id, CAST(epoch_us(reported_at) // 1000000 + coalesce(h, 72) * 3600 AS BIGINT) AS due_s FROM (SELECT *, CASE WHEN k % 3 = 0 THEN 24 WHEN k % 3 = 1 THEN CAST({_CASE(2)} AS INT) END AS h FROM inc)", INC))
def reanchored_window(spark, d):
    h = F.coalesce(F.when(F.col("k") % 3 == 0, 24).when(F.col("k") % 3 == 1, F.expr(_CASE(2))), F.lit(72))
    return incidents(spark, d).select("incident_id", (secs("reported_at") + h * 3600).cast("long").alias("due_s"))


# ---- text ---------------------------------------------------------------------------------------------------------

_CLEAN = "left(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 4000)"


@register("str1_clean_text", f"SELECT page_id, md5(t) AS clean_md5, length(t) AS n_chars FROM (SELECT page_id, CASE WHEN c NOT IN ('', 'N/A', 'n/a', 'NA', '-') THEN c END AS t FROM (SELECT page_id, {_CLEAN.format('html')} AS c FROM pages))")
def clean_text(spark, d):
    t = table(spark, d, "pages").select("page_id", S.clean_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("clean_md5"), F.length("t").cast("long").alias("n_chars"))


@register("str2_duplicate_signal", "SELECT doc_id, coalesce(contains(lower(text), 'is a duplicate'), false) OR contains(lower(text), 'the the') AS weak_signal FROM documents")
def duplicate_signal(spark, d):
    return table(spark, d, "documents").select("doc_id", (S.is_duplicate_note(F.col("text")) | F.lower("text").contains("the the")).alias("weak_signal"))


@register("str3_boolean_text", "SELECT l_orderkey, l_linenumber, lower(l_linestatus) IN ('true', '1', 'yes') AS f, CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' THEN false END AS g FROM lineitem")
def boolean_text(spark, d):
    g = F.when(F.col("l_returnflag") == "R", " TRUE ").when(F.col("l_returnflag") == "A", "no")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.flag(F.col("l_linestatus")).alias("f"), S.flag(g).alias("g"))


@register("str4_on_time_flag", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ONTIME' WHEN 'O' THEN 'OVERDUE' END AS on_time FROM orders")
def on_time_flag(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", "On Time").when(F.col("o_orderstatus") == "O", " overdue").otherwise("?")
    return table(spark, d, "orders").select("o_orderkey", S.on_time_flag(raw).alias("on_time"))


@register("str5_token_set", "SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN ('and','for','from','the','with','other','general','request','service'))), ' ') AS tokens FROM part")
def token_set(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(S.token_set(F.col("p_name"))), " ").alias("tokens"))


# ---- geometry -----------------------------------------------------------------------------------------------------


@register("geo1_haversine", with_("SELECT incident_id, CASE WHEN latitude IS NOT NULL THEN round(2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(latitude - (10 + 5 * rk)) / 2), 2) + cos(radians(10 + 5 * rk)) * cos(radians(latitude)) * pow(sin(radians(longitude - 20) / 2), 2))))), 3) END AS metres FROM inc", INC))
def haversine(spark, d):
    return incidents(spark, d).select("incident_id", F.round(S.haversine_m(F.lit(10) + 5 * F.col("rk"), F.lit(20.0), F.col("latitude"), F.col("longitude")), 3).alias("metres"))


@register("geo2_degree_cell", with_("SELECT incident_id, CAST(floor(latitude / 25e-4) AS BIGINT) AS cy, CAST(floor(longitude / 25e-4) AS BIGINT) AS cx FROM inc", INC))
def degree_cell(spark, d):
    return incidents(spark, d).select("incident_id", S.cell(F.col("latitude"), 0.0025).alias("cy"), S.cell(F.col("longitude"), 0.0025).alias("cx"))


@register("geo3_required_rings", with_("SELECT incident_id, CAST(ceil(250 / (25e-4 * 110574e0)) AS INT) AS rings_ns, CAST(ceil(250e0 / (25e-4 * 111320e0 * cos(radians(least(89.9e0, abs(latitude) + 2 * 25e-4))))) AS INT) AS rings_ew FROM inc", INC))
def required_rings(spark, d):
    ns, ew = S.required_rings(F.col("latitude"), 250.0, 0.0025)
    return incidents(spark, d).select("incident_id", ns.alias("rings_ns"), ew.alias("rings_ew"))


_GRID = "CAST(floor((longitude - lon0) * 111320e0 * cos(radians(ref)) / 1000) AS BIGINT) + 2 AS ix, CAST(floor((latitude - lat0) * 110574e0 / 1000) AS BIGINT) + 2 AS iy"
_ORIGIN = "SELECT *, min(latitude) OVER (PARTITION BY source_dataset) AS lat0, min(longitude) OVER (PARTITION BY source_dataset) AS lon0, max(latitude) OVER (PARTITION BY source_dataset) AS ref FROM inc WHERE latitude IS NOT NULL"


def _grid(spark, d):
    df = incidents(spark, d).where("latitude IS NOT NULL")
    o = df.groupBy("source_dataset").agg(F.min("latitude").alias("lat0"), F.min("longitude").alias("lon0"), F.max("latitude").alias("ref"))
    df = df.join(o, "source_dataset")
    ix, iy = S.metric_cell(*[F.col(c) for c in ("latitude", "longitude", "lat0", "lon0", "ref")], 1000.0)
    return df.withColumn("ix", ix).withColumn("iy", iy)


@register("geo4_metric_cell", with_(f"SELECT incident_id, {_GRID} FROM ({_ORIGIN})", INC))
def metric_cell(spark, d):
    return _grid(spark, d).select("incident_id", "ix", "iy")


@register("geo5_cell_centre", with_(f"SELECT DISTINCT source_dataset, ix, iy, round(lat0 + (iy - 2 + 0.5e0) * (1000e0 / 110574e0), 6) AS lat, round(lon0 + (ix - 2 + 0.5e0) * 1000e0 / (111320e0 * cos(radians(ref))), 6) AS lon FROM (SELECT *, {_GRID} FROM ({_ORIGIN}))", INC))
def cell_centre(spark, d):
    lat, lon = S.cell_centre(*[F.col(c) for c in ("ix", "iy", "lat0", "lon0", "ref")], 1000.0)
    return _grid(spark, d).select("source_dataset", "ix", "iy", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon")).distinct()
