"""Scalar rules as Column expressions: cleaning, time, text and geometry. Unknown stays NULL and never becomes False or 0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
LAT_M_PER_DEG, LON_M_PER_DEG = 110_574.0, 111_320.0
INSTANT_SECONDS, LONGEST_HOURS = 60, 87_600.0

# Words that sources use for states and channels, and texts that stand for nothing.
STATUS = {
    "closed": "closed", "completed": "closed", "completed - dup": "closed", "closed - testing": "closed", "resolved": "closed",
    "open": "open", "pending": "open", "assigned": "open", "in progress": "open", "started": "open", "unassigned": "open",
    "open - dup": "open", "draft": "open", "email sent": "open", "scheduled": "open", "canceled": "cancelled", "cancelled": "cancelled",
}
CHANNEL = {
    "phone": "phone", "phone call": "phone", "constituent call": "phone", "web": "web", "online": "web", "internet": "web", "website": "web",
    "mobile": "mobile", "mobile device": "mobile", "mobile/open311": "mobile", "salesforce mobile app": "mobile", "citizens connect app": "mobile",
    "city worker app": "mobile", "twitter": "social", "email": "email", "in person": "walk_in", "walk-in": "walk_in", "mail": "mail",
}
NOTHING = ["", "N/A", "n/a", "NA", "-"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def lookup(value: Column, table: dict, default: str | None = None) -> Column:
    """A literal dictionary as a CASE expression on the trimmed, lower-cased value."""
    key, out = F.lower(F.trim(value)), F.lit(default).cast("string")
    by: dict = {}
    for k, v in table.items():
        by.setdefault(v, []).append(k)
    case = None
    for v, ks in by.items():
        case = F.when(key.isin(ks), v) if case is None else case.when(key.isin(ks), v)
    return case.otherwise(out)


def normalise_status(x: Column) -> Column:
    return lookup(x, STATUS, "other")


def normalise_channel(x: Column) -> Column:
    return lookup(x, CHANNEL, "other")


def clean_text(x: Column, longest: int = 4000) -> Column:
    """Entities first, then tags to spaces, one space between words, at most `longest` characters; sentinels are NULL."""
    for entity, plain in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    x = F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "\\s+", " "))
    x = F.left(x, F.lit(longest))
    return F.when(~x.isin(NOTHING), x)


def extract_url(x: Column) -> Column:
    """The url of a {"url": ...} text, or the text itself; empty is NULL."""
    bare = F.when(~F.trim(x).startswith("{"), F.trim(x))
    return F.nullif(F.coalesce(F.when(F.trim(x).startswith("{"), F.trim(F.get_json_object(x, "$.url"))), bare), F.lit(""))


def flag(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("true", "1", "yes")


def on_time_flag(x: Column) -> Column:
    return lookup(x, {"ontime": "ONTIME", "on time": "ONTIME", "overdue": "OVERDUE"})


def is_duplicate_note(x: Column) -> Column:
    return F.coalesce(F.lower(x).contains("is a duplicate"), F.lit(False))


STOP_WORDS = ["and", "for", "from", "the", "with", "other", "general", "request", "service"]


def token_set(x: Column, stop: list[str] | None = None) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), F.array(*[F.lit(w) for w in stop or STOP_WORDS]))


# ---- time ---------------------------------------------------------------------------------------------------------


def hours_between(late: Column, early: Column) -> Column:
    return (F.unix_micros(late) - F.unix_micros(early)) / F.lit(3.6e9)


def instant_closure(hours: Column) -> Column:
    return F.when(hours.isNotNull(), (hours >= 0) & (hours * 3600 < INSTANT_SECONDS))


def resolution_hours(hours: Column) -> Column:
    return F.when((hours >= 0) & (hours * 3600 >= INSTANT_SECONDS) & (hours <= LONGEST_HOURS), hours)


def sla_target_hours(hours: Column) -> Column:
    return F.when(hours >= 0, hours)


def parse_local(text: Column, zone: Column, now: str, earliest: str = "2008-01-01") -> Column:
    """A local wall-clock text as an instant; in a gap the first valid instant; NULL outside [earliest, now + 1 day]."""
    local = F.try_to_timestamp(text)
    utc = F.to_utc_timestamp(local, zone)
    utc = F.when(F.from_utc_timestamp(utc, zone) != local, F.to_utc_timestamp(F.date_trunc("hour", local), zone)).otherwise(utc)
    return F.when((utc >= F.lit(earliest).cast("timestamp")) & (utc <= F.lit(now).cast("timestamp") + F.expr("INTERVAL 1 DAY")), utc)


def calendar(local: Column) -> dict[str, Column]:
    """Clock and calendar features of a local time: Monday is 0, nights run from 22 to 6."""
    return {
        "hour": F.hour(local), "day_of_week": F.weekday(local), "month": F.month(local), "year": F.year(local),
        "is_weekend": F.weekday(local) >= 5, "is_night": (F.hour(local) >= 22) | (F.hour(local) < 6),
    }


def minutes(ts: Column, since_micros: int = 1_230_768_000_000_000) -> Column:
    """Whole minutes since 2009-01-01."""
    return F.floor((F.unix_micros(ts) - F.lit(since_micros)) / F.lit(60_000_000)).cast("long")


def week_start(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def week_label(ts: Column) -> Column:
    day = week_start(ts)
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(day, 6), "yyyy-MM-dd"))


def sla_status(now: Column, start: Column, hours: Column, deadline: Column) -> Column:
    """BREACHED, AT_RISK (under a fifth of the window left, or under two hours if its size is unknown) or ON_TRACK."""
    left = hours_between(deadline, now)
    return F.when(deadline.isNull(), F.lit(None).cast("string")).when(left <= 0, "BREACHED").when(left < F.coalesce(hours * 0.2, F.lit(2.0)), "AT_RISK").otherwise("ON_TRACK")


# ---- geometry -----------------------------------------------------------------------------------------------------


def clean_coordinates(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Both NULL at null island or out of range; boxes only flag, and elsewhere."""
    lat, lon = lat.try_cast("double"), lon.try_cast("double")
    good = ~((F.abs(lat) < 1e-4) & (F.abs(lon) < 1e-4)) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(good, lat), F.when(good, lon)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))  # least and greatest skip NULLs


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def required_rings(lat: Column, radius_m: float, size: float) -> tuple[Column, Column]:
    """Rings of cells north-south and east-west that cover the radius, the latter by the outermost row's edge latitude."""
    ns = math.ceil(radius_m / (size * LAT_M_PER_DEG))
    edge = F.least(F.lit(89.9), F.abs(lat) + F.lit((ns + 1) * size))
    return F.lit(ns), F.ceil(F.lit(radius_m) / (F.lit(size * LON_M_PER_DEG) * F.cos(F.radians(edge)))).cast("int")


def metric_cell(lat: Column, lon: Column, lat0: Column, lon0: Column, ref: Column, size_m: float) -> tuple[Column, Column]:
    """Cells of an equirectangular grid from a fixed origin, numbered from 2."""
    y = (lat - lat0) * F.lit(LAT_M_PER_DEG)
    x = (lon - lon0) * F.lit(LON_M_PER_DEG) * F.cos(F.radians(ref))
    return F.floor(x / F.lit(size_m)).cast("long") + 2, F.floor(y / F.lit(size_m)).cast("long") + 2


def cell_centre(ix: Column, iy: Column, lat0: Column, lon0: Column, ref: Column, size_m: float) -> tuple[Column, Column]:
    lat = lat0 + (iy - 2 + F.lit(0.5)) * F.lit(size_m / LAT_M_PER_DEG)
    lon = lon0 + (ix - 2 + F.lit(0.5)) * F.lit(size_m) / (F.lit(LON_M_PER_DEG) * F.cos(F.radians(ref)))
    return lat, lon
