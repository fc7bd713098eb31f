"""City feeds as specifications: which column fills which canonical field; one select for each feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import scalars as S
from wardline.sources.feeds import resolve

FIELDS = ["incident_id", "source_dataset", "source_category_raw", "subcategory", "description", "status", "channel", "reported_raw", "closed_raw", "due_raw", "latitude_raw", "longitude_raw", "image_url", "department", "is_duplicate", "parent_id"]

# The aliases of each feed's columns, by canonical field.
SPECS: dict[str, dict[str, list[str]]] = {
    "sf311": {
        "id": ["service_request_id", "caseid"], "source_category_raw": ["service_name", "category"], "subcategory": ["service_subtype", "request_type"], "description": ["service_details", "request_details"],
        "status": ["status_description", "status"], "channel": ["source"], "reported_raw": ["requested_datetime", "opened"], "closed_raw": ["closed_date", "closed"], "latitude_raw": ["lat", "latitude"],
        "longitude_raw": ["long", "longitude"], "image": ["media_url"], "department": ["agency_responsible", "responsible_agency"], "note": ["status_notes"],
    },
    "chicago311": {
        "id": ["sr_number"], "source_category_raw": ["sr_type"], "subcategory": ["sr_short_code"], "status": ["status"], "channel": ["origin"], "reported_raw": ["created_date"], "closed_raw": ["closed_date"],
        "latitude_raw": ["latitude"], "longitude_raw": ["longitude"], "department": ["owner_department"], "flag": ["duplicate"], "parent": ["parent_sr_number"],
    },
    "nyc311": {
        "id": ["unique_key"], "source_category_raw": ["complaint_type", "problem"], "subcategory": ["descriptor", "problem_detail"], "description": ["resolution_description"], "status": ["status"],
        "channel": ["open_data_channel_type"], "reported_raw": ["created_date"], "closed_raw": ["closed_date"], "due_raw": ["due_date"], "latitude_raw": ["latitude"], "longitude_raw": ["longitude"], "department": ["agency_name", "agency"],
    },
    "boston311": {
        "id": ["case_enquiry_id"], "source_category_raw": ["reason"], "subcategory": ["type"], "title": ["case_title"], "closure": ["closure_reason"], "status": ["case_status"], "channel": ["source"], "reported_raw": ["open_dt"],
        "closed_raw": ["closed_dt"], "due_raw": ["target_dt", "sla_target_dt"], "latitude_raw": ["latitude"], "longitude_raw": ["longitude"], "image": ["submittedphoto", "submitted_photo"], "department": ["department"],
    },
}


def canonical_feed(df: DataFrame, dataset: str) -> DataFrame:
    """A raw feed of strings with the canonical fields, in order; what a feed lacks is NULL."""
    spec = SPECS[dataset]
    col = lambda k: resolve(df, spec.get(k, []))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    described = blank(F.btrim(F.concat(F.coalesce(col("title"), F.lit("")), F.lit(". "), F.coalesce(col("closure"), F.lit(""))), F.lit(" ."))) if "title" in spec else S.clean_text(col("description"))
    duplicate = S.is_duplicate_note(col("note")) if "note" in spec else F.coalesce(S.flag(col("flag")), F.lit(False))
    out = {
        "incident_id": F.concat(F.lit(dataset + ":"), F.trim(col("id"))), "source_dataset": F.lit(dataset), "description": described, "status": S.normalise_status(col("status")), "channel": S.normalise_channel(col("channel")),
        "image_url": S.extract_url(col("image")), "is_duplicate": duplicate, "parent_id": F.concat(F.lit(dataset + ":"), blank(col("parent"))),
    }
    return df.select(*[(out[f] if f in out else blank(col(f))).alias(f) for f in FIELDS])
