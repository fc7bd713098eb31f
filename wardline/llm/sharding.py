"""Operator 7, sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the least of -ln(u) / weight, where u in (0, 1) is a hash of its key and the shard's number. A
shard's score depends on the key and that shard only, so one more shard takes records only into itself, and a removed shard's
records alone move. Law: `key` - the record key and the shards decide.

Slots number each shard's records from 0 without gaps, by counting blocks first (see common.numbered), so that no task holds a
whole shard. Cases: a null text has size 1 and the CRC of the empty text; a null doc_id hashes as a key of its own; repeated rows
go to the same shard and get a slot each; no documents give no rows. Only doc_id, sizes and checksums are shuffled, never texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import numbered, table

SHARDS = 8


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard number that a key gets under these weights."""
    def score(s: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return -F.log(u) / F.lit(float(weights[s]))

    ranked = [F.struct(score(s).alias("score"), F.lit(s).alias("shard")) for s in range(len(weights))]
    return F.least(*ranked)["shard"] if len(ranked) > 1 else F.lit(0)


def shard(documents: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of the mean weight)."""
    weights = weights or [1.0] * SHARDS
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    more = [*weights, sum(weights) / len(weights)]
    rows = rows.select("*", F.lit("key").alias("law"), rendezvous(F.col("doc_id"), weights).alias("shard"), rendezvous(F.col("doc_id"), more).alias("grown_shard"))
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"], "slot", documents.count()).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def query(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op7_sharding": query}
ORACLE: dict[str, str] = {}
