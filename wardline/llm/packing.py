"""Operator 5, packing into optimal length buckets.

A token is a UTF-8 byte, and every text ends with one end token. Longer texts are cut into pieces of at most `longest` tokens, every
three bytes less and then back to the last code point's start, so that nothing is lost and no character is split. The global histogram of piece lengths (at most `longest` rows) goes to the driver, where dynamic programming finds the
`buckets` boundaries with the least padding in all. Pieces are numbered within their bucket without gaps and cut into batches whose
padded size stays within the token budget.

Each piece comes with its bytes, its batch and its place; a batch is what a training step reads, padded to bucket_tokens.

Cases: null and empty texts are one piece of the end token alone. A null doc_id is packed like any other. Repeated rows are pieces
of their own. A text of any length is
whole, in pieces. No documents give no rows. Other columns are not read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import numbered, table

LONGEST, BUCKETS, BUDGET = 2048, 16, 65_536


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The bucket lengths (ascending, the last one the longest length) with the least padding over the histogram."""
    lengths = np.array(sorted(histogram), np.float64)
    if not len(lengths):
        return []
    count = np.array([histogram[int(x)] for x in lengths], np.float64)
    n, total = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * lengths))
    size = len(lengths)
    # pad[i, j]: padding if lengths i..j share a bucket of length j
    pad = lengths[None, :] * (n[None, 1:] - n[:size, None]) - (total[None, 1:] - total[:size, None])
    pad[np.tril_indices(size, -1)] = np.inf
    best, back = pad[0].copy(), []
    for _ in range(1, min(buckets, size)):
        options = np.vstack([np.full((1, size), np.inf), best[:-1, None] + pad[1:]])
        options[0] = pad[0]
        back.append(options.argmin(axis=0))
        best = options.min(axis=0)
    out, j = [], size - 1
    for step in reversed(back):
        out.append(int(lengths[j]))
        j = int(step[j]) - 1
        if j < 0:
            return out[::-1]
    return [int(lengths[j]), *out[::-1]]


def pieces(documents: DataFrame, longest: int = LONGEST) -> DataFrame:
    """doc_id, piece, start, n_tokens, tokens (the piece's bytes, the end token not among them)."""
    stride = longest - 3
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_b"))
    rows = rows.withColumn("_n", F.octet_length("_b")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast(_n div {stride} AS int)"))))

    def begin(at: str) -> str:
        """A place in the bytes, moved back over at most three bytes to where a code point starts."""
        inner = lambda k: f"hex(substring(_b, {at} + {1 - k}, 1)) RLIKE '^[89AB]'"
        return f"({at} - CASE WHEN {at} = 0 OR {at} >= _n OR NOT {inner(0)} THEN 0 WHEN NOT {inner(1)} THEN 1 WHEN NOT {inner(2)} THEN 2 ELSE 3 END)"

    rows = rows.withColumn("start", F.expr(f"cast({begin(f'piece * {stride}')} AS int)"))
    rows = rows.withColumn("_end", F.expr(f"cast(IF(piece = _n div {stride}, _n, {begin(f'(piece + 1) * {stride}')}) AS int)"))
    size = F.expr(f"_end - start + IF(piece = _n div {stride}, 1, 0)").cast("int").alias("n_tokens")
    return rows.select("doc_id", "piece", "start", size, F.expr("substring(_b, start + 1, _end - start)").alias("tokens"))


def pack(documents: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket, bucket_tokens, batch, slot (place in the bucket), tokens."""
    rows = pieces(documents, longest)
    histogram = {r[0]: r[1] for r in rows.groupBy("n_tokens").count().collect()}  # at most `longest` rows
    ends = boundaries(histogram, buckets)
    rows = rows.withColumn("bucket", _stepped(F.col("n_tokens"), ends))
    size = F.element_at(F.array(*[F.lit(e) for e in ends or [longest]]), F.col("bucket") + 1)
    rows = numbered(rows, "bucket", ["doc_id", "piece", "n_tokens"], "slot", sum(histogram.values())).withColumn("bucket_tokens", size)
    batch = F.expr(f"slot div greatest(1, {budget} div bucket_tokens)")
    return rows.select("doc_id", "piece", "start", "n_tokens", "bucket", "bucket_tokens", batch.alias("batch"), "slot", "tokens")


def _stepped(length, ends: list[int]):
    """The first bucket whose length is enough."""
    out = F.lit(max(0, len(ends) - 1))
    for b in reversed(range(len(ends) - 1)):
        out = F.when(length <= ends[b], b).otherwise(out)
    return out


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": query}
ORACLE: dict[str, str] = {}
