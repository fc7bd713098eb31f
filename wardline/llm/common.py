"""What the operators share: word vectors over Arrow buffers, lineage cuts, size-checked broadcasts, gapless numbering."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.operators.storage import BROADCAST_ROWS, cut, shared_folder, small, spread_join

__all__ = ["BROADCAST_ROWS", "SPACE", "Words", "ascii_lower", "cut", "mix", "numbered", "ragged", "shared_folder", "slices", "small", "spread_join", "table", "words"]

#: Separators of words; Python's bytes.split() cuts at the same six bytes.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Bytes of text that a Python task turns into arrays at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text) -> "F.Column":
    """Words of a text column as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text) -> "F.Column":
    """A-Z to a-z and nothing else; texts of ASCII only take the fast path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def numbered(df: DataFrame, group: str, order: list[str], out: str, rows: int, per_block: int = 100_000) -> DataFrame:
    """Adds a gapless number from 0 within each group, however large the group is.

    Rows fall into blocks by a hash of the order columns, as many as `rows` (the number of rows) asks for. Counts of earlier blocks
    give a block's first number (a table of groups x blocks rows), and a window over one block of one group gives the rest."""
    blocks = max(16, math.ceil(rows / per_block))
    part = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    ahead = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = part.groupBy(group, "_block").count().withColumn("_first", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    first = small(cut(first.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), "_first")))
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    part = part.withColumn("_at", F.row_number().over(inside) - 1)
    near = part.join(first, (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")))
    return near.withColumn(out, (F.col("_first") + F.col("_at")).cast("long")).drop("_block", "_at", "_first", "_g", "_b")


# ---- word vectors -------------------------------------------------------------------------------------------------

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BASE, _STEP = (int(x) for x in _odd(7, 2))
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _TABLES[base] = (both[0], both[1])
    return have


def ranged_hashes(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each s, e, from one cumulative sum."""
    up, down = _powers(base, len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Words of a run of texts: bytes with one space between words, where words start and end, each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        word = ~_IS_SPACE[data]
        head = np.zeros(len(data) + 1, dtype=bool)
        head[offsets] = True
        keep = word.copy()
        keep[1:] |= word[:-1] & ~head[1:-1]
        place = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(keep, out=place[1:])
        self.data = np.where(word, data, np.uint8(32))[keep]
        offsets = place[offsets]
        word = self.data != 32
        n = len(self.data)
        head = np.zeros(n + 1, dtype=bool)
        head[offsets] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | head[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | head[1:-1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A hash of each word; bytes go in parts, so that tables of powers stay small."""
        out, a = np.empty(len(self.starts), np.uint64), 0
        while a < len(out):
            low = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, low + (1 << 20), "right")))
            out[a:b] = ranged_hashes(self.data[low : self.ends[b - 1]], _BASE, self.starts[a:b] - low, self.ends[a:b] - low)
            a = b
        return out

    @staticmethod
    def runs(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of runs of words, from the words' hashes."""
        return ranged_hashes(h, _STEP, starts, ends)


def slices(text: pa.Array, most: int = SLICE_BYTES):
    """(first row, last row, bytes, offsets) of parts of a column of about `most` bytes; a longer text is a part of its own."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    text = text.fill_null("") if text.type == pa.string() or text.type == pa.large_string() else text.fill_null(b"")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, len(text))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: each element's group and its place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - first[group]
