"""Operator 13, best-fit packing by a configuration linear program.

Documents become token ids (a public tokenizer's file, then an end id). Longer ones are cut into pieces of `longest` tokens, of which
the first may be shorter. A configuration is a set of piece lengths that fits one sequence; the program asks for the fewest
configurations that cover the histogram of lengths. Multiplicative weights solve it: every length has a weight, at first its share of
all tokens, and loses weight as it is covered; a knapsack by dynamic programming over the token capacity prices the best configuration
of the moment, whose copies then grow until one of its lengths is covered once more. Shares are rounded down to whole copies within
what is left of each length, at a few scales, and what no whole copy takes is put into the fullest sequence that has room (best-fit decreasing).

The driver holds the histogram (`longest` numbers) and the plan: copies of configurations, at most one a round and one for each
different sequence of the rest, whatever the number of documents. Pieces get numbers within their length where they are made (a
running count in each partition, then sums over earlier partitions), so texts and ids are never shuffled, no task holds a length, and
a length with a third of all pieces is dealt like any other. A piece's length and number give its sequence and offset.

Cases: a null or empty text is one piece, the end id alone. A null doc_id is packed like any other; repeated rows are pieces of their
own. Strings of special tokens in a text are ordinary text. Texts of any length are whole, in pieces. No documents give no rows. Other
columns are not read. Tables for the plan go to the shared checkpoint folder."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import cut, slices, small, table

LONGEST, END, ROUNDS = 1024, 2, 400
#: Bytes of text that go to the tokenizer at a time.
ENCODED = 1 << 20
_LOADED: dict = {}


def tokenizer_path() -> str:
    """byte_bpe_50k as ranks: the vocabulary of byte_bpe_50k.json, whose ids these are, at a third of the time."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(path: str):
    """The tokenizer of a file of ranks; without special tokens, so their strings are ordinary text."""
    if path not in _LOADED:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


# ---- the program, over the histogram ------------------------------------------------------------------------------


def configuration(sizes: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is in the configuration of the greatest total value: a bounded knapsack by dynamic programming."""
    best, steps = np.zeros(capacity + 1), []
    for i, size in enumerate(sizes.tolist()):
        left, many = min(int(most[i]), capacity // size), 1
        while left > 0:  # amounts 1, 2, 4, ... make any number up to `most`
            many = min(many, left)
            left -= many
            width = many * size
            with_it = best[: capacity + 1 - width] + many * value[i]
            better = with_it > best[width:]
            best[width:] = np.where(better, with_it, best[width:])
            steps.append((i, many, width, better))
            many *= 2
    out, room = np.zeros(len(sizes), np.int64), capacity
    for i, many, width, better in reversed(steps):
        if room >= width and better[room - width]:
            out[i] += many
            room -= width
    return out


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int = LONGEST, rounds: int = ROUNDS, rate: float = 0.2) -> list[tuple[np.ndarray, float]]:
    """Configurations and their fractional numbers of copies, for demands of all sizes together: what the weights' rounds end with."""
    need, covered, copies = demand.astype(np.float64), np.zeros(len(sizes)), {}
    for _ in range(rounds if len(sizes) else 0):
        share = covered / need
        counts = configuration(sizes, sizes * np.exp(-rate * (share - share.min())), np.minimum(demand, capacity), capacity)
        used = counts > 0
        grown = float((need[used] / counts[used]).min())
        covered += grown * counts
        key = counts.tobytes()
        copies[key] = copies.get(key, 0.0) + grown
    scale = float((sizes * demand).sum()) / capacity / sum(copies.values()) if copies else 0.0
    return [(np.frombuffer(key, np.int64), n * scale) for key, n in sorted(copies.items(), key=lambda x: (-x[1], x[0]))]


def _best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing over counts: (counts by place in `sizes`, number of such sequences)."""
    open_: dict[int, dict[tuple, int]] = {}  # by room: contents and how many sequences hold them
    rooms = np.zeros(capacity + 1, np.int64)

    def put(room: int, what: tuple, n: int) -> None:
        held = open_.setdefault(room, {})
        held[what] = held.get(what, 0) + n
        rooms[room] += n

    for i in np.argsort(-sizes, kind="stable"):
        size, count = int(sizes[i]), int(left[i])
        while count:
            fits = np.flatnonzero(rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                what, n = next(iter(open_[room].items()))
                n = min(n, count)
                open_[room][what] -= n
                rooms[room] -= n
                if not open_[room][what]:
                    del open_[room][what]
                put(room - size, (*what, int(i)), n)
                count -= n
            else:
                each = capacity // size
                whole, rest = divmod(count, each)
                if whole:
                    put(capacity - each * size, (int(i),) * each, whole)
                if rest:
                    put(capacity - rest * size, (int(i),) * rest, 1)
                count = 0
    return [(what, n) for held in open_.values() for what, n in held.items()]


def rounded(sizes: np.ndarray, demand: np.ndarray, shares: list[tuple[np.ndarray, float]], capacity: int = LONGEST) -> list[tuple[np.ndarray, int]]:
    """Whole copies of configurations that hold every piece once; the scale of the fewest sequences wins."""
    best = None
    for scale in (1.0, 0.75, 0.5, 0.25):
        left, plan = demand.astype(np.int64).copy(), []
        for counts, n in shares:
            used = counts > 0
            copies = min(int(n * scale), int((left[used] // counts[used]).min()))
            if copies:
                plan.append((counts, copies))
                left -= copies * counts
        for what, n in _best_fit(sizes, left, capacity):
            plan.append((np.bincount(np.array(what), minlength=len(sizes)), n))
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
    return best


def planned(histogram: dict[int, int], capacity: int = LONGEST, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """For runs of pieces of one length, in the order of length and first number: length, first, each (pieces a sequence), sequence, offset."""
    sizes = np.array(sorted(histogram, reverse=True), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    part = sizes < capacity  # a piece of the whole capacity is a configuration of its own
    plan = rounded(sizes[part], demand[part], solve(sizes[part], demand[part], capacity, rounds), capacity) if part.any() else []
    runs, taken, sequence = [], np.zeros(len(sizes), np.int64), 0
    where = np.flatnonzero(part)
    if (~part).any():
        runs.append((capacity, 0, 1, 0, 0))
        sequence = int(demand[~part][0])
    for counts, copies in plan:
        offset = 0
        for i in np.flatnonzero(counts):
            at, each = where[i], int(counts[i])
            runs.append((int(sizes[at]), int(taken[at]), each, sequence, offset))
            taken[at] += each * copies
            offset += each * int(sizes[at])
        sequence += copies
    runs.sort()
    return dict(zip(("length", "first", "each", "sequence", "offset"), np.array(runs, np.int64).reshape(-1, 5).T, strict=True))


# ---- over documents -----------------------------------------------------------------------------------------------

_PIECES = "doc_id {0}, piece int, start long, length long, ids_crc32 long, _part int, _seat long"


def pieces(documents: DataFrame, path: str, longest: int = LONGEST, end: int = END) -> DataFrame:
    """A row for each piece; _seat counts pieces of its length within the partition _part."""

    def run(batches):
        encoding, part, seats = _encoding(path), TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        for batch in batches:
            for a, b, _, _ in slices(batch.column("text"), ENCODED):
                of, rows = [], []
                for k, text in enumerate(batch.column("text").slice(a, b - a).to_pylist()):
                    ids = np.append(encoding.encode_to_numpy(text or "", disallowed_special=()), end).astype("<u4")
                    for start in _cuts(len(ids), longest):
                        stop = start + longest if start or len(ids) % longest == 0 else len(ids) % longest
                        rows.append((start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                        of.append(k)
                of, (start, length, crc) = np.array(of), np.array(rows, np.int64).T
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                heads = np.flatnonzero(np.diff(sorted_, prepend=-1))
                seat = np.empty(len(length), np.int64)
                sizes = np.diff(np.append(heads, len(length)))
                seat[order] = np.arange(len(length)) - np.repeat(heads, sizes) + seats[sorted_]
                seats[sorted_[heads]] += sizes
                piece = np.arange(len(of)) - np.flatnonzero(np.diff(of, prepend=-1))[of]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(of), part), pa.int32()), pa.array(seat)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_seat"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, _PIECES.format(kind))


def _cuts(n: int, longest: int) -> list[int]:
    """Where the pieces of n tokens start; all but the first have `longest` tokens."""
    return list(range(0, n, longest)) if n % longest == 0 else [0, *range(n % longest, n, longest)]


def pack(documents: DataFrame, path: str | None = None, longest: int = LONGEST, end: int = END, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document."""
    spark = documents.sparkSession
    made = cut(pieces(documents, path or tokenizer_path(), longest, end))
    counts = made.groupBy("_part", "length").agg((F.max("_seat") + 1).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(counts.select("_part", "length", "_n", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first")))
    histogram = {r["length"]: r["n"] for r in first.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `longest` rows
    plan = spark.sparkContext.broadcast(planned(histogram, longest, rounds))

    def place(batches):
        p = plan.value
        most = int(p["first"].max()) + 1 if len(p["first"]) else 1
        runs = p["length"] * most + p["first"]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            k = np.searchsorted(runs, length * most + np.minimum(number, most - 1), "right") - 1
            at = number - p["first"][k]
            sequence = p["sequence"][k] + at // p["each"][k]
            offset = p["offset"][k] + at % p["each"][k] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    met = made.join(small(first.select("_part", "length", "_first")), ["_part", "length"])
    kind = documents.schema["doc_id"].dataType.simpleString()
    return met.select(*names, (F.col("_first") + F.col("_seat")).alias("_number")).mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op13_best_fit_packing": query}
ORACLE: dict[str, str] = {}
