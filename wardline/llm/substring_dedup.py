"""Operator 6, substring deduplication by super-k-mer partitioning.

A window is `k` consecutive words of one document. Its minimiser is the least of the `m`-word runs in it, rare ones before frequent
ones and then by their hash. Consecutive windows with one minimiser form a super-k-mer, which travels as one packed string (its words
joined by spaces) to the minimiser's bucket: about k / 6 + 1 words for each word of text instead of k. Within its bucket every
window meets all its equals, where sorting finds the first document of each. Sorting goes by 64-bit hashes, and every window that is
to go is then compared with the words of the window that it repeats; where hashes alone are equal, the words decide. Buckets are
dealt in groups, and a slice of a task sends all its strings for one group in one compressed row. Words under a window that also
starts in a document with a smaller doc_id go.

Skew: a histogram of all `m`-word runs (of a fixed number of bins) finds the frequent ones, which become minimisers only of windows
that hold no rare run. Groups follow the bytes of text, one for each `GROUP_BYTES` at least, so that a task's memory does not grow with the
corpus. Before the shuffle, equal super-k-mers of one slice of a task are combined. Only those of the smallest doc_id are sent; all
others already have their verdict, and travel as ranges without words, dealt by document. So a passage in a third of all documents
sends a string per slice, not per document. Groups are sorted by Spark and read as a stream, one at a time.

Cases: null and blank texts have no words; their kept text is empty. A null doc_id is no document: the row keeps all its words and
removes none. Rows are told apart by doc_id and a hash of the text; equal doc_ids are never smaller than each other, so repeated
rows remove nothing from each other. Texts are whole, however long. No documents give no rows; other columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Words, mix, ragged, slices, table

K, M = 13, 2
#: Bytes of text whose super-k-mers make a group of buckets; bins of the histogram of runs, and from which count on a bin is frequent.
GROUP_BYTES, BINS, FREQUENT = 4 << 20, 1 << 16, 20_000
SENT = "g int, packed binary"
RANGE = "doc_id long, key long, s int, e int"
_RUN = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(x: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` neighbours."""
    have, out = 1, x
    while have * 2 <= wide:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - wide + 1], out[wide - have : wide - have + len(x) - wide + 1])


def _pack(data: bytes, level: int) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def _ranks(h: np.ndarray, m: int) -> np.ndarray:
    """A hash of every run of m words."""
    runs = h[: len(h) - m + 1] * _RUN[0]
    for j in range(1, m):
        runs = runs + h[j : len(h) - m + 1 + j] * _RUN[j]
    return mix(runs)


def super_kmers(words: Words, k: int, m: int, frequent: np.ndarray):
    """For each super-k-mer: its text's number, its first word, its number of windows, its minimiser, and a hash of its words."""
    h = words.hashes()
    if len(h) < k:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    runs = _ranks(h, m)
    late = frequent[(runs & np.uint64(BINS - 1)).astype(np.int64)].astype(np.uint64)
    least = _least((runs >> np.uint64(1)) | (late << np.uint64(63)), k - m + 1)
    text, at = ragged(np.maximum(words.count - k + 1, 0))
    first = words.first[:-1][text] + at
    mini = least[first]
    new = np.ones(len(first), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (text[1:] != text[:-1])
    a = np.flatnonzero(new)
    n = np.diff(np.append(a, len(first)))
    start = first[a]
    return text[a], start, n, mini[a], Words.runs(h, start, start + n + k - 1)


def equal_words(words: Words, x: np.ndarray, y: np.ndarray, n: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether the n words from x on are those from y on, by their bytes; about `most` bytes are compared at a time."""
    xs, ys = words.starts[x], words.starts[y]
    size = words.ends[x + n - 1] - xs
    same = size == words.ends[y + n - 1] - ys
    todo, a = np.flatnonzero(same), 0
    total = np.append(0, np.cumsum(size[todo]))
    while a < len(todo):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        part = todo[a:b]
        group, at = ragged(size[part])
        differ = words.data[xs[part][group] + at] != words.data[ys[part][group] + at]
        same[part] = np.bincount(group[differ], minlength=len(part)) == 0
        a = b
    return same


def binned(m: int):
    def run(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                h = Words(data, offsets).hashes()
                if len(h) >= m:  # runs over a text's end count too; they are few
                    total += np.bincount((_ranks(h, m) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
        b = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(total[b])], names=["bin", "n"])

    return run


def frequent_bins(documents: DataFrame, m: int, least: int | None = None) -> np.ndarray:
    """Which bins of the runs' hashes are frequent: more than `least` runs and than 8 times the mean. The histogram has BINS rows."""
    rows = documents.select("text").mapInArrow(binned(m), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    most = max(FREQUENT if least is None else least, 8 * sum(r["n"] for r in rows) / BINS)
    out = np.zeros(BINS, bool)
    out[[r["bin"] for r in rows if r["n"] > most]] = True
    return out


def send(k: int, m: int, groups: int, frequent: np.ndarray):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(batch.column("text"), 4 << 20):
                words = Words(data, offsets)
                text, start, n, mini, whole = super_kmers(words, k, m, frequent)
                if not len(text):
                    continue
                doc, key = ids[a:b][text], keys[a:b][text]
                order = np.lexsort((doc, whole))
                head = np.ones(len(order), bool)
                head[1:] = whole[order][1:] != whole[order][:-1]
                of = np.empty(len(order), np.int64)  # the first equal super-k-mer of each
                of[order] = order[head][np.cumsum(head) - 1]
                later = doc > doc[of]
                at = np.flatnonzero(later)
                later[at] = (n[at] == n[of[at]]) & equal_words(words, start[at], start[of[at]], np.minimum(n[at], n[of[at]]) + k - 1)
                pos = (start - words.first[:-1][text]).astype(np.int64)
                # What has its verdict already goes along as (-1 - position, words) without a string, dealt by document.
                size = np.where(later, n + k - 1, 0)
                at, end = words.starts[start], np.where(later, words.starts[start], words.ends[start + n + k - 2])
                group = (mix(np.where(later, doc.astype(np.uint64), mini)) % np.uint64(groups)).astype(np.int64)
                order = np.lexsort((start, group))
                cuts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
                raw, rows, out = words.data.tobytes(), [], []
                for x, y in zip(cuts, np.append(cuts[1:], len(order))):
                    own = order[x:y]
                    strings = b"\n".join([raw[p:q] for p, q in zip(at[own].tolist(), end[own].tolist())])
                    columns = np.stack([doc[own], key[own], np.where(later[own], -1 - pos[own], pos[own]), size[own]]).astype("<i8")
                    rows.append(int(group[own[0]]))
                    out.append(_pack(len(own).to_bytes(4, "little") + _deltas(columns) + strings, 6))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(out, pa.binary())], names=["g", "packed"])

    return run


def _deltas(columns: np.ndarray) -> bytes:
    return np.diff(columns, axis=1, prepend=0).tobytes()


def _unpacked(packed: list[bytes]):
    """doc, key, position, words (of rows with a verdict), and the strings' bytes and offsets, of all rows of a group."""
    columns, strings = [], []
    for x in packed:
        x = _unpack(x)
        n = int.from_bytes(x[:4], "little")
        columns.append(np.cumsum(np.frombuffer(x, "<i8", 4 * n, 4).reshape(4, n), axis=1))
        strings.append(x[4 + 32 * n :])
    data = np.frombuffer(b"\n".join(strings), np.uint8)
    offsets = np.concatenate(([0], np.flatnonzero(data == 10) + 1, [len(data)]))
    return *np.concatenate(columns, axis=1), data, offsets


def _repeats(words: Words, first: np.ndarray, window: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Which windows (k words from `first` on, hashed as `window`) also start in a smaller document."""
    order = np.argsort(window, kind="stable")
    run = np.cumsum(np.append(False, np.diff(window[order]) != 0))
    low = np.minimum.reduceat(docs[order], np.flatnonzero(np.append(True, np.diff(run) != 0)))
    lowest = np.flatnonzero(docs[order] == low[run])
    lowest = lowest[np.append(True, np.diff(run[lowest]) != 0)]
    of = np.empty(len(order), np.int64)
    of[order] = order[lowest[run]]
    gone = docs > docs[of]
    hit = np.flatnonzero(gone)
    if len(hit):
        # A window that follows on another, as the one it repeats does, has but its last word to compare.
        on = np.append(False, (np.diff(first[hit]) == 1) & (np.diff(first[of[hit]]) == 1))
        skip = np.where(on, k - 1, 0)
        same = equal_words(words, first[hit] + skip, first[of[hit]] + skip, k - skip)
        if not same.all():  # equal hashes of unequal words
            raw = words.data.tobytes()
            clash = np.flatnonzero(np.isin(window, window[hit[~same]]))
            text = {int(i): raw[words.starts[first[i]] : words.ends[first[i] + k - 1]] for i in clash}
            least: dict[bytes, int] = {}
            for i, t in text.items():
                least[t] = min(int(docs[i]), least.get(t, int(docs[i])))
            for i, t in text.items():
                gone[i] = docs[i] > least[t]
    return gone


def _judge(packed: list[bytes], k: int):
    """Ranges of words to remove, from a whole group of buckets."""
    doc, key, pos, size, data, offsets = _unpacked(packed)
    known = pos < 0
    if known.any():
        yield _range(doc[known], key[known], -1 - pos[known], -1 - pos[known] + size[known])
    words = Words(data, offsets)
    h = words.hashes()
    row, at = ragged(np.maximum(words.count - k + 1, 0))
    if not len(row):
        return
    first = words.first[:-1][row] + at
    gone = _repeats(words, first, Words.runs(h, first, first + k), doc[row], k)
    hit = np.flatnonzero(gone)
    if len(hit):  # neighbouring windows of one super-k-mer make one range
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit][1:] != row[hit][:-1])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(hit)) - 1
        r = row[hit[a]]
        yield _range(doc[r], key[r], pos[r] + at[hit[a]], pos[r] + at[hit[z]] + k)


def _range(doc, key, s, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(np.asarray(s, np.int32)), pa.array(np.asarray(e, np.int32))], names=["doc_id", "key", "s", "e"])


def judge(k: int):
    def run(batches):
        group, held = None, []
        for batch in batches:
            for g, packed in zip(batch.column("g").to_pylist(), batch.column("packed").to_pylist()):
                if g != group and held:
                    yield from _judge(held, k)
                    held = []
                group = g
                held.append(packed)
        if held:
            yield from _judge(held, k)

    return run


def ranges(documents: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_id, key (hash of the text), and s, e of runs of words that also start in a document with a smaller doc_id."""
    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    groups = max(8 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // GROUP_BYTES)
    sent = rows.mapInArrow(send(k, m, groups, frequent_bins(rows, m)), SENT)
    return sent.repartition("g").sortWithinPartitions("g").mapInArrow(judge(k), RANGE)


def _shrunk(batches):
    """Texts go to the join with their ranges in compressed form."""
    for batch in batches:
        z = pa.array([_pack((t or "").encode(), 1) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), z], names=["doc_id", "key", "z"])


def strip_words(text: bytes, spans: list | None) -> tuple[list[bytes], int, int]:
    """The kept words of a text, how many words it had, and how many go."""
    words = text.split()
    if not spans:
        return words, len(words), 0
    kept, at = [], 0
    for s, e in sorted(spans):
        kept.extend(words[at:s])
        at = max(at, e)
    kept.extend(words[at:])
    return kept, len(words), len(words) - len(kept)


def deduplicate(documents: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_id, text (the kept words, joined by spaces), n_words, n_removed, kept_sha256."""
    gone = ranges(documents, k, m).groupBy("doc_id", "key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "spans")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").mapInArrow(_shrunk, "doc_id long, key long, z binary")
    met = rows.join(gone, (F.col("doc_id") == F.col("_d")) & (F.col("key") == F.col("_k")), "left").select("doc_id", "z", "spans")

    def strip(batches):
        for batch in batches:
            texts, n, lost, sha = [], [], [], []
            for z, spans in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist()):
                kept, words, removed = strip_words(_unpack(z), [(x["s"], x["e"]) for x in spans] if spans else None)
                joined = b" ".join(kept)
                texts.append(joined.decode())
                n.append(words)
                lost.append(removed)
                sha.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "text", "n_words", "n_removed", "kept_sha256"])

    return met.mapInArrow(strip, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")


def query(spark, sf_dir):
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {K - 1}], ' ') AS t FROM d, unnest(range(1, len(w) - {K - 2})) AS u(i)),
first AS (SELECT t, min(doc_id) AS low FROM win GROUP BY t HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN first USING (t) WHERE doc_id > low),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM hit, unnest(range(i, i + {K})) AS u(p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""

QUERIES = {"op6_substring_dedup": query}
ORACLE = {"op6_substring_dedup": SQL}
