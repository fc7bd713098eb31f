"""Operator 10, benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of letters and digits (any character beyond ASCII counts as one), lower-cased in A-Z. An item is cut into windows of
`window` words (a shorter item is one window of all its words). A window's fingerprint is the least hash of the `gram`-word runs in
it, so the sliding window of winnowing is exactly one item window: a document that holds an item's window holds its fingerprint
too, and every shared span of `window` words or more is found. Hits are then extended: a window counts only where its words equal
the item's words, and all its word positions are hit.

Windows that several items share are one row with all their ids, so that hits don't multiply by items before they are confirmed.
The benchmark's windows are broadcast if a count shows them to be few and short; else fingerprints and windows meet in shuffles.

Cases: null and blank texts have no words and no hits; null items none either. Items with equal windows each count. A null doc_id is
judged like any other. Repeated rows each get their row; hits are joined by doc_id (null-safe) and the text's hash. Texts are whole.
Generators are outer ones on purpose: for others Spark infers filters that compute the arrays anew for each row. An empty benchmark
leaves every document clean; no documents give no rows. Other columns are not read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import BROADCAST_ROWS, ascii_lower, cut, small, table

WINDOW, GRAM = 10, 5
#: Bytes of windows' texts up to which a small benchmark is broadcast.
BROADCAST_BYTES = 64 << 20
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _with_fingerprints(df: DataFrame, length: int, gram: int, out: str) -> DataFrame:
    """Adds the fingerprint of every window of `length` words of the column _words, whose words' hashes are in _h."""
    k = min(gram, length)
    grams = F.expr(f"transform(sequence(1, size(_h) - {k - 1}), i -> xxhash64({', '.join(f'_h[i + {j - 1}]' for j in range(k))}))")
    df = df.withColumn("_g", F.when(F.size("_h") >= length, grams))
    wide = length - k + 1
    least = f"least({', '.join(f'_g[i + {j}]' for j in range(wide))})" if wide > 1 else "_g[i]"
    return df.withColumn(out, F.when(F.size("_h") >= length, F.expr(f"transform(sequence(0, size(_h) - {length}), i -> {least})"))).drop("_g")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))


def _windows(length: str) -> Column:
    return F.expr(f"array_join(slice(_words, _pos + 1, {length}), ' ')")


def _placed(length: int, first: bool, prints: Column) -> Column:
    """Fingerprints with their window's length and position; in the first array element 0 is not a window."""
    return F.transform(prints, lambda x, i: F.struct(F.lit(length).alias("_len"), (i - int(first)).alias("_pos"), x.alias("_fp")))


def item_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, list[int]]:
    """(_fp, _len, _text, _ids) for every distinct window of all items, cut; the windows' lengths."""
    base = _hashed(benchmark.select("item_id", item_words(F.col("text")).alias("_words")).where("size(_words) > 0"))
    lengths = sorted(r[0] for r in base.select(F.least(F.size("_words"), F.lit(window)).alias("n")).distinct().collect())  # `window` values at most
    parts = []
    for n in lengths:
        own = base.where(F.size("_words") >= n if n == window else F.size("_words") == n)
        own = _with_fingerprints(own, n, gram, "_fps").select("item_id", "_words", F.posexplode_outer("_fps").alias("_pos", "_fp")).where("_fp IS NOT NULL")
        parts.append(own.select("_fp", F.lit(n).alias("_len"), _windows(str(n)).alias("_text"), "item_id"))
    if not parts:
        none = base.select(F.lit(0).cast("long").alias("_fp"), F.lit(0).alias("_len"), F.lit("").alias("_text"), F.array("item_id").alias("_ids"))
        return none.limit(0), lengths
    return cut(reduce(DataFrame.unionByName, parts).groupBy("_fp", "_len", "_text").agg(F.collect_set("item_id").alias("_ids"))), lengths


def _rows_of_windows(docs: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """doc_id, _id, _key, _len, _pos, _fp of all windows; a row with _pos -1 stands for the document, its number of words in _fp."""
    prints = docs
    for n in lengths:
        prints = _with_fingerprints(_hashed(prints), n, gram, f"_f{n}").drop("_h")
    none = F.expr("cast(array() AS array<bigint>)")
    parts = []
    for k, n in enumerate(lengths or [window]):
        own = F.coalesce(F.col(f"_f{n}"), none) if lengths else none
        parts.append((n, k == 0, F.concat(F.array(F.size("_words").cast("long")), own) if k == 0 else own))
    ids = ["doc_id", "_id", "_key"]
    if len(parts) == 1:
        n, _, own = parts[0]
        return prints.select(*ids, F.posexplode_outer(own).alias("_at", "_fp")).select(*ids, F.lit(n).alias("_len"), (F.col("_at") - 1).alias("_pos"), "_fp")
    every = F.concat(*[_placed(n, first, own) for n, first, own in parts])
    return prints.select(*ids, F.explode_outer(every).alias("_e")).select(*ids, "_e._len", "_e._pos", "_e._fp")


def _key_of(documents: DataFrame) -> list[Column]:
    """_id and _key: the doc_id without null, and a hash of the text. Equal texts share their hits, whatever their ids."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64("text").alias("_key")]


def judged(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, _id, _key, n_words, n_hit, n_items, items_sha256, contaminated."""
    items, lengths = item_windows(benchmark, window, gram)
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).collect()[0]
    few = size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES
    near_items = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    docs = documents.select("doc_id", *_key_of(documents), item_words(F.col("text")).alias("_words"))
    rows = _rows_of_windows(docs, lengths, window, gram)
    known = items.select(F.col("_fp").alias("_ifp"), F.col("_len").alias("_ilen"), F.col("_text").alias("_itext"))
    same = (F.col("_fp") == F.col("_ifp")) & (F.col("_len") == F.col("_ilen")) & (F.col("_pos") >= 0)
    met = rows.join(near_items(known), same, "left").where("_pos < 0 OR _itext IS NOT NULL")
    met = cut(met.select("doc_id", "_id", "_key", "_len", "_pos", F.when(F.col("_pos") < 0, F.col("_fp")).alias("_n"), "_itext"))
    # Extension: the words of a window that met an item's fingerprint must equal the item's words.
    met_docs = met.where("_pos >= 0").select("_id", "_key", "_pos", "_len", "_itext").distinct()
    met_docs = cut(met_docs.groupBy("_id", "_key").agg(F.collect_list(F.struct("_pos", "_len", "_itext")).alias("_met")))
    there = F.expr("filter(_met, m -> array_join(slice(_words, m._pos + 1, m._len), ' ') = m._itext)")
    near = docs.join(small(met_docs.select("_id", "_key")), ["_id", "_key"], "left_semi")
    hits = cut(near.join(met_docs, ["_id", "_key"]).select("_id", "_key", F.inline_outer(there)).where("_pos IS NOT NULL").distinct())
    spans = hits.groupBy("_id", "_key").agg(F.collect_set(F.struct("_pos", "_len")).alias("_spans"))
    ids = items.select(F.col("_len"), F.col("_text").alias("_itext"), "_ids")
    ids = hits.select("_id", "_key", "_len", "_itext").distinct().join(near_items(ids), ["_len", "_itext"])
    ids = ids.groupBy("_id", "_key").agg(F.array_distinct(F.flatten(F.collect_list("_ids"))).alias("_items"))
    found = spans.join(ids, ["_id", "_key"]).select(F.col("_id").alias("_d"), F.col("_key").alias("_k"), "_spans", "_items")
    out = met.where("_pos < 0").join(found, (F.col("_id") == F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    covered = F.expr("size(array_distinct(flatten(transform(_spans, s -> sequence(s._pos, s._pos + s._len - 1)))))")
    listed = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id", "_id", "_key", F.col("_n").alias("n_words"), F.when(F.col("_d").isNull(), 0).otherwise(covered).cast("long").alias("n_hit"),
        F.when(F.col("_d").isNull(), 0).otherwise(F.size("_items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(listed, F.lit("")), 256).alias("items_sha256"), F.col("_d").isNotNull().alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of the input."""
    return judged(documents, benchmark, window, gram).drop("_id", "_key")


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows, with all their columns, that hold no window of the benchmark."""
    bad = judged(documents, benchmark, window, gram).where("contaminated").select("_id", "_key").distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), *_key_of(documents))
    return rows.join(small(cut(bad)), ["_id", "_key"], "left_anti").select("_row.*")


def query(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM b JOIN lens ON n = least(len(w), 10), unnest(range(1, len(w) - n + 2)) AS u(i)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(p) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""

QUERIES = {"op10_benchmark_decontamination": query}
ORACLE = {"op10_benchmark_decontamination": SQL}
