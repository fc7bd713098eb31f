"""Operator 8, quality rules by cross-document line frequency, in DataFrame functions only.

Every line with a word is normalised (lower case, runs of digits to 0, runs of white space to one space) and hashed. A line's
frequency is the number of distinct documents of its host that hold it, counted with map-side combining. A line is boilerplate, and
removed, if more than `least_docs` documents of its host hold it, and more than `share` of the host's documents or more than
`most_docs`, so that large hosts have a limit too. A document that keeps fewer than `keep_words` words, or less than `keep_share` of
its words, is depleted and rejected. Base rules on length and repetition apply besides. Lines above the limits are few, and joins
with them leave skew to AQE.

Cases: null and blank texts have no words and fail the base rule. A null host is a host of its own. Copies of a line within one
document count once, and so do rows that repeat a doc_id within a host; each row of a null doc_id is a document. Every row gets its
verdict. Very long texts are whole: three-word windows are compared by sorting their hashes with positions, never by pairs. Up to
4,095 words a hash and its position share one long (52 bits of hash); longer texts sort 64-bit hashes beside positions. No documents
give no rows; other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, small, table, words

LEAST_DOCS, SHARE, MOST_DOCS, KEEP_WORDS, KEEP_SHARE = 10, 0.02, 2_000, 50, 0.3
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from _words: windows' hashes are sorted with their positions, so that equal ones are neighbours."""
    window, bits = "xxhash64(_words[i], _words[i + 1], _words[i + 2])", 12
    short = f"transform(sequence(0, size(_words) - 3), i -> shiftleft({window}, {bits}) | i)"
    long = f"transform(sequence(0, size(_words) - 3), i -> named_struct('h', {window}, 'i', cast(i AS bigint)))"
    df = df.withColumn("_s", F.when((F.size("_words") >= 4) & (F.size("_words") < 1 << bits), F.sort_array(F.expr(short))))
    df = df.withColumn("_l", F.when(F.size("_words") >= 1 << bits, F.sort_array(F.expr(long))))

    def twins(array: str, hash_of: str, place: str) -> str:
        own, left, right = hash_of.format("x"), hash_of.format(f"{array}[i - 1]"), hash_of.format(f"{array}[i + 1]")
        return f"sort_array(transform(filter({array}, (x, i) -> (i > 0 AND {own} = {left}) OR (i < size({array}) - 1 AND {own} = {right})), x -> {place}))"

    df = df.withColumn("_p", F.expr(f"coalesce({twins('_s', f'shiftright({{}}, {bits})', f'x & {(1 << bits) - 1}L')}, {twins('_l', '{}.h', 'x.i')})"))
    covered = "aggregate(_p, named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)"
    return df.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("_s", "_l", "_p")


def line_hashes(text) -> "F.Column":
    """Hash and number of words of each normalised line that has a word; the text is normalised once, not line by line."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0"), "\\x20*[\\x09\\x0B-\\x0D][\\x20\\x09\\x0B-\\x0D]*|\\x20{2,}", " ")
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def quality(documents: DataFrame, host_col: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, most_docs: int = MOST_DOCS, keep_words: int = KEEP_WORDS,
            keep_share: float = KEEP_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_kept_words (left by the line rule)."""
    text, key, host = F.col("text"), F.xxhash64("text").alias("_key"), F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("_host")
    full = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(HAS_WORD))
    rows = documents.select("doc_id", key, host, text.alias("_text"), words(text).alias("_words"), F.transform(full, lambda x: F.xxhash64(x)).alias("_full"))
    base = _repeat_words(rows).select(
        "doc_id", "_key", "_host", F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce("_text", F.lit("")), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
    )
    lined = cut(documents.select("doc_id", key, host, line_hashes(text).alias("_l")))
    held = lined.select("doc_id", "_host", F.explode_outer(F.array_distinct(F.transform("_l", lambda x: x["h"]))).alias("h")).where("h IS NOT NULL")
    count, sizes = _distinct_documents(held, lined.select("doc_id", "_host"))
    over = (F.col("_df") > share * F.col("_docs")) | (F.col("_df") > most_docs)
    common = count.where(F.col("_df") > least_docs).join(sizes, "_host").where(over).select("_host", "h")
    each = lined.select("doc_id", "_key", "_host", F.posexplode_outer("_l").alias("_at", "_e")).select("doc_id", "_key", "_host", "_at", "_e.h", "_e.n")
    # Line numbers make rows that repeat a document lose each line once.
    gone = each.join(common, ["_host", "h"], "left_semi").groupBy("doc_id", "_key", "_host").agg(F.collect_set(F.struct("_at", "n")).alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), F.col("_host").alias("_h"), F.expr("aggregate(_gone, 0L, (a, x) -> a + x.n)").alias("_lost"))
    met = base.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")) & (F.col("_host") == F.col("_h")), "left")
    return _verdict(met, keep_words, keep_share)


def _distinct_documents(held: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_host, h, _df) and (_host, _docs): distinct documents that hold a line, and of a host.

    Rows are counted on the map side; only those whose doc_id comes more than once are made distinct first."""
    twice = cut(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return held.groupBy("_host", "h").agg(F.count("*").alias("_df")), rows.groupBy("_host").agg(F.count("*").alias("_docs"))
    twice = small(twice)

    def once(df: DataFrame) -> DataFrame:
        return df.join(twice, "doc_id", "left_anti").unionByName(df.join(twice, "doc_id", "left_semi").distinct())

    return once(held).groupBy("_host", "h").agg(F.count("*").alias("_df")), once(rows).groupBy("_host").agg(F.count("*").alias("_docs"))


def _verdict(df: DataFrame, keep_words: int, keep_share: float) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    fine = (left >= keep_words) & (left >= keep_share * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fine).alias("kept"), left.alias("n_kept_words"))


def query(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


_W = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_NORM = r"regexp_replace(regexp_replace(trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g'), '\s+', ' ', 'g')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_W.format("text")} AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_rep FROM twice, unnest(range(i, i + 3)) AS u(p) GROUP BY rid),
line AS (SELECT rid, source, l, {_NORM} AS norm, len({_W.format("l")}) AS n FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ 	-
]')),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup FROM line GROUP BY rid),
ids AS (SELECT rid, source, coalesce('d' || doc_id, 'r' || rid) AS id FROM d),
host AS (SELECT source, count(DISTINCT id) AS n_docs FROM ids GROUP BY source),
freq AS (SELECT l.source, norm, count(DISTINCT id) AS df FROM line l JOIN ids USING (rid) GROUP BY l.source, norm),
bad AS (SELECT f.source, norm FROM freq f JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE df > {LEAST_DOCS} AND (df > {SHARE} * n_docs OR df > {MOST_DOCS})),
lost AS (SELECT rid, sum(n) AS n_lost FROM line l JOIN bad b ON l.norm = b.norm AND l.source IS NOT DISTINCT FROM b.source GROUP BY rid),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(n_lost, 0) AS BIGINT) AS n_kept_words
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_kept_words >= {KEEP_WORDS} AND n_kept_words >= {KEEP_SHARE} * n_words AS kept, n_kept_words
FROM f"""

QUERIES = {"op8_line_frequency": query}
ORACLE = {"op8_line_frequency": SQL}
