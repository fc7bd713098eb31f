"""Operator 12, ranked lexical search by range-maximum tables over posting lists.

A first scan finds, in every whole text, the terms that any item holds, with their occurrences, and counts all terms; N, L and each
term's documents are counts over all documents. A second pass searches: a block of documents, in the order of doc_id, has a posting
list for each term, with the impact that each posting adds to a score, and a sparse table that answers which posting of any stretch of a list has the
greatest impact. An item starts with one interval, the block. The sum of its lists' maxima bounds the score of every document inside;
the intervals of the greatest bounds are split at the document of their greatest single impact, which is scored in full, until no
bound can reach the item's tenth place, which goes from block to block of a task. So every document is either scored or bounded below ten others.

Only the found terms are written, each block is a stretch of an input partition, and the partitions' best rows meet in two rounds
(a salted one first): no text is shuffled and no task holds a posting list of the whole table, however frequent its term. Items are a
query set; they go to the tasks in parts of at most ITEMS items, so a large set takes more passes and not more memory.

Cases: null and empty texts and texts without a term rank nowhere and are not counted in N. An item without terms, or one whose
terms no document holds, has no rows. Rows of `items` with one item_id are one item with the terms of all; a null item_id is an item.
Repeated rows of a document rank each on its own (ranks stay unique); equal scores go by doc_id, null last. Empty tables give no
rows. Other columns are not read."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import ascii_lower, cut, slices, table

TOP = 10
#: Items, and rows of (item, term), of one pass.
ITEMS, ITEM_TERMS = 2_000, 400_000
#: Postings of one block of documents.
POSTINGS = 1_000_000
#: Intervals that are split at a time.
BEAM = 64
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTE = np.arange(256)
_IN_TERM = (_BYTE >= 128) | (_BYTE >= 48) & (_BYTE < 58) | (_BYTE >= 65) & (_BYTE < 91) | (_BYTE >= 97) & (_BYTE < 123)
_LOWER = np.where((_BYTE >= 65) & (_BYTE < 91), _BYTE + 32, _BYTE).astype(np.uint8)


def item_terms(items: DataFrame, ident: str = "item_id", text: str = "text") -> DataFrame:
    """item, term: the distinct terms of each item."""
    found = items.select(F.col(ident).alias("item"), F.explode(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAP)).alias("term"))
    return found.where("term <> ''").distinct()


# ---- terms of documents -------------------------------------------------------------------------------------------


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a run of texts, lower-cased, and the number of the text that each is from."""
    inside = _IN_TERM[data]
    head = np.zeros(len(data) + 1, dtype=bool)
    head[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | head[1:-1]
    end[:-1] &= ~inside[1:] | head[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    bounds = np.empty(2 * len(starts) + 1, np.int32)  # terms and the gaps between them, by turns
    bounds[0:-1:2], bounds[1:-1:2], bounds[-1] = starts, ends, ends[-1] if len(ends) else 0
    both = pa.Array.from_buffers(pa.string(), 2 * len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[data])])
    return both, np.searchsorted(offsets, starts, "right") - 1


def found_terms(documents: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in the vocabulary, ascending), tfs: a row for each document that has a term."""

    def run(batches):
        known = pa.array(vocabulary.value, pa.string())
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                both, of = terms_of(data, offsets)
                number = pc.index_in(both, value_set=known)[::2].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = number >= 0
                key, tf = np.unique(of[hit] * len(known) + number[hit], return_counts=True)
                doc, n = key // max(1, len(known)), np.bincount(of, minlength=b - a)
                cuts = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (key - doc * len(known), tf)]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


# ---- the search in one block --------------------------------------------------------------------------------------


class Block:
    """Posting lists of a block's documents (by term, then by document) with one sparse table of the places of greatest impacts."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((docs, terms))
        self.docs, self.impacts, self.n_docs = docs[order], np.append(impacts[order], 0), n_docs
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.keys = terms[order] * n_docs + self.docs
        longest = int(np.diff(self.lists).max(initial=1))
        self.best = [np.arange(len(docs), dtype=np.int32)]
        for level in range(longest.bit_length() - 1):
            left, right = self.best[-1][: -(1 << level)], self.best[-1][1 << level :]
            self.best.append(np.where(self.impacts[left] >= self.impacts[right], left, right))
        self.log = np.zeros(longest + 1, np.int64)
        for level in range(1, longest.bit_length()):
            self.log[1 << level :] = level

    def greatest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the greatest impact (the first of equal ones) among the places low..high-1 of a list; -1 if there is none."""
        out = np.full(low.shape, -1, np.int64)
        level = self.log[np.maximum(high - low, 0)]
        for k in np.unique(level[high > low]):
            at = (level == k) & (high > low)
            first, last = self.best[k][low[at]], self.best[k][high[at] - (1 << k)]
            out[at] = np.where(self.impacts[first] >= self.impacts[last], first, last)
        return out

    def search(self, terms: np.ndarray, top: int, ids: np.ndarray, held: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The `top` best (score, id) of this block's documents and of `held`; `ids` ascends over the block's documents."""
        terms = terms[self.lists[terms + 1] > self.lists[terms]]
        if not len(terms):
            return held
        low, high = self.lists[terms][None, :], self.lists[terms + 1][None, :]
        begin = np.zeros(1, np.int64)
        bound, split = self._bounds(low, high)
        while len(bound):
            if len(held) == top:
                least, last = held[-1]
                alive = (bound > least) | (bound == least) & (ids[begin] < last)
                low, high, begin, bound, split = low[alive], high[alive], begin[alive], bound[alive], split[alive]
                if not len(bound):
                    break
            # most at a time BEAM intervals, those of the greatest bounds and among equals the first
            order = np.lexsort((begin, -bound))
            now, later = order[:BEAM], order[BEAM:]
            doc = self.docs[split[now]]
            place = np.searchsorted(self.keys, terms[None, :] * self.n_docs + doc[:, None])
            there = self.keys[np.minimum(place, len(self.keys) - 1)] == terms[None, :] * self.n_docs + doc[:, None]
            score = np.where(there, self.impacts[place], 0).sum(axis=1)
            held = sorted(held + list(zip(score.tolist(), ids[doc].tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:top]
            new_low = np.concatenate([low[now], place + there])
            new_high = np.concatenate([place, high[now]])
            new_begin = np.concatenate([begin[now], doc + 1])
            new_bound, new_split = self._bounds(new_low, new_high)
            some = new_bound > 0
            low, high, begin = (np.concatenate([x[later], y[some]]) for x, y in ((low, new_low), (high, new_high), (begin, new_begin)))
            bound, split = np.concatenate([bound[later], new_bound[some]]), np.concatenate([split[later], new_split[some]])
        return held

    def _bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval: the sum of its lists' maxima, and the place of the greatest of them."""
        at = self.greatest(low, high)
        most = np.where(at >= 0, self.impacts[at], 0)
        row = np.arange(len(at))
        return most.sum(axis=1), at[row, most.argmax(axis=1)]


def _best_rows(found: DataFrame, weights, by_item, n_all: int, l_all: int, top: int) -> DataFrame:
    """item_no, id (NULL_ID for null), score: the best rows of each partition."""

    def blocks(batches):
        held, size = [], 0
        for batch in batches:
            lengths = pc.list_value_length(batch.column("terms")).to_numpy()
            a = 0
            while a < len(lengths):
                take = max(1, int(np.searchsorted(np.cumsum(lengths[a:]), POSTINGS - size, "right")))
                held.append(batch.slice(a, take))
                size += int(lengths[a : a + take].sum())
                a += take
                if size >= POSTINGS or a < len(lengths):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        w, items, best = weights.value, by_item.value, {}
        for part in blocks(batches):
            part = part.combine_chunks()
            raw = part["doc_id"].combine_chunks()
            raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
            ids = np.where(raw.is_null().to_numpy(zero_copy_only=False), NULL_ID, raw.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            counts = pc.list_value_length(part["terms"]).to_numpy()
            terms, tf = (pc.list_flatten(part[c]).to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            if not len(terms):
                continue
            m = 10 + 90 * part["n"].to_numpy() * n_all // l_all
            impact = w[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, counts)))
            block = Block(terms, np.repeat(rank, counts), impact, len(ids), len(w))
            for k, own in enumerate(items):
                best[k] = block.search(own, top, ids[order], best.get(k, []))
        rows = [(k, i, s) for k, held in best.items() for s, i in held]
        part_of = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))] + [pa.array([part_of] * len(rows), pa.int32())], names=["item_no", "id", "score", "part"])

    return found.where("size(terms) > 0").mapInArrow(run, "item_no int, id long, score long, part int")


NULL_ID = (1 << 63) - 1


def _pass(found_in: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """The result for one part of the items; `terms` (item, term) is small enough for the driver."""
    spark = found_in.sparkSession
    pairs = terms.orderBy("item", "term").collect()  # at most ITEM_TERMS rows, but for a single longer item
    vocabulary = sorted({r["term"] for r in pairs})
    number, items = {t: k for k, t in enumerate(vocabulary)}, {}
    for r in pairs:
        items.setdefault(r["item"], []).append(number[r["term"]])
    found = cut(found_terms(found_in, spark.sparkContext.broadcast(vocabulary)))
    n_all, l_all = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the vocabulary of these items at most
        df[term] = n
    weights = np.floor(1000 * np.log((2.0 * n_all + 2) / (2.0 * df + 1))).astype(np.int64)
    own = [np.array(sorted(x), np.int64) for x in items.values()]
    best = _best_rows(found, spark.sparkContext.broadcast(weights), spark.sparkContext.broadcast(own), n_all, l_all, top).where("score > 0")
    for by in (["item_no", F.pmod("part", F.lit(64))], ["item_no"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(items)), f"item_no int, item_id {terms.schema['item'].dataType.simpleString()}")
    kind = found_in.schema["doc_id"].dataType.simpleString()
    best = best.join(F.broadcast(names), "item_no")  # at most ITEMS rows
    return best.select("item_id", "rank", F.when(F.col("id") != NULL_ID, F.col("id")).cast(kind).alias("doc_id"), "score")


def search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item."""
    terms = cut(item_terms(items))
    n_items, n_rows = terms.agg(F.countDistinct(F.struct("item")), F.count("*")).collect()[0]
    parts = max(1, -(-n_items // ITEMS), -(-n_rows // ITEM_TERMS))
    mine = [terms.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k) for k in range(parts)]
    return reduce(DataFrame.unionByName, [_pass(documents, t, top) for t in mine])


def query(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
occ AS (SELECT rid, unnest(t) AS term FROM d),
p AS (SELECT rid, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, totals GROUP BY term, n_docs),
s AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(t) * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (rid), totals GROUP BY item_id, rid, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

QUERIES = {"op12_ranked_search": query}
ORACLE = {"op12_ranked_search": SQL}
