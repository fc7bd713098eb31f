"""Operator 2, near-duplicate documents by MinHash and a multi-index Hamming join.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; shorter documents are one shingle). Its signature is 64 MinHash
values cut to b = 16 bits each. The Hamming distance of two signatures is the number of values that differ. Signatures are split
into chunks, half as many as the distance threshold and one more. By the pigeonhole principle, two signatures within the threshold
agree in some chunk but for one value at most, so each chunk is indexed once for every value left out (the allowed chunk error): 64
keys a document, and every pair within the threshold shares a key. op2 takes pairs of a similarity of 0.85 at distance 23 (12 chunks):
a value differs with chance 0.15, and more than 23 of 64 do so for about one pair in a hundred thousand. The pipeline's stage takes
0.80 at distance 28 (15 chunks), which misses about four pairs in a million; no candidate is dropped otherwise.

Groups of any size: documents with equal sets are one class, and only classes are compared. Within a key's bucket a search over
signature distances joins classes to groups and emits one row a class, never pairs; a bucket of more than `block` classes is one
group without a search. The groups of all buckets, closed over shared classes, are the clusters: every pair within the distance lies
in one. A class's full set travels to its cluster, where pairs are confirmed on full sets, nearest first; two classes that are
already connected are not compared again, which loses no link between components. A cluster beyond a block's size is dealt into
blocks by a hash, twice over, and each block is confirmed on its own; copies and edits of one text all but always connect there. What is
then still apart from the cluster's largest component, usually little, is compared with all blocks. So work grows in proportion to a
cluster's size times what stays apart in it, no task holds more than a block of each side, and no link is lost.

Components come from large-star / small-star rounds with a checkpoint each, on links between classes alone; nothing is gathered on
the driver but counts.

Cases: null, empty and blank texts have no set (n_shingles 0) and are linked with nothing. A null doc_id takes part in no link and
has no component (kept is true). Repeated rows, or versions, of one doc_id are one document for components, and each keeps its
row. Texts are whole. No documents give no rows; other columns are not read."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Words, cut, mix, slices, small, spread_join, table
from wardline.operators.graph import components

SHINGLE, VALUES, DISTANCE, SIMILAR = 5, 64, 23, 85
#: The pipeline's stage: pairs of a similarity of 0.80 and above.
STAGE_DISTANCE, STAGE_SIMILAR = 28, 80
BLOCK = 4096
#: Bytes of sets in a block of a cluster; how often a large cluster is dealt anew.
SET_BYTES, ROUNDS = 24 << 20, 2
_RNG = np.random.default_rng(23)
_MUL = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_KEY = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array):
    """The sorted distinct shingle hashes of each text."""
    for a, b, data, offsets in slices(texts):
        words = Words(data, offsets, lower=True)
        h = words.hashes()
        n = len(h)
        wide = np.zeros(0, np.uint64)
        if n >= SHINGLE:
            start = np.arange(n - SHINGLE + 1)
            wide = Words.runs(h, start, start + SHINGLE)
        for i in range(b - a):
            lo, hi = int(words.first[i]), int(words.first[i + 1])
            if hi - lo >= SHINGLE:
                yield np.unique(wide[lo : hi - SHINGLE + 1])
            elif hi > lo:
                yield Words.runs(h, np.array([lo]), np.array([hi]))
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 2048):  # long sets in parts
        low = np.minimum(low, ((s[None, a : a + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def digests(s: np.ndarray) -> tuple[int, int, int]:
    """The size of a set and two hashes of it."""
    if not len(s):
        return 0, 0, 0
    other = mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return len(s), int(np.add.reduce(mix(s)).astype(np.int64)), int(np.bitwise_xor.reduce(other).astype(np.int64))


def _sign(batches):
    for batch in batches:
        found, sig = [], []
        for s in shingle_sets(batch.column("text")):
            found.append(digests(s))
            sig.append(signature(s).tobytes() if len(s) else None)
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(sig, pa.binary())], names=["doc_id", "n", "d1", "d2", "sig"])


def _sets(batches):
    for batch in batches:
        found, sets = [], []
        for s in shingle_sets(batch.column("text")):
            found.append(digests(s))
            sets.append(s.tobytes())
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(sets, pa.binary())], names=["id", "n", "d1", "d2", "set"])


def chunks(distance: int) -> list[int]:
    """First value of each chunk, longer chunks first: so many that one of them differs in one value at most within the distance."""
    size, more = divmod(VALUES, distance // 2 + 1)
    return [c * size + min(c, more) for c in range(distance // 2 + 2)]


def chunk_keys(sig: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """64 keys for each row of signatures: each chunk with each of its values left out."""
    first = chunks(distance)
    out = np.empty((len(sig), VALUES), np.uint64)
    part = sig.astype(np.uint64) + np.uint64(1)
    for c in range(len(first) - 1):
        a, b = first[c], first[c + 1]
        terms = mix(part[:, a:b] * _KEY[None, a:b] + np.uint64(c))
        total = terms.sum(axis=1, dtype=np.uint64)
        for j in range(a, b):
            out[:, j] = mix(total - terms[:, j - a] + _KEY[j])
    return out


def _keys(batches, distance):
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
            ids = np.repeat(batch.column("id").to_numpy(), VALUES)
            yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(sig, distance).reshape(-1).view(np.int64)), pa.array(ids)], names=["k", "id"])


def _dealt(df: DataFrame) -> DataFrame:
    """The rows of each group g in one task, one group after another, smaller ids first."""
    return df.repartition("g").sortWithinPartitions("g", "id")


def _whole(batches):
    """Tables of whole groups, the batches being sorted by g."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy()
        if held and g[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        last = g[-1]
        cut_at = int(np.searchsorted(g, last, "left"))
        if cut_at:
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held)


def _columns(t: pa.Table):
    g, i, n = (t.column(c).to_numpy() for c in ("g", "id", "n"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return i, n, sig, first, np.append(first[1:], len(g))


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _near(sig: np.ndarray, n: np.ndarray, x, ys, distance: int, similar: int):
    """Distances of x from ys, and where they and the sets' sizes allow a link."""
    d = (sig[ys] != sig[x]).sum(axis=-1)
    return d, (d <= distance) & (100 * np.minimum(n[ys], n[x]) >= similar * np.maximum(n[ys], n[x]))


def _grouped(batches, distance, similar):
    """An edge to its group's least class for each class of a bucket that is within the distance of another, step by step."""
    for t in _whole(batches):
        i, n, sig, first, end = _columns(t)
        x = first[end - first == 2]
        x = x[_near(sig, n, x, x + 1, distance, similar)[1]]
        a, b = i[x + 1].tolist(), i[x].tolist()
        for lo, hi in zip(first[end - first > 2].tolist(), end[end - first > 2].tolist()):
            rest = np.arange(lo, hi)
            while len(rest) > 1:
                root, rest = rest[0], rest[1:]
                queue = [root]
                while queue and len(rest):
                    near = _near(sig, n, queue.pop(), rest, distance, similar)[1]
                    if near.any():
                        found, rest = rest[near], rest[~near]
                        a += i[found].tolist()
                        b += [int(i[root])] * len(found)
                        queue += found.tolist()
        yield _edges(a, b)


def _confirm(t: pa.Table, lo: int, hi: int, probes: np.ndarray | None, distance: int, similar: int):
    """Links that connect the classes of rows lo to hi, confirmed on full sets. `c` is the component that a class is already in.

    Without probes every pair is looked at; with probes only those with a probe in them."""
    i, n, sig = (t.column(c)[lo:hi] for c in ("id", "n", "sig"))
    i, n = i.to_numpy(), n.to_numpy()
    sig = np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(-1, VALUES)
    sets = t.column("set")[lo:hi].combine_chunks()
    own = [np.frombuffer(sets[k].as_buffer(), np.uint64) for k in range(hi - lo)]
    part = np.unique(t.column("c")[lo:hi].to_numpy(), return_inverse=True)[1]
    for x in range(hi - lo) if probes is None else np.flatnonzero(probes):
        ys = np.arange(x) if probes is None else np.flatnonzero(part != part[x])
        d, ok = _near(sig, n, x, ys, distance, similar)
        ys = ys[ok][np.argsort(d[ok], kind="stable")]
        ys = ys[part[ys] != part[x]]
        while len(ys):
            y, ys = ys[0], ys[1:]
            both = len(np.intersect1d(own[x], own[y], assume_unique=True))
            if 100 * both >= similar * (len(own[x]) + len(own[y]) - both):
                yield int(i[x]), int(i[y])
                part[part == part[y]] = part[x]
                ys = ys[part[ys] != part[x]]


def _stars(links) -> tuple[list, list]:
    """Edges that connect what the links connect, from each class to the least of its part."""
    root: dict[int, int] = {}

    def least(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for pair in links:
        low, high = sorted(map(least, pair))
        root[high] = low
    nodes = [x for x in root if least(x) != x]
    return nodes, [least(x) for x in nodes]


def _linked(batches, distance, similar):
    """What the links of each group connect; where a column `probe` is there, links between probes and the others only."""
    for t in _whole(batches):
        g = t.column("g").to_numpy()
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        probes = t.column("probe").to_numpy() if "probe" in t.column_names else None
        links = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(g)]):
            links += _confirm(t, lo, hi, None if probes is None else probes[lo:hi], distance, similar)
        yield _edges(*_stars(links))


def _large_clusters(members: DataFrame, distance: int, similar: int) -> DataFrame:
    """Links of clusters of several blocks. members: id, n, sig, set, root, blocks."""
    confirm = partial(_linked, distance=distance, similar=similar)
    members = cut(members)
    links, now = None, members.select("id", F.col("id").alias("c"))
    for r in range(ROUNDS):
        block = F.xxhash64("root", F.pmod(F.xxhash64("id", F.lit(r)), F.col("blocks")))
        found = _dealt(members.join(now, "id").select(block.alias("g"), "id", "n", "sig", "set", "c")).mapInArrow(confirm, "a long, b long")
        links = cut(found if links is None else links.unionByName(found))
        parts = components(links).select(F.col("node").alias("id"), F.col("component").alias("c"))
        now = cut(members.select("id").join(parts, "id", "left").select("id", F.coalesce("c", "id").alias("c")))
    sizes = members.join(now, "id").groupBy("root", "c").agg(F.count("*").alias("size"))
    top = sizes.groupBy("root").agg(F.max(F.struct("size", "c")).alias("top"), F.sum("size").alias("all"))
    top = cut(top.select("root", F.col("top.c").alias("top"), (F.col("all") - F.col("top.size")).alias("apart")).where("apart > 0"))
    if top.isEmpty():
        return links
    # Every class meets the probes of every hand; every probe meets the classes of every block.
    rows = members.join(now, "id").join(small(top), "root").withColumn("hands", F.ceil(F.col("apart") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    whole = rows.withColumn("hand", F.explode(F.sequence(F.lit(0), F.col("hands") - 1))).withColumn("block", own).withColumn("probe", F.lit(False))
    probes = rows.where("c <> top").withColumn("hand", F.pmod(F.xxhash64("id"), F.col("hands")).cast("int"))
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
    both = whole.unionByName(probes.select(*whole.columns)).select(F.xxhash64("root", "block", "hand").alias("g"), "id", "n", "sig", "set", "c", "probe")
    return links.unionByName(_dealt(both).mapInArrow(confirm, "a long, b long"))


def near_duplicates(documents: DataFrame, similar: int = SIMILAR, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of the input. `similar` is in percent."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(documents.mapInArrow(_sign, "doc_id long, n long, d1 long, d2 long, sig binary"))
    live, of = signed.where("n > 0 AND doc_id IS NOT NULL"), ["n", "d1", "d2"]
    classes = cut(live.groupBy(*of).agg(F.min("doc_id").alias("id"), F.count("*").alias("size"), F.first("sig").alias("sig")))
    heads = classes.select("id", "n", "sig")
    keys = cut(heads.select("id", "sig").mapInArrow(partial(_keys, distance=distance), "k long, id long"))
    sizes = cut(keys.groupBy("k").agg(F.count("*").alias("size"), F.min("id").alias("low")).where("size > 1"))
    shared = cut(spread_join(keys, sizes, ["k"], "size", ["id"]))
    searched = _dealt(shared.where(F.col("size") <= block).join(heads, "id").select(F.col("k").alias("g"), "id", "n", "sig"))
    edges = searched.mapInArrow(partial(_grouped, distance=distance, similar=similar), "a long, b long")
    clusters = components(edges.unionByName(shared.where(F.col("size") > block).select(F.col("id").alias("a"), F.col("low").alias("b"))))
    clusters = cut(clusters.select(F.col("node").alias("id"), F.col("component").alias("root")).join(heads, "id"))
    totals = clusters.groupBy("root").agg(F.count("*").alias("size"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") * 8 / SET_BYTES)).alias("blocks"))
    members = cut(spread_join(clusters, cut(totals), ["root"], "size", ["id"]))
    texts = documents.join(small(members.select(F.col("id").alias("doc_id")), 100_000), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "id long, n long, d1 long, d2 long, set binary").join(classes.select("id", *of), ["id", *of]).select("id", "set")
    placed = sets.dropDuplicates(["id"]).join(members, "id")
    few = _dealt(placed.where("blocks = 1").select(F.col("root").alias("g"), "id", "n", "sig", "set", F.col("id").alias("c")))
    links = few.mapInArrow(partial(_linked, distance=distance, similar=similar), "a long, b long")
    if not members.where("blocks > 1").isEmpty():
        links = links.unionByName(_large_clusters(placed.where("blocks > 1"), distance, similar))
    return _with_components(signed, live, classes, links)


def _with_components(signed: DataFrame, live: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    of = ["n", "d1", "d2"]
    ids = cut(spread_join(live.select("doc_id", *of), classes.drop("sig"), of, "size", ["doc_id"]).select("doc_id", "id"))
    # Versions of one document connect their classes.
    versions = ids.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("doc_id", "low")
    versions = ids.join(versions, "doc_id").select(F.col("id").alias("a"), F.col("low").alias("b"))
    roots = components(links.unionByName(versions)).select(F.col("node").alias("id"), F.col("component").alias("root"))
    known = cut(classes.drop("sig").join(roots, "id", "left").select(*of, "size", F.coalesce("root", "id").alias("root")))
    out = spread_join(live.select("doc_id", *of), known, of, "size", ["doc_id"]).select("doc_id", "n", "root")
    dead = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", "n")
    own = out.join(small(cut(dead.select("doc_id").distinct())), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("root").alias("root"))
    out = out.unionByName(dead.join(own, "doc_id", "left").select("doc_id", "n", F.coalesce("root", "doc_id").alias("root")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"))


def distinct_documents(documents: DataFrame, similar: int = SIMILAR, distance: int = DISTANCE) -> DataFrame:
    """One row, with all its columns, of each group of near-duplicates: the smallest doc_id's.

    Rows of a null doc_id take part under an id made from their text, above all others. Of repeated rows and versions of one doc_id
    the one whose text has the least hash stays."""
    made = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), made).alias("_id"), F.xxhash64("text").alias("_h"), "text")
    near = near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"), similar, distance)
    gone = small(cut(near.where("NOT kept").select(F.col("doc_id").alias("_id")).distinct()))
    twice = small(cut(near.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")))
    left = rows.drop("text").join(gone, "_id", "left_anti")
    once = left.join(twice, "_id", "left_semi").groupBy("_id").agg(F.min_by("_row", "_h").alias("_row"))
    return left.join(twice, "_id", "left_anti").select("_row.*").unionByName(once.select("_row.*"))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_minhash_dedup": query}
ORACLE: dict[str, str] = {}
