"""Whitening, ranked search and best-fit packing against brute force, on odd rows, empty tables, ties and clashing columns."""

import itertools
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import check
from wardline.llm import best_fit, ranked_search, whitening
from wardline.llm.common import table

DOCS = "doc_id long, text string, item_id string, rank int, term string, score long, piece int, n long, sequence_id string"


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# ---- whitening ----------------------------------------------------------------------------------------------------


def brute_whiten(vectors, most=16):
    kept = [v for v in vectors if v and all(c is not None and math.isfinite(c) and abs(64 * c) < 2.0**62 for c in v)]
    lists = {tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in kept}
    sizes = Counter(len(x) for x in lists)
    d = max(sizes, key=lambda s: (sizes[s], s)) if sizes else 0
    x = [v for v in sorted(lists) if len(v) == d]
    n, s = len(x), [sum(v[j] for v in x) for j in range(d)]
    c = np.array([[n * a - b for a, b in zip(v, s)] for v in x], np.float64) / max(n, 1)
    e, u = np.linalg.eigh(c.T @ c / max(n, 1)) if n else (np.zeros(0), np.zeros((0, 0)))
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, d, s, e, u, float((c * c).sum() / max(n, 1))


def close(got, vectors, most=16):
    """Holds rows of whiten() against brute force; components whose variances nearly meet may turn among themselves."""
    n, d, s, e, u, trace = brute_whiten(list(vectors.values()), most)
    some = e > 1e-12 * trace
    e, u = e[some], u[:, some]
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    kept = {i: v for i, v in vectors.items() if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)}
    assert set(by) == (set(kept) if len(e) else set())
    for i, v in kept.items() if len(e) else ():
        x = [math.floor(64 * c) + 1_000_000 for c in v]
        moved = [n * a - b for a, b in zip(x, s)]
        want = np.array([float(m) / n for m in moved]) @ u / np.sqrt(e)
        have = by[i]
        assert sorted(have) == list(range(1, len(e) + 1))
        assert {r["n"] for r in have.values()} == {n} and {r["deviation"] for r in have.values()} == {sum(m * m for m in moved)}
        for k in range(len(e)):
            assert abs(have[k + 1]["explained"] - e[k] / trace) <= 1e-10
            lone = (k == 0 or e[k - 1] - e[k] > 1e-3 * e[0]) and (k + 1 == len(e) or e[k] - e[k + 1] > 1e-3 * e[0])
            if lone:
                assert abs(abs(have[k + 1]["whitened"]) - abs(want[k])) < 1e-8 * (1 + abs(want[k]))
    assert all(r["identity_error"] < 1e-10 for r in got)


def test_whitening_equals_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    made = {i: [float(c) for c in rng.normal(size=5) * [5, 3, 2, 1, 0.5]] for i in range(60)}
    made |= {100: None, 101: [], 102: [1.0, None, 0.0, 0.0, 0.0], 103: [float("nan")] + [0.0] * 4, 104: [float("inf")] + [0.0] * 4, 105: [1.0, 2.0], 106: made[3], 107: made[3], 108: [c + 1e-4 for c in made[4]]}
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in made.items()], "vec_id long, embedding array<float>, whitened double, component int")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    close(whitening.whiten(df.repartition(3)).collect(), vectors)


def test_whitening_of_large_numbers_is_exact(spark):
    made = {i: [float(2**40 + i * 2**36), float(-(2**44)), float(i * i), 0.0] for i in range(9)}
    df = spark.createDataFrame(list(made.items()), "vec_id long, embedding array<double>")
    n, d, s, e, u, trace = brute_whiten(list(made.values()))
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    for i, v in made.items():
        exact = sum((n * (math.floor(64 * c) + 1_000_000) - b) ** 2 for c, b in zip(v, s))
        assert got[i] == (exact if exact < 2**63 else None)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_whitening_without_variance_gives_no_rows(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).collect() == []


def test_whitening_null_ids_and_repeated_rows_stay(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert Counter(r["vec_id"] for r in whitening.whiten(df).collect()) == {None: 4, 1: 4}


@pytest.mark.parametrize("direct", [64, 0])
def test_whitening_equals_brute_force_on_the_given_table(spark, sf, monkeypatch, direct):
    monkeypatch.setattr(whitening, "DIRECT", direct)
    df = table(spark, sf, "embeddings")
    close(whitening.query(spark, sf).collect(), {r["vec_id"]: r["embedding"] for r in df.select("vec_id", "embedding").collect()})


@pytest.mark.parametrize("name", ["spread", "ties", "decay", "rank3", "narrow"])
def test_jacobi_davidson_reaches_double_precision(name):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(120, 300))
    q = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    turned = lambda e: (q[: len(e), : len(e)] if len(e) == 60 else np.linalg.qr(rng.normal(size=(len(e), len(e))))[0])
    values = {"ties": [5.0] * 20 + [1.0] * 40, "decay": [2.0**-k for k in range(60)], "rank3": [1.0] * 3 + [0.0] * 57, "narrow": [1 + 1e-5 * k for k in range(40)]}
    m = a @ a.T / 300 if name == "spread" else (t := turned(values[name])) @ np.diag(values[name]) @ t.T
    m = (m + m.T) / 2
    products = itertools.count()

    def product(w):
        next(products)
        return m @ w

    e, u = whitening.jacobi_davidson(product, len(m), 16)
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(m))[::-1][:16], rtol=0, atol=1e-13 * e[0])
    assert np.linalg.norm(m @ u - u * e, axis=0).max() < 1e-12 * e[0]
    assert np.abs(u.T @ u - np.eye(16)).max() < 1e-12
    assert next(products) < 400


# ---- ranked search ------------------------------------------------------------------------------------------------


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top=10):
    terms = [(i, Counter(brute_terms(t))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_all, l_all = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    wanted = {}
    for k, t in items:
        wanted.setdefault(k, set()).update(brute_terms(t))
    out = []
    for k, ts in wanted.items():
        scores = []
        for i, c in terms:
            m = 100 - 90 + (90 * sum(c.values()) * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(k, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def some_docs(seed=1, n=300):
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(80)] + ["Ünï", "x9", "é", "ÀB", "日本"]
    texts = [" ".join(rng.choice(vocab[: int(rng.integers(3, 85))], size=int(rng.integers(1, 60)))) for _ in range(n)]
    odd = [None, "", " .,;", "W1-w1_W1", "w1" * 3000, "w2 " * 20000, texts[0], texts[0], texts[0].upper(), "a\tb\nc", " w3 ", "w4\x7fw5"]
    return [(i * 2, t) for i, t in enumerate(texts)] + [(1001 + i, t) for i, t in enumerate(odd)] + [(7, texts[5]), (7, texts[5]), (None, texts[6]), (None, texts[7])]


ITEMS = [(1, "w1 w2 w3"), (2, "nothing here"), (3, None), (4, ""), (5, "w70 w71 w72 w73 é Ünï"), (5, "w79"), (None, "w10 w11"), (6, " ".join(f"w{k}" for k in range(80))), (7, "日本, Àb"), (8, "W1!w1?")]


def searched(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame([(i, t, "x", 1, "t", 5, 0, 9, "s") for i, t in docs], DOCS).repartition(parts)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    return sorted(rows_of(ranked_search.search(d, q, **more), "item_id", "rank", "doc_id", "score"), key=str)


@pytest.mark.parametrize("postings,parts", [(1_000_000, 1), (200, 3), (1, 2)])
def test_search_equals_brute_force(spark, monkeypatch, postings, parts):
    monkeypatch.setattr(ranked_search, "POSTINGS", postings)
    docs = some_docs(n=300 if postings > 1 else 40)
    assert searched(spark, docs, ITEMS, parts) == brute_search(docs, ITEMS)


def test_search_of_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEMS", 3)
    docs = some_docs(2, 60)
    assert searched(spark, docs, ITEMS) == brute_search(docs, ITEMS)


def test_search_of_many_equal_documents_takes_the_least_ids(spark):
    docs = [(5000 - i, "w1 w2 w3 w4") for i in range(2000)] + [(9000 + i, "other words") for i in range(4000)]
    assert searched(spark, docs, ITEMS[:1], 2) == brute_search(docs, ITEMS[:1])
    assert [r[2] for r in sorted(searched(spark, docs, ITEMS[:1]), key=lambda r: r[1])] == list(range(3001, 3011))


@pytest.mark.parametrize("docs,items", [([], ITEMS), ([(1, None)], ITEMS), (some_docs(3, 8), []), (some_docs(3, 8), [(1, "")])])
def test_search_of_empty_tables(spark, docs, items):
    assert searched(spark, docs, items) == []


def test_interval_bounds_leave_most_documents_unscored(spark):
    """The tenth place prunes: documents of common terms alone are never scored."""
    rng = np.random.default_rng(4)
    n = 20_000
    terms = np.concatenate([np.zeros(n, np.int64), np.full(50, 1)])
    docs = np.concatenate([np.arange(n), rng.choice(n, 50, replace=False)])
    impacts = np.concatenate([rng.integers(1, 100, n), np.full(50, 1000)])
    block = ranked_search.Block(terms, docs, impacts, n, 2)
    calls = []
    bounds = block._bounds
    block._bounds = lambda low, high: calls.append(len(low)) or bounds(low, high)
    held = block.search(np.array([0, 1]), 10, np.arange(n), [])
    total = np.zeros(n, np.int64)
    np.add.at(total, docs, impacts)
    best = sorted(((int(s), i) for i, s in enumerate(total)), key=lambda x: (-x[0], x[1]))[:10]
    assert held == best and sum(calls) < n / 10


def test_search_equals_sql(spark, sf):
    check(spark, sf, ranked_search.query, ranked_search.SQL)


# ---- best-fit packing ---------------------------------------------------------------------------------------------


def tokenized(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def packed_well(rows, docs, longest):
    """Checks pieces against the documents' ids, and sequences for gapless places within the limit; gives the number of sequences."""
    want = Counter()
    for (i, _), ids in zip(docs, tokenized([t for _, t in docs]), strict=True):
        first = len(ids) % longest or longest
        cuts = [0, *range(first, len(ids), longest), len(ids)] if len(ids) > longest else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= longest
    return len(places)


def test_ids_of_every_code_point_are_those_of_the_other_library():
    encoding = best_fit._encoding(best_fit.tokenizer_path())
    texts = [f"a{c}b1{c}2.{c}! {c}{c} z{c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    for k in range(0, len(texts), 65_536):
        part = texts[k : k + 65_536]
        assert all(ids == [*encoding.encode_to_numpy(t, disallowed_special=()).tolist(), 2] for t, ids in zip(part, tokenized(part), strict=True))


@pytest.mark.parametrize("longest,parts", [(1024, 3), (64, 2), (7, 1)])
def test_packing_of_odd_documents(spark, longest, parts):
    docs = some_docs(5, 120) + [(None, None), (2001, "<|endoftext|> <s>"), (2002, "x" * 9000), (2003, "😀 é 日本語 " * 50)]
    df = spark.createDataFrame([(i, t, "x", 1, "t", 5, 0, 9, "s") for i, t in docs], DOCS).repartition(parts)
    rows = best_fit.pack(df, longest=longest, rounds=60).collect()
    n = packed_well(rows, docs, longest)
    assert n <= 1.05 * sum(r["length"] for r in rows) / longest + 3


def test_packing_the_given_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = best_fit.query(spark, sf).collect()
    assert packed_well(rows, docs, 1024) <= math.ceil(sum(r["length"] for r in rows) / 1024) + 2


def test_packing_of_no_documents(spark):
    assert best_fit.pack(spark.createDataFrame([], DOCS)).collect() == []


def test_configuration_is_the_best_bounded_knapsack():
    rng = np.random.default_rng(6)
    for _ in range(30):
        sizes, most = rng.integers(1, 12, 5), rng.integers(1, 5, 5)
        sizes = np.unique(sizes)
        most, value = most[: len(sizes)], rng.random(len(sizes))
        got = best_fit.configuration(sizes, value, most, 20)
        options = itertools.product(*[range(int(m) + 1) for m in most])
        best = max(float(np.dot(o, value)) for o in options if np.dot(o, sizes) <= 20)
        assert (got <= most).all() and got @ sizes <= 20 and abs(got @ value - best) < 1e-9


def optimum(lengths, capacity):
    """The fewest bins, by search over bins' rooms."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= lengths[k]:
                place(k + 1, rooms[:i] + [rooms[i] - lengths[k]] + rooms[i + 1 :])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_plan_is_near_the_optimum_and_holds_each_piece_once():
    rng = np.random.default_rng(7)
    for _ in range(20):
        lengths = sorted(rng.integers(2, 12, 9).tolist(), reverse=True)
        sizes = np.array(sorted(set(lengths), reverse=True))
        demand = np.array([lengths.count(s) for s in sizes])
        plan = best_fit.rounded(sizes, demand, best_fit.solve(sizes, demand, 12, 60), 12)
        assert (sum(c * n for c, n in plan) == demand).all() and all(c @ sizes <= 12 for c, _ in plan)
        assert sum(n for _, n in plan) <= optimum(lengths, 12) + 1


def test_plan_beats_padding_each_piece_alone():
    """Pieces of 6 and 4 with a limit of 10 meet in pairs; best-fit alone would do so too, 4-3-3 beside 5-5 needs the program's counts."""
    plan = best_fit.planned({4: 100, 3: 200, 5: 200}, 10, 200)
    assert int(plan["sequence"].max()) < 210


def test_toxicity_after_fitting_on_a_given_table(spark):
    """The fitted weights keep the grammar's order, aimed insults and threats are enough, and nine in ten held-out toxic texts are found."""
    from wardline.llm import toxicity

    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    units, beta = toxicity.train(docs, labels)
    weight = dict(zip(toxicity.PATTERNS, beta[1:]))
    assert all(w >= 0 for w in weight.values()) and weight["threat_aimed"] > weight["threat"]
    for a, b in (("hint", "insult"), ("insult", "piled"), ("hint_aimed", "insult_aimed"), ("insult_aimed", "piled_aimed"), ("hint", "hint_aimed"), ("insult", "insult_aimed"), ("piled", "piled_aimed")):
        assert weight[a] <= weight[b]
    lexicon = toxicity.Lexicon(units)
    score = lambda text: toxicity._scores([text], lexicon, np.array(beta))[0][0]
    for aimed, weaker in (
        ("you are an idiot", ["an idiot", "you are not an idiot", 'he said "you are an idiot"']), ("I will kill you", ["to kill time", "I will never kill you", 'she wrote "I will kill you"']),
    ):
        assert score(aimed) >= 0.5 and all(score(w) < score(aimed) for w in weaker) and all(score(w) < 0.5 for w in weaker[1:])
    y = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    got = toxicity.query(spark, sf_dir).where("held_out").join(y, "doc_id").groupBy("y").agg(F.avg("predicted").alias("p")).collect()
    rate = {r["y"]: r["p"] for r in got}
    assert rate[1] >= 0.9 and rate[0] <= 0.01


def test_toxicity_weights_stay_in_order_whatever_the_labels_say():
    from wardline.llm import toxicity

    rng = np.random.default_rng(5)
    for y in (0, 1):
        x = toxicity.strength(rng.integers(0, 3, (60, len(toxicity.PATTERNS))))
        beta = toxicity.fit(x, np.full(60, float(y)), np.ones(60))
        w = dict(zip(toxicity.PATTERNS, beta[1:]))
        assert np.isfinite(beta).all() and min(w.values()) >= 0 and w["insult_aimed"] >= w["insult"] and beta[0] + w["threat_aimed"] > 0
