"""The operators against brute force, on odd texts, empty tables, repeated rows and clashing columns."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import check
from wardline.llm.common import Words
from wardline.llm import chat_format, decontaminate, minhash_dedup, packing, pii, quality_rules, registry, sharding, substring_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, id string, sig string, shard int"
RNG = random.Random(5)
VOCAB = [a + b for a in "bcdfgklmnprst" for b in ("a", "e", "io", "ùn", "or")]
PASSAGE = " ".join(RNG.choice(VOCAB) for _ in range(60))


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def odd_texts():
    base, long = prose(200), prose(3000)
    near = base.split()
    near[17] = "Changed"
    texts = [
        None, "", " \n\t ", "one", "One", "five words of text here", "a b c d", base, base, " ".join(near), base.upper(), long, long + " tail", prose(40) + " " + PASSAGE + "\n" + prose(30),
        PASSAGE.replace(" ", "  \n", 7), "x" * 5000, "a@b.c_d@e.f.g 1.2.3.4.5.6.7.8 999.1.1.1.2.2.2.2", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (509) 555-6973 😀 é 10.0.0.1",
        "same line\n" * 40, "😀 😀 😀 😀 😀 😀", ("na " * 200).strip(), prose(60) + " 000255.1.1.1 0256.1.1.1 +12 +1.2.3.4.5.6.7.8.9.0",
    ]
    return texts + [base + " " + prose(k) for k in (1, 3, 9, 60)] + [" ".join(near[:k]) for k in (190, 195)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, "en", f"host{i % 2}" if i % 5 else None, len(t or ""), "k", "i", "s", 3) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_pii_base_spans(docs):
    got = by_id(pii.digest(pii.find(docs)), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == {i: brute.pii(t) for i, t in pairs(docs)}


def test_pii_terms_that_disclose_an_entity_are_masked(spark):
    text = lambda i, name: f"word{i} said {name} the key is bob{i % 3}.x@mail.example.com near town and the of {i}"
    rows = [(i, text(i, "Fnord" if i % 3 == 1 else "Zorblax")) for i in range(60)] + [(100 + i, "the of and near said key is the town") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = by_id(pii.sanitise(df, classes=False), "text")
    assert out[1] == ("word1 said <NAME> the key is <EMAIL> near town and the of 1",) and out[0] == ("word0 said Zorblax the key is <EMAIL> near town and the of 0",)
    assert out[100] == (rows[60][1],)


def test_pii_terms_of_rare_entities_are_masked_in_the_whole_text(spark):
    far = "filler words without end " * 12
    text = lambda i, who, mail: f"<{who}> wrote {i}a. {far}at {mail}, {far}{i}b {who}! x:{mail}"
    rows = [(i, text(i, "Fnord", "bob@mail.example.com")) for i in range(3)] + [(10 + i, text("same", "Zork", "eve@mail.example.com")) for i in range(6)]
    rows += [(20, "0c Grue +1 509 555 6970"), (21, "Grue 1c: +1 (509) 555-6970")] + [(100 + i, f"{far}wrote {i} at") for i in range(400)]
    out = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), classes=False), "text")
    assert [out[i][0] for i in range(3)] == [f"<<NAME>> wrote {i}a. {far}at <EMAIL>, {far}{i}b <NAME>! x:<EMAIL>" for i in range(3)]
    assert all(out[10 + i][0] == f"<Zork> wrote samea. {far}at <EMAIL>, {far}sameb Zork! x:<EMAIL>" for i in range(6))  # copies are one text
    assert (out[20][0], out[21][0]) == ("0c <NAME> <PHONE>", "<NAME> 1c: <PHONE>")  # one number, written in two ways
    assert all(out[i][0] == t for i, t in rows if i >= 100)
    spans = pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"), classes=False)).where("doc_id = 0").collect()[0]["spans"]
    assert spans.startswith("term:1:6,email:") and spans.count("term:") == 2


def test_pii_flags_the_terms_that_brute_force_flags(spark):
    rng, rows = random.Random(8), []
    for i in range(300):
        w = [rng.choice(VOCAB) for _ in range(40)]
        if i % 6 == 0:
            w[7:7] = ["Inbox", f"u{i}@mail{i % 12}.example.com", "Zork" if i % 12 else "grue"]
        if i % 10 == 1:
            w[3:3] = ["token", "=", f'"{"".join(rng.choice("a1b2c3d4e5f6") for _ in range(32))}"']
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 6)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["entity"], r["term"]): r["ratio"] for r in pii.disclosures(df, pii.entities(pii.with_spans(df).withColumn("_all", F.expr(pii.ALL)))).collect()}
    want = brute.disclosures([t for _, t in rows], pii.DISCLOSURE, pii.CHANCE)
    assert set(found) == set(want) and {"zork", "inbox", "token"} <= {t for _, t in found}
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_pii_masks_terms_and_secrets_of_the_given_tables(spark, sf):
    df = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = pii.digest(pii.find(df))
    assert out.where("spans LIKE '%term:%'").count() > 0 and out.where("spans LIKE '%secret:%'").count() > 0
    base = brute.pii
    assert all((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == base(t["text"]) for r, t in zip(out.orderBy("doc_id").collect(), df.orderBy("doc_id").collect()))


def test_pii_keeps_columns_of_clashing_names(spark):
    row = (None, "mail a.b@c.de now", "KEEP", "d", "k", "t", 5, "e", "r")
    names = "doc_id long, text string, _key string, _d string, _k string, _t string, n_chars int, entity string, _row string"
    (got,) = pii.sanitise(spark.createDataFrame([row], names)).collect()
    assert tuple(got) == (None, "mail <EMAIL> now", "KEEP", "d", "k", "t", 16, "e", "r")


def test_near_duplicates(docs):
    assert by_id(minhash_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept") == brute.near_duplicates(pairs(docs))


def test_near_duplicates_in_a_large_group_of_edits(spark):
    base, rows = prose(120).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(RNG.choice([0, 1, 2, 3])):
            w[RNG.randrange(len(w))] = f"new{RNG.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (minhash_dedup.BLOCK, 20):  # in one task, and in blocks
        assert by_id(minhash_dedup.near_duplicates(df, block=block), "n_shingles", "component_id", "kept") == brute.near_duplicates(rows)


def test_large_clusters_lose_no_link_between_what_stays_apart(spark):
    # A chain: each text is near its neighbours alone; and pairs of it that only a probe finds.
    base, rows = [f"w{i}" for i in range(400)], []
    for i in range(60):
        rows.append((i, " ".join(base[3 * i : 3 * i + 120])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(rows)
    assert len({c for _, c, _ in want.values()}) == 1
    for block in (7,):
        assert by_id(minhash_dedup.near_duplicates(df, block=block), "n_shingles", "component_id", "kept") == want


def test_versions_of_one_document_connect_their_classes(spark):
    a, b, c = prose(50), prose(50), prose(50)
    rows = [(3, a), (7, a), (7, b), (9, b), (7, ""), (8, c), (8, None), (10, None), (None, a)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == sorted([("3", 3, True), ("7", 3, False), ("7", 3, False), ("7", 3, False), ("9", 3, False), ("8", 8, True), ("8", 8, True), ("10", 10, True), ("None", None, True)])


def test_near_duplicates_of_the_given_tables(spark, sf):
    df = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    assert by_id(minhash_dedup.near_duplicates(df), "n_shingles", "component_id", "kept") == brute.near_duplicates([(r["doc_id"], r["text"]) for r in df.collect()])


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 16, (200, minhash_dedup.VALUES)).astype(np.uint16)
    other = sig.copy()
    for row in other:
        row[rng.choice(minhash_dedup.VALUES, minhash_dedup.DISTANCE, replace=False)] += 1
    assert (minhash_dedup.chunk_keys(sig) == minhash_dedup.chunk_keys(other)).any(axis=1).all()


def test_substrings(docs):
    got = by_id(substring_dedup.deduplicate(docs), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substrings(pairs(docs))


def test_substrings_where_runs_are_frequent_and_hashes_clash(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("the of a b".split()) for _ in range(60)) + " " + PASSAGE for _ in range(40)] + [PASSAGE] * 3
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "FREQUENT", 5)
    bins = substring_dedup.frequent_bins(df, 2, 5)
    assert 0 < bins.sum() < 100
    assert by_id(substring_dedup.deduplicate(df), "n_words", "n_removed", "kept_sha256") == brute.substrings(rows)
    # Windows of one hash: only the words tell them apart.
    data = "\n".join(["a b c d", "a b c e", "a b c d", "x b c d"]).encode()
    words = Words(np.frombuffer(data, np.uint8), np.array([0, 8, 16, 24, 31]))
    first = np.array([0, 4, 8, 12])
    gone = substring_dedup._repeats(words, first, np.zeros(4, np.uint64), np.array([1, 2, 3, 0]), 4)
    assert gone.tolist() == [False, False, True, False]


def test_quality_base_rules(docs):
    got = by_id(quality_rules.quality(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality(t) for i, t in pairs(docs)}


def test_lines_common_within_a_host_deplete_documents(spark):
    shared = "\n".join(prose(30) for _ in range(3))
    rows = [(i, shared + "\n" + prose(20), "h") for i in range(20)] + [(100 + i, shared + "\n" + prose(20), f"g{i}") for i in range(20)] + [(200, prose(80), "h")]
    got = by_id(quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")), "kept")
    assert not any(got[i][0] for i in range(20)) and all(got[100 + i][0] for i in range(20)) and got[200][0]


def test_lines_count_distinct_documents_and_large_hosts_have_a_limit(spark):
    line = prose(30)
    rows = [(1, line + "\n" + prose(40 + i), "h") for i in range(30)] + [(2, line + "\n" + prose(70), "h")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r["n_kept_words"] == r["n_words"] for r in quality_rules.quality(frame(rows)).collect())  # two documents hold it
    many = [(None, line + "\n" + prose(60), None) for i in range(12)] + [(i, prose(60), None) for i in range(100)]
    left = quality_rules.quality(frame(many), share=0.5, most_docs=11).where("n_kept_words < n_words").collect()
    assert len(left) == 12 and {r["n_words"] - r["n_kept_words"] for r in left} == {30}
    assert quality_rules.quality(frame(many), share=0.5, most_docs=12).where("n_kept_words < n_words").count() == 0


def test_repeated_words_of_very_long_texts(spark):
    texts = [prose(4095), prose(4096), prose(9000), " ".join(f"w{i % 7000}" for i in range(9000)), " ".join(f"w{i}" for i in range(70_000)) + " w5 w6 w7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    assert by_id(quality_rules.quality(df), "n_repeat_words") == {i: (brute.quality(t)[4],) for i, t in enumerate(texts)}


def test_contamination(spark, docs):
    items = [(1, " ".join(PASSAGE.split()[5:25])), (2, "five WORDS of"), (3, prose(30)), (4, None), (5, "..."), (10, "na-na na na na na na na na na na na")]
    got = by_id(decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == {i: brute.contaminated(t, items) for i, t in pairs(docs)}
    odd = spark.createDataFrame([(None, PASSAGE, 1, "a"), (None, PASSAGE, 1, "a"), (7, "clean words", 1, "a"), (7, PASSAGE, 2, "b")], "doc_id long, text string, _id long, item_id string")
    found = decontaminate.decontaminate(odd, spark.createDataFrame(items + [(11, items[0][1])], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["contaminated"], r["n_items"]) for r in found) == [("7", False, 0), ("7", True, 2), ("None", True, 2), ("None", True, 2)]
    none = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == docs.count() and none.where("contaminated").count() == 0


def test_toxicity_learns_and_leaves_reported_and_clean_texts_alone(spark):
    bad, rows, labels = ["blarg", "idiot", "scum"], [], []
    for i in range(400):
        w = prose(30).split()
        if i % 4 == 0:
            w[RNG.randrange(30)] = bad[i // 4 % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.score(df, lab), "held_out", "predicted", "score")
    assert all(got[i][0] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert all(got[i][1] == t for i, t in labels) and all(0 <= x[2] <= 1 for x in got.values())
    assert toxicity.train(df, lab)[0]["blarg$"] == toxicity.INSULT
    empty = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "you are a pathetic loser")], "doc_id long, text string"), lab.limit(0))
    assert [r["predicted"] for r in empty.orderBy("doc_id").collect()] == [0, 0, 1]
    assert toxicity.clean(df, lab).count() == 300


def test_grammar_tells_aimed_negated_and_reported_clauses_apart():
    lexicon = toxicity.Lexicon({"blarg$": toxicity.INSULT, "snor": toxicity.HINT, "snork$": toxicity.INSULT})
    found = lambda t: {n: c for n, c in zip(toxicity.PATTERNS, toxicity.patterns(t, lexicon)) if c}
    assert found("you are an idiot") == found("idiot that you are") == {"insult_aimed": 1} and found("an idiot") == {"insult": 1} and found("not an idiot") == {"excused": 1}
    assert found("She said: you idiot. An idiot") == {"excused": 1, "insult": 1} and found("\"You idiot. Moron!\" An idiot") == {"excused": 2, "insult": 1}
    assert found("I will kill you") == {"threat_aimed": 1} and found("to kill time") == {"threat": 1} and found("you, then a blarg") == {"insult": 1} and not found("the cat")
    assert found("snoring") == {"hint": 1} and found("a snoring snorer") == {"insult": 1} and found("snork") == {"insult": 1} and found("idiot moron. idiot.") == {"piled": 1, "insult": 1}


def test_composed_transition_table_equals_the_parts_run_side_by_side():
    rng, names = random.Random(2), list(toxicity.PATTERNS)
    for _ in range(3000):
        symbols = [rng.randrange(toxicity.OTHER + 1) for _ in range(rng.randrange(1, 14))] + [toxicity.BREAK]
        state, got = 0, Counter()
        for x in symbols:
            got.update(names[p] for p in toxicity.EMIT[state][x])
            state = toxicity.STEP[state][x]
        assert got == brute.clauses(symbols, toxicity)


@pytest.mark.parametrize("sf_dir, recall, clean", [("/root/testdata/sf0.1", 0.85, 0.99), ("/root/testdata/sf0.01", 0.6, 0.99)])
def test_toxicity_on_held_out_labels(spark, sf_dir, recall, clean):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("y")).where("y IS NOT NULL")
    got = toxicity.query(spark, sf_dir).where("held_out").join(labels, "doc_id").groupBy("y").agg(F.avg("predicted").alias("p")).collect()
    rate = {r["y"]: r["p"] for r in got}
    assert rate[1] >= recall and 1 - rate[0] >= clean


def test_preference_pairs(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", "why"), (3, 0, "user", "alone"), (3, 1, "assistant", "ok"), (4, 0, None, None), (5, 0, "user", "hi"), (5, 1, "assistant", "yes")]
    got = {r["conv_id"]: r for r in chat_format.preference_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 3, 4, 5}
    assert (got[2]["chosen_id"], got[2]["prompt"], got[2]["chosen"]) == (1, "<|user|>hi<|end|>", "<|assistant|>yes<|end|>")
    assert got[2]["rejected"] == "<|assistant|>no<|end|><|user|>why<|end|>" and got[2]["rejected_mask"] == [[13, 15]]
    assert got[5]["chosen"] == "" and got[5]["n_prompt_turns"] == 2 and got[3]["rejected"] is None and got[3]["chosen_mask"] == [[13, 15]]
    for r in got.values():
        assert all(r["chosen"][s:e] in ("yes", "ok") for s, e in r["chosen_mask"])


def test_no_conversation_is_lost_to_ties_null_ids_or_hot_openings(spark):
    turns = [(None, 0, "user", "hi", 1), (-1, 0, "user", "hi", 1), (None, 0, "user", "hi", 1), (None, None, None, None, 2), (7, 0, "user", "x " * 300_000, 3), (7, 1, "assistant", "y", 3)]
    turns += [(100 + i, t, ("user", "assistant")[t], "hot" if t == 0 else f"answer {i % 7}", 4) for i in range(2500) for t in (0, 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, first long")
    got = chat_format.preference_pairs(df).collect()
    assert len(got) == 2 + 1 + 1 + 2499
    assert sorted(str(r["conv_id"]) for r in got if r["chosen_id"] == -1) == ["None", "None"]
    hot = [r for r in got if r["prompt"] == "<|user|>hot<|end|>" or r["chosen"] == ""]
    assert {r["chosen_id"] for r in got if r["conv_id"] is not None and r["conv_id"] > 100} == {100} and len(hot) >= 2499


def test_preference_pairs_equal_sql_where_openings_repeat(spark, tmp_path):
    rng, turns = random.Random(6), []
    for c in range(60):
        for t in range(rng.randrange(1, 6)):
            turns.append((c if c % 9 else None, t, rng.choice(["user", "assistant", "assistant", None]), rng.choice(["a", "bb", None, "ü😀"])))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    df.toPandas().to_parquet(tmp_path / "conversations.parquet")
    check(spark, str(tmp_path), registry.QUERIES["op4_preference_pairs"], registry.ORACLE["op4_preference_pairs"])


def test_bucket_boundaries_have_the_least_padding():
    for seed in range(20):
        rng = random.Random(seed)
        h = {rng.randint(1, 30): rng.randint(1, 20) for _ in range(rng.randint(1, 8))}
        pad = lambda ends: sum(n * (min(e for e in ends if e >= x) - x) for x, n in h.items())
        for b in (1, 2, 3):
            own = packing.boundaries(h, b)
            assert own[-1] == max(h) and len(own) <= b
            assert pad(own) == min(pad([*c, max(h)]) for k in range(b) for c in itertools.combinations(sorted(h)[:-1], k))


def test_packing_loses_nothing_and_keeps_the_budget(docs):
    out = packing.pack(docs, longest=300, buckets=4, budget=1000).collect()
    texts = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        texts[r["doc_id"]] = texts.get(r["doc_id"], b"") + bytes(r["tokens"])
        assert r["n_tokens"] <= r["bucket_tokens"] <= 300
        bytes(r["tokens"]).decode()  # no character is split
    assert texts == {i: (t or "").encode() for i, t in pairs(docs)}
    for b in {r["bucket"] for r in out}:
        own = [r for r in out if r["bucket"] == b]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        for batch in {r["batch"] for r in own}:
            assert sum(r["bucket_tokens"] for r in own if r["batch"] == batch) <= 1000


def test_sharding_is_gapless_stable_and_even(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 3 = 0, NULL, concat('t', id)) AS text")
    out = sharding.shard(df).collect()
    for s in range(8):
        own = sorted(r["slot"] for r in out if r["shard"] == s)
        assert own == list(range(len(own))) and 400 < len(own) < 600
    assert {r["grown_shard"] for r in out if r["grown_shard"] != r["shard"]} == {8}
    assert all(r["size"] == len("" if r["doc_id"] % 3 == 0 else f"t{r['doc_id']}") + 1 for r in out)
    heavy = sharding.shard(df, [1.0, 3.0]).groupBy("shard").count().collect()
    assert 2.6 < dict((r[0], r[1]) for r in heavy)[1] / dict((r[0], r[1]) for r in heavy)[0] < 3.4


def test_sharding_equals_brute_force_on_odd_ids(spark):
    ids = [None, None, 0, 0, -1, 1 << 62, -(1 << 63), *range(200)]
    df = spark.createDataFrame([(i, "t", 9, 8, 7) for i in ids], "doc_id long, text string, shard int, _block int, slot int")
    weights = [1.0, 2.0, 0.5]
    got = Counter((r["doc_id"], r["shard"], r["grown_shard"]) for r in sharding.shard(df, weights).collect())
    assert got == Counter((i, brute.rendezvous(i, weights), brute.rendezvous(i, [*weights, 3.5 / 3])) for i in ids)


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/7817?x", "http://a.com/en/", "http://evil.org/x.com/en/", "http://xcom/en/", "http://example.net/de/81", "http://net/de/8", "http://free-bets.example.fr/a", "ftp://q.fr/setup.exe?z", "http://q.fr/ü", "http://org/es/"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    none = (None, "allow")
    assert [got[i] for i in range(len(urls))] == [none, none, none, none, ("example.com/en/7", "allow"), ("com/en/", "block"), none, none, ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "block"), (None, "block"), none, ("org/es/", "block")]


def test_urls_of_any_length_and_any_id(spark):
    long = "http://q.fr/" + "a/b" * 400_000
    rows = [(None, "http://com/en/", "x"), (9007199254740993, long + ".exe", "y"), (9007199254740993, long, "z"), (5, "http://q.fr/" + "/login" * 500, "w")]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert [(r["page_id"], r["verdict"], r["method_glob"]) for r in got] == [(None, "block", None), (9007199254740993, "block", "**.exe"), (9007199254740993, "allow", None), (5, "block", "**/login**")]
    rng = random.Random(4)
    urls = ["".join(rng.choice("a/b.exlogin-") for _ in range(rng.randrange(60))) for _ in range(300)] + ["a/login" * k for k in (300, 600)]
    globs = ["**", "*a*/**", "a*b", "**/login**", "", "*", "**.e*", "a/**/b"]
    automaton = url_filter.ShiftAnd(globs)
    want = [[re.fullmatch("".join("(?s:.*)" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.split(r"(\*\*|\*)", g)), u) is not None for g in globs] for u in urls]
    assert automaton.match(urls).tolist() == want and [automaton._alone(u) for u in urls] == want


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, registry.QUERIES[name], registry.ORACLE[name])


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for df in (pii.find(none), pii.sanitise(none), minhash_dedup.near_duplicates(none), substring_dedup.deduplicate(none), quality_rules.quality(none), decontaminate.decontaminate(none, items), toxicity.score(none, lab), packing.pack(none), sharding.shard(none)):
        assert df.count() == 0
    assert chat_format.preference_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_null_ids_and_repeated_rows(spark, docs):
    twice = docs.where("doc_id IN (22, 25)").withColumn("doc_id", F.lit(7)).union(docs.where("doc_id = 22").withColumn("doc_id", F.lit(None).cast("long")))
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for df in (pii.find(twice), pii.sanitise(twice), minhash_dedup.near_duplicates(twice), substring_dedup.deduplicate(twice), quality_rules.quality(twice), decontaminate.decontaminate(twice, items), sharding.shard(twice)):
        assert df.count() == 3
    assert substring_dedup.deduplicate(twice).where("n_removed > 0").count() == 0
    assert by_id(minhash_dedup.near_duplicates(twice).where("doc_id = 7"), "component_id") == {7: (7,)}
