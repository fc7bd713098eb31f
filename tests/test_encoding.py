"""Codes, even parts, dealt values and lookups: what is read once, what moves, and that results are those of brute force."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from wardline import catalog
from wardline.operators import metrics as M
from wardline.operators import models as L
from wardline.operators.storage import cut


def test_codes_are_looked_up_where_rows_are(spark):
    k = F.col("id")
    df = cut(spark.range(500).select("id", F.when(k % 11 > 0, F.concat(F.lit("v"), F.floor(F.sqrt(k)).cast("string"))).alias("c"), (k % 3 > 0).alias("known")))
    train = df.where("known AND id < 450")
    found = L.encode(df, train, ["c"], 4)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    n = Counter(r["c"] or L.MISSING for r in train.collect())
    code = {v: i if i < 4 else 4 for i, (v, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0])))}
    assert all(r["c_code"] == code.get(r["c"] or L.MISSING, -1) for r in found.collect())


def test_parts_of_a_fit_have_some_rows_whatever_the_table(spark, monkeypatch):
    monkeypatch.setattr(L, "EVEN", 100)
    parts = L.evened(cut(spark.range(5000).coalesce(1)), "id").rdd.glom().map(len).collect()
    assert len(parts) == 50 and max(parts) < 200 and sum(parts) == 5000


def test_values_are_dealt_by_one_move_for_all_seeds(spark):
    df = cut(spark.range(900).select("id", (F.col("id") * 2).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") * 3).alias("y"), (F.col("id") * 7).alias("t"), F.pmod(F.xxhash64("id"), F.lit(L.BLOCKS)).alias("b")))
    found = L.dealt(df.drop("b"), ["x", "y"], ["7|0", "7|1"], "id", ["t"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and "Join" not in plan
    blocks, want = {}, {}
    for r in df.collect():
        blocks.setdefault(r["b"], []).append(r)
    for rows in blocks.values():
        own = sorted(rows, key=lambda r: r["id"])
        others = [sorted(rows, key=lambda r: hashlib.md5(f"{s}|{r['id']}".encode()).hexdigest()) for s in ("7|0", "7|1")]  # noqa: B023
        want |= {r["t"]: (r["x"], r["y"], [(o[i]["x"], o[i]["y"]) for o in others]) for i, r in enumerate(own)}
    assert {r["t"]: (r["x"], r["y"], [tuple(o) for o in r["_others"]]) for r in found.collect()} == want


def test_a_known_aggregate_of_all_rows_is_not_made_again(spark, monkeypatch):
    df = cut(spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("y")))
    want = sorted(map(tuple, M.lookup_prediction(df.where("k < 2"), df, ["k"], "y").collect()))
    known, made = cut(M.overall(df.where("k < 2"), "y")), []
    quantiles = M.quantiles
    monkeypatch.setattr(M, "quantiles", lambda *a: made.append(a[1]) or quantiles(*a))
    assert sorted(map(tuple, M.lookup_prediction(df.where("k < 2"), df, ["k"], "y", overall=known).collect())) == want and made == [["k"]]


def test_importance_and_regressor_cover_all_parts(spark, sf):
    q = catalog.queries()
    assert {r["feature"]: r["repeats"] for r in q["mlx6_permutation_importance"](spark, sf).collect()} == dict.fromkeys(("category_code", "city_code", "subcategory_code", "hour", "sla"), 5)
    assert {r["split"] for r in q["mlx2_resolution_regressor"](spark, sf).collect()} == {"train", "val", "test"}
