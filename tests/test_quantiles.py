"""Order statistics, medians as of a time, cut points and splits against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import quantiles as Q
from wardline.operators import splits as SP

SHARES = {"least": 0.0, "p1": 0.01, "q1": 0.25, "mid": 0.5, "p85": 0.85, "most": 1.0}


def rows_of_groups(rng):
    out = [("hot", 7.0)] * 900 + [("hot", rng.choice([7.0, 7.0 + 1e-9, -3.5, 1e12, rng.random()])) for _ in range(700)]
    out += [("wide", math.exp(rng.uniform(-15, 15)) * rng.choice([1, -1])) for _ in range(400)]
    out += [(None, float(rng.randint(0, 40))) for _ in range(300)] + [("one", 5.0), ("empty", None), ("empty", None), ("hot", None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sorted_rows,bins", [(100_000, 4096), (60, 128)])
def test_quantiles_equal_numpy_at_every_depth(spark, monkeypatch, sorted_rows, bins):
    monkeypatch.setattr(Q, "SORTED", sorted_rows)
    monkeypatch.setattr(Q, "BINS", bins)
    rows = rows_of_groups(random.Random(1))
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["g"]: r for r in Q.quantiles(df, ["g"], "v", SHARES).collect()}
    assert set(got) == {"hot", "wide", None, "one", "empty"}
    for g, r in got.items():
        own = np.array([v for k, v in rows if k == g and v is not None])
        assert r["n"] == len(own)
        for name, s in SHARES.items():
            assert r[name] == (pytest.approx(np.quantile(own, s), rel=1e-12) if len(own) else None)
    r = Q.quantiles(df, [], "v", SHARES).collect()
    every = np.array([v for _, v in rows if v is not None])
    assert len(r) == 1 and all(r[0][n] == pytest.approx(np.quantile(every, s), rel=1e-12) for n, s in SHARES.items())


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert Q.quantiles(df, ["g"], "v", SHARES).collect() == []
    assert [tuple(r) for r in Q.quantiles(df, [], "v", {"a": 0.5}).collect()] == [(0, None)]


@pytest.mark.parametrize("since,digits,block", [(None, 16, 7), (30, 16, 64), (5, 4, 3)])
def test_prior_quantile_equals_brute_force(spark, monkeypatch, since, digits, block):
    monkeypatch.setattr(Q, "DIGITS", digits)
    rng = random.Random(2)
    events = [(rng.choice(["a", "b", None]), rng.randint(0, 200), rng.choice([1.0, 2.5, 2.5, rng.random() * 10, None])) for _ in range(500)] + [("a", None, 3.0)]
    asks = [(rng.choice(["a", "b", None, "new"]), rng.randint(0, 210)) for _ in range(150)]
    e, a = spark.createDataFrame(events, "g string, minute long, v double"), spark.createDataFrame(asks, "g string, minute long")
    got = {(r["g"], r["minute"]): (r["n"], r["q"]) for r in Q.prior_quantile(e, a, ["g"], "v", since, 0.5, block).collect()}
    assert set(got) == set(asks)
    for (g, m), (n, q) in got.items():
        known = [v for k, t, v in events if k == g and v is not None and t is not None and t < m and (since is None or t >= m - since)]
        assert n == len(known) and q == (pytest.approx(float(np.median(known)), rel=1e-12) if known else None)
    every = {r["minute"]: r["n"] for r in Q.prior_quantile(e, a, [], "v", since, 0.5, block).collect()}
    assert every == {m: sum(v is not None and t is not None and t < m and (since is None or t >= m - since) for _, t, v in events) for m in every}


@pytest.mark.parametrize("since,fit", [(None, 60), (40, 60), (None, 15), (40, 3), (None, 0)])
def test_prior_quantile_is_the_same_however_much_a_task_holds(spark, monkeypatch, since, fit):
    """Groups that a task may hold need no pass over digits; smaller tasks take some passes, and none at all takes each digit by one."""
    rng = random.Random(9)
    events = [(rng.choice(["a", "b", None]), rng.randint(0, 100), rng.choice([1.0, 2.5, rng.random() * 10])) for _ in range(300)]
    asks = [(rng.choice(["a", "b", None, "new"]), rng.randint(0, 110)) for _ in range(120)] + [("a", None)]
    e, a = spark.createDataFrame(events, "g string, minute long, v double"), spark.createDataFrame(asks, "g string, minute long")
    rows = lambda: {(r["g"], r["minute"]): (r["n"], r["q"]) for r in Q.prior_quantile(e, a, ["g"], "v", since, 0.3, 7).collect()}
    with monkeypatch.context() as m:
        m.setattr(Q, "prior_sums", None)
        want = rows()
    assert set(want) == set(asks) and want["a", None] == (0, None)
    for (g, t), (n, q) in want.items():
        known = [v for k, at, v in events if t is not None and k == g and at < t and (since is None or at >= t - since)]
        assert n == len(known) and q == (pytest.approx(float(np.quantile(known, 0.3)), rel=1e-12) if known else None)
    monkeypatch.setattr(Q, "FIT", max(fit, 1))
    if not fit:
        monkeypatch.setattr(Q, "_most", lambda groups: 2)
    got = rows()
    assert set(got) == set(want) and all(got[x] == (n, pytest.approx(q, rel=1e-12) if n else None) for x, (n, q) in want.items())


def test_cut_points_take_dates_then_rows_then_distinct_times(spark):
    made = [("fine", d) for d in range(400)] + [("coarse", 30 * (d % 4)) for d in range(400)] + [("dated", d * 10) for d in range(400)] + [("two", 0), ("two", 5), ("none", None)]
    df = spark.createDataFrame(made, "g string, d int").withColumn("reported_at", F.expr("timestampadd(DAY, d, TIMESTAMP '2000-01-01')"))
    cuts = {r["g"]: r for r in SP.cut_points(df, "g", ("2001-12-31", "2005-01-01"), least=20).collect()}
    assert {g: r["mode"] for g, r in cuts.items()} == {"fine": "quantile", "coarse": "distinct", "dated": "dates", "two": "quantile"}
    split = SP.chronological(df, "g", ("2001-12-31", "2005-01-01"), least=20).groupBy("g", "split").count().collect()
    n = {(r["g"], r["split"]): r["count"] for r in split}
    assert n["fine", "train"] == 280 and n["fine", "val"] == 60 and n["fine", "test"] == 60
    assert n["coarse", "train"] == 200 and n["coarse", "val"] == 100 and n["coarse", "test"] == 100
    assert n["none", "unassigned"] == 1 and ("dated", "val") in n


def test_split_column_of_one_source_or_an_empty_fold(spark):
    df = lambda rows: spark.createDataFrame(rows, "src string, split string")
    full = [("a", "train"), ("a", "val"), ("a", "test")]
    assert SP.split_column(df(full), "src") == "split_by_source"
    assert SP.split_column(df([*full, ("b", "train")]), "src") == "split"
    assert SP.split_column(df([("a", "train"), ("b", "val")]), "src") == "split_by_source"
