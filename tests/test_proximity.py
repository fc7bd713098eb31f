"""Density and near pairs against brute force, with hot places and every way of counting them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import duplicates, geo, proximity

DAY = 86_400


def metres(a, b):
    y1, x1, y2, x2 = (math.radians(v) for v in (*a, *b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1.0, h)))


def planted(rng, n=260):
    """Two hot points 190 m apart, a street across cells, far points, a pair beside the equator, rows without a place."""
    rows = []
    for i in range(n):
        kind = i % 6
        lat, lon = [(40.7, -74.0), (40.7017, -74.0), (40.7 + rng.uniform(-4e-3, 4e-3), -74.0 + rng.uniform(-4e-3, 4e-3)), (-33.9 + rng.uniform(0, 2e-3), 151.2), (rng.uniform(-1e-3, 1e-3), rng.uniform(-1e-3, 1e-3)), (None, None)][kind]
        rows.append((f"i{i}", rng.choice(["a", "b"]), lat, lon, rng.randint(0, 60 * DAY) if i % 5 else 30 * DAY))
    return rows


@pytest.fixture(params=[(64, 1_000_000), (0, 20)])
def counting(request, monkeypatch):
    monkeypatch.setattr(proximity, "FEW", request.param[0])
    monkeypatch.setattr(proximity, "HEAVY", request.param[1])


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "incident_id string, category string, latitude double, longitude double, s long")
    return df.withColumn("reported_at", F.timestamp_seconds(F.col("s") + 1_000_000_000)).drop("s")


def test_density_equals_brute_force(spark, counting):
    rows = planted(random.Random(3))
    got = {r["incident_id"]: r for r in geo.historical_density(table_of(spark, rows)).collect()}
    for i, cat, lat, lon, t in rows:
        r = got[i]
        if lat is None:
            assert r["n_24h"] is None and r["all_30d"] is None and r["hours_since"] is None
            continue
        near = [(c, t - u) for _, c, la, lo, u in rows if la is not None and 0 < t - u <= 30 * DAY and metres((lat, lon), (la, lo)) <= 250]
        same = [d for c, d in near if c == cat]
        assert (r["n_24h"], r["n_7d"], r["n_30d"], r["all_30d"]) == (sum(d <= DAY for d in same), sum(d <= 7 * DAY for d in same), len(same), len(near))
        assert r["hours_since"] == (pytest.approx(min(d for _, d in near) / 3600, abs=1e-3) if near else None)


def test_late_and_near_pairs_equal_brute_force(spark, counting):
    rows = planted(random.Random(4), 150)
    df = table_of(spark, rows)
    placed = [r for r in rows if r[2] is not None]
    pairs = [(a, b) for k, a in enumerate(placed) for b in placed[:k] if metres(a[2:4], b[2:4]) < 200]
    late = [abs(a[4] - b[4]) / 3600 for a, b in pairs if a[1] == b[1] and abs(a[4] - b[4]) > 20 * DAY]
    got = duplicates.late_pairs(df, 200.0, 20).collect()
    assert len(got) == 1 and got[0]["n"] == len(late) and got[0]["hours"] == pytest.approx(sum(late))
    soon = {tuple(sorted((a[0], b[0]))) for a, b in pairs if a[1] == b[1] and abs(a[4] - b[4]) <= 7 * DAY}
    assert {(r["a"], r["b"]) for r in duplicates.near_pairs(df, 200.0, within_hours=168, same_category=True).collect()} == soon


def test_counts_of_no_rows(spark):
    df = table_of(spark, [])
    assert geo.historical_density(df).collect() == []
    assert [tuple(r) for r in duplicates.late_pairs(df, 200.0, 20).collect()] == [(0, 0.0)]


def test_a_hot_place_makes_no_pairs(spark):
    """Rows of one place and time bucket are counted by sums: no pair of cells is left for the search in pairs."""
    size = proximity.grid_size(250.0)
    points = spark.range(5000).select(proximity.fine_cell(F.lit(40.7), size).alias("fy"), proximity.fine_cell(F.lit(-74.0), size).alias("fx"), F.lit(0).alias("b"))
    inside, border = proximity.relations(points, 250.0, size)
    assert inside.count() == 1 and border.count() == 0
