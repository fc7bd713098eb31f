"""Learned models by their properties: what is learnable is learned, choices are made on validation rows, noise has no importance."""

from pyspark.sql import functions as F

from wardline.operators import models as L
from wardline import catalog


def table_of(spark, n=600):
    df = spark.range(n).select("id", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(100)).cast("double").alias("x"), F.pmod(F.xxhash64(F.col("id"), F.lit(2)), F.lit(100)).cast("double").alias("noise"))
    split = F.when(F.col("id") % 5 == 0, "val").when(F.col("id") % 5 == 1, "test").otherwise("train")
    return df.withColumns({"split": split, "y": (F.col("x") > 60).cast("int"), "hours": F.when(F.col("x") > 60, 90.0).otherwise(10.0)})


def test_classifier_learns_and_the_choice_is_on_validation(spark):
    df = table_of(spark)
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    fits = {"blind": L.boosted_classifier(train, ["noise"], "y", 2, 2), "seeing": L.boosted_classifier(train, ["x", "noise"], "y", 3, 2)}
    name, model, scores = L.selected(fits, val, lambda m, v: L.average_precision(m, v, "y"))
    assert name == "seeing" and scores["seeing"] > 0.95 > scores["blind"]
    wrong = L.probability(model, df.where("split = 'test'")).where((F.col("p") >= 0.5).cast("int") != F.col("y")).count()
    assert wrong <= 6


def test_importance_is_of_what_matters(spark):
    df = table_of(spark)
    model = L.boosted_log_regressor(df.where("split = 'train'"), ["x", "noise"], "hours", 3, 2)
    got = {r["feature"]: r for r in L.permutation_importance(model, df.where("split = 'test'"), ["x", "noise"], "hours", "id", 3).collect()}
    assert got["x"]["rise"] > 10 > 1 > abs(got["noise"]["rise"]) and {r["repeats"] for r in got.values()} == {3}


def test_queries_of_models_beat_chance(spark, sf):
    q = catalog.queries()
    sla = {r["split"]: r for r in q["mlx3_sla_classifier"](spark, sf).collect()}
    assert set(sla) == {"train", "val", "test"} and sla["train"]["brier"] < sla["train"]["base_brier"]
    pairs = {r["strategy"]: r for r in q["mlx5_duplicate_classifier"](spark, sf).collect()}
    assert "N4" in pairs and pairs["N4"]["recall"] > 0.5 and all(r["n"] == r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in pairs.values())
    hot = {(r["fold"], r["method"]): r for r in q["mlx4_hotspot_regressor"](spark, sf).collect()}
    assert {m for _, m in hot} == {"boosted", "persistence", "roll_4"}
    assert all(hot[f, "boosted"]["mae"] <= 1.2 * hot[f, "persistence"]["mae"] for f, _ in hot)
