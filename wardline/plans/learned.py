"""Queries of the encoder and the boosted models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wardline.operators import duplicates as D
from wardline.operators import graph
from wardline.operators import metrics as M
from wardline.operators import models as L
from wardline.operators import splits as SP
from wardline.operators.storage import cut
from wardline.plans import hotspots
from wardline.plans.base import INC, incidents, register, with_
from wardline.plans.evaluation import _SPLIT, PAIRED, PLACED, own_splits, splits

_CATS = ["category", "city", "subcategory"]


@register("mlx1_encoder", with_("""SELECT incident_id, CAST(coalesce(c.code, CASE WHEN s.level IS NOT NULL THEN 3 ELSE -1 END) AS INT) AS source_category_raw_code FROM sp LEFT JOIN (SELECT level, row_number() OVER (ORDER BY n DESC, level) - 1 AS code FROM (SELECT source_category_raw AS level, count(*) AS n FROM sp WHERE split = 'train' GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, level) <= 3) c ON c.level = source_category_raw
 LEFT JOIN (SELECT DISTINCT source_category_raw AS level FROM sp WHERE split = 'train') s ON s.level = source_category_raw""", INC, _SPLIT))
def encoder(spark, d):
    df = cut(splits(spark, d).select("incident_id", "split", "source_category_raw"))
    return L.encode(df, df.where("split = 'train'"), ["source_category_raw"], 3).select("incident_id", "source_category_raw_code")


def _encoded(spark, d, label: str, **more):
    """Rows with a label, their split, codes and hour and the columns `more`, in even parts. Incidents are derived once, and their codes come from
    a count of each column's levels."""
    df = own_splits(spark, d, ["incident_id", "reported_at", label, "sla_target_hours", *_CATS]).where(F.col(label).isNotNull())
    df = cut(df.select("incident_id", "split", label, *_CATS, F.hour("reported_at").alias("hour"), *[x.alias(n) for n, x in more.items()]))
    df = L.encode(df, df.where("split = 'train'"), _CATS)
    features = [f"{c}_code" for c in _CATS] + ["hour", *more]
    return cut(L.evened(df.select("incident_id", "split", label, *features), "incident_id")), features


def _durations(spark, d):
    return _encoded(spark, d, "resolution_hours", sla=F.coalesce("sla_target_hours", F.lit(-1.0)))


def _regressor(df, features):
    """The candidate of the least error on the validation rows."""
    train = df.where("split = 'train'")
    fits = {f"depth_{k}": L.boosted_log_regressor(train, features, "resolution_hours", 5, k) for k in (2, 4)}
    return L.selected(fits, df.where("split = 'val'"), lambda m, v: L.mean_error(m, v, "resolution_hours"))


@register("mlx2_resolution_regressor")
def resolution_regressor(spark, d):
    df, features = _durations(spark, d)
    name, model, _ = _regressor(df, features)
    out = L.predicted(model, df).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("resolution_hours") - F.col("p"))), 2).alias("mae"))
    return out.withColumn("chosen", F.lit(name))


@register("mlx3_sla_classifier")
def sla_classifier(spark, d):
    """Breach probability: candidates on training rows, the choice on validation rows, metrics on all parts beside the base rate's."""
    df, features = _encoded(spark, d, "sla_met", sla_target_hours=F.col("sla_target_hours"))
    df = df.withColumn("y", (~F.col("sla_met")).cast("int"))
    train = df.where("split = 'train'")
    fits = {f"depth_{k}": L.boosted_classifier(train, features, "y", 5, k) for k in (2, 4)}
    name, model, _ = L.selected(fits, df.where("split = 'val'"), lambda m, v: L.average_precision(m, v, "y"))
    scored = cut(L.probability(model, df).select("split", "y", "p"))
    rate = train.agg(F.avg("y").alias("r")).collect()[0]["r"]
    sums = scored.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"), F.round(F.avg(F.pow(F.lit(rate) - F.col("y"), 2)), 6).alias("base_brier"))
    return sums.join(M.ranking(scored, ["split"]), "split").withColumn("chosen", F.lit(name))


@register("mlx4_hotspot_regressor")
def hotspot_regressor(spark, d):
    """Next week's count by boosted trees beside persistence and the four weeks' mean, by fold."""
    rows = cut(hotspots.forecast_rows(spark, d))
    features = ["y", "lag_1", "lag_2", "lag_3", "roll_4", "roll_8", "roll_12", "trend_4_12", "zero_share_12", "history"]
    folds = SP.weekly_folds(rows, ["1996-01-01", "1997-01-06"])
    parts = []
    for fold in ("1996-01-01", "1997-01-06"):
        own = cut(folds.where(F.col("fold") == fold).fillna(-1, features))
        model = L.boosted_log_regressor(own.where("role = 'train'"), features, "target", 5, 3)
        test = L.predicted(model, own.where("role = 'test'"))
        parts.append(test.select("fold", "target", F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).cast("double").alias("q")) for n, c in (("boosted", "p"), ("persistence", "y"), ("roll_4", "roll_4"))])).alias("x")).select("fold", "target", "x.*"))
    e = reduce(lambda a, b: a.unionByName(b), parts)
    q = F.greatest(F.col("q"), F.lit(1e-9))
    deviance = 2 * (F.when(F.col("target") > 0, F.col("target") * F.log(F.col("target") / q)).otherwise(0.0) - F.col("target") + q)
    return e.groupBy("fold", "method").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("target") - F.col("q"))), 4).alias("mae"), F.round(F.avg(deviance), 4).alias("deviance"))


_PAIR = ["split", "distance_m", "hours_apart", "same_category"]


@register("mlx5_duplicate_classifier")
def duplicate_classifier(spark, d):
    """Duplicate pairs by boosted trees: each strategy's negatives beside the positives of the test part."""
    i = cut(incidents(spark, d).select(*PAIRED))
    pos = cut(D.positives(i))
    rows = cut(D.component_splits(i, graph.components(pos), pos, [*PLACED, "source_dataset"]))
    linked = rows.where("linked")  # both ends of positives are
    pairs = cut(D.features(pos.join(linked.select(F.col("incident_id").alias("a"), "split"), "a"), linked).select(F.lit("positive").alias("strategy"), *_PAIR))
    side = lambda x: F.struct(*[F.col(f"{c}{x}").alias(c) for c in (*PLACED, "reported_at")])
    random = D.random_negatives(rows, pos, "n4", "source_dataset", [*PLACED, "reported_at"])
    random = random.select("a", "b", "split", *[x.alias(n) for x, n in zip(D.apart(side(""), side("_b")), ("distance_m", "hours_apart", "same_category"), strict=True)])
    random = D.by_quota(random, pairs.groupBy("split").agg(F.ceil(F.count("*") / 4).alias("quota")), "7", ["split"])
    near = D.near_negatives(rows, pos).select("strategy", "split", "distance_m", "hours_apart", (F.col("strategy") == "N2").alias("same_category"))
    df = pairs.unionByName(near).unionByName(random.select(F.lit("N4").alias("strategy"), *_PAIR))
    df = df.withColumns({"y": (F.col("strategy") == "positive").cast("int"), "same": F.col("same_category").cast("double")}).fillna(-1.0, ["distance_m", "hours_apart", "same"])
    df = cut(df.select("strategy", "split", "y", "distance_m", "hours_apart", "same"))
    features = ["distance_m", "hours_apart", "same"]
    model = L.boosted_classifier(df.where("split = 'train'"), features, "y", 5, 3)
    test = L.probability(model, df.where("split <> 'train'"))
    negatives = test.where("y = 0").select("strategy", "y", "p")
    both = negatives.unionByName(test.where("y = 1").crossJoin(F.broadcast(negatives.select(F.col("strategy").alias("s")).distinct())).select(F.col("s").alias("strategy"), "y", "p"))  # three strategies
    return M.classification(both, ["strategy"], 0.5).select("strategy", "n", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


@register("mlx6_permutation_importance")
def permutation_importance(spark, d):
    df, features = _durations(spark, d)
    _, model, _ = _regressor(df, features)
    return L.permutation_importance(model, df.where("split = 'test'"), features, "resolution_hours", "incident_id")
