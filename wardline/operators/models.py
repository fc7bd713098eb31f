"""Learned models as Spark ML jobs: train-only encoding, boosted trees, permutation importance."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators import metrics
from wardline.operators.storage import cut, small

MISSING, OTHER, LEVELS = "__MISSING__", "__OTHER__", 250
#: Rows of one part of a table that models are fitted on.
EVEN = 250_000
#: Blocks of rows whose values are dealt among them.
BLOCKS = 64


def vocabulary(train: DataFrame, column: str, levels: int = LEVELS) -> DataFrame:
    """(level, code) of every level of the training rows: the top ones by count then name from 0, `levels` for all others. Rows are counted
    once; what comes after has a row a level."""
    counts = cut(train.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("level")).agg(F.count("*").alias("n")))
    top = counts.orderBy(F.desc("n"), "level").limit(levels)
    top = top.select("level", (F.row_number().over(Window.orderBy(F.desc("n"), "level")) - 1).alias("code"))  # at most `levels` rows
    return cut(counts.join(F.broadcast(top), "level", "left").select("level", F.coalesce("code", F.lit(levels)).alias("code")))


def encode(df: DataFrame, train: DataFrame, columns: list[str], levels: int = LEVELS) -> DataFrame:
    """Adds <column>_code: the level's code, the next free one for known but rare levels, -1 for levels that training never saw. train should be
    cut, as it is read for each column; a column of few levels is looked up where the rows are."""
    for c in columns:
        seen = small(vocabulary(train, c, levels).withColumnRenamed("code", f"{c}_code"))
        df = df.withColumn("level", F.coalesce(F.col(c).cast("string"), F.lit(MISSING))).join(seen, "level", "left").drop("level").fillna(-1, [f"{c}_code"])
    return df


def evened(df: DataFrame, key: str) -> DataFrame:
    """df, which should be cut, in parts of some EVEN rows by a hash of the key, so that parts (and what fits keep in memory of one) don't grow
    with the table."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / EVEN))
    return df.repartition(parts, key)


def boosted_log_regressor(train: DataFrame, features: list[str], target: str, trees: int = 10, depth: int = 4) -> PipelineModel:
    """Gradient-boosted trees on log1p of the target."""
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTRegressor(featuresCol="features", labelCol="_y", maxIter=trees, maxDepth=depth, seed=7)]
    return Pipeline(stages=stages).fit(train.where(F.col(target).isNotNull()).withColumn("_y", F.log1p(target)))


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", F.greatest(F.lit(0.0), F.expm1("prediction"))).drop("features", "prediction")


def dealt(df: DataFrame, features: list[str], seeds: list[str], key: str, keep: list[str]) -> DataFrame:
    """Each row's features and `keep` beside the features of another row for each seed (an array of structs `_others`): rows ranked by id within
    hash blocks meet rows ranked by a seeded hash. Rows move once for all seeds and features."""
    ranks = [F.row_number().over(Window.partitionBy("_b").orderBy(F.md5(F.concat_ws("|", F.lit(s), F.col(key).cast("string"))), key)) for s in seeds]
    rows = df.select(key, *features, *keep, F.pmod(F.xxhash64(F.col(key)), F.lit(BLOCKS)).alias("_b")).repartition(BLOCKS, "_b")
    rows = rows.select("*", F.array(F.row_number().over(Window.partitionBy("_b").orderBy(key)), *ranks).alias("_ranks"))
    rows = rows.select("*", F.posexplode("_ranks").alias("_s", "_i"))
    of = lambda s, c, name: F.max(F.when(F.col("_s") == s, F.col(c))).alias(name)
    met = rows.groupBy("_b", "_i").agg(*[of(0, c, c) for c in (*features, *keep)], *[of(s + 1, f, f"_{s}_{f}") for s in range(len(seeds)) for f in features])
    return met.select(*features, *keep, F.array(*[F.struct(*[F.col(f"_{s}_{f}").alias(f) for f in features]) for s in range(len(seeds))]).alias("_others"))


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], target: str, key: str, repeats: int = 5) -> DataFrame:
    """Mean and deviation, over the repeats, of the rise of the mean absolute error when one feature's values are dealt anew. All features of a
    repeat take their values from the same other row."""
    error = F.avg(F.abs(F.col(target) - F.col("p"))).alias("mae")
    base = predicted(model, df).agg(error).collect()[0]["mae"]
    rows = dealt(df, features, [f"7|{r}" for r in range(repeats)], key, [target]).select("*", F.posexplode("_others").alias("repeat", "_other"))
    rows = rows.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    rows = rows.select(target, "repeat", "feature", *[F.when(F.col("feature") == f, F.col("_other")[f]).otherwise(F.col(f)).alias(f) for f in features])
    rises = predicted(model, rows).groupBy("feature", "repeat").agg(error).select("feature", (F.col("mae") - F.lit(base)).alias("rise"))
    return rises.groupBy("feature").agg(F.avg("rise").alias("rise"), F.stddev_pop("rise").alias("deviation"), F.count("*").alias("repeats"))


def boosted_classifier(train: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 4) -> PipelineModel:
    """Gradient-boosted trees for a label of 0 and 1; rows without a label are left out."""
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTClassifier(featuresCol="features", labelCol="_y", maxIter=trees, maxDepth=depth, seed=7)]
    return Pipeline(stages=stages).fit(train.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double")))


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds p, the probability of label 1."""
    return model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("features", "prediction", "probability", "rawPrediction")


def selected(candidates: dict[str, PipelineModel], validation: DataFrame, score: Callable[[PipelineModel, DataFrame], float]) -> tuple[str, PipelineModel, dict[str, float]]:
    """The candidate with the highest score on the validation rows (the first of equal ones), and all scores."""
    scores = {name: score(model, validation) for name, model in candidates.items()}
    name = max(scores, key=lambda n: (scores[n], -list(scores).index(n)))
    return name, candidates[name], scores


def mean_error(model: PipelineModel, df: DataFrame, target: str) -> float:
    """Minus the mean absolute error of a regressor."""
    return -(predicted(model, df).agg(F.avg(F.abs(F.col(target) - F.col("p"))).alias("e")).collect()[0]["e"] or 0.0)


def average_precision(model: PipelineModel, df: DataFrame, label: str) -> float:
    rows = probability(model, df.where(F.col(label).isNotNull())).select(F.lit(1).alias("g"), F.col(label).cast("int").alias("y"), "p")
    got = metrics.ranking(rows, ["g"]).collect()
    return got[0]["average_precision"] or 0.0 if got else 0.0
