"""Imputation, classifiers, calibration, walk-forward evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallygrid.boosting import BoostedTrees, forward_scores, set_scores
from rallygrid.operators.evaluate import auc, probability_scores
from rallygrid.session import cut_lineage


def _prepared(features: Sequence[str]) -> list:
    filled = [f"{f}__filled" for f in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=0.0001),
        VectorAssembler(inputCols=filled, outputCol="features_raw", handleInvalid="keep"),
    ]


#: Rows of a partition in training. A boosted tree is some five jobs in a row, so on few rows the number
#: of tasks is what it costs; on many rows the partitions grow in number, not in size.
TRAIN_ROWS = 50_000


def sized(df: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """In as many partitions as its rows need for training; a frame that is written already."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def logistic(features: Sequence[str], reg: float = 1e-4) -> Pipeline:
    return Pipeline(
        stages=[
            *_prepared(features),
            StandardScaler(inputCol="features_raw", outputCol="features", withMean=True),
            LogisticRegression(featuresCol="features", labelCol="target", maxIter=2000, regParam=reg),
        ]
    )


def boosted_trees(features: Sequence[str], trees: int = 300, depth: int = 4, step: float = 0.05, seed: int = 42) -> Pipeline:
    return Pipeline(
        stages=[
            *_prepared(features),
            BoostedTrees(
                featuresCol="features_raw", labelCol="target", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, checkpointInterval=20
            ),
        ]
    )


#: Models fitted at once; they share the executors.
PARALLEL = 4


def fit_all(jobs: Sequence[tuple[Pipeline, DataFrame]]) -> list[PipelineModel]:
    """Independent models, fitted side by side: each is a long row of small jobs, which leaves most of
    a cluster idle."""
    with ThreadPool(max(1, min(PARALLEL, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(jobs[0][1].sparkSession)(lambda job: job[0].fit(job[1])), jobs)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``p``, the probability of class 1; drops the working columns."""
    out = model.transform(df).withColumn("p", vector_to_array("probability")[1])
    return out.select(*df.columns, "p")


def calibrated(make: Pipeline, train: DataFrame, key: str, folds: int = 3):
    """Cross-fitted isotonic calibration: per fold a model on the other folds and an isotonic
    curve on its scores; the calibrated probability is the mean over the folds."""
    fold = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(folds))
    models = []
    fitted = fit_all([(make, train.filter(fold != k)) for k in range(folds)])
    for k, model in enumerate(fitted):
        held = score(model, train.filter(fold == k))
        curve = IsotonicRegression(featuresCol="p", labelCol="target", predictionCol="c").fit(held.withColumn("p", F.col("p").cast("double")))
        models.append((model, curve))

    def apply(df: DataFrame) -> DataFrame:
        out = df
        for k, (model, curve) in enumerate(models):
            out = curve.transform(score(model, out)).withColumnRenamed("c", f"c{k}").drop("p")
        mean = sum((F.col(f"c{k}") for k in range(folds)), F.lit(0.0)) / folds
        return out.withColumn("p", mean).drop(*[f"c{k}" for k in range(folds)])

    return apply


def walk_forward(df: DataFrame, year: str, years: Sequence[int], features: Sequence[str], make=logistic, profit: str | None = None, market: str | None = None, edge: float = 0.05) -> DataFrame:
    """Train on the years before, test on the year; one row of metrics per year. With the columns
    ``profit`` (of a unit stake) and ``market`` (its probability), also the number and mean profit of
    the bets whose probability exceeds the market's by more than ``edge``."""
    pipelines = [make(features) for _ in years]
    trees = [p.getStages()[-1] for p in pipelines]
    kept = list(dict.fromkeys(["target", *([profit, market] if profit and market else [])]))
    parts = forward_scores(df, year, years, features, trees, kept) if all(isinstance(t, BoostedTrees) for t in trees) else None
    if parts is None:
        fitted = fit_all([(p, df.filter(F.col(year) < y)) for p, y in zip(pipelines, years)])
        parts = [score(model, df.filter(F.col(year) == y)).select(*kept, "p", F.lit(y).alias("test_year")) for y, model in zip(years, fitted)]
    # Written once, as the metrics read them several times; a job a year, since a union of frames of one partition is one task.
    with ThreadPool(len(parts)) as pool:
        written = pool.map(inheritable_thread_target(df.sparkSession)(cut_lineage), parts)
    scored = reduce(DataFrame.unionByName, written)
    out = probability_scores(scored, "target", "p", ["test_year"]).join(auc(scored, "target", "p", ["test_year"]), "test_year")
    if profit and market:
        taken = F.col("p") - F.col(market) > edge
        bet = scored.groupBy("test_year").agg(F.count(F.when(taken, 1)).alias("bets"), F.avg(F.when(taken, F.col(profit))).alias("roi"))
        out = out.join(bet, "test_year")
    return out


def ablation(train: DataFrame, test: DataFrame, sets: dict[str, Sequence[str]], make=logistic) -> DataFrame:
    """Metrics of the same model on named feature sets."""
    pipelines = {name: make(features) for name, features in sets.items()}
    trees = {name: p.getStages()[-1] for name, p in pipelines.items()}
    parts = set_scores(train, test, sets, trees) if all(isinstance(t, BoostedTrees) for t in trees.values()) else None
    if parts is None:
        fitted = fit_all([(p, train) for p in pipelines.values()])
        parts = {name: score(model, test).select(F.col("target").cast("double").alias("target"), "p") for name, model in zip(sets, fitted)}
    # The largest first, as they take longest; planned before, as wide plans take longer and would start last.
    ordered = [parts[name].withColumn("feature_set", F.lit(name)) for name in sorted(sets, key=lambda name: -len(sets[name]))]
    for part in ordered:
        part._jdf.queryExecution().executedPlan()
    with ThreadPool(len(ordered)) as pool:
        written = pool.map(inheritable_thread_target(train.sparkSession)(cut_lineage), ordered, chunksize=1)
    scored = reduce(DataFrame.unionByName, written)
    return probability_scores(scored, "target", "p", ["feature_set"]).join(auc(scored, "target", "p", ["feature_set"]), "feature_set")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """Loss of AUC when a feature is shuffled between rows: each row takes the feature of the row
    with the next hash (a shift inside hash buckets, no global sort)."""
    from pyspark.sql import Window

    whole = auc(score(model, df), "target", "p").withColumnRenamed("auc", "whole")
    out = None
    for f in features:
        w = Window.partitionBy(F.pmod(F.xxhash64(key, F.lit(f)), F.lit(256))).orderBy(F.xxhash64(key, F.lit(f"{f}.")))
        mixed = df.withColumn(f, F.coalesce(F.lead(f).over(w), F.col(f)))
        part = auc(score(model, mixed), "target", "p").select(F.lit(f).alias("feature"), "auc")
        out = part if out is None else out.unionByName(part)
    return out.join(whole).select("feature", (F.col("whole") - F.col("auc")).alias("importance"))
