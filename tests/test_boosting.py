import random

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler

from rallygrid import boosting, ml
from rallygrid.ml import score
from rallygrid.operators.evaluate import auc
from rallygrid.session import cut_lineage

NAMES = ["a", "b", "c"]


def _rows(spark, n=3000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in NAMES]
        rows.append((i, *x, float(rng.random() < 1 / (1 + 2.7 ** -(2 * x[0] + (1.5 if x[1] > 0.3 else -1))))))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, target double")
    return VectorAssembler(inputCols=NAMES, outputCol="v").transform(df).coalesce(2)


def test_one_task_grows_the_trees_that_jobs_grow(spark, tmp_path):
    df = _rows(spark)
    args = dict(featuresCol="v", labelCol="target", maxIter=12, maxDepth=3, stepSize=0.1, subsamplingRate=1.0, featureSubsetStrategy="1.0", seed=1)
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one task", "")
    own = boosting.BoostedTrees(**args).fit(df)
    jobs = len(before.getJobIdsForGroup("one task"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs <= 4  # not some for each tree
    jvm = GBTClassifier(**args).fit(df)
    assert own.getNumTrees == jvm.getNumTrees == 12 and own.treeWeights == jvm.treeWeights
    both = score(own, df).withColumnRenamed("p", "q").join(score(jvm, df).select("id", "p"), "id")
    assert both.selectExpr("corr(p, q)").first()[0] > 0.99 and both.selectExpr("avg(abs(p - q))").first()[0] < 0.02
    assert abs(own.featureImportances[0] - jvm.featureImportances[0]) < 0.05
    own.write().overwrite().save(str(tmp_path / "m"))
    again = score(GBTClassificationModel.load(str(tmp_path / "m")), df).withColumnRenamed("p", "r").join(score(own, df).select("id", "p"), "id")
    assert again.filter("abs(p - r) > 1e-12").count() == 0


def test_larger_frames_are_fitted_by_jobs(spark, monkeypatch):
    df = _rows(spark, 600)
    model = boosting.BoostedTrees(featuresCol="v", labelCol="target", maxIter=3, featureSubsetStrategy="0.8", subsamplingRate=0.8, seed=1)
    few = auc(score(model.fit(df), df), "target", "p").first()[0]
    monkeypatch.setattr(boosting, "TASK_CELLS", 100)
    assert abs(auc(score(model.fit(df), df), "target", "p").first()[0] - few) < 0.05


def test_the_whole_grid_gives_the_trees_of_its_cells():
    rng = np.random.default_rng(3)
    for sizes in ([5, 4, 6], [3, 7], [4, 1, 3, 5], [9]):
        codes = list(np.unique(np.stack([rng.integers(0, s, 60) for s in sizes]), axis=1))
        ones, zeros = (rng.integers(0, 9, len(codes[0])).astype(float) for _ in range(2))
        ones += zeros + ones == 0  # no cell is empty
        for sample in (1.0, 0.8):
            how = (sizes, ones, zeros, 15, 4, 0.1, sample, max(1, len(sizes) - 1), 7)
            cells = boosting.grow(codes, *how)
            grid, margins = boosting.grow_grid(codes, *how)
            assert [n[:4] for n in grid] == [n[:4] for n in cells]
            assert np.allclose([n[4:] for n in grid], [n[4:] for n in cells])
            assert np.allclose(boosting.margins_of(cells, codes, 15, 4, 0.1), margins[np.ravel_multi_index(codes, sizes)])


def _years(spark):
    rows = _rows(spark).selectExpr("id", "a", "round(b, 1) b", "if(id % 9 = 0, null, round(c)) c", "target", "2018 + pmod(hash(id), 5) year", "target - 0.5 profit", "0.4D market")
    return cut_lineage(rows)


def _walk(df, **kw):
    make = lambda features: ml.boosted_trees(features, trees=6)
    return sorted(map(tuple, ml.walk_forward(df, "year", (2020, 2021, 2022), NAMES, make, "profit", "market", **kw).collect()))


def test_a_year_is_trained_and_scored_in_one_task_as_by_models(spark, monkeypatch):
    df = _years(spark)
    spark.sparkContext.setJobGroup("walk", "")
    own = _walk(df)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("walk"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs <= 25  # not a scoring of all trees for each metric, and no fit of medians
    monkeypatch.setattr(ml, "forward_scores", lambda *a: None)
    models = _walk(df)
    assert [r[0] for r in own] == [2020, 2021, 2022] and all(r[1] > 300 and r[6] > 0 for r in own)
    assert np.allclose(own, models, rtol=1e-9)


def test_many_rows_in_few_bins_are_trained_on_the_grid(spark, monkeypatch):
    df, seen, real = _years(spark).withColumns({"a": ml.F.expr("round(a)"), "b": ml.F.expr("round(b)")}), [], boosting.grow_grid
    whole = _walk(df)
    # In the driver, as the tasks' calls can't be seen here.
    monkeypatch.setattr(boosting, "grow_grid", lambda *a: seen.append(1) or real(*a))
    rows = df.filter("year < 2021 and c is not null").toPandas()
    columns = [rows[f].to_numpy() for f in NAMES]
    how = (32, 6, 4, 0.05, 0.8, 3, 42)
    grown = boosting.Grown(iter(columns), rows["target"].to_numpy(), *how)
    assert seen
    p = boosting.margins_of(grown.nodes, [np.searchsorted(b, c) for b, c in zip(grown.borders, columns)], 6, 4, 0.05)
    assert np.allclose(grown.probabilities(columns), 1 / (1 + np.exp(-2 * p)))
    monkeypatch.setattr(ml, "forward_scores", lambda *a: None)
    assert np.allclose(whole, _walk(df), rtol=1e-9)


def test_years_that_no_task_can_train_go_by_models(spark, monkeypatch):
    df = _years(spark)
    trees = [ml.boosted_trees(NAMES).getStages()[-1]] * 2
    kept = ["target"]
    assert len(boosting.forward_scores(df, "year", (2020, 2021), NAMES, trees, kept)) == 2
    assert boosting.forward_scores(df, "year", (2018, 2021), NAMES, trees, kept) is None  # none before
    odd = df.withColumn("target", ml.F.expr("if(id = 5, 2, target)"))
    assert boosting.forward_scores(odd.withColumn("year", ml.F.lit(2019)), "year", (2020, 2021), NAMES, trees, kept) is None
    monkeypatch.setattr(boosting, "TASK_CELLS", 100)
    assert boosting.forward_scores(df, "year", (2020, 2021), NAMES, trees, kept) is None


def test_wide_frames_grow_the_same_trees():
    """Sums over codes of three features, and of a child as its parent's less the other's, give the trees of all sums taken apart."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 9_000))
    x[3, :8_000] = 0.0  # a cell of many rows, counted apart at either limit
    y = (x[0] + x[1] * x[2] + rng.normal(size=9_000) > 0).astype(float)[:6_000]
    borders = [boosting.thresholds(c[:6_000], 32) for c in x]
    bins = [np.searchsorted(b, c).astype(np.uint8) for b, c in zip(borders, x)]
    codes = np.zeros((3, 9_000), np.uint16)
    for j, c in enumerate(bins):
        codes[j // 3] |= c.astype(np.uint16) << 5 * (2 - j % 3)
    how = (8, 4, 0.1, 1.0, 7, 1)
    nodes = boosting.grow([c[:6_000] for c in bins], [len(b) + 1 for b in borders], y, 1 - y, *how)
    want = boosting.margins_of(nodes, bins, 8, 4, 0.1)
    for most in (1 << 14, 10):
        boosting.UNIT_ROWS, before = most, boosting.UNIT_ROWS
        try:
            assert np.abs(boosting.grow_wide(codes, 7, y, *how) - want).max() < 1e-8
        finally:
            boosting.UNIT_ROWS = before


def test_sets_beyond_a_frame_of_doubles_are_grown_in_a_task(spark, monkeypatch):
    def jobs(*_):
        raise AssertionError("fitted by Spark's jobs")

    monkeypatch.setattr(GBTClassifier, "_fit", jobs)
    monkeypatch.setattr(boosting, "TASK_CELLS", 100)
    rng = np.random.default_rng(5)
    rows = [(float(a + rng.normal() > 0), float(a), float(b) if i % 5 else None) for i, (a, b) in enumerate(rng.normal(size=(1_200, 2)))]
    df = spark.createDataFrame(rows, "target double, a double, b double").repartition(3)
    make = lambda features: ml.boosted_trees(features, trees=5)
    got = {r.feature_set: r for r in ml.ablation(df.limit(800), df, {"a": ("a",), "b": ("b",), "both": ("a", "b")}, make).collect()}
    assert {k: r.n for k, r in got.items()} == {"a": 1_200, "b": 1_200, "both": 1_200}
    assert got["a"].auc > 0.75 and got["both"].auc > 0.75 and 0.4 < got["b"].auc < 0.65
