"""Ensembles grown on binned rows: the trees of Spark's trainer, in a handful of jobs."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from voltaic.operators import features as FE
from voltaic.operators import growing as GR
from voltaic.operators import models
from voltaic.operators import trees as TR

ALL = {"featureSubsetStrategy": "all", "labelCol": "y", "seed": 3}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    a, b, c, d = rng.normal(size=400), rng.integers(0, 5, 400), rng.integers(0, 2, 400), rng.integers(0, 3, 400)
    y = 3 * a + b * b + 2 * c + (d == 1) * a + rng.normal(size=400) * .3 + 1000
    df = spark.createDataFrame([(i, float(p), float(q), f"c{r}", f"d{s}", float(t)) for i, (p, q, r, s, t) in enumerate(zip(a, b, c, d, y))],
                               "k int, a double, b double, c string, d string, y double")
    stages, _ = FE.feature_stages(df, ["a", "b", "c", "d"])
    return Pipeline(stages=stages).fit(df).transform(df).select("k", "features", "y", (F.col("k") % 3).alias("fold")).repartition(3, "k").cache()


def predictions(model, df):
    return np.array([r[0] for r in model.transform(df).orderBy("k").select("prediction").collect()])


@pytest.mark.parametrize("folded", [False, True])
def test_trees_are_those_of_sparks_trainer(rows, monkeypatch, folded):
    data = rows.unionAll(rows).unionAll(rows.withColumn("y", F.col("y") + 1)) if folded else rows
    for mine, theirs, more in ((GR.GrownBoosting, GBTRegressor, {"maxIter": 4, "maxDepth": 4, "stepSize": .3}), (GR.GrownBoosting, GBTRegressor, {"maxIter": 2, "maxDepth": 6, "minInstancesPerNode": 5}),
                               (GR.GrownForest, RandomForestRegressor, {"numTrees": 1, "maxDepth": 30, "bootstrap": False}), (GR.GrownForest, RandomForestRegressor, {"numTrees": 1, "maxDepth": 5, "minInstancesPerNode": 9, "bootstrap": False})):
        if folded:
            monkeypatch.setattr(GR, "TABLE_BYTES", 1)
            assert GR.binned(data, mine(**ALL, **more), cells=400).folded
        got, want = mine(**ALL, **more).fit(data), theirs(**ALL, **more).fit(data)
        # of equal splits (a category and its only alternative) round-off may choose either; the rows' sides are the same
        assert np.allclose(predictions(got, rows), predictions(want, rows), rtol=1e-12) and got.totalNumNodes == want.totalNumNodes


@pytest.mark.parametrize("folded", [False, True])
def test_a_forest_takes_a_handful_of_jobs_and_is_a_model_of_spark(rows, tmpdir_path, monkeypatch, folded):
    if folded:
        monkeypatch.setattr(GR, "TABLE_BYTES", 1)
    sc = rows.sparkSession.sparkContext
    est = models.make_estimator("random_forest", "y", n_estimators=30)
    group = f"grow {folded}"
    sc.setJobGroup(group, "")
    grown = TR.fit_forest(est, rows)
    priced = predictions(grown, rows)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup(group)) <= 25        # Spark's trainer: some 30 a run of five trees
    alone = RandomForestRegressor(**ALL, numTrees=30, maxDepth=30).fit(rows)
    y = np.array([r[0] for r in rows.orderBy("k").select("y").collect()])
    assert np.mean((priced - y) ** 2) < 2 * np.mean((predictions(alone, rows) - y) ** 2) < .5 * np.var(y)
    assert grown._loaded is None                                          # nothing of it is on the driver
    told = {r.feature: r.importance for r in TR.importances(grown, [f"f{i}" for i in range(7)]).collect()}
    assert grown.getNumTrees == 30 and len(grown.trees) == 30 and grown.uid == est.uid and grown.getMaxDepth() == 30
    assert [told[f"f{i}"] for i in range(7)] == pytest.approx(grown.featureImportances.toArray().tolist(), abs=1e-6)
    grown.write().overwrite().save(f"{tmpdir_path}/forest")
    kept = RandomForestRegressionModel.load(f"{tmpdir_path}/forest")
    assert np.allclose(predictions(kept, rows), priced, rtol=1e-12) and kept.totalNumNodes > 30 * 200
    if not folded:
        assert np.array_equal(predictions(TR.fit_forest(est, rows.repartition(5)), rows), priced)        # however rows are dealt out


def test_scores_of_a_search_are_those_of_models_trained_alone(rows):
    feats = rows.select("features", "y", "k", "fold")

    def r2(model, held):
        return RegressionEvaluator(labelCol="y", metricName="r2").evaluate(model.transform(held))
    for kind, grid in (("random_forest", {"n_estimators": [3, 7], "max_depth": [4, None], "min_samples_leaf": [1, 3]}),
                       ("gradient_boosting", {"n_estimators": [3, 6], "learning_rate": [.1, .4], "max_depth": [3], "subsample": [1.0, .7]})):
        est = models.make_estimator(kind, "y")
        maps = models.param_grid(est, kind, 1.0, 400, grid)
        scores = TR.nested_search(feats, est, maps, "y", "k", "fold", 3, 4)
        for at in (0, len(maps) - 1):
            alone = [r2(est.fit(feats.where(F.col("fold") != f), maps[at]), feats.where(F.col("fold") == f)) for f in range(3)]
            assert scores[at] == pytest.approx(np.mean(alone), rel=1e-9)


def test_many_rows_of_few_kinds_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(GR, "ROWS_WORTH_FOLDING", 100)
    df = spark.range(2000).selectExpr("id as k", "cast(id % 5 as double) as a", "cast(id % 3 as double) as b", "cast(id as double) as y", "cast(id as double) as c")
    for features, kinds in ((["a", "b"], 15), (["a", "b", "c"], 2000)):
        stages, _ = FE.feature_stages(df, features)
        data, est = Pipeline(stages=stages).fit(df).transform(df), models.make_estimator("random_forest", "y", n_estimators=3)
        table = GR.binned(data, est, cells=1000)
        assert len(table.bins) == kinds and table.folded == (kinds == 15) and table.n.sum() == 2000
        assert (table.s + table.n * table.shift).sum() == pytest.approx(2000 * 1999 / 2)


def test_tables_too_large_or_of_many_categories_go_to_sparks_trainer(rows, monkeypatch):
    est = models.make_estimator("gradient_boosting", "y", n_estimators=2, subsample=.8)
    monkeypatch.setattr(GR, "TABLE_BYTES", 100)
    want = predictions(GR.plain(est).fit(rows), rows)
    assert np.array_equal(predictions(est.fit(rows), rows), want)
    monkeypatch.setattr(GR, "SAMPLE_BYTES", 100)
    forest = models.make_estimator("random_forest", "y", n_estimators=7, max_depth=4)
    assert not isinstance(TR.fit_forest(forest, rows), GR.GrownForestModel) and TR.fit_forest(forest, rows).getNumTrees == 7
    maps = models.param_grid(forest, "random_forest", 1.0, 400, {"n_estimators": [2, 3], "max_depth": [2], "min_samples_leaf": [1]})
    assert len(TR.nested_search(rows, forest, maps, "y", "k", "fold", 3, 2)) == 2
    monkeypatch.undo()
    nominal = rows.select("k", "y", F.col("features").alias("features", metadata={"ml_attr": {"attrs": {"nominal": [{"idx": 0, "vals": ["a", "b", "c"]}]}, "num_attrs": 7}}))
    assert GR.binned(nominal, forest) is None and GR.binned(rows.withColumn("y", F.lit(None).cast("double")), forest) is None
