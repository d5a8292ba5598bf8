"""Linear models from sums of products, tree grids and importances from node tables."""

import threading

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from voltaic.operators import linear as LI
from voltaic.operators import models
from voltaic.operators import trees as TR


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [1, 5, 2, 1]
    x[:, 3] = x[:, 0] + x[:, 1]                       # no full rank
    y = 3 * x[:, 0] - 2 * x[:, 1] + np.sin(x[:, 2]) * 4 + 1e6 + rng.normal(size=300)
    rows = [(i, *map(float, r), float(v), i % 5) for i, (r, v) in enumerate(zip(x, y))] + [(900, 1.0, 1.0, 1.0, 1.0, None, 0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, y double, fold int")
    return x, y, VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).repartition(3).cache()


def test_sums_give_the_textbook_solutions(table):
    x, y, df = table
    parts = LI.moments(df, "y", "fold")
    m = LI.total(parts)
    assert sorted(parts) == [0, 1, 2, 3, 4] and m.n == 300
    c = x - x.mean(0)
    ols = LI.solve(m, "linear")
    assert np.allclose(ols.coefficients, np.linalg.lstsq(c, y - y.mean(), rcond=None)[0])
    assert ols.intercept == pytest.approx(y.mean() - x.mean(0) @ ols.coefficients, rel=1e-12)
    assert np.allclose(LI.solve(m, "ridge", 2.0).coefficients, np.linalg.solve(c.T @ c + 2 * np.eye(4), c.T @ (y - y.mean())))
    for kind, alpha, ratio in (("lasso", 0.5, 1.0), ("elastic_net", 0.7, 0.4)):
        w = LI.solve(m, kind, alpha, ratio).coefficients
        gradient = c.T @ (y - y.mean() - c @ w) / 300 - alpha * (1 - ratio) * w
        assert (np.abs(gradient) <= alpha * ratio * (1 + 1e-6)).all()              # optimality
        assert np.allclose(gradient[w != 0], alpha * ratio * np.sign(w[w != 0]), rtol=1e-5)
    with pytest.raises(ValueError):
        LI.solve(m, "svm")


def test_search_equals_fitting_every_fold(table):
    x, y, df = table
    parts = LI.moments(df, "y", "fold")
    fold = np.arange(300) % 5
    for alpha, got in zip([0.1, 50.0], LI.search(parts, "ridge", [0.1, 50.0])):
        scores = []
        for f in range(5):
            a, b = x[fold != f], y[fold != f]
            c = a - a.mean(0)
            w = np.linalg.solve(c.T @ c + alpha * np.eye(4), c.T @ (b - b.mean()))
            e = y[fold == f] - (b.mean() + (x[fold == f] - a.mean(0)) @ w)
            scores.append(1 - (e @ e) / ((y[fold == f] - y[fold == f].mean()) ** 2).sum())
        assert got == pytest.approx(np.mean(scores), rel=1e-9)


def test_sums_take_one_aggregate_and_models_survive_saving(table, tmpdir_path):
    _, _, df = table
    fitted = LI.solve(LI.total(LI.moments(df, "y")), "ridge", 1.0)
    model = LI.spark_model(fitted)
    model.write().overwrite().save(tmpdir_path + "/m")
    back = LinearRegressionModel.load(tmpdir_path + "/m")
    assert np.allclose(back.coefficients.toArray(), fitted.coefficients) and back.intercept == fitted.intercept
    for r in back.transform(df).select("features", "prediction").limit(5).collect():
        assert r.prediction == pytest.approx(r.features.toArray() @ fitted.coefficients + fitted.intercept, rel=1e-12)
    assert LI.moments(df.limit(0), "y") == {}


def r2(model, df):
    return RegressionEvaluator(labelCol="y", metricName="r2").evaluate(model.transform(df))


def test_parts_of_ensembles_equal_models_trained_alone(table):
    df = table[2].where("y is not null")
    train, held = df.where("fold <> 0"), df.where("fold = 0")
    forest = RandomForestRegressor(numTrees=6, maxDepth=7, featureSubsetStrategy="all", seed=42, labelCol="y")
    got = TR.nested_scores(forest.fit(train), held, "y", "k", [2, 6], [3, 7])
    for depth in (3, 7):
        assert got[6, depth] == pytest.approx(r2(forest.copy({forest.maxDepth: depth}).fit(train), held), rel=1e-9)
    assert got[2, 7] != got[6, 7]
    boost = GBTRegressor(maxIter=6, maxDepth=3, stepSize=0.3, subsamplingRate=0.7, seed=42, labelCol="y")
    got = TR.nested_scores(boost.fit(train), held, "y", "k", [1, 4, 6], [3])
    for stages in (1, 4, 6):
        assert got[stages, 3] == pytest.approx(r2(boost.copy({boost.maxIter: stages}).fit(train), held), rel=1e-9)


def test_tree_grids_train_once_per_group_and_fold(table, monkeypatch):
    df = table[2].where("y is not null").drop("features", "fold")
    fits = []
    plain = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data, params=None: fits.append(params) or plain(self, data, params))
    grid = {"n_estimators": [2, 4], "learning_rate": [0.1, 0.5], "max_depth": [2], "subsample": [1.0]}
    model, names, scores = models.grid_search(df, "gradient_boosting", "y", ["a", "b", "c"], "k", grid, folds=3)
    assert len(fits) == 2 * 3 + 1 and len(scores) == 4 and names == ["a", "b", "c"]
    assert max(scores) == scores[3] and model.stages[-1].getNumTrees == 4
    model, _, scores = models.grid_search(df, "random_forest", "y", ["a", "b"], "k", {"n_estimators": [2, 3], "max_depth": [None, 2, 30], "min_samples_leaf": [1]}, folds=2)
    assert len(scores) == 6 and scores[0] == scores[2] and len(set(scores)) == 4


def test_importances_from_nodes_equal_the_models_own(table):
    df = table[2].where("y is not null")
    for est in (RandomForestRegressor(numTrees=7, maxDepth=4, seed=1, labelCol="y"), GBTRegressor(maxIter=7, maxDepth=3, subsamplingRate=0.6, seed=1, labelCol="y"),
                RandomForestRegressor(numTrees=2, maxDepth=0, seed=1, labelCol="y")):
        m = est.fit(df)
        got = {r.feature: r.importance for r in TR.importances(m, list("abcd")).collect()}
        assert [got[c] for c in "abcd"] == pytest.approx(m.featureImportances.toArray().tolist(), rel=1e-9)


def test_rows_that_cannot_be_priced_do_not_end_the_job(spark):
    rows = [(i, float(i % 13) + i * .1, "a" if i % 3 else "b", 3.0 * i + (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, c string, y double")
    ms = {k: models.train_model(df, k, "y", ["x", "c"], **p)[0] for k, p in (("linear", {}), ("random_forest", {"n_estimators": 3, "max_depth": 3}))}
    ms["other"] = models.train_model(df.withColumnRenamed("x", "z"), "linear", "y", ["z"])[0]
    bad = spark.createDataFrame([(1, "5.0", "a"), (2, "abc", "a"), (3, None, "zzz"), (4, "NaN", None), (5, "-Infinity", "b"), (6, "", "b")], "id int, x string, c string")
    got = {(r.id, r.model): r for r in models.compare_models(ms, bad, "id").collect()}
    assert len(got) == 18
    for i in range(1, 7):
        for m in ("linear", "random_forest"):
            sound = i in (1, 3)
            assert (got[i, m].predicted_price is not None) == sound and (got[i, m].message is None) == sound
        assert got[i, "other"].message == "Prediction failed: no column z" and got[i, "other"].predicted_price is None
    assert got[2, "linear"].message == "Prediction failed: x is not a number"
    clean = bad.where("id = 1").withColumn("x", F.col("x").cast("double"))
    assert got[1, "linear"].predicted_price == ms["linear"].transform(clean).first().prediction


def test_a_forest_is_put_together_from_runs(table, tmpdir_path, monkeypatch):
    _, _, df = table
    seeds, fit = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, data: seeds.append((self.getNumTrees(), self.getSeed())) or fit(self, data))
    est = RandomForestRegressor(numTrees=TR.TREES_A_FIT + 3, maxDepth=30, featureSubsetStrategy="all", seed=42, labelCol="y", predictionCol="p")
    train = df.where("y is not null")
    whole = TR.fit_forest(est, train)
    assert sorted(n for n, _ in seeds) == [3, TR.TREES_A_FIT] and len({s for _, s in seeds}) == 2
    assert whole.getNumTrees == TR.TREES_A_FIT + 3 and sum(whole.treeWeights) == whole.getNumTrees
    first = fit(est.copy({est.numTrees: TR.TREES_A_FIT}), train)
    assert [t.toDebugString.split("\n", 1)[1] for t in whole.trees[:TR.TREES_A_FIT]] == [t.toDebugString.split("\n", 1)[1] for t in first.trees]
    again = TR.fit_forest(est, train)
    got, same = ({r["k"]: r["p"] for r in m.transform(train).collect()} for m in (whole, again))
    assert got == same and len(set(got.values())) > 100
    whole.write().overwrite().save(f"{tmpdir_path}/forest")
    kept = type(whole).load(f"{tmpdir_path}/forest")
    assert {r["k"]: r["p"] for r in kept.transform(train).collect()} == got
    assert sum(r["importance"] for r in TR.importances(whole, list("abcd")).collect()) == pytest.approx(1.0)
    small = est.copy({est.numTrees: 2})
    assert TR.fit_forest(small, train).toDebugString.split("\n", 1)[1] == fit(small, train).toDebugString.split("\n", 1)[1]


def test_the_ensembles_of_a_family_are_grown_side_by_side(spark, monkeypatch):
    rows = [(i, float(i % 13) + i * .1, 3.0 * i + (i % 7)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    both, fit = threading.Barrier(2, timeout=60), models._fit

    def meet(feats, kind, *rest, **params):
        if kind not in LI.KINDS:
            both.wait()                               # breaks where one waits for the other to end
            assert feats.is_cached
        return fit(feats, kind, *rest, **params)
    monkeypatch.setattr(models, "_fit", meet)
    small = {"n_estimators": 2, "max_depth": 2}
    ms, met, _ = models.train_family(df, "id", "y", ["x"], ["linear", "random_forest", "ridge", "gradient_boosting"], params={"random_forest": small, "gradient_boosting": small})
    assert list(ms) == [r.model for r in met.collect()] == ["linear", "random_forest", "ridge", "gradient_boosting"]


def test_a_grid_of_forests_keeps_the_sums_of_its_parts_only(table, monkeypatch):
    df = table[2].where("y is not null")
    monkeypatch.setattr(TR, "TREES_A_FIT", 2)
    monkeypatch.setattr(TR, "RUNS_A_SCORE", 2)
    scored, sums = [], TR.forest_sums
    monkeypatch.setattr(TR, "forest_sums", lambda model, *rest: scored.append(model.getNumTrees) or sums(model, *rest))
    est = RandomForestRegressor(maxDepth=8, featureSubsetStrategy="all", seed=42, labelCol="y")
    maps = [{est.numTrees: k, est.maxDepth: d, est.minInstancesPerNode: 2} for k in (3, 7) for d in (2, 8)]
    got = TR.nested_search(df, est, maps, "y", "k", "fold", 2, 2)
    assert sorted(scored) == [3, 3, 4, 4]             # never all 7 trees of a forest
    monkeypatch.setattr(TR, "ROWS_A_TASK", df.count())       # more rows: the trees of one run at a time
    scored.clear()
    assert TR.nested_search(df, est, maps, "y", "k", "fold", 2, 2) == pytest.approx(got, rel=1e-9)
    assert sorted(scored) == [1, 1, 2, 2, 2, 2, 2, 2]
    data = df.coalesce(1).persist()
    for m, r in zip(maps, got):
        alone = []
        for held in range(2):
            whole = TR.fit_forest(est, data.where(F.col("fold") != held), maps[-1])
            alone.append(TR.nested_scores(whole, data.where(F.col("fold") == held), "y", "k", [3, 7], [2, 8])[m[est.numTrees], m[est.maxDepth]])
        assert r == pytest.approx(sum(alone) / 2, rel=1e-9)
