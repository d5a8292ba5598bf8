import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.operators import features as FE
from voltaic.operators import models


def test_pipeline_handles_unknown_category(spark):
    rows = [(i, float(i), "a" if i % 2 else "b", 3.0 * i + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, c string, y double")
    m, names = models.train_model(df, "linear", "y", ["x", "c"])
    assert names == ["x", "c_a", "c_b"]
    new = spark.createDataFrame([(99, 5.0, "zzz", 0.0)], "id int, x double, c string, y double")
    assert m.transform(new).count() == 1


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 200)
    y = 4.0 * x + 2 + rng.normal(0, 1, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    m, _ = models.train_model(df, "linear", "y", ["x"])
    lr = m.stages[-1]
    slope, icpt = np.polyfit(x, y, 1)
    # features are scaled with the population std inside the pipeline
    sx = x.std()
    assert lr.coefficients[0] / sx == pytest.approx(slope, rel=1e-6)


def test_split_is_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = FE.split_flag(df, "k").where("is_test").count()
    b = FE.split_flag(df.repartition(7), "k").where("is_test").count()
    assert a == b and 150 < a < 250


def test_entry_contract(spark):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    out = E.entry(spark)
    assert set(out.columns) >= {"origin", "n", "mean", "median", "min", "max", "std"}
    assert out.count() > 0


def test_model_grid_kinds_searches_the_full_grids(spark, monkeypatch):
    from voltaic.operators import models
    from voltaic.plans import model_queries
    searched = {}

    def points(train, kind, label, features, key, grid=None, **more):
        maps = models.param_grid(models.make_estimator(kind, label, 1.0, 100), kind, 1.0, 100, grid)
        searched[kind] = [tuple(sorted((p.name, v) for p, v in m.items())) for m in maps]
        return None, None, [0.0] * len(maps)
    monkeypatch.setattr(models, "grid_search", points)
    assert model_queries.model_grid_kinds(spark, "/root/testdata/sf0.001").count() == 4 + 36 + 54
    # unlimited depth is 30 in Spark, which the grid has too: 27 of the 36 differ
    assert {k: len(set(v)) for k, v in searched.items()} == {"lasso": 4, "random_forest": 27, "gradient_boosting": 54}
    assert {k: len(v) for k, v in searched.items()} == {"lasso": 4, "random_forest": 36, "gradient_boosting": 54}
    assert any(("numTrees", 200) in p and ("maxDepth", 30) in p for p in searched["random_forest"])
