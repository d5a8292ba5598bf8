import numpy as np
import pandas as pd
import pytest

from voltaic.operators import stats
from voltaic.operators.quantiles import exact_quantiles


def test_exact_quantiles_match_pandas(spark):
    rng = np.random.default_rng(7)
    n = 20000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 4, n)).astype(int),
                        "v": np.round(rng.lognormal(2, 1.5, n), 3)})
    pdf.loc[:1999, "v"] = 5.0  # ties
    df = spark.createDataFrame(pdf)
    out = exact_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"]).toPandas().set_index("g").sort_index()
    exp = pdf.groupby("g")["v"].quantile([0.1, 0.5, 0.9]).unstack()
    assert np.allclose(out.values, exp.values)


def test_quantiles_of_heavy_values(spark):
    df = spark.range(20000).selectExpr("id % 3 as g", "cast(id % 2 as double) as v")
    out = exact_quantiles(df, "v", [0.25, 0.5, 0.75], ["g"]).orderBy("g").collect()
    exp = pd.DataFrame({"g": np.arange(20000) % 3, "v": np.arange(20000) % 2}).groupby("g")["v"].quantile([0.25, 0.5, 0.75]).unstack()
    assert np.allclose([tuple(r)[1:] for r in out], exp.values)
    one = exact_quantiles(df, "v", [0.5], names=["median"]).first()
    assert one["median"] == 0.5
    assert exact_quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_density_is_exact_and_bins_are_asked_for(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(10, 2, 3000), 2)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", 2.0)], "k string, v double")
    got = {r["i"]: (r["x"], r["density"]) for r in stats.density_curve(df, "v", "k", points=50).where("k = 'a'").collect()}
    bw = x.std(ddof=1) * len(x) ** -0.2
    for i, g in enumerate(np.linspace(x.min(), x.max(), 50)):
        d = np.exp(-0.5 * ((g - x) / bw) ** 2).sum() / (len(x) * bw * np.sqrt(2 * np.pi))
        assert got[i][0] == pytest.approx(g) and got[i][1] == pytest.approx(d, rel=1e-9)
    binned = {r["i"]: r["density"] for r in stats.density_curve(df, "v", "k", points=50, bins=64).where("k = 'a'").collect()}
    assert binned[25] != got[25][1] and binned[25] == pytest.approx(got[25][1], rel=0.02)


def test_dummy_correlations_match_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(size=300), "c": rng.choice(["p", "q", "r"], 300), "y": rng.normal(size=300)})
    got = {r["feature"]: r["correlation"] for r in stats.correlations(spark.createDataFrame(pdf), "y", ["x"], ["c"]).collect()}
    assert got["x"] == pytest.approx(pdf.x.corr(pdf.y))
    for level in "pqr":
        assert got[f"c_{level}"] == pytest.approx((pdf.c == level).astype(float).corr(pdf.y))


def test_box_and_histogram(spark):
    vals = [1.0, 2.0, 2.5, 3.0, 4.0, 100.0, 5.0, 6.0]
    df = spark.createDataFrame([("a", v) for v in vals], "k string, v double")
    b = stats.box_stats(df, "v", ["k"]).first()
    q1, q3 = np.percentile(vals, [25, 75])
    assert b["q1"] == pytest.approx(q1) and b["q3"] == pytest.approx(q3)
    assert b["outliers"] == 1 and b["whisker_high"] == 6.0
    h = stats.histogram(df, "v", ["k"]).orderBy("bin").toPandas()
    counts, edges = np.histogram(vals, bins="auto")
    assert len(h) <= len(counts) and h["count"].sum() == len(vals)


def test_quadratic_matches_polyfit(spark):
    x = np.linspace(100, 5000, 50)
    y = 3e-4 * x * x + 2.0 * x + 50 + np.sin(x)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    coef, curve = stats.quadratic_trend(df, "x", "y")
    a, b, c = coef.first()
    ea, eb, ec = np.polyfit(x, y, 2)
    assert a == pytest.approx(ea, rel=1e-6) and b == pytest.approx(eb, rel=1e-6) and c == pytest.approx(ec, rel=1e-6)
    assert curve.count() == 100


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (0.0, 1.0), (4.0, 3.0)], "label double, prediction double")
    m = stats.regression_metrics(df).first()
    e = np.array([-0.5, 0.0, -1.0, 1.0])
    y = np.array([1.0, 2.0, 0.0, 4.0])
    assert m["rmse"] == pytest.approx(np.sqrt(np.mean(e ** 2)))
    assert m["r2"] == pytest.approx(1 - np.sum(e ** 2) / np.sum((y - y.mean()) ** 2))
    assert m["mape"] == pytest.approx(np.mean([0.5, 0.0, 0.25]) * 100)


def test_quantiles_sort_only_inside_the_bracket(spark):
    """A hot group, heavy values, small groups: exact, and few rows reach the sort."""
    import numpy as np
    import pandas as pd

    from voltaic.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(1)
    hot = np.concatenate([np.round(rng.normal(50, 20, 30000), 3), np.full(9000, 7.5), rng.exponential(1e6, 5000)])
    pdf = pd.DataFrame({"g": ["hot"] * len(hot) + ["one"] + ["two"] * 2 + ["same"] * 6000 + [None] * 5,
                        "v": [*hot, 3.0, 1.0, 2.0, *[4.25] * 6000, *[9.0] * 5]})
    pdf.loc[::101, "v"] = None
    df = spark.createDataFrame(pdf.astype({"v": "Float64"}).astype(object).where(pdf.notna(), None), "g string, v double").repartition(7)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["g"]: list(r)[1:] for r in exact_quantiles(df, "v", qs, ["g"]).collect()}
    want = {g: d["v"].dropna().quantile(qs).tolist() for g, d in pdf.groupby("g")}
    assert set(got) == {g for g, w in want.items()} and all(np.allclose(got[g], want[g], rtol=1e-12) for g in got)
    assert list(exact_quantiles(df, "v", [0.5]).first()) == [pdf["v"].median()]
    assert exact_quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_density_reaches_only_near_points(spark):
    import numpy as np

    from voltaic.operators.stats import density_curve
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 400), rng.normal(1e4, 1, 4)])
    rows = [("a", float(v)) for v in x] + [("b", 1.0), ("b", 2.0), ("c", 5.0)]
    got = {}
    for r in density_curve(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect():
        got.setdefault(r.g, {})[r.i] = (r.x, r.density)
    for g, values in (("a", x), ("b", np.array([1.0, 2.0]))):
        bw = values.std(ddof=1) * len(values) ** -0.2
        grid = np.linspace(values.min(), values.max(), 200)
        want = np.exp(-0.5 * ((grid[:, None] - values) / bw) ** 2).sum(1) / (len(values) * bw * np.sqrt(2 * np.pi))
        assert np.allclose([got[g][i][1] for i in range(200)], want, rtol=1e-9, atol=1e-12)
    assert len(got["c"]) == 200 and got["c"][0][1] is None


def test_fuzzy_names_against_a_large_book(spark):
    from pyspark.sql import functions as F

    from voltaic.operators import materials
    names = [f"{w} {i % 997:03d} part" for i in range(3000) for w in ("item", "kit")]
    book = [(f"m{i:05d} {i % 997:03d}", float(i), "USD", None, i) for i in range(100_000)]
    book += [("item 01", 1.0, "USD", None, 100_001), ("it", 2.0, "USD", None, 100_002), ("x", 3.0, "USD", None, 100_003), ("kit 996 part", 4.0, "USD", None, 100_004)]
    df = spark.createDataFrame([(n,) for n in [*names, "zzz", "x", "", None]], "material string")
    bk = spark.createDataFrame(book, "material string, price double, unit string, price_date date, book_order int")
    found = materials.contained_in(df.where("material is not null").select(F.col("material").alias("name")).distinct(), bk.select("material", "book_order"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.name, r.material) for r in found.collect()}
    some = [b[0] for b in book if not b[0].startswith("m")] + [b[0] for b in book[:50]]
    assert got == {(n, m) for n in {*names, "zzz", "x", ""} for m in some if m in n}
    resolved = {r.material: r.resolved_material for r in materials.resolve_materials(df, bk).collect()}
    assert resolved["item 010 part"] == "item 01" and resolved["kit 996 part"] == "kit 996 part" and resolved["kit 000 part"] == "it"
