"""Model queries: split, preprocessing statistics, one-feature closed-form
oracles for the linear family, and rows-only checks for trees, grid search,
scoring, comparison, importances, persistence."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import bindings as B
from .. import constants as K
from ..functions import random as R
from ..operators import features as FE
from ..operators import materials, models, stats
from ..session import scratch_path
from . import dataset_queries as DQ
from . import listing_queries as LQ
from .registry import query, r, round_half_up

SPEC = B.duck_ctes("specs")
_TEST = R.sql_uniform("spec_id", 1000 + K.SPLIT_SEED) + f" < {K.TEST_FRACTION}"


def specs_split(spark, sf):
    return FE.split_flag(B.specs(spark, sf), "spec_id")


@query("model_split", SPEC + f"""
select is_test, count(*) as n, {r('avg(quoted_price)', 'mean_price')}
from (select *, {_TEST} as is_test from specs) t group by is_test""")
def model_split(spark, sf):
    """M1: stable hash split of the specs (about 20 % test)."""
    return specs_split(spark, sf).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"),
                                                        F.avg("quoted_price").alias("mean_price"))


_NULLED = "case when spec_id % 7 = 0 then null else power_rating end"


@query("model_impute_median", SPEC + f"""
, s as (select spec_id, {_NULLED} as x, {_TEST} as is_test from specs),
m as (select median(x) as med from s where not is_test)
select spec_id, {r('coalesce(x, med)', 'power_rating')} from s, m""")
def model_impute_median(spark, sf):
    """M4: exact training median fills the gaps (all rows)."""
    df = specs_split(spark, sf).withColumn("power_rating", F.expr(_NULLED))
    st = FE.fit_numeric_stats(df.where(~F.col("is_test")), ["power_rating"])
    return df.select("spec_id", F.coalesce("power_rating", F.lit(st["power_rating"]["median"])).alias("power_rating"))


@query("model_scale", SPEC + f"""
, s as (select spec_id, efficiency as x, {_TEST} as is_test from specs),
m as (select avg(x) as mu, stddev_pop(x) as sd from s where not is_test)
select spec_id, {r('(x - mu) / sd', 'efficiency_scaled')} from s, m""")
def model_scale(spark, sf):
    """M3: standard scaling with the training mean and population std."""
    df = specs_split(spark, sf)
    st = FE.fit_numeric_stats(df.where(~F.col("is_test")), ["efficiency"])["efficiency"]
    return df.select("spec_id", ((F.col("efficiency") - st["mean"]) / st["std"]).alias("efficiency_scaled"))


_NULL_COOL = "case when spec_id % 5 = 0 then null else cooling_type end"


@query("model_impute_mode", SPEC + f"""
, s as (select spec_id, {_NULL_COOL} as c, {_TEST} as is_test from specs),
m as (select c as mode from s where not is_test and c is not null group by c order by count(*) desc, c limit 1)
select spec_id, coalesce(c, mode) as cooling_type from s, m""")
def model_impute_mode(spark, sf):
    """M5: most frequent training category fills the gaps."""
    df = specs_split(spark, sf).withColumn("cooling_type", F.expr(_NULL_COOL))
    mode = FE.fit_modes(df.where(~F.col("is_test")), ["cooling_type"])["cooling_type"]
    return df.select("spec_id", F.coalesce("cooling_type", F.lit(mode)).alias("cooling_type"))


# --- one-feature linear family (closed forms in SQL) ----------------------------------------------

def _fit1(spark, sf, kind, **p):
    df = B.specs(spark, sf).select("spec_id", "power_rating", F.col("quoted_price").alias("label"))
    sigma, n = models.label_std_pop(df, "label")
    est = models.make_estimator(kind, "label", sigma, n, **p)
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["power_rating"], outputCol="features"), est])
    lr = pipe.fit(df).stages[-1]
    return spark.createDataFrame([(float(lr.intercept), float(lr.coefficients[0]))], "intercept double, slope double")


_MOM = """, m as (select avg(power_rating) as mx, avg(quoted_price) as my, count(*) as n,
  sum((power_rating - (select avg(power_rating) from specs)) * (power_rating - (select avg(power_rating) from specs))) as sxx,
  sum((power_rating - (select avg(power_rating) from specs)) * (quoted_price - (select avg(quoted_price) from specs))) as sxy
  from specs)
"""


@query("model_ols1", SPEC + _MOM + f"""
select {r('my - sxy / sxx * mx', 'intercept', 4)}, {r('sxy / sxx', 'slope', 4)} from m""")
def model_ols1(spark, sf):
    """OLS of the quoted price on the rating (Spark ML normal equations)."""
    out = _fit1(spark, sf, "linear")
    return out.select(round_half_up(F.col("intercept"), 4).alias("intercept"),
                      round_half_up(F.col("slope"), 4).alias("slope"))


@query("model_ridge1", SPEC + _MOM + f"""
select {r('my - sxy / (sxx + 100000.0) * mx', 'intercept', 4)}, {r('sxy / (sxx + 100000.0)', 'slope', 4)} from m""")
def model_ridge1(spark, sf):
    """Ridge with alpha = 1e5 (penalty translated to Spark's scaling)."""
    out = _fit1(spark, sf, "ridge", alpha=100000.0)
    return out.select(round_half_up(F.col("intercept"), 4).alias("intercept"),
                      round_half_up(F.col("slope"), 4).alias("slope"))


def _soft(z: str, t: str) -> str:
    return f"(sign({z}) * greatest(abs({z}) - {t}, 0.0))"


@query("model_lasso1", SPEC + _MOM + f"""
select {r(f"my - {_soft('sxy / n', '1000.0')} / (sxx / n) * mx", 'intercept', 2)},
  {r(f"{_soft('sxy / n', '1000.0')} / (sxx / n)", 'slope', 2)} from m""")
def model_lasso1(spark, sf):
    """Lasso with alpha = 1000 (soft-threshold closed form for one feature)."""
    out = _fit1(spark, sf, "lasso", alpha=1000.0)
    return out.select(round_half_up(F.col("intercept"), 2).alias("intercept"),
                      round_half_up(F.col("slope"), 2).alias("slope"))


@query("model_enet1", SPEC + _MOM + f"""
select {r(f"my - {_soft('sxy / n', '500.0')} / (sxx / n + 500.0) * mx", 'intercept', 2)},
  {r(f"{_soft('sxy / n', '500.0')} / (sxx / n + 500.0)", 'slope', 2)} from m""")
def model_enet1(spark, sf):
    """M8d: elastic net alpha = 1000, l1_ratio = 0.5 (closed form for one feature)."""
    out = _fit1(spark, sf, "elastic_net", alpha=1000.0, l1_ratio=0.5)
    return out.select(round_half_up(F.col("intercept"), 2).alias("intercept"),
                      round_half_up(F.col("slope"), 2).alias("slope"))


# --- many features: normal equations in SQL ------------------------------------------------------------------

_NUMBERS = [c for c in models.FAMILY_A_FEATURES if c in DQ.DOUBLE_SPEC or c == "frequency"]
_LEVELS = {"cooling_type": K.SPEC_COOLING, "tap_changer": ["false", "true"], "phase": K.SPEC_PHASES, "installation_type": K.SPEC_INSTALLATION,
           "insulation_type": K.SPEC_INSULATION, "manufacturing_location": K.SPEC_LOCATIONS}


def _solved_sql(rows_and_penalties: str, fitted_on: str) -> str:
    """DuckDB text up to ``predicted`` (spec_id, fold, alpha, y) of ridge fits (alpha 0: OLS) on all
    features of the labelled specs: sums of products per fold, centred normal equations, and
    Gauss-Jordan elimination step by step, columns without a pivot left out."""
    xs = [f"(cast({c} as double) - m_{c}) / s_{c}" for c in _NUMBERS]
    xs += [f"case when cast({c} as varchar) = '{level}' then 1.0 else 0.0 end" for c, levels in _LEVELS.items() for level in sorted(levels)]
    p = len(xs)
    stats = ", ".join(f"avg(cast({c} as double)) as m_{c}, stddev_pop(cast({c} as double)) as s_{c}" for c in _NUMBERS)
    step = (f"list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 2}), lambda j: case when abs(m[k][k]) < 1e-6 then m[i][j] "
            "when i = k then m[k][j] / m[k][k] else m[i][j] - m[i][k] * m[k][j] / m[k][k] end))")
    return "with recursive " + DQ.G1_GEN + f""",
data as (select *, cast(price as double) as y, {_FOLD} as fold, {_TEST} as is_test from gspecs),
scale as (select {stats} from data where {fitted_on}),
design as (select spec_id, y, fold, is_test, [{", ".join(f"cast({x} as double)" for x in xs)}] as x from data, scale),
level as (select avg(y) as y0 from design where {fitted_on}),
z as (select fold, list_concat(list_concat([cast(1.0 as double)], x), [y - y0]) as z from design, level where {fitted_on}),
gram as (select fold, i, j, sum(z[i] * z[j]) as s from z, range(1, {p + 3}) a(i), range(1, {p + 3}) b(j) group by fold, i, j),
{rows_and_penalties},
centred as (select f.fold, alpha, f.i - 1 as i, f.j - 1 as j, f.s - a.s * b.s / n.s + case when f.i = f.j and f.i <= {p + 1} then alpha else 0.0 end as v
  from fit_rows f join fit_rows a on a.fold = f.fold and a.i = 1 and a.j = f.i join fit_rows b on b.fold = f.fold and b.i = 1 and b.j = f.j
  join fit_rows n on n.fold = f.fold and n.i = 1 and n.j = 1, penalty where f.i > 1 and f.j > 1 and f.i <= {p + 1}),
matrix as (select fold, alpha, list(row order by i) as m from (select fold, alpha, i, list(v order by j) as row from centred group by fold, alpha, i) t group by fold, alpha),
steps as (select fold, alpha, 1 as k, m from matrix union all select fold, alpha, k + 1, {step} from steps where k <= {p}),
weight as (select fold, alpha, list_transform(range(1, {p + 1}), lambda i: case when abs(m[i][i] - 1) < 1e-3 then m[i][{p + 1}] else 0.0 end) as w from steps where k = {p + 1}),
mean as (select fold, list(s / n order by j) as c from (select f.fold, f.j, f.s, n.s as n from fit_rows f join fit_rows n on n.fold = f.fold and n.i = 1 and n.j = 1
  where f.i = 1 and f.j > 1) t group by fold),
predicted as (select spec_id, w.fold, alpha, y0 + c[{p + 1}] + list_sum(list_transform(range(1, {p + 1}), lambda i: w.w[i] * (x[i] - c[i]))) as y
  from design, weight w join mean on mean.fold = w.fold, level)"""


_FOLD = f"cast(floor({R.sql_uniform('spec_id', 2000 + K.SPLIT_SEED)} * 5) as integer)"


# --- rows-only: training families, trees, grid, scoring ------------------------------------------------------

def family_a(spark, sf, kinds, params=None):
    return models.train_family(DQ.gen_specs(spark, sf), "spec_id", "price", models.FAMILY_A_FEATURES, kinds,
                               params=params)


@query("model_linear_family")
def model_linear_family(spark, sf):
    """M12 (linear part) + M10: linear, ridge, lasso on the labelled specs; metrics table."""
    _, met, _ = family_a(spark, sf, ["linear", "ridge", "lasso"], {"ridge": {"alpha": 1.0}, "lasso": {"alpha": 0.1}})
    return met


@query("model_rf")
def model_rf(spark, sf):
    """M8e: random forest on the labelled specs; test metrics."""
    _, met, _ = family_a(spark, sf, ["random_forest"])
    return met


@query("model_gbt")
def model_gbt(spark, sf):
    """M8f: gradient boosting on the labelled specs; test metrics."""
    _, met, _ = family_a(spark, sf, ["gradient_boosting"])
    return met


@query("model_grid", _solved_sql(f"""
fit_rows as (select f.fold, g.i, g.j, sum(s) as s from gram g join (select unnest(range(5)) as fold) f on g.fold <> f.fold group by f.fold, g.i, g.j),
penalty as (select unnest({list(map(float, K.RIDGE_ALPHAS))}) as alpha)""", "true") + f"""
, error as (select alpha, d.fold, sum((d.y - p.y) * (d.y - p.y)) as e, count(*) as n, var_pop(d.y) as v
  from design d join predicted p on p.spec_id = d.spec_id and p.fold = d.fold group by alpha, d.fold)
select alpha, {r('avg(1 - e / (n * v))', 'cv_r2')} from error group by alpha""")
def model_grid(spark, sf):
    """M9: 5-fold grid search of ridge over the reference alphas, all features; CV R^2 per alpha."""
    df = DQ.gen_specs(spark, sf).withColumn("label", F.col("price").cast("double"))
    _, _, avg = models.grid_search(df, "ridge", "label", models.FAMILY_A_FEATURES, "spec_id")
    rows = [(float(a), float(m)) for a, m in zip(K.RIDGE_ALPHAS, avg)]
    return spark.createDataFrame(rows, "alpha double, cv_r2 double")


@query("model_linear_metrics", _solved_sql("""
fit_rows as (select 0 as fold, i, j, sum(s) as s from gram where fold >= 0 group by i, j),
penalty as (select unnest([0.0, 1.0]) as alpha)""", "not is_test") + f"""
, t as (select case alpha when 0.0 then 'linear' else 'ridge' end as model, d.y, p.y as f from design d join predicted p on p.spec_id = d.spec_id where d.is_test)
select model, count(*) as n, {r('sqrt(avg((y - f) * (y - f)))', 'rmse', 2)}, {r('avg(abs(y - f))', 'mae', 2)},
  {r('1 - sum((y - f) * (y - f)) / (count(*) * var_pop(y))', 'r2')}, {r('100 * avg(abs((y - f) / y))', 'mape', 4)} from t group by model""")
def model_linear_metrics(spark, sf):
    """OLS and ridge on all features of the labelled specs; test metrics."""
    _, met, _ = family_a(spark, sf, ["linear", "ridge"], {"ridge": {"alpha": 1.0}})
    return met.select("model", "n", *[round_half_up(F.col(c), d).alias(c) for c, d in (("rmse", 2), ("mae", 2), ("r2", 6), ("mape", 4))])


@query("model_importance")
def model_importance(spark, sf):
    """Random-forest importances with feature names, sorted."""
    ms, _, names = family_a(spark, sf, ["random_forest"])
    return models.feature_importance(ms["random_forest"], names)


@query("model_family_b")
def model_family_b(spark, sf):
    """All log-target models on the market table; metrics in dollars, ranked."""
    df = LQ.market(spark, sf)
    _, met, _ = models.train_family(df, "l_orderkey", "unit_price_usd", models.FAMILY_B_FEATURES,
                                    ["linear", "ridge", "random_forest", "gradient_boosting"], log_target=True,
                                    params={"ridge": {"alpha": 1.0}})
    return models.rank_models(met)


@query("model_scoring")
def model_scoring(spark, sf):
    """M14 + M16 + M17-style output: score every spec with a fitted pipeline, with
    the rule price as fallback and its provenance."""
    ms, _, _ = family_a(spark, sf, ["linear"])
    scored = models.score(ms["linear"], DQ.gen_specs(spark, sf))
    return models.with_rule_fallback(scored, "predicted_price", rating="power_rating", v1="primary_voltage",
                                     v2="secondary_voltage").select("spec_id", "predicted_price", "final_price",
                                                                    "price_source")


@query("model_comparison")
def model_comparison(spark, sf):
    """M15 + A13: every model's price per spec in long form, with the ensemble mean."""
    ms, _, _ = family_a(spark, sf, ["linear", "ridge", "random_forest", "gradient_boosting"], {"ridge": {"alpha": 1.0}})
    long = models.compare_models(ms, DQ.gen_specs(spark, sf), "spec_id")
    return long.join(stats.ensemble_mean(long), "spec_id")


@query("model_residuals")
def model_residuals(spark, sf):
    """Actual vs predicted on the test rows with identity-line bounds."""
    ms, _, _ = family_a(spark, sf, ["linear"])
    data = DQ.gen_specs(spark, sf).withColumn("__label", F.col("price").cast("double"))
    _, test = FE.train_test_split(data, "spec_id")
    return models.residuals(ms["linear"].transform(test), "__label")


@query("model_registry")
def model_registry(spark, sf):
    """S12 + S13 + J6 + A18: save each pipeline, reload one and score, registry
    table with metrics looked up (defaults flagged) and the best model."""
    ms, met, _ = family_a(spark, sf, ["linear", "ridge"], {"ridge": {"alpha": 1.0}})
    base = scratch_path(spark, f"models_{os.getpid()}")
    reg = models.save_models(ms, met, base, "family_a")
    reloaded = models.load_model(reg.where(F.col("model") == "linear").first()["path"])
    n_scored = reloaded.transform(DQ.gen_specs(spark, sf)).count()
    requested = spark.createDataFrame([("linear",), ("ridge",), ("random_forest",)], "model string")
    looked = materials.metrics_with_defaults(requested, reg.select("model", "r2", "mae", "rmse", "mape"))
    best = stats.best_by(reg, "model", "r2").first()["best"]
    return (looked.withColumn("is_best", F.col("model") == F.lit(best))
                  .withColumn("reloaded_rows", F.lit(n_scored)))


# --- one-feature twins of training, scoring and comparison, with closed forms in SQL ---------------------

@query("model_split_exact", SPEC + f"""
, u as (select spec_id, {R.sql_uniform("spec_id", 1000 + K.SPLIT_SEED)} as u from specs),
k as (select spec_id, row_number() over (order by u, spec_id) <= ceil({K.TEST_FRACTION} * (select count(*) from u)) as is_test from u)
select spec_id, is_test from k""")
def model_split_exact(spark, sf):
    """M1: split with exactly ceil(.2 n) test rows."""
    return FE.split_exact(B.specs(spark, sf).select("spec_id"), "spec_id")


def _pair(spark, sf):
    """(data, {linear, ridge}) fitted on the training rows with the rating alone, through the
    library's own preprocessing."""
    data = B.specs(spark, sf).select("spec_id", "power_rating", F.col("quoted_price").alias("price"))
    ms, met, _ = models.train_family(data, "spec_id", "price", ["power_rating"], ["linear", "ridge"], params={"ridge": {"alpha": 500.0}})
    return data, ms, met


_PAIR = f""", t as (select spec_id, power_rating as x, quoted_price as y, {_TEST} as is_test from specs),
m as (select avg(x) as mx, avg(y) as my, count(*) as n, stddev_pop(x) as sx from t where not is_test),
q as (select sum((x - mx) / sx * (y - my)) as szy, max(n) as n, max(mx) as mx, max(my) as my, max(sx) as sx from t, m where not is_test),
p as (select spec_id, y, is_test, my + szy / n * (x - mx) / sx as lin, my + szy / (n + 500.0) * (x - mx) / sx as rid from t, q)
"""


@query("model_scores_long", SPEC + _PAIR + f"""
select spec_id, model, {r('price', 'predicted_price', 2)}, 2 as n_warnings, cast(null as varchar) as message from (
  select spec_id, 'linear' as model, lin as price from p union all select spec_id, 'ridge', rid from p) u
union all select spec_id, 'tree', null, 0, 'failed' from p""")
def model_scores_long(spark, sf):
    """Every model's price per spec in one scan; a model that lacks its input reports why."""
    data, ms, _ = _pair(spark, sf)
    other = models.train_model(data.withColumn("age", F.col("power_rating") * 2), "linear", "price", ["age"])[0]
    long = models.compare_models({**ms, "tree": other}, data.drop("price"), "spec_id")
    return long.select("spec_id", "model", round_half_up(F.col("predicted_price"), 2).alias("predicted_price"), "n_warnings",
                       F.when(F.col("message").startswith("Prediction failed:"), "failed").alias("message"))


@query("model_ensemble", SPEC + _PAIR + f"""
select spec_id, {r('(lin + rid) / 2', 'ensemble_price', 2)}, 2 as n_models from p""")
def model_ensemble(spark, sf):
    """Mean price over the models."""
    data, ms, _ = _pair(spark, sf)
    out = stats.ensemble_mean(models.compare_models(ms, data, "spec_id"))
    return out.select("spec_id", round_half_up(F.col("ensemble_price"), 2).alias("ensemble_price"), F.col("n_models").cast("int").alias("n_models"))


@query("model_residuals1", SPEC + _PAIR + f"""
, b as (select least(min(y), min(lin)) as lo, greatest(max(y), max(lin)) as hi from p where is_test)
select {r('y', 'actual', 2)}, {r('lin', 'predicted', 2)}, {r('y - lin', 'residual', 2)}, {r('lo', 'line_min', 2)}, {r('hi', 'line_max', 2)}
from p, b where is_test""")
def model_residuals1(spark, sf):
    """M17 on the test rows of the one-feature model."""
    data, ms, _ = _pair(spark, sf)
    test = FE.split_flag(data, "spec_id").where("is_test")
    out = models.residuals(ms["linear"].transform(test), "price")
    return out.select(*[round_half_up(F.col(c), 2).alias(c) for c in ["actual", "predicted", "residual", "line_min", "line_max"]])


def _metrics_sql(col: str) -> str:
    return (f"select '{{0}}' as model, count(*) as n, {r(f'sqrt(avg((y - {col}) * (y - {col})))', 'rmse', 2)}, "
            f"{r(f'avg(abs(y - {col}))', 'mae', 2)}, {r(f'1 - sum((y - {col}) * (y - {col})) / (count(*) * var_pop(y))', 'r2', 5)} from p where is_test")


@query("model_registry1", SPEC + _PAIR + f"""
, met as ({_metrics_sql('lin').format('linear')} union all {_metrics_sql('rid').format('ridge')})
select w.model, coalesce(rmse, {K.DEFAULT_METRICS['rmse']}) as rmse, coalesce(mae, {K.DEFAULT_METRICS['mae']}) as mae,
  coalesce(r2, {K.DEFAULT_METRICS['r2']}) as r2, met.model is null as is_default,
  w.model = (select model from met order by r2 desc, model limit 1) as is_best, (select count(*) from p) as reloaded_rows
from (values ('linear'), ('ridge'), ('random_forest')) w(model) left join met on met.model = w.model""")
def model_registry1(spark, sf):
    """Save, reload and score; metrics looked up with defaults; the best model."""
    data, ms, met = _pair(spark, sf)
    met = met.select("model", round_half_up(F.col("rmse"), 2).alias("rmse"), round_half_up(F.col("mae"), 2).alias("mae"),
                     round_half_up(F.col("r2"), 5).alias("r2"), "mape")
    reg = models.save_models(ms, met, scratch_path(spark, f"models1_{os.getpid()}"), "one_feature")
    scored = models.load_model(reg.where(F.col("model") == "ridge").first()["path"]).transform(data).where("prediction is not null").count()
    requested = spark.createDataFrame([("linear",), ("ridge",), ("random_forest",)], "model string")
    looked = materials.metrics_with_defaults(requested, reg.select("model", "r2", "mae", "rmse", "mape"))
    best = stats.best_by(reg, "model", "r2").first()["best"]
    return looked.select("model", "rmse", "mae", "r2", "is_default", (F.col("model") == best).alias("is_best"), F.lit(scored).cast("long").alias("reloaded_rows"))


@query("model_grid1", SPEC + f"""
, m0 as (select avg(power_rating) as mx, stddev_pop(power_rating) as sx from specs),
t as (select (power_rating - mx) / sx as z, quoted_price as y, {_FOLD} as fold from specs, m0),
a as (select unnest({list(map(float, K.RIDGE_ALPHAS))}) as alpha),
f as (select unnest(range(5)) as fold),
s as (select f.fold, avg(z) as mz, avg(y) as my, count(*) as n from t join f on t.fold <> f.fold group by f.fold),
c as (select s.fold, sum((z - mz) * (z - mz)) as szz, sum((z - mz) * (y - my)) as szy from t join s on t.fold <> s.fold group by s.fold),
g as (select alpha, s.fold, mz, my, szy / (szz + alpha) as b from a, s join c on s.fold = c.fold),
e as (select alpha, g.fold, 1 - sum((y - my - b * (z - mz)) * (y - my - b * (z - mz))) / (count(*) * var_pop(y)) as r2 from g join t on t.fold = g.fold group by alpha, g.fold)
select alpha, {r('avg(r2)', 'cv_r2', 6)} from e group by alpha""")
def model_grid1(spark, sf):
    """M9: 5-fold ridge search with the rating alone; mean R^2 per alpha."""
    df = B.specs(spark, sf).select("spec_id", "power_rating", F.col("quoted_price").alias("label"))
    _, _, avg = models.grid_search(df, "ridge", "label", ["power_rating"], "spec_id")
    out = spark.createDataFrame([(float(a), float(m)) for a, m in zip(K.RIDGE_ALPHAS, avg)], "alpha double, cv_r2 double")
    return out.select("alpha", round_half_up(F.col("cv_r2"), 6).alias("cv_r2"))


_STUMP = SPEC + f"""
, w as (select spec_id, primary_voltage, quoted_price * (1 + primary_voltage / 50) as quoted_price from specs),
v as (select distinct primary_voltage as v from w),
c as (select v, (select max(v) from v) as vmax from v),
s as (select c.v, sum(case when primary_voltage <= c.v then 1 end) as nl, avg(case when primary_voltage <= c.v then quoted_price end) as yl,
  sum(case when primary_voltage > c.v then 1 end) as nr, avg(case when primary_voltage > c.v then quoted_price end) as yr
  from w, c where c.v < c.vmax group by c.v),
b as (select * from s order by nl * 1.0 * nr / (nl + nr) * (yl - yr) * (yl - yr) desc limit 1)
select spec_id, {r('case when primary_voltage <= v then yl else yr end', 'price', 2)} from w, b"""


def _stump(spark, sf, kind, **params):
    df = B.specs(spark, sf).select("spec_id", "primary_voltage",
                                    (F.col("quoted_price") * (1 + F.col("primary_voltage") / 50)).alias("price"))
    m, _ = models.train_model(df, kind, "price", ["primary_voltage"], n_estimators=1, max_depth=1, **params)
    return models.score(m, df.drop("price")).select("spec_id", round_half_up(F.col("predicted_price"), 2).alias("price"))


@query("model_rf_stump", _STUMP)
def model_rf_stump(spark, sf):
    """M8e: a forest of one tree of depth one equals the best split by search."""
    return _stump(spark, sf, "random_forest", bootstrap=False)


@query("model_gbt_stump", _STUMP)
def model_gbt_stump(spark, sf):
    """M8f: one boosting step of depth one equals the best split by search."""
    return _stump(spark, sf, "gradient_boosting")


@query("model_grid_stumps", SPEC + f"""
, w as (select primary_voltage as x, quoted_price * (1 + primary_voltage / 50) as y, {_FOLD} as fold from specs),
c as (select distinct x as cut from w),
f as (select unnest(range(5)) as f),
s as (select f, cut, count(*) filter (where x <= cut) as nl, avg(y) filter (where x <= cut) as yl, count(*) filter (where x > cut) as nr,
  avg(y) filter (where x > cut) as yr from w join f on w.fold <> f.f, c group by f, cut),
b as (select *, row_number() over (partition by f order by nl * 1.0 * nr / (nl + nr) * (yl - yr) * (yl - yr) desc) as o from s where nl > 0 and nr > 0),
e as (select b.f, 1 - avg((y - case when x <= cut then yl else yr end) ** 2) / var_pop(y) as r2 from w join b on w.fold = b.f where b.o = 1 group by b.f)
select learning_rate, {r('(select avg(r2) from e)', 'cv_r2')} from (select unnest([0.1, 0.2]) as learning_rate) g""")
def model_grid_stumps(spark, sf):
    """M9: 5-fold search over boosting runs of one stump; whatever the rate, each is the best split."""
    df = B.specs(spark, sf).select("spec_id", "primary_voltage", (F.col("quoted_price") * (1 + F.col("primary_voltage") / 50)).alias("label"))
    grid = {"n_estimators": [1], "learning_rate": [0.1, 0.2], "max_depth": [1], "subsample": [1.0]}
    _, _, avg = models.grid_search(df, "gradient_boosting", "label", ["primary_voltage"], "spec_id", grid)
    return spark.createDataFrame(list(zip(grid["learning_rate"], map(float, avg))), "learning_rate double, cv_r2 double")


def _searched(spark, sf, kind, **options):
    df = DQ.gen_specs(spark, sf).withColumn("label", F.col("price").cast("double"))
    _, _, avg = models.grid_search(df, kind, "label", models.FAMILY_A_FEATURES, "spec_id", **options)
    return spark.createDataFrame([(kind, i, float(m)) for i, m in enumerate(avg)], "kind string, point int, cv_r2 double")


@query("model_grid_lasso")
def model_grid_lasso(spark, sf):
    """M9: the lasso's alphas on all features, from one scan."""
    return _searched(spark, sf, "lasso")


@query("model_grid_forest")
def model_grid_forest(spark, sf):
    """M9: the full forest grid, ``constants.RF_GRID``, from one forest per leaf size and fold."""
    return _searched(spark, sf, "random_forest", parallelism=8)


_BEST = "nl * 1.0 * nr / (nl + nr) * (yl - yr) * (yl - yr)"


@query("model_importance_tree", SPEC + f"""
, w as (select spec_id, unnest([primary_voltage, secondary_voltage]) as v, unnest(['primary_voltage', 'secondary_voltage']) as feature,
  quoted_price * (1 + primary_voltage / 50 + secondary_voltage) as y from specs),
c as (select distinct feature, v as cut from w),
s0 as (select c.feature, cut, count(*) filter (where v <= cut) as nl, avg(y) filter (where v <= cut) as yl, count(*) filter (where v > cut) as nr,
  avg(y) filter (where v > cut) as yr from w join c on c.feature = w.feature group by c.feature, cut),
b0 as (select *, {_BEST} as gain from s0 where nl > 0 and nr > 0 order by gain desc limit 1),
side as (select spec_id, v <= cut as goes from w join b0 on b0.feature = w.feature),
s1 as (select goes, c.feature, c.cut, count(*) filter (where v <= cut) as nl, avg(y) filter (where v <= cut) as yl, count(*) filter (where v > cut) as nr,
  avg(y) filter (where v > cut) as yr from w join side on side.spec_id = w.spec_id join c on c.feature = w.feature group by goes, c.feature, c.cut),
b1 as (select *, {_BEST} as gain, row_number() over (partition by goes order by {_BEST} desc) as o from s1 where nl > 0 and nr > 0),
g as (select feature, gain from b0 union all select feature, gain from b1 where o = 1)
select f.feature, {r('coalesce(sum(gain), 0) / (select sum(gain) from g)', 'importance', 5)}
from (select distinct feature from w) f left join g on g.feature = f.feature group by f.feature""")
def model_importance_tree(spark, sf):
    """Importances of a tree of depth two, read off its nodes, equal a search of all splits."""
    df = B.specs(spark, sf).select("spec_id", "primary_voltage", "secondary_voltage",
                                    (F.col("quoted_price") * (1 + F.col("primary_voltage") / 50 + F.col("secondary_voltage"))).alias("price"))
    m, names = models.train_model(df, "random_forest", "price", ["primary_voltage", "secondary_voltage"], n_estimators=1, max_depth=2, bootstrap=False)
    out = models.feature_importance(m, names)
    return out.select("feature", round_half_up(F.col("importance"), 5).alias("importance"))


_BAD = "case spec_id % 10 when 0 then 'n/a' when 1 then null when 2 then 'NaN' else cast(power_rating as {0}) end"


@query("model_guarded", SPEC + _PAIR + f"""
, g as (select p.spec_id, case p.spec_id % 10 when 1 then med else x end as x, p.spec_id % 10 in (0, 2) as bad, mx, my, sx, szy, n
  from p join t on t.spec_id = p.spec_id, q, (select median(x) as med from t where not is_test) d),
u as (select spec_id, bad, 'linear' as model, my + szy / n * (x - mx) / sx as price from g union all
  select spec_id, bad, 'ridge', my + szy / (n + 500.0) * (x - mx) / sx from g)
select spec_id, model, case when bad then null else {r('price', 'price', 2).rsplit(' as ', 1)[0]} end as predicted_price, 2 as n_warnings,
  case when bad then 'Prediction failed: power_rating is not a number' end as message from u""")
def model_guarded(spark, sf):
    """Rows that a model cannot price have no price and a reason; the other rows keep theirs."""
    data, ms, _ = _pair(spark, sf)
    long = models.compare_models(ms, data.drop("price").withColumn("power_rating", F.expr(_BAD.format("string"))), "spec_id")
    return long.select("spec_id", "model", round_half_up(F.col("predicted_price"), 2).alias("predicted_price"), "n_warnings", "message")


@query("model_grid_kinds")
def model_grid_kinds(spark, sf):
    """M9 for the other kinds: the lasso's alphas and the full tree grids, ``constants.RF_GRID`` (36
    points; Spark has no ``min_samples_split``) and ``GB_GRID`` (54)."""
    df = DQ.gen_specs(spark, sf).withColumn("label", F.col("price").cast("double"))
    rows = []
    for kind in ["lasso", "random_forest", "gradient_boosting"]:
        _, _, avg = models.grid_search(df, kind, "label", models.FAMILY_A_FEATURES, "spec_id", parallelism=8)
        rows += [(kind, i, float(m)) for i, m in enumerate(avg)]
    return spark.createDataFrame(rows, "kind string, point int, cv_r2 double")
