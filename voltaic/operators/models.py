"""Price models (M8-M17, S12, S13, J6 input) with Spark ML.

One ``Pipeline`` per model: frozen preprocessing (see ``features``) + estimator.
Training, cross-validation and scoring run on executors; the driver only loops
over the handful of estimators and collects one metrics row per model.  Linear models are
solved from sums of products gathered in one scan (``linear``); a search over tree grids
trains only the largest models and scores the others as parts of them (``trees``).
"""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from . import features as FE
from . import linear as LI
from . import trees as TR
from .growing import GrownBoosting, GrownForest
from .pricing import rule_price
from .stats import regression_metrics

FAMILY_A_FEATURES = ["power_rating", "primary_voltage", "secondary_voltage", "core_weight", "copper_weight",
                     "insulation_weight", "tank_weight", "oil_weight", "total_weight", "cooling_type",
                     "tap_changer", "efficiency", "impedance", "phase", "frequency", "installation_type",
                     "insulation_type", "manufacturing_location"]
FAMILY_B_FEATURES = ["power_rating_kva", "primary_voltage_kv", "secondary_voltage_kv", "phase", "type",
                     "frequency_hz"]


#: Parts of the names of linear models.
LINEAR_NAMES = ("linear", "ridge", "lasso", "elasticnet")


# --- M8: estimators and penalty translation -------------------------------------------------------

def label_std_pop(train: DataFrame, label: str) -> tuple[float, int]:
    r = train.agg(F.stddev_pop(label).alias("s"), F.count(label).alias("n")).first()
    return float(r["s"] or 0.0), int(r["n"])


def ridge_reg_param(alpha: float, sigma_y: float, n: int) -> float:
    """Spark minimises 1/(2n) SSE + lambda/2 |w|^2 on a label scaled by sigma_y;
    an un-normalised penalty alpha |w|^2 on SSE maps to lambda = alpha * sigma_y / n."""
    return alpha * sigma_y / n if n else alpha


def enet_params(alpha: float, l1_ratio: float, sigma_y: float) -> tuple[float, float]:
    """M8d: (regParam, elasticNetParam) for min SSE/2n + a r |w|_1 + a (1-r)/2 |w|^2."""
    lam = alpha * l1_ratio + alpha * (1 - l1_ratio) * sigma_y
    return lam, (alpha * l1_ratio / lam if lam else 0.0)


def make_estimator(kind: str, label: str = "label", sigma_y: float = 1.0, n: int = 1, **p):
    common = dict(featuresCol="features", labelCol=label, predictionCol="prediction")
    if kind == "linear":
        return LinearRegression(regParam=0.0, solver="normal", **common)
    if kind == "ridge":
        return LinearRegression(regParam=ridge_reg_param(p.get("alpha", 1.0), sigma_y, n), elasticNetParam=0.0,
                                standardization=False, solver="normal", **common)
    if kind == "lasso":
        return LinearRegression(regParam=p.get("alpha", 1.0), elasticNetParam=1.0, standardization=False,
                                maxIter=p.get("max_iter", 1000), tol=p.get("tol", 1e-12), **common)
    if kind == "elastic_net":
        lam, mix = enet_params(p.get("alpha", 1.0), p.get("l1_ratio", 0.5), sigma_y)
        return LinearRegression(regParam=lam, elasticNetParam=mix, standardization=False,
                                maxIter=p.get("max_iter", 1000), tol=p.get("tol", 1e-12), **common)
    if kind == "random_forest":
        depth = p.get("max_depth")
        return GrownForest(numTrees=p.get("n_estimators", 100), maxDepth=min(depth or 30, 30),
                           minInstancesPerNode=p.get("min_samples_leaf", 1),
                           featureSubsetStrategy="all", bootstrap=p.get("bootstrap", True), seed=K.SPLIT_SEED, **common)
    if kind == "gradient_boosting":
        return GrownBoosting(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1),
                             maxDepth=p.get("max_depth", 3), subsamplingRate=p.get("subsample", 1.0),
                             seed=K.SPLIT_SEED, **common)
    raise ValueError(f"unknown model type: {kind}")


def _frozen(df: DataFrame) -> DataFrame:
    """Training reads its input many times (statistics, every optimiser pass, every
    fold): write it once to the checkpoint folder and cut the lineage."""
    from ..session import materialize
    return materialize(df, "training")


# --- M9: grid search --------------------------------------------------------------------------------

def param_grid(est, kind: str, sigma_y: float, n: int, grid: dict | None = None):
    b = ParamGridBuilder()
    if kind == "ridge":
        b.addGrid(est.regParam, [ridge_reg_param(a, sigma_y, n) for a in (grid or {}).get("alpha", K.RIDGE_ALPHAS)])
    elif kind == "lasso":
        b.addGrid(est.regParam, list((grid or {}).get("alpha", K.LASSO_ALPHAS)))
    elif kind == "random_forest":
        g = grid or K.RF_GRID
        b.addGrid(est.numTrees, g["n_estimators"])
        b.addGrid(est.maxDepth, [min(d or 30, 30) for d in g["max_depth"]])
        b.addGrid(est.minInstancesPerNode, g["min_samples_leaf"])
    elif kind == "gradient_boosting":
        g = grid or K.GB_GRID
        b.addGrid(est.maxIter, g["n_estimators"])
        b.addGrid(est.stepSize, g["learning_rate"])
        b.addGrid(est.maxDepth, g["max_depth"])
        b.addGrid(est.subsamplingRate, g["subsample"])
    else:
        raise ValueError(f"no grid for model type: {kind}")
    return b.build()


def grid_search(train: DataFrame, kind: str, label: str, features: list[str], key: str,
                grid: dict | None = None, folds: int = 5, parallelism: int = 4):
    """M9: k-fold CV on R^2 with folds from the key hash.  As in the reference,
    preprocessing is fitted once on the training rows and the folds search the
    estimator only; the best parameters are refit on all training rows.  Ridge and lasso
    take all folds and penalties from one scan; trees train one model per group of
    nested grid points (``trees``).
    Returns (PipelineModel of preprocessing + best model, feature names, avg metrics in the
    order of ``param_grid``)."""
    sigma, n = label_std_pop(train, label)
    stages, names = FE.feature_stages(train, features)
    prep = Pipeline(stages=stages).fit(train)
    feats = FE.fold_column(prep.transform(train).select("features", label, key), key, folds)
    if kind in ("ridge", "lasso") and len(names) <= LI.MAX_FEATURES:
        alphas = list((grid or {}).get("alpha", K.RIDGE_ALPHAS if kind == "ridge" else K.LASSO_ALPHAS))
        parts = LI.moments(feats, label, "fold", p=len(names))
        metrics = LI.search(parts, kind, alphas)
        best = alphas[max(range(len(alphas)), key=metrics.__getitem__)]
        fitted = LI.spark_model(LI.solve(LI.total(parts), kind, best))
        return PipelineModel(stages=list(prep.stages) + [fitted]), names, metrics
    est = make_estimator(kind, label, sigma, n)
    grid_maps = param_grid(est, kind, sigma, n, grid)
    feats = _frozen(feats)
    if kind in ("random_forest", "gradient_boosting"):
        metrics = TR.nested_search(feats, est, grid_maps, label, key, "fold", folds, parallelism)
        best_map = grid_maps[max(range(len(grid_maps)), key=metrics.__getitem__)]
        best = TR.fit_forest(est, feats, best_map) if kind == "random_forest" else est.fit(feats, best_map)
        return PipelineModel(stages=list(prep.stages) + [best]), names, metrics
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid_maps,
                        evaluator=RegressionEvaluator(labelCol=label, metricName="r2"),
                        foldCol="fold", numFolds=folds, parallelism=parallelism, seed=K.SPLIT_SEED)
    cvm = cv.fit(feats)
    model = PipelineModel(stages=list(prep.stages) + [cvm.bestModel])
    return model, names, list(cvm.avgMetrics)


# --- M12 / M13: training families ------------------------------------------------------------------------

def _fit(feats: DataFrame, kind: str, label: str, names: list[str], sums, **params):
    """The last stage of a model on prepared rows; ``sums`` gives their moments (linear kinds)."""
    if kind in LI.KINDS and len(names) <= LI.MAX_FEATURES:
        return LI.spark_model(LI.solve(LI.total(sums()), kind, **{k: v for k, v in params.items() if k in ("alpha", "l1_ratio")}))
    sigma, n = label_std_pop(feats, label)
    est = make_estimator(kind, label, sigma, n, **params)
    return TR.fit_forest(est, feats) if kind == "random_forest" else est.fit(feats)


def train_model(train: DataFrame, kind: str, label: str, features: list[str], **params):
    stages, names = FE.feature_stages(train, features)
    prep = Pipeline(stages=stages).fit(train)
    feats = prep.transform(train)
    return PipelineModel(stages=list(prep.stages) + [_fit(feats, kind, label, names, lambda: LI.moments(feats, label, p=len(names)), **params)]), names


def evaluate(model, test: DataFrame, label: str, name: str, log_target: bool = False) -> DataFrame:
    """One metrics row for ``model`` on ``test``."""
    pred = model.transform(test)
    return regression_metrics(pred, label, "prediction", exp_back=log_target).withColumn("model", F.lit(name))


def train_family(df: DataFrame, key: str, label: str, features: list[str], kinds: list[str],
                 log_target: bool = False, params: dict | None = None):
    """M12 (family A) / M13 (family B): split, fit each model, evaluate on the test rows.
    Returns ({name: PipelineModel}, metrics DataFrame, feature names)."""
    data = df.withColumn("__label", F.log1p(F.col(label)) if log_target else F.col(label).cast("double"))
    flagged = _frozen(FE.split_flag(data, key))
    train = flagged.where(~F.col("is_test")).drop("is_test")
    test = flagged.where(F.col("is_test")).drop("is_test")
    models, metrics = {}, None
    # preprocessing statistics and the linear models' sums depend on the training rows only:
    # they are gathered once
    stages, names = FE.feature_stages(train, features)
    prep = Pipeline(stages=stages).fit(train)
    feats = prep.transform(train).select("features", "__label")
    grown = [kind for kind in kinds if kind not in LI.KINDS]
    if grown:
        feats.persist()          # every run of a forest and boosting read it; in place, so draws stay the same
    sums = functools.cache(lambda: LI.moments(feats, "__label", p=len(names)))

    def last(kind: str):
        return _fit(feats, kind, "__label", names, sums, **(params or {}).get(kind, {}))
    with ThreadPoolExecutor(max(1, len(grown))) as pool:     # ensembles side by side: each waits for its small stages
        jobs = {kind: pool.submit(last, kind) for kind in grown}
        fitted = {kind: jobs[kind].result() if kind in jobs else last(kind) for kind in sorted(kinds, key=grown.__contains__)}
    feats.unpersist()
    for kind in kinds:
        models[kind] = PipelineModel(stages=list(prep.stages) + [fitted[kind]])
        met = evaluate(models[kind], test, "__label", kind, log_target)
        metrics = met if metrics is None else metrics.unionByName(met)
    return models, metrics, names


def feature_importance(model: PipelineModel, names: list[str]) -> DataFrame | None:
    """Importances (trees, from their nodes) or absolute coefficients (linear) with names, sorted."""
    spark = SparkSession.getActiveSession()
    last = model.stages[-1]
    if hasattr(type(last), "featureImportances"):         # asked of the class: a grown forest is not loaded for it
        return TR.importances(last, names)
    if not hasattr(last, "coefficients"):
        return None
    rows = list(zip(names, [abs(float(v)) for v in last.coefficients.toArray()]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# --- M14 / M15 / M16 / M17: scoring -------------------------------------------------------------------------------

def score(model: PipelineModel, specs: DataFrame, log_target: bool = False, out: str = "predicted_price") -> DataFrame:
    """Batch scoring; family B predictions are expm1-ed back to dollars."""
    pred = model.transform(specs)
    p = F.expm1("prediction") if log_target else F.col("prediction")
    keep = [c for c in specs.columns]
    return pred.select(*keep, p.alias(out))


def unusable(model: PipelineModel, specs: DataFrame) -> Column:
    """Why a row cannot be priced, else null: a text where the model needs a number, or a
    number that is not finite.  Missing values are filled and unknown categories count for
    nothing, as the preprocessing has it."""
    reasons = []
    for c, kind in FE.inputs(model.stages[0]).items():
        if kind == "number" and c in specs.columns:
            raw = F.col(f"`{c}`")
            value = raw.try_cast("double")
            reasons.append(F.when(raw.isNotNull() & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))), F.lit(f"{c} is not a number")))
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def compare_models(models: dict, specs: DataFrame, key: str, log_target: bool = False,
                   warnings: str | None = None) -> DataFrame:
    """Long table (key, model, predicted_price, n_warnings, message) from one scan of the
    specs: the models' transforms are chained, each keeping its prediction alone.  A row
    that a model cannot price has a null price and the reason, and so has every row for a
    model that lacks an input; the others keep theirs.  Linear models count the two
    standing warnings.  ``warnings`` names a column with the spec's own count."""
    wide, rows = specs, []
    for i, (name, m) in enumerate(models.items()):
        linear = any(w in name for w in LINEAR_NAMES)
        price, message = F.lit(None).cast("double"), F.lit(None).cast("string")
        needed = FE.inputs(m.stages[0])
        missing = [c for c in needed if c not in specs.columns]
        if missing:
            message = F.lit(f"Prediction failed: no column {', '.join(missing)}")
        else:
            # rows that would end the job go through with the value missing
            finite = {c: F.when(F.abs(v := F.col(f"`{c}`").try_cast("double")) < float("inf"), v) for c, k in needed.items() if k == "number"}
            reason = unusable(m, specs)
            guarded = wide.withColumn(f"__m{i}", reason).withColumns({f"__was_{c}": F.col(f"`{c}`") for c in finite}).withColumns(finite)
            p = F.expm1("prediction") if log_target else F.col("prediction")
            back = [F.col(f"__was_{c}").alias(c) if c in finite else F.col(f"`{c}`") for c in wide.columns]
            wide = m.transform(guarded).select(*back, f"__m{i}", p.alias(f"__p{i}"))
            message = F.when(F.col(f"__m{i}").isNotNull(), F.concat(F.lit("Prediction failed: "), F.col(f"__m{i}")))
            usable = F.col(f"__m{i}").isNull() & ~F.isnan(f"__p{i}")
            price = F.when(usable, F.col(f"__p{i}"))
        n = F.lit(2 if linear else 0) + (F.coalesce(F.col(warnings), F.lit(0)) if warnings else F.lit(0))
        rows.append(F.struct(F.lit(name).alias("model"), price.alias("predicted_price"), n.cast("int").alias("n_warnings"), message.alias("message")))
    return wide.select(key, F.inline(F.array(*rows)))


def with_rule_fallback(scored: DataFrame, price: str = "predicted_price", **rule_cols) -> DataFrame:
    """The rule price where no model price exists, with its provenance."""
    ruled = rule_price(scored, out="__rule", **rule_cols)
    ok = F.col(price).isNotNull() & ~F.isnan(price)
    return (ruled.withColumn("price_source", F.when(ok, F.lit("model")).otherwise(F.lit("rule")))
                 .withColumn("final_price", F.when(ok, F.col(price)).otherwise(F.col("__rule")))
                 .drop("__rule"))


def residuals(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Actual vs predicted with the identity-line bounds."""
    b = pred.agg(F.least(F.min(label), F.min(prediction)).alias("line_min"),
                 F.greatest(F.max(label), F.max(prediction)).alias("line_max"))
    rows = pred.select(F.col(label).alias("actual"), F.col(prediction).alias("predicted"),
                       (F.col(label) - F.col(prediction)).alias("residual"))
    return rows.crossJoin(F.broadcast(b))  # one row of bounds


def rank_models(metrics: DataFrame, by: str = "r2") -> DataFrame:
    """The models of a metrics table with their rank, best first (ties by name)."""
    order = F.desc(by) if by == "r2" else F.asc(by)
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(order, "model")))  # one row per model


# --- S12 / S13: persistence and registry -----------------------------------------------------------------------------

def save_models(models: dict, metrics: DataFrame, base: str, family: str) -> DataFrame:
    """S12 + S13: each pipeline under ``base/family/name``; returns the registry rows
    (model, family, path, metrics) -- preprocessing is inside each pipeline."""
    paths = {}
    for name, m in models.items():
        path = f"{base.rstrip('/')}/{family}/{name}"
        m.write().overwrite().save(path)
        paths[name] = path
    spark = metrics.sparkSession
    p = spark.createDataFrame(list(paths.items()), "model string, path string")
    return metrics.join(p, "model").withColumn("family", F.lit(family))


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def display_name(name: str) -> str:
    return name.replace("_", " ").title()
