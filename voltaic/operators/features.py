"""Feature preparation (M1-M7).

Fitting statistics (medians, modes, means, population std) are distributed
aggregates over the training rows; the handful of resulting numbers (one per
column) are frozen into a ``SQLTransformer`` stage so the saved pipeline carries
them and scoring is one projection.
"""

from __future__ import annotations

import math
import re

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import random as R
from .quantiles import exact_quantiles


# --- M1: split ---------------------------------------------------------------------------

def split_flag(df: DataFrame, key: str, test_fraction: float = K.TEST_FRACTION,
               seed: int = K.SPLIT_SEED, out: str = "is_test") -> DataFrame:
    """Stable split: a row is in the test set when the key's hash uniform is below
    ``test_fraction``.  Independent of partitioning and of the other rows."""
    return df.withColumn(out, R.uniform(F.col(key), 1000 + seed) < test_fraction)


def train_test_split(df: DataFrame, key: str, test_fraction: float = K.TEST_FRACTION,
                     seed: int = K.SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    flagged = split_flag(df, key, test_fraction, seed)
    return (flagged.where(~F.col("is_test")).drop("is_test"),
            flagged.where(F.col("is_test")).drop("is_test"))


def split_exact(df: DataFrame, key: str, test_fraction: float = K.TEST_FRACTION,
                seed: int = K.SPLIT_SEED, out: str = "is_test") -> DataFrame:
    """M1 with an exact count: the ceil(``test_fraction`` x n) rows of least (hash uniform,
    key) are the test set (``key`` is unique).  Rows are counted per slice of the uniform;
    only the slice that holds the boundary is sorted, and one cut goes to the driver."""
    u, slices = R.uniform(F.col(key), 1000 + seed), 1 << 16
    counts = df.groupBy(F.floor(u * slices).alias("slice")).agg(F.count(F.lit(1)).alias("c")).orderBy("slice").collect()
    left, at = math.ceil(test_fraction * sum(r["c"] for r in counts)), None
    for row in counts:  # at most 65,536 slices
        if row["c"] >= left:
            at = row["slice"]
            break
        left -= row["c"]
    if at is None or left == 0:
        return df.withColumn(out, F.lit(False))
    cut = (df.where(F.floor(u * slices) == at).select(F.struct(u.alias("u"), F.col(key).cast("bigint").alias("k")).alias("o"))
           .orderBy("o").limit(left).agg(F.max("o").alias("o")).first()["o"])
    return df.withColumn(out, (u < cut["u"]) | ((u == cut["u"]) & (F.col(key) <= cut["k"])))


def fold_column(df: DataFrame, key: str, folds: int = 5, seed: int = K.SPLIT_SEED, out: str = "fold") -> DataFrame:
    """Cross-validation fold from the key hash (for ``CrossValidator(foldCol=...)``)."""
    return df.withColumn(out, F.floor(R.uniform(F.col(key), 2000 + seed) * folds).cast("int"))


# --- M2: roles ----------------------------------------------------------------------------

def column_roles(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """Strings and booleans are categorical; numbers are numeric."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name not in features:
            continue
        if isinstance(f.dataType, (T.StringType, T.BooleanType)):
            cat.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            num.append(f.name)
    order = {c: i for i, c in enumerate(features)}
    return sorted(num, key=order.get), sorted(cat, key=order.get)


# --- M3 / M4 / M5: fitted statistics ----------------------------------------------------------

def fit_numeric_stats(train: DataFrame, cols: list[str]) -> dict:
    """Exact median (imputation) and mean / population std (scaling) per column,
    the std taken after imputation as the reference's pipeline does."""
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("r")
    ).select("r.column", "r.value")
    med = {r["column"]: r["median"] for r in
           exact_quantiles(long, "value", [0.5], ["column"], ["median"]).collect()}
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med.get(c) or 0.0)).alias(c) for c in cols])
    row = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: {"median": med.get(c), "mean": row[f"m_{c}"], "std": row[f"s_{c}"]} for c in cols}


def fit_modes(train: DataFrame, cols: list[str]) -> dict:
    """Most frequent value per categorical column (ties: smallest): one aggregate over a
    long (column, value) projection, one row per column to the driver."""
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("r")
    ).select("r.column", "r.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    found = {r["column"]: r["mode"] for r in per.collect()}
    return {c: found.get(c) for c in cols}


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(float(v))


def prep_transformer(num_stats: dict, modes: dict, scale: bool = True) -> SQLTransformer:
    """M3 + M4 + M5 frozen into one projection: numeric -> median fill ->
    (x - mean) / population std; categorical -> string, mode fill."""
    parts = ["*"]
    for c, s in num_stats.items():
        filled = f"coalesce(cast(`{c}` as double), {_sql_lit(s['median'] or 0.0)})"
        if scale:
            std = s["std"] or 0.0
            expr = f"({filled} - {_sql_lit(s['mean'])}) / {_sql_lit(std if std > 0 else 1.0)}"
        else:
            expr = filled
        parts.append(f"{expr} AS `{c}__num`")
    for c, m in modes.items():
        parts.append(f"coalesce(cast(`{c}` as string), {_sql_lit(m)}) AS `{c}__cat`")
    return SQLTransformer(statement="SELECT " + ", ".join(parts) + " FROM __THIS__")


def inputs(prep) -> dict[str, str]:
    """The columns a preprocessing stage reads: name -> ``number`` or ``category``."""
    found = re.findall(r"cast\(`((?:[^`]|``)+)` as (double|string)\)", prep.getStatement())
    return {name: "number" if kind == "double" else "category" for name, kind in found}


def feature_stages(train: DataFrame, features: list[str], scale: bool = True) -> tuple[list, list[str]]:
    """M2-M7: the preprocessing stages and the feature names in vector order."""
    num, cat = column_roles(train, features)
    stats = fit_numeric_stats(train, num) if num else {}
    modes = fit_modes(train, cat) if cat else {}
    prep = prep_transformer(stats, modes, scale)
    stages = [prep]
    names = list(num)
    if cat:
        # fitted here, so its levels (alphabetical; filled nulls fall on the mode) name the
        # vector's places and are gathered once
        idx = StringIndexer(inputCols=[f"{c}__cat" for c in cat], outputCols=[f"{c}__idx" for c in cat],
                            handleInvalid="keep", stringOrderType="alphabetAsc").fit(prep.transform(train))
        ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__ohe" for c in cat],
                            dropLast=True, handleInvalid="error")
        stages += [idx, ohe]
        for c, levels in zip(cat, idx.labelsArray):
            names += [f"{c}_{lv}" for lv in levels]
    inputs = [f"{c}__num" for c in num] + [f"{c}__ohe" for c in cat]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages, names


def feature_pipeline(train: DataFrame, features: list[str], estimator=None, scale: bool = True):
    stages, names = feature_stages(train, features, scale)
    return Pipeline(stages=stages + ([estimator] if estimator is not None else [])), names
