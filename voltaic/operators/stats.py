"""Aggregations.

Algebraic statistics (count, mean, std, min, max, corr, sums) are single
partial+final aggregates.  Order statistics go through ``exact_quantiles`` so a
hot group never lands whole in one task.  Results are tidy DataFrames.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .quantiles import exact_quantiles, join_groups, narrow_values


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return left.join(right, keys, "inner")
    return left.crossJoin(right)  # without keys both are aggregates of one row, or the right one is


def _join_values(values: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return join_groups(values, groups, keys) if keys else _join_on(values, groups, keys)


def _non_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def five_number(df: DataFrame, value: str, keys: list[str] | None = None, prefix: str = "") -> DataFrame:
    """A1: count, mean, median, min, max, sample std of ``value`` per group."""
    keys = list(keys or [])
    vals = narrow_values(df, value, keys)
    v = F.col("__v")
    algebraic = vals.groupBy(*keys).agg(
        F.count(v).alias(prefix + "n"),
        F.avg(v).alias(prefix + "mean"),
        F.min(v).alias(prefix + "min"),
        F.max(v).alias(prefix + "max"),
        F.stddev_samp(v).alias(prefix + "std"))
    med = exact_quantiles(vals, "__v", [0.5], keys, [prefix + "median"], narrowed=True)
    if keys:
        return algebraic.join(med, keys, "left")
    return _join_on(algebraic, med, [])


def min_max_mean_median(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """A2: the cleaning report (no std)."""
    return five_number(df, value, keys).drop("std")


def category_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """A3: rows per non-null category, most frequent first (ties by name)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
              .orderBy(F.desc(name), F.asc(col)))


def grouped_means(df: DataFrame, key: str, cols: list[str], suffix: str = "") -> DataFrame:
    """A4: mean of each column per key, ordered by key."""
    return (df.groupBy(key).agg(*[F.avg(c).alias(c + suffix) for c in cols]).orderBy(key))


def adjustment_stats(df: DataFrame, qty: str = "quantity_int", original: str = "original_unit_price_usd",
                     unit: str = "unit_price_usd") -> DataFrame:
    """A5: among lots (qty > 1), how many and how much the unit price dropped."""
    d = F.col(original) - F.col(unit)
    return df.where(F.col(qty) > 1).agg(F.count(F.lit(1)).alias("adjusted_rows"),
                                        F.avg(d).alias("mean_reduction"),
                                        F.max(d).alias("max_reduction"))


def null_profile(df: DataFrame) -> DataFrame:
    """One pass, null count and type per column, as rows."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype")) for c in df.columns])).alias("r"))
    return stacked.select("r.column", "r.null_count", "r.dtype")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, 25/50/75 %, max of each numeric column
    (exact, linearly interpolated percentiles), one row per column."""
    cols = cols or numeric_columns(df)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("r")
    ).select("r.column", "r.value")
    alg = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                     F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                     F.max("value").alias("max"))
    qs = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"], ["p25", "p50", "p75"])
    return alg.join(qs, "column", "left")


def correlations(df: DataFrame, target: str, numeric: list[str] | None = None,
                 categorical: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every numeric column and every 0/1 category dummy
    with ``target``.  Numeric columns take one aggregate.  A dummy's correlation follows
    from its level's count and target sum, so all dummies take one (column, level)
    aggregate, however many levels there are; none is collected."""
    numeric = [c for c in (numeric if numeric is not None else numeric_columns(df)) if c != target]
    categorical = categorical or []
    y = F.col(target).cast("double")
    agg = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(f"c{i}") for i, c in enumerate(numeric)], F.count(y).alias("n"),
                 F.avg(y).alias("my"), F.var_pop(y).alias("vy"))
    agg = materialize(agg, "correlations")
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("correlation")) for i, c in enumerate(numeric)])
    out = agg.select(F.inline(rows)) if numeric else None
    if categorical:
        long = df.where(y.isNotNull()).select(y.alias("y"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in categorical])).alias("r"))
        level = (long.select("y", "r.column", "r.level").where(F.col("level").isNotNull())
                 .groupBy("column", "level").agg(F.count(F.lit(1)).alias("nl"), F.avg("y").alias("yl")))
        share = F.col("nl") / F.col("n")
        corr = share * (F.col("yl") - F.col("my")) / F.sqrt(F.nullif(share * (1 - share) * F.col("vy"), F.lit(0.0)))
        dummies = level.crossJoin(F.broadcast(agg.select("n", "my", "vy"))).select(  # one row of totals
            F.concat_ws("_", "column", "level").alias("feature"), corr.alias("correlation"))
        out = dummies if out is None else out.unionByName(dummies)
    return out.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A9."""
    return df.select(col).distinct()


def quality_counters(df: DataFrame, conditions: dict) -> DataFrame:
    """Named conditional counts in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_if(cond).alias(name) for name, cond in conditions.items()])


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       keys: list[str] | None = None, exp_back: bool = False) -> DataFrame:
    """RMSE, MAE, R^2, MAPE (% over non-zero labels) per group, one pass.
    ``exp_back`` applies expm1 to both columns first (log-target models)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    if exp_back:
        y, p = F.expm1(y), F.expm1(p)
    e = y - p
    keys = list(keys or [])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop(y))).alias("r2"),
        (F.avg(F.when(y != 0, F.abs(e / y))) * 100).alias("mape"))


def ensemble_mean(long_preds: DataFrame, key: str = "spec_id", value: str = "predicted_price") -> DataFrame:
    """Mean over models of each spec's predictions."""
    return long_preds.groupBy(key).agg(F.avg(value).alias("ensemble_price"),
                                       F.count(value).alias("n_models"))


def box_stats(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers (extreme values inside the fences)
    and outlier count per group -- the numbers a box plot draws."""
    keys = list(keys or [])
    base = narrow_values(df, value, keys)
    qs = exact_quantiles(base, "__v", [0.25, 0.5, 0.75], keys, ["q1", "median", "q3"], narrowed=True)
    qs = (qs.withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
            .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))
    v = F.col("__v")
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    fences = qs.select(*keys, "lower_fence", "upper_fence")
    agg = _join_values(base, fences, keys).groupBy(*keys).agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("n"))
    return _join_on(qs, agg, keys)


def histogram(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Automatic bins per group (the larger bin count of Sturges and
    Freedman-Diaconis, as numpy's 'auto'), then counts per bin.  Two passes."""
    keys = list(keys or [])
    base = narrow_values(df, value, keys)          # one pass over the (expensive) input
    q = exact_quantiles(base, "__v", [0.25, 0.75], keys, ["q1", "q3"], narrowed=True)
    alg = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"),
                                  F.max("__v").alias("hi"))
    base = base.withColumnRenamed("__v", value)
    spec = _join_on(alg, q, keys)
    rng = F.col("hi") - F.col("lo")
    sturges = rng / (F.log2(F.col("n")) + 1)
    fd = 2.0 * (F.col("q3") - F.col("q1")) * F.pow(F.col("n"), F.lit(-1.0 / 3.0))
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    spec = (spec.withColumn("bins", F.when(rng > 0, F.greatest(F.ceil(rng / width), F.lit(1))).otherwise(F.lit(1))
                            .cast("int"))
                .select(*keys, "lo", "hi", "bins"))
    joined = _join_values(base, spec, keys)
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")),
                       F.col("bins") - 1)).otherwise(F.lit(0)).cast("int")
    counts = joined.withColumn("bin", b).groupBy(*keys, "bin", "lo", "hi", "bins").agg(
        F.count(F.lit(1)).alias("count"))
    w = (F.col("hi") - F.col("lo")) / F.col("bins")
    return counts.select(*keys, "bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"),
                         (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"), "count")


#: Bandwidths within which a value counts for a grid point.
REACH = 8.0


def density_curve(df: DataFrame, value: str, key: str, points: int = 200, bins: int | None = None) -> DataFrame:
    """Gaussian kernel density per group on a ``points`` grid over the group's
    range, Scott bandwidth (sample std * n^(-1/5)).  Equal values are merged into one
    weighted value; each then adds its kernel to the grid points of its own group within
    ``REACH`` bandwidths, summed map-side first, so a hot group is no hot join key.  What lies
    beyond adds at most exp(-REACH^2 / 2), 1.3e-14, of a value's weight to a point.  With
    ``bins`` the values are snapped to that many bins of the group's range first."""
    v, k = F.col(value).cast("double"), F.col(key)
    weighted = (df.where(v.isNotNull() & k.isNotNull()).groupBy(k.alias(key), v.alias("__x")).agg(F.count(F.lit(1)).alias("__w")))
    weighted = materialize(weighted, "density_values")
    n, mean = F.sum("__w"), F.sum(F.col("__w") * F.col("__x")) / F.sum("__w")
    st = weighted.groupBy(key).agg(n.alias("n"), mean.alias("__m"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    centred = weighted.join(st.select(key, "__m"), key).groupBy(key).agg(
        F.sum(F.col("__w") * F.pow(F.col("__x") - F.col("__m"), F.lit(2.0))).alias("__ss"))
    st = st.join(centred, key).withColumn("bw", F.sqrt(F.col("__ss") / F.nullif(F.col("n") - 1, F.lit(0))) * F.pow(F.col("n"), F.lit(-0.2)))
    j = weighted.join(st.select(key, "n", "lo", "hi", "bw"), key)
    step = F.col("hi") - F.col("lo")
    if bins:
        j = j.withColumn("__x", F.when(step > 0, F.col("lo") + (F.floor((F.col("__x") - F.col("lo")) / step * bins) + 0.5) * step / bins)
                         .otherwise(F.col("__x")))
    g = F.col("lo") + F.col("i") * step / (points - 1)
    every = F.sequence(F.lit(0), F.lit(points - 1))
    per = (points - 1) / step
    first = F.greatest(F.ceil((F.col("__x") - REACH * F.col("bw") - F.col("lo")) * per), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("__x") + REACH * F.col("bw") - F.col("lo")) * per), F.lit(points - 1)).cast("int")
    near = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    spread = j.withColumn("i", F.explode(F.when((F.col("bw") > 0) & (step > 0), near).otherwise(every))).withColumn("__at", g)
    z = (F.col("__at") - F.col("__x")) / F.col("bw")
    sums = spread.groupBy(key, "i").agg(F.sum(F.col("__w") * F.exp(-0.5 * z * z)).alias("__s"))
    grid = st.select(key, "n", "lo", "hi", "bw", F.explode(every).alias("i")).withColumn("__at", g)   # points rows a group
    total = F.when(F.col("bw") > 0, F.coalesce("__s", F.lit(0.0))).otherwise(F.col("__s"))
    return grid.join(sums, [key, "i"], "left").select(
        key, "i", F.col("__at").alias("x"), (total / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"))


def quadratic_trend(df: DataFrame, x: str, y: str, points: int = 100) -> tuple[DataFrame, DataFrame]:
    """Least-squares y = a x^2 + b x + c.  One aggregate gathers the power
    sums on centred/scaled x (numerically stable); the 3x3 normal equations are
    solved in SQL by Cramer's rule.  Returns (coefficients, fitted curve)."""
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = base.agg(F.avg(x).alias("mx"), F.stddev_pop(x).alias("sx"))
    t = _join_on(base, m, []).withColumn("t", (F.col(x) - F.col("mx")) / F.col("sx"))
    tt, yy = F.col("t"), F.col(y)
    s = t.groupBy("mx", "sx").agg(
        F.count(F.lit(1)).alias("s0"), F.sum(tt).alias("s1"), F.sum(tt * tt).alias("s2"),
        F.sum(tt * tt * tt).alias("s3"), F.sum(tt * tt * tt * tt).alias("s4"),
        F.sum(yy).alias("y0"), F.sum(tt * yy).alias("y1"), F.sum(tt * tt * yy).alias("y2"))
    c = {k: F.col(k) for k in ["s0", "s1", "s2", "s3", "s4", "y0", "y1", "y2"]}

    def det3(a, b, cc, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + cc * (d * h - e * g)
    # matrix rows: [s4 s3 s2 | y2], [s3 s2 s1 | y1], [s2 s1 s0 | y0] for (A, B, C) in t
    D = det3(c["s4"], c["s3"], c["s2"], c["s3"], c["s2"], c["s1"], c["s2"], c["s1"], c["s0"])
    A = det3(c["y2"], c["s3"], c["s2"], c["y1"], c["s2"], c["s1"], c["y0"], c["s1"], c["s0"]) / D
    B = det3(c["s4"], c["y2"], c["s2"], c["s3"], c["y1"], c["s1"], c["s2"], c["y0"], c["s0"]) / D
    C = det3(c["s4"], c["s3"], c["y2"], c["s3"], c["s2"], c["y1"], c["s2"], c["s1"], c["y0"]) / D
    mx, sx = F.col("mx"), F.col("sx")
    # back to x: t = (x - mx)/sx
    coef = s.select(
        (A / (sx * sx)).alias("a"),
        (B / sx - 2 * A * mx / (sx * sx)).alias("b"),
        (A * mx * mx / (sx * sx) - B * mx / sx + C).alias("c"))
    rng = base.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    curve = (_join_on(rng, coef, [])
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
             .withColumn("x", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1))
             .select("i", "x", (F.col("a") * F.col("x") * F.col("x") + F.col("b") * F.col("x") + F.col("c"))
                     .alias("fitted")))
    return coef, curve


def best_by(df: DataFrame, name: str, metric: str, highest: bool = True) -> DataFrame:
    """The name with the best metric (ties: smallest name), as one aggregate."""
    key = -F.col(metric) if highest else F.col(metric)
    return df.where(F.col(metric).isNotNull()).agg(
        F.min_by(F.col(name), F.struct(key, F.col(name))).alias("best"),
        (F.max(metric) if highest else F.min(metric)).alias(metric))
