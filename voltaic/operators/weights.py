"""Component weight model (Q1-Q5) over a table of specifications.

Every step is a column expression; a spec never leaves its row, so the job is
one narrow stage at any table size.  Component constants come from
``constants.COMPONENTS`` and are folded into literals.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import compute_once

COMPONENTS = K.COMPONENT_NAMES


def phase_kind(phase: Column) -> Column:
    """Q5: 'single' / 'three'; null or empty -> 'three'; unknown -> null (reject)."""
    direct = None
    for spelling, kind in K.PHASE_SPELLINGS.items():
        direct = (F.when(phase == spelling, F.lit(kind)) if direct is None
                  else direct.when(phase == spelling, F.lit(kind)))
    low = F.lower(phase)
    return (F.when(phase.isNull() | (phase == ""), F.lit("three"))
            .otherwise(F.coalesce(direct, F.when(low.contains("single"), F.lit("single"))
                                  .when(low.contains("three"), F.lit("three")))))


def _density_target(p: Column) -> Column:
    expr = None
    for bound, target in K.DENSITY_TARGETS:
        if bound is None:
            expr = expr.otherwise(F.lit(target))
        else:
            expr = (F.when(p <= bound, F.lit(target)) if expr is None
                    else expr.when(p <= bound, F.lit(target)))
    return expr


def estimate_weights(df: DataFrame, rating: str = "power_rating", v1: str = "primary_voltage",
                     v2: str = "secondary_voltage", phase: str = "phase",
                     jitter: dict | None = None, prefix: str = "") -> DataFrame:
    """Q1: ``<component>_weight`` (kg, rounded half-even) for the five components
    plus ``total_weight``.  ``jitter`` maps a component to a multiplier column
    (the reference draws U(0.95, 1.05); default 1).  Rows with a non-positive
    rating / voltage or an unknown phase get null weights (see C12)."""
    p, a, b = F.col(rating).cast("double"), F.col(v1).cast("double"), F.col(v2).cast("double")
    kind = phase_kind(F.col(phase))
    # Stage boundaries (compute_once): each stage references the previous one's
    # columns several times; collapsing them would copy the pow/log10 subtrees
    # into every reference and grow the expression multiplicatively.
    out = compute_once(df, {
        "__p": p,
        "__valid": (p > 0) & (a > 0) & (b > 0) & kind.isNotNull(),
        "__vf": F.log10((a + 0.1) / (b + 0.1) + 1),
        "__large": F.when(p >= K.LARGE_THRESHOLD_KVA, F.sqrt(F.log10(p / K.LARGE_THRESHOLD_KVA + 1))),
        "__ultra": F.when(p > K.ULTRA_THRESHOLD_KVA,
                          1 - F.least(F.lit(K.ULTRA_MAX_REDUCTION),
                                      K.ULTRA_MAX_REDUCTION * F.log10(p / K.ULTRA_THRESHOLD_KVA + 1))),
        "__single": kind == "single",
    })
    pc = F.col("__p")
    raw = {}
    for name, base, exp_, large, vadj, single, ultra, _ in K.COMPONENTS:
        w = F.lit(base) * F.pow(pc / 1000.0, F.lit(exp_)) * (1 + vadj * F.col("__vf"))
        w = w * F.when(F.col("__single"), F.lit(single)).otherwise(F.lit(1.0))
        w = w * F.coalesce(1 - (1 - large) * F.col("__large"), F.lit(1.0))
        w = w * F.coalesce(F.col("__ultra") * ultra, F.lit(1.0))
        if jitter and name in jitter:
            w = w * jitter[name]
        raw[f"__w_{name}"] = F.when(F.col("__valid"), F.bround(w, 0))
    out = compute_once(out, raw)
    total = sum((F.col(f"__w_{c}") for c in COMPONENTS), F.lit(0.0))
    # density rebalance for ultra-large units
    target = _density_target(pc)
    density = F.try_divide(pc, total)
    out = compute_once(out, {
        "__fire": (pc > K.ULTRA_THRESHOLD_KVA) & (density < target * K.DENSITY_SLACK),
        "__adj": density / target,
    })
    final = {f"{prefix}{c}_weight": F.when(F.col("__fire"), F.bround(F.col(f"__w_{c}") * F.col("__adj"), 0))
             .otherwise(F.col(f"__w_{c}")) for c in COMPONENTS}
    out = compute_once(out, final)
    out = out.withColumn(f"{prefix}total_weight", sum((F.col(f"{prefix}{c}_weight") for c in COMPONENTS), F.lit(0.0)))
    return out.drop("__p", "__valid", "__vf", "__large", "__ultra", "__single", "__fire", "__adj",
                    *[f"__w_{c}" for c in COMPONENTS])


def weight_ranges(df: DataFrame, rating: str = "power_rating", phase: str = "phase") -> DataFrame:
    """Q2: reference weights at 10.5 / 0.4 kV, then x0.85 and x1.15, rounded."""
    ref = estimate_weights(df.withColumn("__v1", F.lit(10.5)).withColumn("__v2", F.lit(0.4)),
                           rating, "__v1", "__v2", phase, prefix="__ref_")
    cols = {}
    for c in COMPONENTS:
        w = F.col(f"__ref_{c}_weight")
        cols[f"{c}_weight_min"] = F.bround(w * 0.85, 0)
        cols[f"{c}_weight_max"] = F.bround(w * 1.15, 0)
    return ref.withColumns(cols).drop("__v1", "__v2", *[f"__ref_{c}_weight" for c in COMPONENTS],
                                      "__ref_total_weight")


def power_density(df: DataFrame, rating: str = "power_rating", total: str = "total_weight",
                  out: str = "power_density") -> DataFrame:
    """Q3: kVA per kg, 0 when the weight is not positive."""
    return df.withColumn(out, F.when(F.col(total) > 0, F.col(rating) / F.col(total)).otherwise(F.lit(0.0)))


def weight_distribution(df: DataFrame, key: str = "spec_id", use_component_sum: bool = False) -> DataFrame:
    """Q4: long form (key, component, weight, percentage); the total is the stated
    total weight, or the sum of components (application variant)."""
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"{c}_weight").cast("double").alias("weight"))
                     for c in COMPONENTS])
    total = (sum((F.col(f"{c}_weight") for c in COMPONENTS), F.lit(0.0)) if use_component_sum
             else F.col("total_weight"))
    long = df.select(key, total.alias("__tot"), F.explode(rows).alias("r"))
    return long.select(key, "r.component", "r.weight",
                       F.when(F.col("__tot") > 0, F.col("r.weight") / F.col("__tot") * 100)
                       .otherwise(F.lit(0.0)).alias("percentage"))
