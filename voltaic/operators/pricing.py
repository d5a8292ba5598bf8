"""Rule price (Q7), price composition (Q8), labelled spec price (Q9) and the
lookup joins they use (J1).  All column expressions; lookups on fixed tiny
dimensions are literal maps folded into the projection (no join at all)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def lookup(col: Column, pairs: list[tuple], default=None) -> Column:
    """Equi lookup against a fixed list, as an ordered CASE (folds into codegen)."""
    expr = None
    for k, v in pairs:
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def rule_price(df: DataFrame, rating: str = "power_rating_kva", v1: str = "primary_voltage_kv",
               v2: str = "secondary_voltage_kv", cooling: str | None = "cooling_type",
               phase: str | None = "phase", out: str = "rule_price") -> DataFrame:
    """Q7: base by rating band x voltage factor x cooling factor x single-phase factor.
    Missing inputs take the defaults 1000 kVA / 11 kV / 0.433 kV."""
    p = F.coalesce(F.col(rating).cast("double"), F.lit(K.DEFAULT_RATING_KVA))
    a = F.coalesce(F.col(v1).cast("double"), F.lit(K.DEFAULT_PRIMARY_KV))
    b = F.coalesce(F.col(v2).cast("double"), F.lit(K.DEFAULT_SECONDARY_KV))
    base = None
    for bound, fixed, per in K.RULE_PRICE_BANDS:
        val = F.lit(fixed) + p * F.lit(per)
        if bound is None:
            base = base.otherwise(val)
        else:
            base = F.when(p <= bound, val) if base is None else base.when(p <= bound, val)
    ratio = F.when(b > 0, a / b).otherwise(F.lit(1.0))
    vf = (F.lit(1.0) + F.when(a > 33, 0.1 * (a / 33 - 1)).otherwise(F.lit(0.0))
          + F.when(ratio > 10, 0.05 * (ratio / 10 - 1)).otherwise(F.lit(0.0)))
    cf = lookup(F.col(cooling), K.COOLING_PRICE_FACTOR, 1.0) if cooling and cooling in df.columns else F.lit(1.0)
    pf = (F.when(F.col(phase) == "Single-phase", F.lit(K.SINGLE_PHASE_PRICE_FACTOR)).otherwise(F.lit(1.0))
          if phase and phase in df.columns else F.lit(1.0))
    return df.withColumn(out, base * vf * cf * pf)


def price_composition(df: DataFrame, price: str = "predicted_price", material: str = "material_cost",
                      rating: str = "power_rating") -> DataFrame:
    """Q8: labour/overhead/profit share; above 5000 kVA the share is pulled towards
    30 % and the price re-derived from the material cost."""
    pr, m, p = F.col(price), F.col(material), F.col(rating)
    lop_pct = F.try_divide(pr - m, pr) * 100
    large = p > K.LARGE_THRESHOLD_KVA
    target = F.greatest(F.lit(K.LOP_MIN_PCT), lop_pct * (1 - F.log10(p / K.LARGE_THRESHOLD_KVA + 1) * K.LOP_SCALE))
    adj_lop = F.try_divide(m * target, 100 - target)
    return df.withColumns({
        "lop_pct": F.when(large, target).otherwise(lop_pct),
        "lop_amount": F.when(large, adj_lop).otherwise(pr - m),
        "final_price": F.when(large, m + adj_lop).otherwise(pr),
        "material_pct": F.try_divide(m, F.when(large, m + adj_lop).otherwise(pr)) * 100,
    })


def label_price(df: DataFrame, noise: Column | None = None, out: str = "price") -> DataFrame:
    """Q9: the deterministic spec price (+ optional N(0, 0.05) noise column), rounded
    to whole dollars half-even."""
    material = sum((F.col(f"{c}_weight") * F.lit(r) for c, r in K.LABEL_KG_RATES), F.lit(0.0))
    adders = (F.col("efficiency") * K.LABEL_EFFICIENCY_RATE
              + lookup(F.col("cooling_type"), K.LABEL_COOLING_ADDER, 0.0)
              + F.when(F.col("tap_changer"), F.lit(K.LABEL_TAP_ADDER)).otherwise(F.lit(0.0))
              + F.when(F.col("phase") == "Three-phase", F.lit(K.LABEL_THREE_PHASE_ADDER)).otherwise(F.lit(0.0))
              + F.when(F.col("insulation_type") == "Dry", F.lit(K.LABEL_DRY_ADDER)).otherwise(F.lit(0.0)))
    loc = lookup(F.col("manufacturing_location"), K.LOCATION_FACTORS)
    raw = (F.col("power_rating") * K.LABEL_PER_KVA + material + adders) * loc
    if noise is not None:
        raw = raw * (1 + noise)
    return df.withColumn(out, F.bround(raw, 0))
