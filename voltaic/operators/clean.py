"""Cleaning and filter operators (C1-C13) plus the listing cleaning plan.

Every operator is DataFrame -> DataFrame and narrow (no shuffle): row filters and
projections that Catalyst fuses into the scan stage.  Counters for "rows removed
by each step" are one conditional aggregate, never one job per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import text as X


def drop_sparse_rows(df: DataFrame, thresh: int = 2, subset: list[str] | None = None) -> DataFrame:
    """Keep rows with at least ``thresh`` non-null columns (of ``subset``)."""
    return df.na.drop(thresh=thresh, subset=subset)


def clean_price(df: DataFrame, col: str = "unit_price", out: str = "unit_price_usd") -> DataFrame:
    """Text price -> double. An already-numeric column is kept as is."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.NumericType):
        return df.withColumn(out, F.col(col).cast("double"))
    return df.withColumn(out, X.parse_price(col))


def clean_quantity(df: DataFrame, col: str = "quantity", out: str = "quantity_int") -> DataFrame:
    """Raw quantity text -> integer count (null / unparsable -> 1)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.NumericType):
        q = F.coalesce(F.when(~F.isnan(F.col(col).cast("double")), F.col(col).cast("bigint")),
                       F.lit(1).cast("bigint"))
        return df.withColumn(out, q)
    return df.withColumn(out, X.parse_quantity(col))


def lot_to_unit_price(df: DataFrame, price: str = "unit_price_usd", qty: str = "quantity_int") -> DataFrame:
    """C4: a lot price divided by its quantity; the original kept beside it."""
    p, q = F.col(price), F.col(qty)
    return (df.withColumn("original_unit_price_usd", p)
              .withColumn(price, F.when((q > 1) & p.isNotNull(), p / q).otherwise(p)))


def require_fields(df: DataFrame, cols=("unit_price_usd", "power_rating_kva")) -> DataFrame:
    """Drop rows where any required field is null."""
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.filter(cond)


def min_rating(df: DataFrame, min_kva: float = K.MIN_POWER_RATING, col: str = "power_rating_kva") -> DataFrame:
    """Rating present and at least ``min_kva``."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) >= F.lit(float(min_kva))))


def min_rating_report(df: DataFrame, min_kva: float = K.MIN_POWER_RATING,
                      col: str = "power_rating_kva") -> DataFrame:
    """C6 counters in one pass: rows in, missing rating, below minimum, kept."""
    r = F.col(col)
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(r.isNull()).alias("missing_rating"),
        F.count_if(r.isNotNull() & (r < F.lit(float(min_kva)))).alias("below_minimum"),
        F.count_if(r >= F.lit(float(min_kva))).alias("rows_kept"),
    )


def flag_equipment(df: DataFrame, col: str = "description", whole_word: bool = False,
                   out: str = "is_transformer") -> DataFrame:
    """C7 as a flag column (the strict keyword predicate)."""
    return df.withColumn(out, X.is_equipment(col, whole_word))


def keep_equipment(df: DataFrame, col: str = "description", whole_word: bool = False) -> DataFrame:
    return df.filter(X.is_equipment(col, whole_word))


def keep_mentions_equipment(df: DataFrame, col: str = "description") -> DataFrame:
    """Loose scraper predicate."""
    return df.filter(X.is_equipment_loose(col))


def positive_price(df: DataFrame, col: str = "unit_price_usd") -> DataFrame:
    """Drop null and non-positive prices."""
    return df.filter(F.col(col) > 0)


def positive_price_report(df: DataFrame, col: str = "unit_price_usd") -> DataFrame:
    p = F.col(col)
    return df.agg(F.count(F.lit(1)).alias("rows_in"),
                  F.count_if(p.isNull()).alias("null_price"),
                  F.count_if(p <= 0).alias("non_positive_price"),
                  F.count_if(p > 0).alias("rows_kept"))


# --- C10 / C11 / C12 / C13: spec validation --------------------------------------

def _msg(cond: Column, text: Column | str) -> Column:
    return F.when(cond, text if isinstance(text, Column) else F.lit(text))


def validate_specs(df: DataFrame) -> DataFrame:
    """Fill missing model inputs with defaults and parse text numbers; each
    change adds a message to ``warnings`` (array<string>)."""
    defaults = [("power_rating_kva", K.DEFAULT_RATING_KVA, "KVA"),
                ("primary_voltage_kv", K.DEFAULT_PRIMARY_KV, "kV"),
                ("secondary_voltage_kv", K.DEFAULT_SECONDARY_KV, "kV")]
    out = df
    msgs = []
    for name, dflt, unit in defaults:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
        raw = F.col(name)
        is_text = isinstance(out.schema[name].dataType, T.StringType)
        parsed = X.spec_number(raw) if is_text else raw.cast("double")
        msgs.append(_msg(raw.isNull(), f"Missing {name}: using default {dflt} {unit}"))
        if is_text:
            msgs.append(_msg(raw.isNotNull() & parsed.isNull(),
                             F.concat(F.lit(f"Invalid {name} value '"), raw,
                                      F.lit(f"': using default {dflt} {unit}"))))
            msgs.append(_msg(raw.isNotNull() & parsed.isNotNull(),
                             F.concat(F.lit(f"Converted {name} from '"), raw, F.lit("' to "),
                                      parsed.cast("string"))))
        out = out.withColumn(name + "__v", F.coalesce(parsed, F.lit(float(dflt))))
    fills = {}
    for name, dflt in [("phase", K.DEFAULT_PHASE), ("type", K.DEFAULT_TYPE)]:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
        msgs.append(_msg(F.col(name).isNull(), f"Missing {name}: using default {dflt}"))
        fills[name] = F.coalesce(F.col(name), F.lit(dflt))
    # messages first (they test the raw values), then the filled values
    out = out.withColumn("warnings", F.array_compact(F.array(*msgs))).withColumns(fills)
    for name, _, _ in defaults:
        out = out.drop(name).withColumnRenamed(name + "__v", name)
    return out


def strict_spec_check(df: DataFrame, required=("power_rating_kva", "primary_voltage_kv",
                                               "secondary_voltage_kv", "phase", "type"),
                      numeric=("power_rating_kva", "primary_voltage_kv", "secondary_voltage_kv"),
                      strict: bool = False) -> DataFrame:
    """C11: ``reject_reason`` for a missing field or a non-numeric number.
    ``strict=True`` raises inside the job for the first bad row instead."""
    reasons = []
    for c in required:
        if c not in df.columns:
            reasons.append(F.lit(f"missing field {c}"))
        else:
            reasons.append(_msg(F.col(c).isNull(), f"missing field {c}"))
    for c in numeric:
        if c in df.columns:
            reasons.append(_msg(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull(),
                                f"non-numeric {c}"))
    reason = F.try_element_at(F.array_compact(F.array(*reasons)), F.lit(1))
    out = df.withColumn("reject_reason", reason)
    if strict:
        out = out.withColumn("reject_reason", F.when(F.col("reject_reason").isNotNull(),
                                                     F.raise_error(F.col("reject_reason"))))
    return out


def weight_domain_check(df: DataFrame, rating="power_rating", v1="primary_voltage",
                        v2="secondary_voltage", phase="phase") -> DataFrame:
    """Reject non-positive rating / voltage and unknown phase spellings."""
    from .weights import phase_kind
    kind = phase_kind(F.col(phase))
    reason = (F.when(F.col(rating).isNull() | (F.col(rating) <= 0), F.lit("Power rating must be positive"))
              .when(F.col(v1).isNull() | (F.col(v1) <= 0) | F.col(v2).isNull() | (F.col(v2) <= 0),
                    F.lit("Voltage values must be positive"))
              .when(kind.isNull(), F.concat(F.lit("Unknown phase type: "), F.col(phase))))
    return df.withColumn("reject_reason", reason)


def implausible_weight_flag(df: DataFrame, cols=None, limit: float = 1e6) -> DataFrame:
    """Any weight above ``limit`` kg."""
    cols = cols or [f"{c}_weight" for c in K.COMPONENT_NAMES] + ["total_weight"]
    return df.withColumn("implausible_weight", F.greatest(*[F.col(c) for c in cols]) > F.lit(limit))


# --- listing plan ------------------------------------------------------------------

def clean_listings(df: DataFrame, min_kva: float | None = K.MIN_POWER_RATING,
                   keep_rejected: bool = False, whole_word: bool = False) -> DataFrame:
    """C1, C2, X2, X5, C7, P1, C3, C4, C6 as one lazy, narrow plan.

    Every parse runs once per row (``compute_once``): the cased text first, then
    price, rating, voltages, equipment flag and quantity from it; the filters sit
    above.  With ``keep_rejected`` all rows stay and carry ``is_transformer``
    (S8 writes them partitioned by that flag)."""
    out = drop_sparse_rows(df)
    out = X.compute_once(out, {"__lo": F.lower(F.col("description")), "__up": F.upper(F.col("description"))})
    if isinstance(out.schema["unit_price"].dataType, T.NumericType):
        price = F.col("unit_price").cast("double")
    else:
        price = X.parse_price("unit_price")
    rating = X.rating_kva(F.col("__up"), cased=True)
    if "power_rating_kva" in out.columns:
        rating = F.coalesce(F.col("power_rating_kva").cast("double"), rating)
    if "quantity" in out.columns and isinstance(out.schema["quantity"].dataType, T.NumericType):
        qty = F.coalesce(F.when(~F.isnan(F.col("quantity").cast("double")), F.col("quantity").cast("bigint")),
                         F.lit(1).cast("bigint"))
    else:
        qty = X.parse_quantity("quantity")
    # columns that filters reference go behind the barrier; voltages are only
    # projected, so a plain column lets pruning skip them when nobody reads them
    out = X.compute_once(out, {
        "unit_price_usd": price,
        "power_rating_kva": rating,
        "is_transformer": X.is_equipment(F.col("__lo"), whole_word, cased=True),
        "quantity_int": qty,
    })
    out = (out.withColumn("__v", X.voltages(F.col("__up"), cased=True))
              .withColumn("primary_voltage_kv", F.col("__v.primary_kv"))
              .withColumn("secondary_voltage_kv", F.col("__v.secondary_kv"))
              .drop("__v", "__lo", "__up"))
    if not keep_rejected:
        out = out.filter("is_transformer")
    out = out.withColumn("data_source", F.lit(K.SOURCE_REAL))
    out = lot_to_unit_price(out)
    if min_kva is not None and not keep_rejected:
        out = min_rating(out, min_kva)
    return out
