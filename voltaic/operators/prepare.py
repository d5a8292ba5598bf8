"""Projections, fills, derived columns (P1-P12) and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

MODEL_TYPES = {
    "power_rating_kva": "double", "primary_voltage_kv": "double", "secondary_voltage_kv": "double",
    "phase": "string", "type": "string", "frequency_hz": "double", "unit_price_usd": "double",
    "description": "string", "data_source": "string",
}


def tag_source(df: DataFrame, source: str, col: str = "data_source") -> DataFrame:
    """Constant provenance tag."""
    return df.withColumn(col, F.lit(source))


def project_model_columns(df: DataFrame, cols: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """The fixed model column list, then ``carry``; absent columns become typed nulls."""
    cols = cols or K.MODEL_COLUMNS
    return df.select(*[(F.col(c).cast(MODEL_TYPES.get(c, "string")) if c in df.columns
                        else F.lit(None).cast(MODEL_TYPES.get(c, "string"))).alias(c) for c in cols], *(carry or []))


def fill_defaults(df: DataFrame) -> DataFrame:
    """Default values (and whole columns when absent)."""
    defaults = {"frequency_hz": K.DEFAULT_FREQUENCY, "phase": K.DEFAULT_PHASE, "type": K.DEFAULT_TYPE,
                "primary_voltage_kv": K.DEFAULT_PRIMARY_KV, "secondary_voltage_kv": K.DEFAULT_SECONDARY_KV}
    out = df
    for c, v in defaults.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v))
    return out.na.fill({c: v for c, v in defaults.items()})


def _phase_norm(c: Column) -> Column:
    low = F.lower(c)
    return (F.when(low.isin(*K.THREE_PHASE_ALIASES), F.lit("Three-phase"))
            .when(low.isin(*K.SINGLE_PHASE_ALIASES), F.lit("Single-phase"))
            .otherwise(c))


def bridge_fields(df: DataFrame) -> DataFrame:
    """P5: application field names -> model names; phase spellings normalised;
    installation type mapped to a transformer type (Indoor/Outdoor -> Power)."""
    out = df
    renames = {a: m for a, m in K.APP_FIELD_MAP if a in df.columns and a != m}
    if "installation_type" in out.columns:
        expr = None
        for k, v in K.INSTALLATION_TO_TYPE:
            expr = (F.when(F.col("installation_type") == k, F.lit(v)) if expr is None
                    else expr.when(F.col("installation_type") == k, F.lit(v)))
        out = out.withColumn("installation_type", expr.otherwise(F.lit(K.DEFAULT_TYPE)))
    out = out.withColumnsRenamed(renames)
    if "phase" in out.columns:
        out = out.withColumn("phase", _phase_norm(F.col("phase")))
    return out


def price_per_kva(df: DataFrame, price: str = "unit_price_usd", rating: str = "power_rating_kva",
                  out: str = "price_per_kva") -> DataFrame:
    """Price / rating (null on a zero rating; ANSI division would raise)."""
    return df.withColumn(out, F.try_divide(F.col(price), F.col(rating)))


def log_target(df: DataFrame, col: str = "unit_price_usd", out: str = "log_price") -> DataFrame:
    """P8."""
    return df.withColumn(out, F.log1p(F.col(col)))


def weight_features(df: DataFrame) -> DataFrame:
    """power/weight, component shares (%), copper/core, active part
    (core + copper + insulation) and non-active part (tank + oil) with shares."""
    tw = F.col("total_weight")
    active = F.col("core_weight") + F.col("copper_weight") + F.col("insulation_weight")
    non_active = F.col("tank_weight") + F.col("oil_weight")
    cols = {"power_to_weight_ratio": F.try_divide(F.col("power_rating"), tw)}
    cols.update({f"{c}_weight_pct": F.try_divide(F.col(f"{c}_weight"), tw) * 100 for c in K.COMPONENT_NAMES})
    cols.update({
        "copper_to_core_ratio": F.try_divide(F.col("copper_weight"), F.col("core_weight")),
        "active_weight": active,
        "active_weight_pct": F.try_divide(active, tw) * 100,
        "non_active_weight": non_active,
        "non_active_weight_pct": F.try_divide(non_active, tw) * 100,
    })
    return df.withColumns(cols)


def normalise_spec_flags(df: DataFrame) -> DataFrame:
    """P10: tap changer text -> boolean; efficiency given in percent -> fraction."""
    out = df
    if "tap_changer" in out.columns and isinstance(out.schema["tap_changer"].dataType, T.StringType):
        out = out.withColumn("tap_changer", F.coalesce(F.lower(F.col("tap_changer")) != "none", F.lit(False)))
    if "efficiency" in out.columns:
        e = F.col("efficiency").cast("double")
        out = out.withColumn("efficiency", F.when(e > 1, e / 100).otherwise(e))
    return out


def kv_to_volts(c) -> Column:
    """P11."""
    return (F.col(c) if isinstance(c, str) else c) * 1000.0


def usd_per_lb_to_ton(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c) * K.LB_PER_TON


def money(c) -> Column:
    """``$1,234.56``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("$"), F.format_number(col, 2))


def display_name(c) -> Column:
    """``electrical_steel`` -> ``Electrical Steel``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def to_display(df: DataFrame) -> DataFrame:
    """Rename snake_case columns to the listing display names (for CSV sinks)."""
    return df.withColumnsRenamed({k: v for k, v in K.DISPLAY_NAMES.items() if k in df.columns})


def from_display(df: DataFrame) -> DataFrame:
    inv = {v: k for k, v in K.DISPLAY_NAMES.items()}
    return df.withColumnsRenamed({c: inv[c] for c in df.columns if c in inv})


# --- set operations -----------------------------------------------------------------

def union_common(a: DataFrame, b: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Union all over the shared columns (order from ``order`` or ``a``).
    No shared column is an error."""
    common = [c for c in (order or a.columns) if c in a.columns and c in b.columns]
    if not common:
        raise ValueError("inputs share no column")
    return a.select(*common).unionByName(b.select(*common))


def union_common_saved(a: DataFrame, b: DataFrame, path: str) -> DataFrame:
    """As ``union_common``, written as CSV; inputs that share no column give ``a``."""
    from ..sources.files import write_csv
    out = union_common(a, b) if set(a.columns) & set(b.columns) else a
    write_csv(out, path)
    return out


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct (null equals null)."""
    return df.dropDuplicates()


def prepare_market(df: DataFrame, min_kva: float | None = None, carry: list[str] | None = None) -> DataFrame:
    """The integration step for cleaned listings: C5, P1, X7-X9 where absent, P3/P4, P2;
    ``carry`` names further columns to keep."""
    from .clean import require_fields, min_rating
    from .extract import add_frequency, add_phase, add_type, enrich
    out = require_fields(df)
    if min_kva is not None:
        out = min_rating(out, min_kva)
    out = tag_source(out, K.SOURCE_REAL)
    if not {"phase", "type", "frequency_hz"} & set(out.columns):
        out = enrich(out)
    else:
        for name, add in (("phase", add_phase), ("type", add_type), ("frequency_hz", add_frequency)):
            if name not in out.columns:
                out = add(out)
    return project_model_columns(fill_defaults(out), carry=carry)
