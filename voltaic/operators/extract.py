"""Feature extraction from listing text (X1-X9), as column-adding operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def add_rating(df: DataFrame, text: str = "description", out: str = "power_rating_kva",
               fill_only: bool = True) -> DataFrame:
    """Rating from the description; by default only where it is missing."""
    parsed = X.rating_kva(text)
    if fill_only and out in df.columns:
        return df.withColumn(out, F.coalesce(F.col(out).cast("double"), parsed))
    return df.withColumn(out, parsed)


def add_rating_loose(df: DataFrame, text: str = "description", out: str = "power_rating_kva",
                     drop_unparsable: bool = True) -> DataFrame:
    """Scraper rating; a hit whose number does not parse drops the row."""
    out_df = df.withColumn(out, X.rating_kva_loose(text))
    if drop_unparsable:
        out_df = out_df.filter(~X.rating_kva_loose_bad(text))
    return out_df


def add_rating_int(df: DataFrame, text: str = "description", out: str = "power_rating_kva") -> DataFrame:
    """Integer-part rating (sample-table variant)."""
    return df.withColumn(out, X.rating_kva_int(text))


def add_voltages(df: DataFrame, text: str = "description") -> DataFrame:
    """Primary / secondary kV from the description."""
    v = X.voltages(text)
    return (df.withColumn("__v", v)
              .withColumn("primary_voltage_kv", F.col("__v.primary_kv"))
              .withColumn("secondary_voltage_kv", F.col("__v.secondary_kv"))
              .drop("__v"))


def add_phase(df: DataFrame, text: str = "description", out: str = "phase") -> DataFrame:
    return df.withColumn(out, X.phase_from_text(text))


def add_type(df: DataFrame, text: str = "description", out: str = "type") -> DataFrame:
    return df.withColumn(out, X.type_from_text(text))


def add_frequency(df: DataFrame, text: str = "description", out: str = "frequency_hz") -> DataFrame:
    return df.withColumn(out, X.frequency_from_text(text))


def enrich(df: DataFrame, text: str = "description") -> DataFrame:
    """X7-X9 together (the integration step's enrichment); the lower-cased text is
    computed once and shared by the three keyword scans."""
    out = X.compute_once(df, {"__lo": F.lower(F.col(text))})
    out = X.compute_once(out, {
        "phase": X.phase_from_text(F.col("__lo"), cased=True),
        "type": F.when(F.col(text).isNull() | (F.col(text) == ""), F.lit(None).cast("string"))
                 .otherwise(X.type_from_text(F.col("__lo"), cased=True)),
        "frequency_hz": F.when(F.col(text).isNull() | (F.col(text) == ""), F.lit(None).cast("double"))
                         .otherwise(X.frequency_from_text(F.col("__lo"), cased=True)),
    })
    return out.drop("__lo")
