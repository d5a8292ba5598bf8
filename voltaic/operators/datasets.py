"""Dataset builders (G1-G3), re-aimed from driver-side generator loops to one
narrow projection over a key column: the table grows with the key table it is
built from, every value is a pure function of (key, stream), and no row is ever
produced on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import random as R
from ..functions import text as X
from .pricing import label_price
from .weights import estimate_weights

# stream numbers (one independent uniform per use)
S_RATING, S_V1, S_V2, S_PHASE = 1, 2, 3, 4
S_JITTER = {c: 5 + i for i, c in enumerate(K.COMPONENT_NAMES)}           # 5..9
S_VARY = {c: 10 + i for i, c in enumerate(K.COMPONENT_NAMES + ["total"])}  # 10..15
S_COOL, S_TAP, S_EFF, S_IMP, S_FREQ, S_INST, S_INSUL, S_LOC, S_NOISE = 16, 17, 18, 19, 20, 21, 22, 23, 24

# FIXED VALUES: sample listing HSN codes, descriptions, origins and destinations
SAMPLE_HSN = ["85042100", "85042210", "85042290", "85042300", "85043100", "85043200"]
SAMPLE_DESCRIPTIONS = [
    "3 Phase 11KV/433V 500KVA Distribution Transformer Oil Filled",
    "Single Phase 33kV/11kV 1000KVA Power Transformer",
    "Three Phase 33kV/400V 2000kVA Oil Immersed Transformer",
    "Dry Type 11kV/433V 315KVA Cast Resin Transformer",
    "Distribution Transformer 11/0.433kV 100KVA Oil Filled",
    "Power Transformer 132/33kV 40MVA ONAN/ONAF",
    "22kV/415V 630KVA Three Phase Distribution Transformer",
    "Single Phase 19.1kV/240V 50KVA Pole Mounted Transformer",
    "Three Phase 33/6.6kV 5MVA Power Transformer ONAN Cooling",
    "11kV/433V 1250KVA Distribution Transformer ONAN",
]
SAMPLE_ORIGINS = ["China", "India", "South Korea", "Germany", "Italy",
                  "United States", "Turkey", "Japan", "Brazil", "Spain"]
SAMPLE_DESTINATIONS = ["United Kingdom", "United States", "Germany", "France",
                       "Spain", "India", "Japan", "Canada", "Australia"]
SAMPLE_URL = "https://example.com/p/electrical-transformer/import/"


def spec_table(ids: DataFrame, id_col: str = "id", noise: bool = True) -> DataFrame:
    """G1: labelled specifications, one per key: uniform choices of rating and
    voltages, weights from Q1 with +-5 % jitter, each then varied +-10 % (the
    total independently), spec options, and the Q9 price with N(0, 5 %) noise."""
    i = F.col(id_col)
    df = ids.select(
        i.alias("spec_id"),
        R.choice(i, S_RATING, [float(x) for x in K.SPEC_RATINGS]).alias("power_rating"),
        R.choice(i, S_V1, K.SPEC_PRIMARY_KV).alias("primary_voltage"),
        R.choice(i, S_V2, K.SPEC_SECONDARY_KV).alias("secondary_voltage"),
        R.choice(i, S_PHASE, K.SPEC_PHASES).alias("phase"),
        *[R.between(i, S_JITTER[c], 0.95, 1.05).alias(f"__j_{c}") for c in K.COMPONENT_NAMES],
        *[R.between(i, S_VARY[c], 0.9, 1.1).alias(f"__v_{c}") for c in K.COMPONENT_NAMES + ["total"]],
        R.choice(i, S_COOL, K.SPEC_COOLING).alias("cooling_type"),
        (R.uniform(i, S_TAP) < 0.5).alias("tap_changer"),
        R.between(i, S_EFF, 0.95, 0.99).alias("efficiency"),
        R.between(i, S_IMP, 2.0, 8.0).alias("impedance"),
        R.choice(i, S_FREQ, K.SPEC_FREQUENCY).alias("frequency"),
        R.choice(i, S_INST, K.SPEC_INSTALLATION).alias("installation_type"),
        R.choice(i, S_INSUL, K.SPEC_INSULATION).alias("insulation_type"),
        R.choice(i, S_LOC, K.SPEC_LOCATIONS).alias("manufacturing_location"),
        (R.normal(i, S_NOISE, K.LABEL_NOISE_SD) if noise else F.lit(0.0)).alias("__noise"),
    )
    df = estimate_weights(df, jitter={c: F.col(f"__j_{c}") for c in K.COMPONENT_NAMES}, prefix="__q_")
    varied = {f"{c}_weight": F.col(f"__q_{c}_weight") * F.col(f"__v_{c}") for c in K.COMPONENT_NAMES}
    varied["total_weight"] = F.col("__q_total_weight") * F.col("__v_total")
    df = df.withColumns(varied)
    df = label_price(df, noise=F.col("__noise"))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def market_table(ids: DataFrame, id_col: str = "id", min_power_rating: float = K.MIN_POWER_RATING) -> DataFrame:
    """Market-like rows: rating in three bands (30 % up to 1000 kVA, 40 % up to
    10 MVA, 30 % up to 100 MVA), weighted choices for the rest, price about
    20 $/kVA with -20 %..+30 % spread."""
    i = F.col(id_col)
    band = R.uniform(i, 31)
    u = R.uniform(i, 32)
    rating = (F.when(band < 0.3, min_power_rating + u * (1000.0 - min_power_rating))
              .when(band < 0.7, 1000.0 + u * 9000.0).otherwise(10000.0 + u * 90000.0))
    return ids.select(
        i.alias("row_id"),
        rating.alias("power_rating_kva"),
        R.choice(i, 33, [float(x) for x in K.MARKET_PRIMARY_KV]).alias("primary_voltage_kv"),
        R.choice(i, 34, [float(x) for x in K.MARKET_SECONDARY_KV]).alias("secondary_voltage_kv"),
        R.weighted_choice(i, 35, ["Single-phase", "Three-phase"], [0.1, 0.9]).alias("phase"),
        R.weighted_choice(i, 36, ["Power", "Distribution", "Auto", "Instrument"],
                          [0.5, 0.4, 0.05, 0.05]).alias("type"),
        R.weighted_choice(i, 37, [50.0, 60.0], [0.8, 0.2]).alias("frequency_hz"),
        (20.0 * rating * (1 + R.between(i, 38, -0.2, 0.3))).alias("unit_price_usd"),
        F.lit(K.SOURCE_SYNTHETIC).alias("data_source"),
    )


def sample_listings(ids: DataFrame, id_col: str = "id", as_of: str = "2025-03-19") -> DataFrame:
    """Raw sample listings (date within 730 days of ``as_of``, fixed lists,
    quantity 1-49, no price) with the integer-part rating (X4)."""
    i = F.col(id_col)
    df = ids.select(
        i.alias("row_id"),
        F.date_sub(F.to_date(F.lit(as_of)), (1 + F.floor(R.uniform(i, 41) * 730)).cast("int")).alias("listing_date"),
        R.choice(i, 42, SAMPLE_HSN).alias("hsn_code"),
        R.choice(i, 43, SAMPLE_DESCRIPTIONS).alias("description"),
        R.choice(i, 44, SAMPLE_ORIGINS).alias("origin"),
        R.choice(i, 45, SAMPLE_DESTINATIONS).alias("destination"),
        (1 + F.floor(R.uniform(i, 46) * 49)).cast("int").alias("quantity"),
        F.lit(None).cast("double").alias("unit_price_usd"),
        F.lit(SAMPLE_URL).alias("source_url"),
    )
    return df.withColumn("power_rating_kva", X.rating_kva_int("description"))
