"""Listing-side queries: cleaning, extraction, statistics, top-k (binding L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from .. import constants as K
from ..functions import text as X
from ..operators import clean, extract, prepare, stats, topk
from . import sqlfrag as S
from .registry import query, r

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
KEYS_SQL = "l_orderkey, l_linenumber, l_partkey"
LST = B.duck_ctes("listings")
CLEAN = LST.rstrip() + ",\n" + S.CLEAN_LISTINGS
PARSED = LST.rstrip() + ",\n" + S.PARSED_LISTINGS


def cleaned(spark, sf):
    return clean.clean_listings(B.listings(spark, sf))


def priced(spark, sf):
    """Cleaned listings with a price and price per kVA (C5 + P7)."""
    return prepare.price_per_kva(clean.require_fields(cleaned(spark, sf)))


# --- flagship: A1 of price per kVA by origin ---------------------------------------

@query("price_per_kva_by_origin", CLEAN + f"""
select origin, count(ppk) as n, {r('avg(ppk)', 'mean')}, {r('median(ppk)', 'median')},
  {r('min(ppk)', 'min')}, {r('max(ppk)', 'max')}, {r('stddev_samp(ppk)', 'std')}
from (select origin, unit_price_usd / power_rating_kva as ppk from clean_listings
      where unit_price_usd is not null and power_rating_kva is not null) t
where origin is not null group by origin
""")
def price_per_kva_by_origin(spark, sf):
    """Clean listings, price per kVA, five-number summary per origin."""
    return stats.five_number(priced(spark, sf), "price_per_kva", ["origin"])


# --- C: cleaning ---------------------------------------------------------------------

@query("clean_thresh", LST + f"""
select {KEYS_SQL} from listings
where ((case when l_orderkey is not null then 1 else 0 end) + (case when l_linenumber is not null then 1 else 0 end)
  + (case when l_partkey is not null then 1 else 0 end) + (case when listing_date is not null then 1 else 0 end)
  + (case when hsn_code is not null then 1 else 0 end) + (case when origin is not null then 1 else 0 end)
  + (case when destination is not null then 1 else 0 end) + (case when quantity is not null then 1 else 0 end)
  + (case when unit_price is not null then 1 else 0 end) + (case when description is not null then 1 else 0 end)) >= 2
""")
def clean_thresh(spark, sf):
    return clean.drop_sparse_rows(B.listings(spark, sf)).select(*KEYS)


@query("clean_price", LST + f"select {KEYS_SQL}, {r(S.parse_price('unit_price'), 'unit_price_usd')} from listings")
def clean_price(spark, sf):
    return clean.clean_price(B.listings(spark, sf)).select(*KEYS, "unit_price_usd")


@query("clean_quantity", LST + f"select {KEYS_SQL}, quantity, {S.parse_quantity('quantity')} as quantity_int from listings")
def clean_quantity(spark, sf):
    return clean.clean_quantity(B.listings(spark, sf)).select(*KEYS, "quantity", "quantity_int")


@query("clean_unit_price", PARSED + f"""
select {KEYS_SQL}, quantity_int, {r('original_unit_price_usd', 'original_unit_price_usd')},
  {r('unit_price_usd', 'unit_price_usd')} from parsed_listings""")
def clean_unit_price(spark, sf):
    df = clean.clean_quantity(clean.clean_price(B.listings(spark, sf)))
    return clean.lot_to_unit_price(df).select(*KEYS, "quantity_int", "original_unit_price_usd", "unit_price_usd")


@query("clean_required", PARSED + f"""
select {KEYS_SQL} from parsed_listings where unit_price_usd is not null and power_rating_kva is not null""")
def clean_required(spark, sf):
    df = extract.add_rating(clean.clean_price(B.listings(spark, sf)))
    return clean.require_fields(df).select(*KEYS)


@query("clean_min_power", PARSED + f"""
select count(*) as rows_in, count(*) filter (where power_rating_kva is null) as missing_rating,
  count(*) filter (where power_rating_kva < {K.MIN_POWER_RATING}) as below_minimum,
  count(*) filter (where power_rating_kva >= {K.MIN_POWER_RATING}) as rows_kept
from parsed_listings""")
def clean_min_power(spark, sf):
    return clean.min_rating_report(extract.add_rating(B.listings(spark, sf)))


@query("clean_equipment", LST + f"select {KEYS_SQL}, {S.is_equipment('description')} as is_transformer from listings")
def clean_equipment(spark, sf):
    return clean.flag_equipment(B.listings(spark, sf)).select(*KEYS, "is_transformer")


@query("clean_rejects", PARSED + """
select is_transformer, count(*) as n, count(power_rating_kva) as n_rated from parsed_listings group by is_transformer""")
def clean_rejects(spark, sf):
    """S8's content: every row, kept and rejected, split by the equipment flag."""
    df = clean.clean_listings(B.listings(spark, sf), keep_rejected=True)
    return df.groupBy("is_transformer").agg(F.count(F.lit(1)).alias("n"),
                                            F.count("power_rating_kva").alias("n_rated"))


@query("clean_positive_price", PARSED + """
select count(*) as rows_in, count(*) filter (where unit_price_usd is null) as null_price,
  count(*) filter (where unit_price_usd <= 0) as non_positive_price,
  count(*) filter (where unit_price_usd > 0) as rows_kept from parsed_listings""")
def clean_positive_price(spark, sf):
    df = clean.lot_to_unit_price(clean.clean_quantity(clean.clean_price(B.listings(spark, sf))))
    return clean.positive_price_report(df)


@query("clean_null_profile", CLEAN + """
select 'unit_price_usd' as "column", count(*) filter (where unit_price_usd is null) as null_count, 'double' as dtype from clean_listings
union all select 'power_rating_kva', count(*) filter (where power_rating_kva is null), 'double' from clean_listings
union all select 'primary_voltage_kv', count(*) filter (where primary_voltage_kv is null), 'double' from clean_listings
union all select 'secondary_voltage_kv', count(*) filter (where secondary_voltage_kv is null), 'double' from clean_listings
union all select 'quantity', count(*) filter (where quantity is null), 'string' from clean_listings
union all select 'quantity_int', count(*) filter (where quantity_int is null), 'bigint' from clean_listings
union all select 'origin', count(*) filter (where origin is null), 'string' from clean_listings
""")
def clean_null_profile(spark, sf):
    cols = ["unit_price_usd", "power_rating_kva", "primary_voltage_kv", "secondary_voltage_kv",
            "quantity", "quantity_int", "origin"]
    return stats.null_profile(cleaned(spark, sf).select(*cols))


#: The columns of cleaned listings and their types.
CLEANED = {"l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "listing_date": "date", "hsn_code": "string",
           "origin": "string", "destination": "string", "quantity": "string", "unit_price": "string", "description": "string",
           "unit_price_usd": "double", "power_rating_kva": "double", "is_transformer": "boolean", "quantity_int": "bigint",
           "primary_voltage_kv": "double", "secondary_voltage_kv": "double", "data_source": "string",
           "original_unit_price_usd": "double"}


@query("clean_null_profile_table", CLEAN + "\nunion all ".join(
    f"""select '{c}' as "column", count(*) filter (where {c} is null) as null_count, '{t}' as dtype from clean_listings"""
    for c, t in CLEANED.items()))
def clean_null_profile_table(spark, sf):
    """A6 of the whole cleaned table."""
    return stats.null_profile(cleaned(spark, sf))


# --- X: extraction ------------------------------------------------------------------

@query("extract_rating", LST + f"select {KEYS_SQL}, {r(S.rating_kva('description'), 'power_rating_kva')} from listings")
def extract_rating(spark, sf):
    return extract.add_rating(B.listings(spark, sf)).select(*KEYS, "power_rating_kva")


_GIVEN = "case when l_linenumber % 3 = 0 then cast(l_linenumber * 250 as double) end"


@query("extract_rating_fill", LST + f"""
select {KEYS_SQL}, {r(f"coalesce({_GIVEN}, {S.rating_kva('description')})", 'power_rating_kva')} from listings""")
def extract_rating_fill(spark, sf):
    df = B.listings(spark, sf).withColumn("power_rating_kva", F.expr(_GIVEN))
    return extract.add_rating(df, fill_only=True).select(*KEYS, "power_rating_kva")


_INT_KVA = r"(\d+)(?:\.\d+)?\s*(?:KVA|kVA|kva)"
_INT_MVA = r"(\d+)(?:\.\d+)?\s*(?:MVA|mva)"


@query("extract_rating_int", LST + f"""
select {KEYS_SQL}, {r(f"coalesce(try_cast({S.extract('description', _INT_MVA)} as double) * 1000.0, "
                      f"try_cast({S.extract('description', _INT_KVA)} as double))", 'power_rating_kva')}
from listings""")
def extract_rating_int(spark, sf):
    return extract.add_rating_int(B.listings(spark, sf)).select(*KEYS, "power_rating_kva")


@query("extract_voltages", LST + f"""
select {KEYS_SQL}, {r(S.voltage('description', 'primary'), 'primary_voltage_kv')},
  {r(S.voltage('description', 'secondary'), 'secondary_voltage_kv')} from listings""")
def extract_voltages(spark, sf):
    return extract.add_voltages(B.listings(spark, sf)).select(*KEYS, "primary_voltage_kv", "secondary_voltage_kv")


@query("extract_phase", LST + f"select {KEYS_SQL}, {S.phase('description')} as phase from listings")
def extract_phase(spark, sf):
    return extract.add_phase(B.listings(spark, sf)).select(*KEYS, "phase")


@query("extract_type", LST + f"select {KEYS_SQL}, {S.type_('description')} as type from listings")
def extract_type(spark, sf):
    return extract.add_type(B.listings(spark, sf)).select(*KEYS, "type")


@query("extract_frequency", LST + f"select {KEYS_SQL}, {r(S.frequency('description'), 'frequency_hz')} from listings")
def extract_frequency(spark, sf):
    return extract.add_frequency(B.listings(spark, sf)).select(*KEYS, "frequency_hz")


# --- P: prepare ---------------------------------------------------------------------

MARKET_SQL = f"""
market as (
  select power_rating_kva, coalesce(primary_voltage_kv, {K.DEFAULT_PRIMARY_KV}) as primary_voltage_kv,
    coalesce(secondary_voltage_kv, {K.DEFAULT_SECONDARY_KV}) as secondary_voltage_kv,
    coalesce({S.phase('description')}, 'Three-phase') as phase,
    coalesce({S.type_('description')}, 'Power') as type,
    coalesce({S.frequency('description')}, 50.0) as frequency_hz,
    unit_price_usd, description, 'Real (Market)' as data_source, {KEYS_SQL}
  from clean_listings where unit_price_usd is not null and power_rating_kva is not null
)
"""
MARKET = CLEAN.rstrip() + ",\n" + MARKET_SQL


def market(spark, sf, with_keys: bool = True):
    df = clean.require_fields(cleaned(spark, sf))
    keys = df.select(*KEYS, "description", "unit_price_usd", "power_rating_kva", "primary_voltage_kv",
                     "secondary_voltage_kv")
    return prepare.prepare_market(keys, carry=KEYS if with_keys else [])


@query("prepare_model_table", MARKET + f"""
select {KEYS_SQL}, {r('power_rating_kva', 'power_rating_kva')}, {r('primary_voltage_kv', 'primary_voltage_kv')},
  {r('secondary_voltage_kv', 'secondary_voltage_kv')}, phase, type, {r('frequency_hz', 'frequency_hz')},
  {r('unit_price_usd', 'unit_price_usd')}, data_source from market""")
def prepare_model_table(spark, sf):
    """The model table of the market side."""
    return market(spark, sf).drop("description")


@query("prepare_price_per_kva", CLEAN + f"""
select {KEYS_SQL}, {r('unit_price_usd / power_rating_kva', 'price_per_kva')} from clean_listings
where unit_price_usd is not null""")
def prepare_price_per_kva(spark, sf):
    return priced(spark, sf).select(*KEYS, "price_per_kva")


@query("prepare_log_price", CLEAN + f"""
select {KEYS_SQL}, {r('ln(1 + unit_price_usd)', 'log_price')} from clean_listings where unit_price_usd > 0""")
def prepare_log_price(spark, sf):
    df = clean.positive_price(cleaned(spark, sf))
    return prepare.log_target(df).select(*KEYS, "log_price")


# --- A: statistics ------------------------------------------------------------------

@query("stats_report", CLEAN + f"""
select 'power_rating_kva' as metric, count(power_rating_kva) as n, {r('avg(power_rating_kva)', 'mean')},
  {r('median(power_rating_kva)', 'median')}, {r('min(power_rating_kva)', 'min')}, {r('max(power_rating_kva)', 'max')}
from clean_listings
union all
select 'unit_price_usd', count(unit_price_usd), {r('avg(unit_price_usd)', 'mean')}, {r('median(unit_price_usd)', 'median')},
  {r('min(unit_price_usd)', 'min')}, {r('max(unit_price_usd)', 'max')} from clean_listings
""")
def stats_report(spark, sf):
    """A2 for rating and price, tidy (one row per metric): the two measures are
    unpivoted into (metric, value) so one grouped summary covers both."""
    df = cleaned(spark, sf)
    long = df.select(F.explode(F.array(
        F.struct(F.lit("power_rating_kva").alias("metric"), F.col("power_rating_kva").alias("value")),
        F.struct(F.lit("unit_price_usd").alias("metric"), F.col("unit_price_usd").alias("value")))).alias("r")
    ).select("r.metric", "r.value")
    return stats.min_max_mean_median(long, "value", ["metric"])


@query("stats_rating_summary", CLEAN + f"""
select count(power_rating_kva) as n, {r('avg(power_rating_kva)', 'mean')}, {r('median(power_rating_kva)', 'median')},
  {r('min(power_rating_kva)', 'min')}, {r('max(power_rating_kva)', 'max')}, {r('stddev_samp(power_rating_kva)', 'std')}
from clean_listings where unit_price_usd is not null""")
def stats_rating_summary(spark, sf):
    """A1 of the rating over the priced listings (no grouping)."""
    return stats.five_number(clean.require_fields(cleaned(spark, sf)), "power_rating_kva")


@query("stats_country_counts", CLEAN + """
select origin, count(*) as "count" from clean_listings where origin is not null group by origin""")
def stats_country_counts(spark, sf):
    return stats.category_counts(cleaned(spark, sf), "origin")


@query("stats_destination_counts", CLEAN + """
select destination, count(*) as "count" from clean_listings where destination is not null group by destination""")
def stats_destination_counts(spark, sf):
    return stats.category_counts(cleaned(spark, sf), "destination")


@query("stats_adjustments", CLEAN + f"""
select count(*) as adjusted_rows, {r('avg(original_unit_price_usd - unit_price_usd)', 'mean_reduction')},
  {r('max(original_unit_price_usd - unit_price_usd)', 'max_reduction')} from clean_listings where quantity_int > 1""")
def stats_adjustments(spark, sf):
    return stats.adjustment_stats(cleaned(spark, sf))


@query("stats_quality_counters", PARSED + """
select count(*) as "rows", count(*) filter (where unit_price_usd is null) as missing_price,
  count(*) filter (where power_rating_kva is null) as missing_rating,
  count(*) filter (where not is_transformer) as not_equipment,
  count(*) filter (where quantity_int > 1) as lots from parsed_listings""")
def stats_quality_counters(spark, sf):
    df = clean.clean_listings(B.listings(spark, sf), keep_rejected=True)
    return stats.quality_counters(df, {
        "missing_price": F.col("unit_price_usd").isNull(),
        "missing_rating": F.col("power_rating_kva").isNull(),
        "not_equipment": ~F.col("is_transformer"),
        "lots": F.col("quantity_int") > 1})


@query("stats_box_by_origin", CLEAN + f"""
, b as (select origin, unit_price_usd / power_rating_kva as v from clean_listings
        where unit_price_usd is not null and origin is not null),
q as (select origin, quantile_cont(v, 0.25) as q1, median(v) as med, quantile_cont(v, 0.75) as q3 from b group by origin),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lf, q3 + 1.5 * (q3 - q1) as uf from q)
select f.origin, {r('q1', 'q1')}, {r('med', 'median')}, {r('q3', 'q3')}, {r('iqr', 'iqr')},
  {r('lf', 'lower_fence')}, {r('uf', 'upper_fence')},
  {r('min(case when v >= lf and v <= uf then v end)', 'whisker_low')},
  {r('max(case when v >= lf and v <= uf then v end)', 'whisker_high')},
  count(*) filter (where not (v >= lf and v <= uf)) as outliers, count(*) as n
from b join f on b.origin = f.origin group by f.origin, q1, med, q3, iqr, lf, uf""")
def stats_box_by_origin(spark, sf):
    """A14 of price per kVA per origin."""
    return stats.box_stats(priced(spark, sf), "price_per_kva", ["origin"])


# --- T / J4: top-k ------------------------------------------------------------------

@query("topk_origins", CLEAN + """
select origin, count(*) as "count" from clean_listings where origin is not null group by origin
order by "count" desc, origin limit 5""")
def topk_origins(spark, sf):
    return topk.top_categories(cleaned(spark, sf), "origin", 5)


@query("topk_supported_origins", CLEAN + """
select origin, count(*) as "count" from clean_listings where origin is not null group by origin
having count(*) >= 3 order by "count" desc, origin limit 5""")
def topk_supported_origins(spark, sf):
    return topk.top_categories(cleaned(spark, sf), "origin", 5, min_count=3)


@query("topk_preview", CLEAN + f"""
select {KEYS_SQL}, origin, {r('unit_price_usd', 'unit_price_usd')}, {r('power_rating_kva', 'power_rating_kva')}
from clean_listings order by l_orderkey, l_linenumber, l_partkey limit 5""")
def topk_preview(spark, sf):
    df = cleaned(spark, sf).select(*KEYS, "origin", "unit_price_usd", "power_rating_kva")
    return topk.sorted_by(df, KEYS, 5)


@query("semi_top_origins", CLEAN + f"""
, top as (select origin from clean_listings where origin is not null group by origin having count(*) >= 3
          order by count(*) desc, origin limit 5)
select origin, count(*) as n, {r('avg(unit_price_usd / power_rating_kva)', 'mean_price_per_kva')}
from clean_listings where unit_price_usd is not null and origin in (select origin from top) group by origin""")
def semi_top_origins(spark, sf):
    """Price per kVA of the rows from the top supported origins."""
    rows = topk.semi_join_top(priced(spark, sf), "origin", 5, 3)
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n"),
                                      F.avg("price_per_kva").alias("mean_price_per_kva"))
