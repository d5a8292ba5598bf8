"""Dataset builders, the integrated (market + synthetic) table and the analyses
drawn on it: union, describe, correlations, regression metrics, box plots,
histograms, density curves, quadratic trend."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import bindings as B
from .. import constants as K
from ..functions import random as R
from ..operators import datasets, prepare, pricing, stats, topk
from ..session import min_partitions
from . import listing_queries as LQ
from . import sqlfrag as S
from .registry import query, r
from .spec_queries import _label_sql, _rule_sql, weights_sql

# --- G1: labelled specs ---------------------------------------------------------------------

#: Generated rows of a task, at most about: a key takes a few bytes of its file, so that
#: one split of it makes far more rows than a task should.
ROWS_PER_TASK = 20_000


def _dealt(ids, most: int):
    tasks = ids.count() // ROWS_PER_TASK
    return ids.repartition(min(tasks, most), "id") if tasks > 1 else ids


def spec_ids(spark, sf):
    ids = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return _dealt(ids, min_partitions(spark))


def order_ids(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


D = datasets
_J = {c: R.sql_between("id", D.S_JITTER[c], 0.95, 1.05) for c in K.COMPONENT_NAMES}
G1_GEN = f"""
g1 as (select id as spec_id,
  {R.sql_choice('id', D.S_RATING, [float(x) for x in K.SPEC_RATINGS])} as power_rating,
  {R.sql_choice('id', D.S_V1, K.SPEC_PRIMARY_KV)} as primary_voltage,
  {R.sql_choice('id', D.S_V2, K.SPEC_SECONDARY_KV)} as secondary_voltage,
  {R.sql_choice('id', D.S_PHASE, K.SPEC_PHASES)} as phase,
  {', '.join(f"{R.sql_between('id', D.S_VARY[c], 0.9, 1.1)} as v_{c}" for c in K.COMPONENT_NAMES + ['total'])},
  {R.sql_choice('id', D.S_COOL, K.SPEC_COOLING)} as cooling_type,
  {R.sql_uniform('id', D.S_TAP)} < 0.5 as tap_changer,
  {R.sql_between('id', D.S_EFF, 0.95, 0.99)} as efficiency,
  {R.sql_between('id', D.S_IMP, 2.0, 8.0)} as impedance,
  {R.sql_choice('id', D.S_FREQ, K.SPEC_FREQUENCY)} as frequency,
  {R.sql_choice('id', D.S_INST, K.SPEC_INSTALLATION)} as installation_type,
  {R.sql_choice('id', D.S_INSUL, K.SPEC_INSULATION)} as insulation_type,
  {R.sql_choice('id', D.S_LOC, K.SPEC_LOCATIONS)} as manufacturing_location,
  {R.sql_normal('id', D.S_NOISE, K.LABEL_NOISE_SD)} as noise, id
  from (select p_partkey as id from part) ids),
g1w as ({weights_sql('g1', jitter=_J)}),
g1v as (select spec_id, power_rating, primary_voltage, secondary_voltage, phase, cooling_type, tap_changer,
  efficiency, impedance, frequency, installation_type, insulation_type, manufacturing_location, noise,
  {', '.join(f'{c}_weight * v_{c} as {c}_weight' for c in K.COMPONENT_NAMES)},
  ({' + '.join(f'{c}_weight' for c in K.COMPONENT_NAMES)}) * v_total as total_weight from g1w),
gspecs as (select * exclude (noise), {_label_sql('noise')} as price from g1v)
"""
G1_SQL = "with " + G1_GEN
SPEC_COLS = ["spec_id", "power_rating", "primary_voltage", "secondary_voltage", "phase", "cooling_type",
             "tap_changer", "efficiency", "impedance", "frequency", "installation_type", "insulation_type",
             "manufacturing_location"] + [f"{c}_weight" for c in K.COMPONENT_NAMES] + ["total_weight", "price"]
DOUBLE_SPEC = {"power_rating", "primary_voltage", "secondary_voltage", "efficiency", "impedance", "price",
               "total_weight"} | {f"{c}_weight" for c in K.COMPONENT_NAMES}


def _spec_sel():
    return ", ".join(r(c, c) if c in DOUBLE_SPEC else c for c in SPEC_COLS)


def gen_specs(spark, sf):
    return D.spec_table(spec_ids(spark, sf))


@query("dataset_specs", G1_SQL + f"select {_spec_sel()} from gspecs")
def dataset_specs(spark, sf):
    """G1 over the part keys."""
    return gen_specs(spark, sf).select(*SPEC_COLS)


# --- G2 / G3 -------------------------------------------------------------------------------------

def _g2_sql():
    band, u = R.sql_uniform("id", 31), R.sql_uniform("id", 32)
    rating = (f"(case when {band} < 0.3 then {K.MIN_POWER_RATING} + {u} * {1000.0 - K.MIN_POWER_RATING} "
              f"when {band} < 0.7 then 1000.0 + {u} * 9000.0 else 10000.0 + {u} * 90000.0 end)")
    return f"""
synthetic as (select id as row_id, {rating} as power_rating_kva,
  {R.sql_choice('id', 33, [float(x) for x in K.MARKET_PRIMARY_KV])} as primary_voltage_kv,
  {R.sql_choice('id', 34, [float(x) for x in K.MARKET_SECONDARY_KV])} as secondary_voltage_kv,
  {R.sql_weighted_choice('id', 35, ['Single-phase', 'Three-phase'], [0.1, 0.9])} as phase,
  {R.sql_weighted_choice('id', 36, ['Power', 'Distribution', 'Auto', 'Instrument'], [0.5, 0.4, 0.05, 0.05])} as type,
  {R.sql_weighted_choice('id', 37, [50.0, 60.0], [0.8, 0.2])} as frequency_hz,
  20.0 * {rating} * (1 + {R.sql_between('id', 38, -0.2, 0.3)}) as unit_price_usd,
  'Synthetic' as data_source from (select o_orderkey as id from orders) ids)
"""


G2_SQL = "with " + _g2_sql()
MCOLS = ["power_rating_kva", "primary_voltage_kv", "secondary_voltage_kv", "phase", "type", "frequency_hz",
         "unit_price_usd", "data_source"]
DOUBLE_M = {"power_rating_kva", "primary_voltage_kv", "secondary_voltage_kv", "frequency_hz", "unit_price_usd"}


def _msel(prefix=""):
    return ", ".join(r(prefix + c, c) if c in DOUBLE_M else prefix + c for c in MCOLS)


@query("dataset_market", G2_SQL + f"select row_id, {_msel()} from synthetic")
def dataset_market(spark, sf):
    """G2 over the order keys."""
    return D.market_table(order_ids(spark, sf))


def _g3_sql():
    return f"""
select id as row_id, date '2025-03-19' - cast(1 + floor({R.sql_uniform('id', 41)} * 730) as integer) as listing_date,
  {R.sql_choice('id', 42, D.SAMPLE_HSN)} as hsn_code, d as description,
  {R.sql_choice('id', 44, D.SAMPLE_ORIGINS)} as origin,
  {R.sql_choice('id', 45, D.SAMPLE_DESTINATIONS)} as destination,
  cast(1 + floor({R.sql_uniform('id', 46)} * 49) as integer) as quantity,
  cast(null as double) as unit_price_usd, '{D.SAMPLE_URL}' as source_url,
  coalesce(try_cast({S.extract('d', r'(\d+)(?:\.\d+)?\s*(?:MVA|mva)')} as double) * 1000.0,
           try_cast({S.extract('d', r'(\d+)(?:\.\d+)?\s*(?:KVA|kVA|kva)')} as double)) as power_rating_kva
from (select id, {R.sql_choice('id', 43, D.SAMPLE_DESCRIPTIONS)} as d from (select o_orderkey as id from orders) i) t"""


@query("dataset_listings", _g3_sql())
def dataset_listings(spark, sf):
    """G3 over the order keys (X4 fills the rating)."""
    return D.sample_listings(order_ids(spark, sf))


# --- U1: integrated table ---------------------------------------------------------------------------

INTEGRATED = LQ.MARKET.rstrip() + ",\n" + _g2_sql() + f""",
integrated as (select {', '.join(MCOLS)} from market union all select {', '.join(MCOLS)} from synthetic)
"""


def integrated(spark, sf):
    m = LQ.market(spark, sf).select(*MCOLS)
    s = D.market_table(order_ids(spark, sf))
    return prepare.union_common(m, s, MCOLS)


@query("union_common", INTEGRATED + "select data_source, count(*) as n, " + ", ".join([
    r("avg(power_rating_kva)", "mean_rating"), r("avg(unit_price_usd)", "mean_price"),
    r("sum(frequency_hz)", "sum_frequency")]) + " from integrated group by data_source")
def union_common(spark, sf):
    """Prepared market rows + synthetic rows on the shared columns."""
    return integrated(spark, sf).groupBy("data_source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("power_rating_kva").alias("mean_rating"),
        F.avg("unit_price_usd").alias("mean_price"), F.sum("frequency_hz").alias("sum_frequency"))


@query("union_distinct", INTEGRATED + """
select count(*) as n_distinct from (select distinct phase, type, frequency_hz, data_source from integrated) t""")
def union_distinct(spark, sf):
    """Full-row distinct of the categorical projection."""
    d = prepare.distinct_rows(integrated(spark, sf).select("phase", "type", "frequency_hz", "data_source"))
    return d.agg(F.count(F.lit(1)).alias("n_distinct"))


@query("union_distinct_rows", INTEGRATED + """
select data_source, count(*) as n_distinct from (select distinct * from integrated) t group by data_source""")
def union_distinct_rows(spark, sf):
    """Full-row distinct of the whole integrated table, counted by source."""
    d = prepare.distinct_rows(integrated(spark, sf))
    return d.groupBy("data_source").agg(F.count(F.lit(1)).alias("n_distinct"))


@query("stats_distinct_sources", INTEGRATED + "select distinct data_source from integrated")
def stats_distinct_sources(spark, sf):
    """A9."""
    return stats.distinct_values(integrated(spark, sf), "data_source")


@query("stats_five_number_sources", INTEGRATED + f"""
select data_source, count(v) as n, {r('avg(v)', 'mean')}, {r('median(v)', 'median')}, {r('min(v)', 'min')},
  {r('max(v)', 'max')}, {r('stddev_samp(v)', 'std')}
from (select data_source, unit_price_usd / power_rating_kva as v from integrated) t group by data_source""")
def stats_five_number_sources(spark, sf):
    """A1 of price per kVA per data source on the integrated table."""
    df = prepare.price_per_kva(integrated(spark, sf))
    return stats.five_number(df, "price_per_kva", ["data_source"])


@query("stats_box_by_source", INTEGRATED + f"""
, b as (select data_source, unit_price_usd / power_rating_kva as v from integrated),
q as (select data_source, quantile_cont(v, 0.25) as q1, median(v) as med, quantile_cont(v, 0.75) as q3 from b group by data_source),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lf, q3 + 1.5 * (q3 - q1) as uf from q)
select f.data_source, {r('q1', 'q1')}, {r('med', 'median')}, {r('q3', 'q3')}, {r('iqr', 'iqr')},
  {r('lf', 'lower_fence')}, {r('uf', 'upper_fence')},
  {r('min(case when v >= lf and v <= uf then v end)', 'whisker_low')},
  {r('max(case when v >= lf and v <= uf then v end)', 'whisker_high')},
  count(*) filter (where not (v >= lf and v <= uf)) as outliers, count(*) as n
from b join f on b.data_source = f.data_source group by f.data_source, q1, med, q3, iqr, lf, uf""")
def stats_box_by_source(spark, sf):
    """A14 of price per kVA per data source."""
    return stats.box_stats(prepare.price_per_kva(integrated(spark, sf)), "price_per_kva", ["data_source"])


@query("stats_histogram", INTEGRATED + f"""
, b as (select data_source, power_rating_kva as v from integrated),
s as (select data_source, count(*) as n, min(v) as lo, max(v) as hi, quantile_cont(v, 0.25) as q1,
        quantile_cont(v, 0.75) as q3 from b group by data_source),
w as (select *, (hi - lo) / (log2(n) + 1) as sturges, 2.0 * (q3 - q1) * pow(n, {-1.0 / 3.0!r}) as fd from s),
k as (select data_source, lo, hi, case when hi - lo > 0 then cast(greatest(ceil((hi - lo) /
        (case when fd > 0 then least(sturges, fd) else sturges end)), 1) as integer) else 1 end as bins from w),
x as (select b.data_source, k.lo, k.hi, k.bins, cast(case when k.hi > k.lo then
        least(floor((b.v - k.lo) / (k.hi - k.lo) * k.bins), k.bins - 1) else 0 end as integer) as bin
      from b join k on b.data_source = k.data_source)
select data_source, bin, {r('lo + bin * (hi - lo) / bins', 'bin_start')}, {r('lo + (bin + 1) * (hi - lo) / bins', 'bin_end')},
  count(*) as "count" from x group by data_source, bin, lo, hi, bins""")
def stats_histogram(spark, sf):
    """Automatic-bin histogram of the rating per data source."""
    return stats.histogram(integrated(spark, sf), "power_rating_kva", ["data_source"])


@query("stats_density", INTEGRATED + f"""
, b as (select data_source, power_rating_kva as v from integrated),
s as (select data_source, count(*) as n, stddev_samp(v) * pow(count(*), -0.2) as bw, min(v) as lo, max(v) as hi
      from b group by data_source),
red as (select data_source, v as x, count(*) as w from b group by data_source, v),
g as (select s.*, i, lo + i * (hi - lo) / 199 as gx from s, range(200) t(i))
select g.data_source, cast(g.i as integer) as i, {r('g.gx', 'x')},
  {r(f'sum(red.w * exp(-0.5 * ((g.gx - red.x) / g.bw) * ((g.gx - red.x) / g.bw))) / (any_value(g.n) * any_value(g.bw) * {math.sqrt(2 * math.pi)!r})', 'density')}
from g join red on g.data_source = red.data_source group by g.data_source, g.i, g.gx""")
def stats_density(spark, sf):
    """Gaussian KDE (Scott bandwidth) of the rating per data source, 200 points."""
    return stats.density_curve(integrated(spark, sf), "power_rating_kva", "data_source")


def _quad_sql():
    return f"""
, base as (select power_rating_kva as x, unit_price_usd as y from integrated),
m as (select avg(x) as mx, stddev_pop(x) as sx from base),
t as (select (x - mx) / sx as t, y, mx, sx from base, m),
s as (select mx, sx, count(*) as s0, sum(t) as s1, sum(t * t) as s2, sum(t * t * t) as s3, sum(t * t * t * t) as s4,
        sum(y) as y0, sum(t * y) as y1, sum(t * t * y) as y2 from t group by mx, sx),
d as (select *, s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2) as dd from s),
abc as (select mx, sx,
  (y2 * (s2 * s0 - s1 * s1) - s3 * (y1 * s0 - s1 * y0) + s2 * (y1 * s1 - s2 * y0)) / dd as aa,
  (s4 * (y1 * s0 - s1 * y0) - y2 * (s3 * s0 - s1 * s2) + s2 * (s3 * y0 - y1 * s2)) / dd as bb,
  (s4 * (s2 * y0 - y1 * s1) - s3 * (s3 * y0 - y1 * s2) + y2 * (s3 * s1 - s2 * s2)) / dd as cc from d)
"""


@query("stats_quadratic", INTEGRATED + _quad_sql() + f"""
select {r('aa / (sx * sx)', 'a')}, {r('bb / sx - 2 * aa * mx / (sx * sx)', 'b')},
  {r('aa * mx * mx / (sx * sx) - bb * mx / sx + cc', 'c')} from abc""")
def stats_quadratic(spark, sf):
    """Quadratic trend of price on rating (coefficients)."""
    coef, _ = stats.quadratic_trend(integrated(spark, sf), "power_rating_kva", "unit_price_usd")
    return coef


# --- analyses on the labelled specs ----------------------------------------------------------------------

NUMERIC_SPECS = ["power_rating", "primary_voltage", "secondary_voltage", "efficiency", "impedance", "frequency"] + \
    [f"{c}_weight" for c in K.COMPONENT_NAMES] + ["total_weight"]
CATEGORICAL_SPECS = {"phase": K.SPEC_PHASES, "cooling_type": K.SPEC_COOLING,
                     "installation_type": K.SPEC_INSTALLATION, "insulation_type": K.SPEC_INSULATION,
                     "manufacturing_location": K.SPEC_LOCATIONS}


def _corr_items():
    items = [(c, f"cast({c} as double)") for c in NUMERIC_SPECS]
    for c, levels in CATEGORICAL_SPECS.items():
        for lv in sorted(levels):
            items.append((f"{c}_{lv}", f"(case when {c} = {S.q(lv)} then 1.0 else 0.0 end)"))
    return items


CORR_SQL = G1_SQL.rstrip() + ",\ncorrs as (" + " union all ".join(
    f"select {S.q(n)} as feature, corr({e}, price) as correlation from gspecs" for n, e in _corr_items()) + \
    ")\n"


def spec_correlations(spark, sf):
    return stats.correlations(gen_specs(spark, sf), "price", NUMERIC_SPECS, list(CATEGORICAL_SPECS))


@query("stats_correlations", CORR_SQL + f"""
select feature, {r('correlation', 'correlation')} from corrs where correlation is not null and not isnan(correlation)""")
def stats_correlations(spark, sf):
    """Pearson correlation of every input (and category dummy) with the price."""
    return spec_correlations(spark, sf)


@query("topk_correlations", CORR_SQL + f"""
select feature, {r('correlation', 'correlation')}, side, cast(rk as integer) as rank from (
  select feature, correlation, 'top' as side, row_number() over (order by correlation desc, feature) as rk from corrs
   where correlation is not null and not isnan(correlation) qualify rk <= 15
  union all
  select feature, correlation, 'bottom' as side, row_number() over (order by correlation asc, feature) as rk from corrs
   where correlation is not null and not isnan(correlation) qualify rk <= 15) t""")
def topk_correlations(spark, sf):
    """The 15 strongest positive and 15 strongest negative correlations."""
    return topk.head_and_tail(spec_correlations(spark, sf), "correlation", "feature", 15)


@query("stats_describe", G1_SQL.rstrip() + ",\nlong as (" + " union all ".join(
    f"select {S.q(c)} as \"column\", cast({c} as double) as value from gspecs" for c in NUMERIC_SPECS + ["price"]) +
    ")\nselect \"column\", count(value) as \"count\", " + ", ".join([
        r("avg(value)", "mean"), r("stddev_samp(value)", "std"), r("min(value)", "min"),
        r("max(value)", "max"), r("quantile_cont(value, 0.25)", "p25"), r("median(value)", "p50"),
        r("quantile_cont(value, 0.75)", "p75")]) + " from long group by \"column\"")
def stats_describe(spark, sf):
    """describe() of the labelled spec table (exact percentiles)."""
    return stats.describe(gen_specs(spark, sf), NUMERIC_SPECS + ["price"])


@query("stats_regression_metrics", B.duck_ctes("specs") + f"""
select phase, count(*) as n, {r('sqrt(avg(e * e))', 'rmse')}, {r('avg(abs(e))', 'mae')},
  {r('1.0 - sum(e * e) / (count(*) * var_pop(y))', 'r2')},
  {r('avg(case when y <> 0 then abs(e / y) end) * 100', 'mape')}
from (select phase, quoted_price as y, quoted_price - ({_rule_sql()}) as e from specs) t group by phase""")
def stats_regression_metrics(spark, sf):
    """RMSE / MAE / R2 / MAPE of the rule price against the quoted price, per phase."""
    df = pricing.rule_price(B.specs(spark, sf), "power_rating", "primary_voltage", "secondary_voltage",
                            out="prediction")
    return stats.regression_metrics(df, "quoted_price", "prediction", ["phase"])
