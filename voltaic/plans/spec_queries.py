"""Spec-side queries: weights, pricing, material costs (bindings S, Q, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from .. import constants as K
from ..operators import clean, materials, prepare, pricing, stats, weights
from . import sqlfrag as S
from .registry import query, r

# --- DuckDB text of the weight model -------------------------------------------------------


def _phase_kind_sql(ph: str) -> str:
    direct = " ".join(f"when {ph} = {S.q(k)} then {S.q(v)}" for k, v in K.PHASE_SPELLINGS.items())
    return (f"(case when {ph} is null or {ph} = '' then 'three' {direct} "
            f"when contains(lower({ph}), 'single') then 'single' when contains(lower({ph}), 'three') then 'three' end)")


def _target_sql(p: str) -> str:
    parts = []
    for bound, t in K.DENSITY_TARGETS:
        parts.append(f"else {t}" if bound is None else f"when {p} <= {bound} then {t}")
    return "(case " + " ".join(parts) + " end)"


def weights_sql(src: str, p="power_rating", a="primary_voltage", b="secondary_voltage", ph="phase",
                jitter: dict | None = None) -> str:
    """A CTE body adding the Q1 columns to ``src`` (``jitter``: component -> SQL factor)."""
    kind = _phase_kind_sql(ph)
    valid = f"({p} > 0 and {a} > 0 and {b} > 0 and {kind} is not null)"
    vf = f"log10(({a} + 0.1) / ({b} + 0.1) + 1)"
    large = f"(case when {p} >= {K.LARGE_THRESHOLD_KVA} then sqrt(log10({p} / {K.LARGE_THRESHOLD_KVA} + 1)) end)"
    ultra = (f"(case when {p} > {K.ULTRA_THRESHOLD_KVA} then 1 - least({K.ULTRA_MAX_REDUCTION}, "
             f"{K.ULTRA_MAX_REDUCTION} * log10({p} / {K.ULTRA_THRESHOLD_KVA} + 1)) end)")
    raw = []
    for name, base, e, lg, vadj, single, ul, _ in K.COMPONENTS:
        w = (f"cast({base} as double) * pow({p} / 1000.0, {e}) * (1 + {vadj} * {vf})"
             f" * (case when {kind} = 'single' then {single} else 1.0 end)"
             f" * coalesce(1 - (1 - {lg}) * {large}, 1.0) * coalesce({ultra} * {ul}, 1.0)")
        if jitter and name in jitter:
            w = f"{w} * {jitter[name]}"
        raw.append(f"case when {valid} then round_even({w}, 0) end as __w_{name}")
    tot = " + ".join(f"__w_{c}" for c in K.COMPONENT_NAMES)
    tgt = _target_sql(p)
    fire = f"({p} > {K.ULTRA_THRESHOLD_KVA} and {p} / ({tot}) < {tgt} * {K.DENSITY_SLACK})"
    fin = [f"case when {fire} then round_even(__w_{c} * (({p} / ({tot})) / {tgt}), 0) else __w_{c} end as {c}_weight"
           for c in K.COMPONENT_NAMES]
    return (f"select *, {', '.join(fin)} from (select *, {', '.join(raw)} from {src}) w0")


SPEC = B.duck_ctes("specs")
W_SQL = SPEC.rstrip() + ",\nweighted as (select * exclude (" + ", ".join(f"__w_{c}" for c in K.COMPONENT_NAMES) + \
    "), " + " + ".join(f"{c}_weight" for c in K.COMPONENT_NAMES) + " as total_weight from (" + \
    weights_sql("specs") + ") w1)\n"
WCOLS = [f"{c}_weight" for c in K.COMPONENT_NAMES] + ["total_weight"]


def weighted(spark, sf):
    return weights.estimate_weights(B.specs(spark, sf))


def _wsel():
    return ", ".join(r(c, c) for c in WCOLS)


# --- Q: weights ----------------------------------------------------------------------------------

@query("weights_estimate", W_SQL + f"select spec_id, {_wsel()} from weighted")
def weights_estimate(spark, sf):
    """Q1 over every spec."""
    return weighted(spark, sf).select("spec_id", *WCOLS)


_RANGE_SRC = "(select spec_id, power_rating, 10.5 as primary_voltage, 0.4 as secondary_voltage, phase from specs)"


@query("weights_ranges", SPEC.rstrip() + ",\nref as (" + weights_sql(_RANGE_SRC) + ")\nselect spec_id, " + ", ".join(
    f"{r(f'round_even({c}_weight * 0.85, 0)', f'{c}_weight_min')}, {r(f'round_even({c}_weight * 1.15, 0)', f'{c}_weight_max')}"
    for c in K.COMPONENT_NAMES) + " from ref")
def weights_ranges(spark, sf):
    """Q2."""
    out = weights.weight_ranges(B.specs(spark, sf))
    return out.select("spec_id", *[f"{c}_weight_{s}" for c in K.COMPONENT_NAMES for s in ("min", "max")])


@query("weights_density", W_SQL + f"""
select spec_id, {r('case when total_weight > 0 then power_rating / total_weight else 0.0 end', 'power_density')}
from weighted""")
def weights_density(spark, sf):
    """Q3."""
    return weights.power_density(weighted(spark, sf)).select("spec_id", "power_density")


@query("weights_distribution", W_SQL + "select spec_id, component, " + r("w", "weight") + ", " +
       r("case when tw > 0 then w / tw * 100 else 0.0 end", "percentage") + " from (" + " union all ".join(
           f"select spec_id, '{c}' as component, {c}_weight as w, total_weight as tw from weighted"
           for c in K.COMPONENT_NAMES) + ") d")
def weights_distribution(spark, sf):
    """Q4 (long form)."""
    return weights.weight_distribution(weighted(spark, sf))


_PHASES = "(case spec_id % 6 when 0 then 'Three-phase' when 1 then 'single' when 2 then 'SINGLE-PHASE' " \
          "when 3 then 'three phase unit' when 4 then null else 'two-phase' end)"


@query("weights_phase", SPEC + f"select spec_id, {_phase_kind_sql(_PHASES)} as phase_kind from specs")
def weights_phase(spark, sf):
    """Q5 over assorted spellings (one unknown spelling -> null = rejected)."""
    df = B.specs(spark, sf).withColumn("p", F.expr(_PHASES))
    return df.select("spec_id", weights.phase_kind(F.col("p")).alias("phase_kind"))


@query("clean_weight_domain", SPEC + f"""
select spec_id, case when power_rating <= 0 then 'Power rating must be positive'
  when primary_voltage <= 0 or secondary_voltage <= 0 then 'Voltage values must be positive'
  when {_phase_kind_sql(_PHASES)} is null then concat('Unknown phase type: ', {_PHASES}) end as reject_reason
from (select spec_id, case when spec_id % 11 = 0 then 0.0 else power_rating end as power_rating,
      primary_voltage, case when spec_id % 13 = 0 then -1.0 else secondary_voltage end as secondary_voltage from specs) s""")
def clean_weight_domain(spark, sf):
    """Reject reasons for bad ratings, voltages and phase spellings."""
    df = (B.specs(spark, sf)
          .withColumn("power_rating", F.expr("case when spec_id % 11 = 0 then 0.0 else power_rating end"))
          .withColumn("secondary_voltage", F.expr("case when spec_id % 13 = 0 then -1.0 else secondary_voltage end"))
          .withColumn("phase", F.expr(_PHASES)))
    return clean.weight_domain_check(df).select("spec_id", "reject_reason")


@query("clean_implausible_weight", W_SQL + """
select spec_id, greatest(core_weight, copper_weight, insulation_weight, tank_weight, oil_weight, total_weight) > 1000000.0
  as implausible_weight from weighted""")
def clean_implausible_weight(spark, sf):
    """C13."""
    return clean.implausible_weight_flag(weighted(spark, sf)).select("spec_id", "implausible_weight")


@query("prepare_weight_features", W_SQL + "select spec_id, " + ", ".join([
    r("power_rating / total_weight", "power_to_weight_ratio"),
    *[r(f"{c}_weight / total_weight * 100", f"{c}_weight_pct") for c in K.COMPONENT_NAMES],
    r("copper_weight / core_weight", "copper_to_core_ratio"),
    r("core_weight + copper_weight + insulation_weight", "active_weight"),
    r("(core_weight + copper_weight + insulation_weight) / total_weight * 100", "active_weight_pct"),
    r("tank_weight + oil_weight", "non_active_weight"),
    r("(tank_weight + oil_weight) / total_weight * 100", "non_active_weight_pct")]) + " from weighted")
def prepare_weight_features(spark, sf):
    """P9."""
    out = prepare.weight_features(weighted(spark, sf))
    return out.select("spec_id", "power_to_weight_ratio", *[f"{c}_weight_pct" for c in K.COMPONENT_NAMES],
                      "copper_to_core_ratio", "active_weight", "active_weight_pct", "non_active_weight",
                      "non_active_weight_pct")


@query("stats_weight_by_rating", W_SQL + "select power_rating, " + ", ".join(
    r(f"avg({c})", f"avg_{c}") for c in WCOLS) + " from weighted group by power_rating")
def stats_weight_by_rating(spark, sf):
    """A4: mean weights per rating."""
    return stats.grouped_means(weighted(spark, sf), "power_rating", WCOLS).select(
        "power_rating", *[F.col(c).alias(f"avg_{c}") for c in WCOLS])


# --- Q7 / Q8 / Q9: pricing -----------------------------------------------------------------------------

def _rule_sql(p="power_rating", a="primary_voltage", b="secondary_voltage", cool="cooling_type", ph="phase"):
    P, A, Bv = (f"coalesce({p}, {K.DEFAULT_RATING_KVA})", f"coalesce({a}, {K.DEFAULT_PRIMARY_KV})",
                f"coalesce({b}, {K.DEFAULT_SECONDARY_KV})")
    base = "(case " + " ".join(
        (f"else {fx} + {P} * {per}" if bd is None else f"when {P} <= {bd} then {fx} + {P} * {per}")
        for bd, fx, per in K.RULE_PRICE_BANDS) + " end)"
    ratio = f"(case when {Bv} > 0 then {A} / {Bv} else 1.0 end)"
    vf = (f"(1.0 + (case when {A} > 33 then 0.1 * ({A} / 33 - 1) else 0.0 end) + "
          f"(case when {ratio} > 10 then 0.05 * ({ratio} / 10 - 1) else 0.0 end))")
    cf = "(case " + " ".join(f"when {cool} = {S.q(k)} then {v}" for k, v in K.COOLING_PRICE_FACTOR) + " else 1.0 end)"
    pf = f"(case when {ph} = 'Single-phase' then {K.SINGLE_PHASE_PRICE_FACTOR} else 1.0 end)"
    return f"{base} * {vf} * {cf} * {pf}"


@query("price_rule", SPEC + f"select spec_id, {r(_rule_sql(), 'rule_price')} from specs")
def price_rule(spark, sf):
    """Q7 for every spec."""
    df = pricing.rule_price(B.specs(spark, sf), "power_rating", "primary_voltage", "secondary_voltage")
    return df.select("spec_id", "rule_price")


BOOK_W = W_SQL.rstrip() + ",\n" + B.duck_ctes("price_book")[len("with "):].rstrip() + ",\n"
COMP_SQL = """comp as (
  select spec_id, component, material, component_order, weight_kg, pb.price, pb.price_date,
    weight_kg / 1000.0 * pb.price as cost_usd
  from (""" + " union all ".join(
    f"select spec_id, '{c}' as component, '{m}' as material, {i} as component_order, "
    f"cast({c}_weight as double) as weight_kg from weighted"
    for i, (c, m) in enumerate(materials.COMPONENT_MATERIAL)) + """) x
  left join price_book pb using (material)
)
"""


def costed(spark, sf):
    return materials.component_costs(weighted(spark, sf), B.price_book(spark))


@query("cost_components", BOOK_W + COMP_SQL + f"""
select spec_id, component, material, {r('weight_kg', 'weight_kg')}, {r('cost_usd', 'cost_usd')}, price_date from comp""")
def cost_components(spark, sf):
    """Each spec's five components priced from the book."""
    return costed(spark, sf).select("spec_id", "component", "material", "weight_kg", "cost_usd", "price_date")


@query("cost_total_rows", BOOK_W + COMP_SQL + f"""
select spec_id, upper(substr(component, 1, 1)) || substr(component, 2) as material, {r('weight_kg', 'weight_kg')},
  {r('cost_usd', 'cost_usd')}, price_date, component_order as row_order from comp
union all
select c.spec_id, 'Total Raw Materials', {r('max(w.total_weight)', 'weight_kg')}, {r('sum(cost_usd)', 'cost_usd')},
  arg_min(price_date, component_order), 5 from comp c join weighted w using (spec_id) group by c.spec_id""")
def cost_total_rows(spark, sf):
    """A10 / Q6: cost table with the total row per spec."""
    return materials.cost_table(weighted(spark, sf), B.price_book(spark))


@query("price_composition", BOOK_W + COMP_SQL + f"""
, pr as (select w.spec_id, w.power_rating, {_rule_sql()} as predicted_price, m.material_cost
         from weighted w join (select spec_id, sum(cost_usd) as material_cost from comp group by spec_id) m using (spec_id)),
t as (select *, (predicted_price - material_cost) / predicted_price * 100 as lop,
        greatest(30.0, (predicted_price - material_cost) / predicted_price * 100 * (1 - log10(power_rating / 5000.0 + 1) * 0.2)) as tgt
      from pr)
select spec_id, {r('material_cost', 'material_cost')}, {r('predicted_price', 'predicted_price')},
  {r('case when power_rating > 5000 then tgt else lop end', 'lop_pct')},
  {r('case when power_rating > 5000 then material_cost * tgt / (100 - tgt) else predicted_price - material_cost end', 'lop_amount')},
  {r('case when power_rating > 5000 then material_cost + material_cost * tgt / (100 - tgt) else predicted_price end', 'final_price')}
from t""")
def price_composition(spark, sf):
    """Q8 on the rule price and the material cost of each spec."""
    costed = materials.spec_costs_wide(weighted(spark, sf), B.price_book(spark))  # the cost stays in the spec's row
    priced = pricing.rule_price(costed, "power_rating", "primary_voltage", "secondary_voltage", out="predicted_price")
    return pricing.price_composition(priced).select("spec_id", "material_cost", "predicted_price", "lop_pct",
                                                    "lop_amount", "final_price")


def _label_sql(noise: str | None = None):
    mat = " + ".join(f"{c}_weight * {rt}" for c, rt in K.LABEL_KG_RATES)
    cool = "(case " + " ".join(f"when cooling_type = {S.q(k)} then {v}" for k, v in K.LABEL_COOLING_ADDER) + " else 0.0 end)"
    loc = "(case " + " ".join(f"when manufacturing_location = {S.q(k)} then {v}" for k, v in K.LOCATION_FACTORS) + " end)"
    adders = (f"efficiency * {K.LABEL_EFFICIENCY_RATE} + {cool} + (case when tap_changer then {K.LABEL_TAP_ADDER} else 0.0 end)"
              f" + (case when phase = 'Three-phase' then {K.LABEL_THREE_PHASE_ADDER} else 0.0 end)"
              f" + (case when insulation_type = 'Dry' then {K.LABEL_DRY_ADDER} else 0.0 end)")
    raw = f"(power_rating * {K.LABEL_PER_KVA} + (0.0 + {mat}) + ({adders})) * {loc}"
    if noise:
        raw = f"{raw} * (1 + {noise})"
    return f"round_even({raw}, 0)"


@query("price_label", W_SQL + f"select spec_id, {r(_label_sql(), 'price')} from weighted")
def price_label(spark, sf):
    """Q9 without noise."""
    return pricing.label_price(weighted(spark, sf)).select("spec_id", "price")


# --- J3 / J5 / Q10 / S5: materials -----------------------------------------------------------------------

BOM_SQL = B.duck_ctes("bom", "price_book")


def _resolve_sql():
    contains = ("(select x.name, arg_min(pb.material, pb.book_order) as m from (select distinct material as name from bom) x "
                "join price_book pb on instr(x.name, pb.material) > 0 group by x.name)")
    rule = "(case " + " ".join(
        "when " + " or ".join(f"instr(b.material, '{w}') > 0" for w in words) + f" then '{t}'"
        for words, t in K.MATERIAL_KEYWORD_RULES) + f" else '{K.MATERIAL_FALLBACK}' end)"
    return f"""
select b.l_orderkey, b.l_linenumber, b.l_partkey, b.material, b.weight_kg,
  coalesce(e.material, c.m, {rule}) as resolved_material
from bom b left join price_book e on e.material = b.material left join {contains} c on c.name = b.material"""


@query("cost_fuzzy_material", BOM_SQL + f"""
select r.l_orderkey, r.l_linenumber, r.l_partkey, r.material, r.resolved_material,
  {r('r.weight_kg / 1000.0 * pb.price', 'cost_usd')}
from ({_resolve_sql()}) r join price_book pb on pb.material = r.resolved_material""")
def cost_fuzzy_material(spark, sf):
    """Free-text material names resolved against the book, then costed."""
    out = materials.resolve_materials(B.bom(spark, sf), B.price_book(spark))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "material", "resolved_material",
                      (F.col("weight_kg") / 1000.0 * F.col("price")).alias("cost_usd"))


QUOTE_SQL = B.duck_ctes("quotes")


@query("cost_price_priority", QUOTE_SQL + f"""
select material, {r('price', 'price')}, unit, price_date, feed, quote_id, n_quotes from (
  select *, row_number() over (partition by material order by
      case feed when 'api' then 0 when 'web' then 1 when 'default' then 2 else 99 end, price_date desc, quote_id desc) as rn,
    count(*) over (partition by material) as n_quotes
  from quotes) t where rn = 1""")
def cost_price_priority(spark, sf):
    """Best quote per material by feed priority, then recency."""
    return materials.merge_price_feeds(B.quotes(spark, sf))


@query("cost_staleness", QUOTE_SQL + """
select material, price_date, cast(date_diff('day', price_date, date '1998-08-01') as integer) as age_days,
  coalesce(date_diff('day', price_date, date '1998-08-01') >= 2, true) as is_stale from (
  select material, max(price_date) as price_date from quotes group by material) t""")
def cost_staleness(spark, sf):
    """Q10: age of the latest quote per material at a fixed as-of date."""
    latest = B.quotes(spark, sf).groupBy("material").agg(F.max("price_date").alias("price_date"))
    return materials.staleness(latest, "1998-08-01").select("material", "price_date", "age_days", "is_stale")


# --- C10 / C11 / P5 / P10: spec validation and normalisation -----------------------------------------------

_TEXT_RATING = ("case when spec_id % 5 = 0 then null when spec_id % 5 = 1 then concat(cast(cast(power_rating as bigint) as {S}), ' KVA') "
                "when spec_id % 5 = 2 then 'n/a' else cast(cast(power_rating as bigint) as {S}) end")


_NUM = "try_cast(trim(replace(replace(replace(tr, ',', ''), 'KVA', ''), 'kV', '')) as double)"


@query("prepare_validate", SPEC + f"""
select spec_id, {r(f"coalesce({_NUM}, 1000.0)", 'power_rating_kva')}, 5 as n_warnings,
  case when tr is null then 'Missing power_rating_kva: using default 1000.0 KVA'
       when {_NUM} is null then concat('Invalid power_rating_kva value ', chr(39), tr, chr(39), ': using default 1000.0 KVA')
       else concat('Converted power_rating_kva from ', chr(39), tr, chr(39), ' to ', cast({_NUM} as varchar)) end
  as rating_warning
from (select spec_id, {_TEXT_RATING.format(S='varchar')} as tr from specs) s""")
def prepare_validate(spark, sf):
    """Defaults + text-number parsing; the warnings raised per spec."""
    df = B.specs(spark, sf).select("spec_id", F.expr(_TEXT_RATING.format(S="string")).alias("power_rating_kva"))
    out = clean.validate_specs(df)
    return out.select("spec_id", "power_rating_kva", F.size("warnings").alias("n_warnings"),
                      F.col("warnings")[0].alias("rating_warning"))


@query("clean_strict_specs", SPEC + f"""
select spec_id, case when tr is null then 'missing field power_rating_kva'
  when try_cast(tr as double) is null then 'non-numeric power_rating_kva' end as reject_reason
from (select spec_id, {_TEXT_RATING.format(S='varchar')} as tr from specs) s""")
def clean_strict_specs(spark, sf):
    """C11: reject reasons (missing / non-numeric) instead of aborting the job."""
    df = B.specs(spark, sf).select("spec_id", F.expr(_TEXT_RATING.format(S="string")).alias("power_rating_kva"),
                                   "primary_voltage", "secondary_voltage", "phase", "installation_type")
    df = df.withColumnsRenamed({"primary_voltage": "primary_voltage_kv", "secondary_voltage": "secondary_voltage_kv",
                                "installation_type": "type"})
    return clean.strict_spec_check(df).select("spec_id", "reject_reason")


@query("prepare_bridge", SPEC + """
select spec_id, power_rating as power_rating_kva, primary_voltage as primary_voltage_kv,
  secondary_voltage as secondary_voltage_kv,
  case when lower(ph) in ('three', '3', 'three phase', '3-phase') then 'Three-phase'
       when lower(ph) in ('single', '1', 'single phase', '1-phase') then 'Single-phase' else ph end as phase,
  case installation_type when 'Indoor' then 'Power' when 'Outdoor' then 'Power' when 'Pad Mounted' then 'Distribution'
       when 'Pole Mounted' then 'Distribution' else 'Power' end as type,
  cooling_type, cast(frequency as double) as frequency_hz, tap_changer
from (select *, case spec_id % 4 when 0 then 'three' when 1 then '1' when 2 then 'Single-phase' else '3-phase' end as ph from specs) s""")
def prepare_bridge(spark, sf):
    """P5: application field names and spellings -> model fields."""
    df = B.specs(spark, sf).withColumn(
        "phase", F.expr("case spec_id % 4 when 0 then 'three' when 1 then '1' when 2 then 'Single-phase' else '3-phase' end"))
    df = df.select("spec_id", "power_rating", "primary_voltage", "secondary_voltage", "phase", "installation_type",
                   "cooling_type", F.col("frequency").cast("double").alias("frequency"), "tap_changer")
    return prepare.bridge_fields(df)


@query("prepare_normalise", SPEC + f"""
select spec_id, coalesce(lower(tc) <> 'none', false) as tap_changer,
  {r('case when eff > 1 then eff / 100 else eff end', 'efficiency')}
from (select spec_id, case when spec_id % 3 = 0 then 'OLTC' when spec_id % 3 = 1 then 'None' end as tc,
      case when spec_id % 2 = 0 then efficiency * 100 else efficiency end as eff from specs) s""")
def prepare_normalise(spark, sf):
    """P10: tap changer text -> boolean, percent efficiency -> fraction."""
    df = B.specs(spark, sf).select(
        "spec_id", F.expr("case when spec_id % 3 = 0 then 'OLTC' when spec_id % 3 = 1 then 'None' end").alias("tap_changer"),
        F.expr("case when spec_id % 2 = 0 then efficiency * 100 else efficiency end").alias("efficiency"))
    return prepare.normalise_spec_flags(df)


_MODEL_PRICE = "case when spec_id % 4 = 0 then null else quoted_price end"


@query("price_fallback", SPEC + f"""
select spec_id, {r(_MODEL_PRICE, 'predicted_price')},
  {r(f"coalesce({_MODEL_PRICE}, {_rule_sql()})", 'final_price')},
  case when {_MODEL_PRICE} is null then 'rule' else 'model' end as price_source from specs""")
def price_fallback(spark, sf):
    """The rule price (Q7) wherever no model price exists, with its provenance."""
    from ..operators import models
    df = B.specs(spark, sf).withColumn("predicted_price", F.expr(_MODEL_PRICE))
    out = models.with_rule_fallback(df, "predicted_price", rating="power_rating", v1="primary_voltage",
                                    v2="secondary_voltage")
    return out.select("spec_id", "predicted_price", "final_price", "price_source")


@query("stats_density_box_by_rating", W_SQL + f"""
, b as (select power_rating, case when total_weight > 0 then power_rating / total_weight else 0.0 end as v from weighted),
q as (select power_rating, quantile_cont(v, 0.25) as q1, median(v) as med, quantile_cont(v, 0.75) as q3
      from b group by power_rating),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lf, q3 + 1.5 * (q3 - q1) as uf from q)
select f.power_rating, {r('q1', 'q1')}, {r('med', 'median')}, {r('q3', 'q3')}, {r('iqr', 'iqr')},
  {r('lf', 'lower_fence')}, {r('uf', 'upper_fence')},
  {r('min(case when v >= lf and v <= uf then v end)', 'whisker_low')},
  {r('max(case when v >= lf and v <= uf then v end)', 'whisker_high')},
  count(*) filter (where not (v >= lf and v <= uf)) as outliers, count(*) as n
from b join f on b.power_rating = f.power_rating group by f.power_rating, q1, med, q3, iqr, lf, uf""")
def stats_density_box_by_rating(spark, sf):
    """A14 of power density (kVA per kg, Q3) per rating: the weight box plot's numbers."""
    return stats.box_stats(weights.power_density(weighted(spark, sf)), "power_density", ["power_rating"])
