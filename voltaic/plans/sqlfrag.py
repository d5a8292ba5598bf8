"""DuckDB SQL fragments for the oracle side of ``oracle_sql()``.

These are an independent, plain-SQL statement of each operator's semantics,
generated from the same fixed values as the Spark operators.
"""

from __future__ import annotations

from .. import constants as K


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_any(expr: str, needles) -> str:
    return "(" + " or ".join(f"contains({expr}, {q(n)})" for n in needles) + ")"


def extract(expr: str, pattern: str, group: int = 1) -> str:
    """null when no match (DuckDB returns '' like Spark)."""
    return f"(case when regexp_matches({expr}, {q(pattern)}) then regexp_extract({expr}, {q(pattern)}, {group}) end)"


def initcap(expr: str) -> str:
    """Spark's initcap (first letter of each space-separated word upper, rest lower)."""
    return (f"array_to_string(list_transform(string_split(lower({expr}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def try_double(expr: str) -> str:
    return f"try_cast({expr} as double)"


def parse_price(expr: str) -> str:
    return try_double(f"regexp_replace({expr}, '[$,\\s]', '', 'g')")


def parse_quantity(expr: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(trim({expr}), '^(\\d+)', 1), '') as bigint), 1)"


def rating_kva(expr: str) -> str:
    u = f"upper({expr})"
    hits = [try_double(extract(u, p)) for p in K.KVA_PATTERNS]
    hits += [f"{try_double(extract(u, p))} * 1000.0" for p in K.MVA_PATTERNS]
    return "coalesce(" + ", ".join(hits) + ")"


def voltage(expr: str, which: str) -> str:
    u = f"upper({expr})"
    parts = []
    for p in K.VOLTAGE_PATTERNS:
        if which == "primary":
            val = try_double(f"regexp_extract({u}, {q(p)}, 1)")
        else:
            raw = try_double(f"regexp_extract({u}, {q(p)}, 2)")
            val = f"(case when regexp_extract({u}, {q(p)}, 3) = 'V' then {raw} / 1000.0 else {raw} end)"
        parts.append(f"when regexp_matches({u}, {q(p)}) then {val}")
    return "(case " + " ".join(parts) + " end)"


def is_equipment(expr: str) -> str:
    lo = f"lower({expr})"
    return (f"coalesce(not {contains_any(lo, K.EQUIPMENT_EXCLUDE)} and "
            f"{contains_any(lo, K.EQUIPMENT_INCLUDE)}, false)")


def phase(expr: str) -> str:
    lo = f"lower({expr})"
    return (f"(case when {contains_any(lo, K.SINGLE_PHASE_TERMS)} then 'Single-phase' "
            f"when {contains_any(lo, K.THREE_PHASE_TERMS)} then 'Three-phase' "
            f"when {contains_any(lo, K.THREE_PHASE_HINTS)} then 'Three-phase' end)")


def type_(expr: str) -> str:
    lo = f"lower({expr})"
    whens = " ".join(f"when contains({lo}, {q(k)}) then {q(v)}" for k, v in K.TYPE_KEYWORDS)
    return f"(case when {expr} is null or {expr} = '' then null {whens} else {q(K.DEFAULT_TYPE)} end)"


def frequency(expr: str) -> str:
    lo = f"lower({expr})"
    hz = try_double(extract(lo, K.FREQUENCY_PATTERN))
    return (f"(case when {expr} is null or {expr} = '' then null else coalesce({hz}, "
            f"case when {contains_any(lo, K.SIXTY_HZ_HINTS)} then 60.0 else 50.0 end) end)")


CLEAN_LISTINGS = f"""
clean_listings as (
  select *, case when quantity_int > 1 and price0 is not null then price0 / quantity_int else price0 end as unit_price_usd,
         price0 as original_unit_price_usd
  from (
    select *, {parse_quantity('quantity')} as quantity_int
    from (
      select *, {parse_price('unit_price')} as price0,
        {rating_kva('description')} as power_rating_kva,
        {voltage('description', 'primary')} as primary_voltage_kv,
        {voltage('description', 'secondary')} as secondary_voltage_kv,
        {is_equipment('description')} as is_transformer,
        'Real (Market)' as data_source
      from listings
    ) a where is_transformer
  ) b
  where power_rating_kva is not null and power_rating_kva >= {K.MIN_POWER_RATING}
)
"""

# all listing rows with the parsed columns, rejected ones included
PARSED_LISTINGS = f"""
parsed_listings as (
  select *, case when quantity_int > 1 and price0 is not null then price0 / quantity_int else price0 end as unit_price_usd,
         price0 as original_unit_price_usd
  from (
    select *, {parse_quantity('quantity')} as quantity_int, {parse_price('unit_price')} as price0,
      {rating_kva('description')} as power_rating_kva,
      {voltage('description', 'primary')} as primary_voltage_kv,
      {voltage('description', 'secondary')} as secondary_voltage_kv,
      {is_equipment('description')} as is_transformer
    from listings
  ) a
)
"""
