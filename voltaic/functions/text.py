"""Column -> Column parsers for listing text.

All are built-in Spark expressions (regexp_extract / rlike / contains / try_cast),
so they stay inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def compute_once(df, cols: dict):
    """Add ``cols`` so each expression is evaluated exactly once per row.

    Catalyst copies an aliased expression into every pushed-down filter that
    references it and does not share work across CASE / OR branches, so an
    expensive parse can run many times per row.  Columns produced by a generator
    (``inline`` of a one-element array) are opaque to filter pushdown: the
    expressions run once, in the Generate, and filters stay above it."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_re(s: str) -> str:
    """Escape a literal so it can sit inside a Java regex alternation."""
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/-" else ch for ch in s)


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract, with no-match mapped to null instead of ''.  Only valid
    when the group cannot match the empty string (true for every pattern here)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _try_double(c: Column) -> Column:
    return c.try_cast("double")


def contains_any(text: Column, needles: list[str]) -> Column:
    """True when any literal substring occurs (plain substring semantics)."""
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


# --- C2 / X10 / X11: prices and numbers ------------------------------------

def parse_price(c) -> Column:
    """Strip ``$``, commas and whitespace, then a double; else null."""
    return _try_double(F.regexp_replace(_col(c), r"[$,\s]", ""))


def first_number(c) -> Column:
    """First run of digits/commas with an optional fraction, commas removed."""
    t = _col(c)
    raw = F.regexp_extract(t, K.FIRST_NUMBER_PATTERN, 1)
    return _try_double(F.regexp_replace(raw, ",", ""))


def first_number_is_bad(c) -> Column:
    """True when X10 finds a token that does not parse (the scraper drops such rows)."""
    t = _col(c)
    raw = F.regexp_extract(t, K.FIRST_NUMBER_PATTERN, 1)
    return F.coalesce((raw != "") & _try_double(F.regexp_replace(raw, ",", "")).isNull(), F.lit(False))


def price_in_text(c) -> Column:
    """X11: keep only digits, dots and commas, then X10."""
    return first_number(F.regexp_replace(_col(c), r"[^\d.,]", ""))


# --- C3: quantity -----------------------------------------------------------

def parse_quantity(c) -> Column:
    """Leading digits of the trimmed text; null or no digits -> 1."""
    t = _col(c)
    digits = F.regexp_extract(F.trim(t.cast("string")), r"^(\d+)", 1)  # no match: try_cast gives null
    return F.coalesce(digits.try_cast("bigint"), F.lit(1).cast("bigint"))


# --- X1 / X3 / X4: power rating ----------------------------------------------

# Substrings each pattern cannot match without (upper-cased text).  A cheap
# contains() test skips the regex scan on rows that cannot match; results are
# unchanged because the guard is a necessary condition of the pattern.
_KVA_GUARDS = ["KVA", "K", "KILO"]
_MVA_GUARDS = ["MVA", "M", "MEGA"]
_VOLTAGE_GUARDS = [["KV"], ["/"], ["KV", "TO"]]


def _guarded(t: Column, needles: list[str], expr: Column) -> Column:
    cond = None
    for n in needles:
        c = t.contains(n)
        cond = c if cond is None else cond & c
    return F.when(cond, expr)


def rating_kva(c, cased: bool = False) -> Column:
    """First KVA pattern hit (upper-cased text), else first MVA hit x 1000.
    ``cased=True``: ``c`` is already upper-cased."""
    t = _col(c) if cased else F.upper(_col(c))
    # try_cast('' as double) is null, so no-match needs no nullif (which would
    # evaluate the regex twice)
    hits = [_guarded(t, [g], _try_double(F.regexp_extract(t, p, 1))) for p, g in zip(K.KVA_PATTERNS, _KVA_GUARDS)]
    hits += [_guarded(t, [g], _try_double(F.regexp_extract(t, p, 1)) * F.lit(1000.0))
             for p, g in zip(K.MVA_PATTERNS, _MVA_GUARDS)]
    return F.coalesce(*hits)


# lower-cased text that the loose patterns cannot match without, in their order
_LOOSE_GUARDS = ["kva", "k", "kilo", "kilo", "mva", "m", "mega", "mega"]


def loose_rating_token(c, cased: bool = False) -> Column:
    """``<number text>|<scale>`` of the first pattern that hits, else null.  Each pattern
    is tried once, and only where its letters occur."""
    t = _col(c) if cased else F.lower(_col(c))
    patterns = [(p, "1") for p in K.KVA_PATTERNS_LOOSE] + [(p, "1000") for p in K.MVA_PATTERNS_LOOSE]
    return F.coalesce(*[_guarded(t, [g], F.concat(F.try_element_at(F.regexp_extract_all(t, F.lit(p), 1), F.lit(1)), F.lit("|" + scale)))
                        for (p, scale), g in zip(patterns, _LOOSE_GUARDS)])


def loose_rating_of(token: Column) -> Column:
    """The rating of a token; null if its number does not parse."""
    return _try_double(F.replace(F.split_part(token, F.lit("|"), F.lit(1)), F.lit(","), F.lit(""))) * \
        F.split_part(token, F.lit("|"), F.lit(2)).cast("double")


def rating_kva_loose(c, cased: bool = False) -> Column:
    """Scraper variant (lower-cased, commas allowed). The first pattern that
    hits decides; its number must parse, else null (see ``rating_kva_loose_bad``)."""
    return loose_rating_of(loose_rating_token(c, cased))


def rating_kva_loose_bad(c, cased: bool = False) -> Column:
    """True when the deciding X3 pattern hit a number that does not parse."""
    token = loose_rating_token(c, cased)
    return token.isNotNull() & loose_rating_of(token).isNull()


def rating_kva_int(c) -> Column:
    """Integer part before KVA; an MVA hit overrides it (x 1000)."""
    t = _col(c)
    kva = F.regexp_extract(t, r"(\d+)(?:\.\d+)?\s*(?:KVA|kVA|kva)", 1).try_cast("double")
    mva = F.regexp_extract(t, r"(\d+)(?:\.\d+)?\s*(?:MVA|mva)", 1).try_cast("double") * F.lit(1000.0)
    return F.coalesce(mva, kva)


# --- X5: voltages ---------------------------------------------------------------

def voltages(c, cased: bool = False) -> Column:
    """struct(primary_kv, secondary_kv) from the first voltage pattern that hits.
    Secondary in volts is scaled to kV; the primary is never rescaled.  The text
    is scanned once per pattern (whole match); groups are read from the match."""
    t = _col(c) if cased else F.upper(_col(c))
    prim, sec = None, None
    for p, guards in reversed(list(zip(K.VOLTAGE_PATTERNS, _VOLTAGE_GUARDS))):
        m = F.coalesce(_guarded(t, guards, F.regexp_extract(t, p, 0)), F.lit(""))
        hit = m != ""
        p_val = _try_double(F.regexp_extract(m, p, 1))
        s_raw = _try_double(F.regexp_extract(m, p, 2))
        s_val = F.when(F.regexp_extract(m, p, 3) == "V", s_raw / F.lit(1000.0)).otherwise(s_raw)
        prim = F.when(hit, p_val) if prim is None else F.when(hit, p_val).otherwise(prim)
        sec = F.when(hit, s_val) if sec is None else F.when(hit, s_val).otherwise(sec)
    return F.struct(prim.alias("primary_kv"), sec.alias("secondary_kv"))


# --- C7 / C8: equipment predicates ------------------------------------------------

def is_equipment(c, whole_word: bool = False, cased: bool = False) -> Column:
    """No exclude keyword and at least one include keyword (lower-cased
    substring match); null text -> false.  ``whole_word`` matches on word bounds."""
    t = _col(c) if cased else F.lower(_col(c))
    if whole_word:
        excl = t.rlike(r"\b(" + "|".join(_lit_re(k) for k in K.EQUIPMENT_EXCLUDE) + r")\b")
        incl = t.rlike(r"\b(" + "|".join(_lit_re(k.strip()) for k in K.EQUIPMENT_INCLUDE) + r")\b")
    else:
        # plain substring tests: ~4x faster than one alternation regex
        excl = contains_any(t, K.EQUIPMENT_EXCLUDE)
        incl = contains_any(t, K.EQUIPMENT_INCLUDE)
    return F.coalesce(~excl & incl, F.lit(False))


def is_equipment_loose(c, cased: bool = False) -> Column:
    """The text mentions 'transformer' (all other scraper keywords contain it)."""
    t = _col(c) if cased else F.lower(_col(c))
    return F.coalesce(t.contains(K.SCRAPER_KEYWORD), F.lit(False))


# --- X7 / X8 / X9: phase, type, frequency ------------------------------------------

def phase_from_text(c, cased: bool = False) -> Column:
    t = _col(c) if cased else F.lower(_col(c))
    return (F.when(contains_any(t, K.SINGLE_PHASE_TERMS), F.lit("Single-phase"))
            .when(contains_any(t, K.THREE_PHASE_TERMS), F.lit("Three-phase"))
            .when(contains_any(t, K.THREE_PHASE_HINTS), F.lit("Three-phase")))


def type_from_text(c, cased: bool = False) -> Column:
    raw = _col(c)
    t = raw if cased else F.lower(raw)
    expr = F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string"))
    for key, label in K.TYPE_KEYWORDS:
        expr = expr.when(t.contains(key), F.lit(label))
    return expr.otherwise(F.lit(K.DEFAULT_TYPE))


def frequency_from_text(c, cased: bool = False) -> Column:
    raw = _col(c)
    t = raw if cased else F.lower(raw)
    hz = _try_double(F.regexp_extract(t, K.FREQUENCY_PATTERN, 1))
    regional = F.when(contains_any(t, K.SIXTY_HZ_HINTS), F.lit(60.0)).otherwise(F.lit(50.0))
    return F.when(raw.isNull() | (raw == ""), F.lit(None).cast("double")).otherwise(
        F.coalesce(hz, regional))


# --- X12: destination from URL -------------------------------------------------------

def destination_from_url(c) -> Column:
    u = _col(c)
    name = _extract(u, K.DESTINATION_URL_PATTERN)
    return F.initcap(F.replace(name, F.lit("-"), F.lit(" ")))


# --- C10 helpers -------------------------------------------------------------------

def spec_number(c) -> Column:
    """Text number as the spec validator reads it: drop ',', 'KVA', 'kV', trim."""
    t = _col(c).cast("string")
    for tok in [",", "KVA", "kV"]:
        t = F.replace(t, F.lit(tok), F.lit(""))
    return _try_double(F.trim(t))
