"""Deterministic per-row random numbers from a BIGINT key.

``rand()`` depends on partitioning, so nothing compared across engines may use
it.  Instead each (key, stream) pair goes through integer arithmetic that means
the same in Spark and DuckDB (all intermediates stay below 2^63):

    x0 = ((id mod 1e11) * 48271 + c0) mod M,  x = (x * x + c_k) mod M twice,
    u  = x / M                                 with M = 2^31 - 1

The stream constants are derived from the stream number by a fixed rule and
folded into literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647
ID_MOD = 100000000000


def _consts(stream: int) -> tuple[int, int, int]:
    return ((stream * 7919 + 12345) % M, (stream * 104729 + 54321) % M, (stream * 1299709 + 99991) % M)


def _state(idc: Column, stream: int) -> Column:
    c0, c1, c2 = _consts(stream)
    x = ((idc.cast("bigint") % F.lit(ID_MOD)) * F.lit(48271) + F.lit(c0)) % F.lit(M)
    x = (x * x + F.lit(c1)) % F.lit(M)
    x = (x * x + F.lit(c2)) % F.lit(M)
    return x


def uniform(idc, stream: int) -> Column:
    """U[0, 1)."""
    idc = F.col(idc) if isinstance(idc, str) else idc
    return _state(idc, stream).cast("double") / F.lit(float(M))


def uniform_open(idc, stream: int) -> Column:
    """U(0, 1] (safe under a logarithm)."""
    idc = F.col(idc) if isinstance(idc, str) else idc
    return (_state(idc, stream) + 1).cast("double") / F.lit(float(M) + 1.0)


def between(idc, stream: int, lo: float, hi: float) -> Column:
    return F.lit(lo) + uniform(idc, stream) * F.lit(hi - lo)


def normal(idc, stream: int, sd: float = 1.0) -> Column:
    """N(0, sd) by Box-Muller from streams ``stream`` and ``stream + 1``."""
    return F.lit(sd) * F.sqrt(-2.0 * F.log(uniform_open(idc, stream))) * F.cos(
        2 * math.pi * uniform(idc, stream + 1))


def choice(idc, stream: int, values: list) -> Column:
    """Uniform choice from a fixed list."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(uniform(idc, stream) * len(values)) + 1).cast("int"))


def weighted_choice(idc, stream: int, values: list, probs: list[float]) -> Column:
    u = uniform(idc, stream)
    expr, acc = None, 0.0
    for v, p in zip(values[:-1], probs[:-1]):
        acc += p
        expr = F.when(u < acc, F.lit(v)) if expr is None else expr.when(u < acc, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


# --- the same in DuckDB SQL ------------------------------------------------------------------

def sql_state(idc: str, stream: int) -> str:
    c0, c1, c2 = _consts(stream)
    x = f"((cast({idc} as bigint) % {ID_MOD}) * 48271 + {c0}) % {M}"
    x = f"(({x}) * ({x}) + {c1}) % {M}"
    return f"(({x}) * ({x}) + {c2}) % {M}"


def sql_uniform(idc: str, stream: int) -> str:
    return f"(cast({sql_state(idc, stream)} as double) / {float(M)})"


def sql_uniform_open(idc: str, stream: int) -> str:
    return f"(cast({sql_state(idc, stream)} + 1 as double) / {float(M) + 1.0})"


def sql_between(idc: str, stream: int, lo: float, hi: float) -> str:
    return f"({lo} + {sql_uniform(idc, stream)} * {hi - lo})"


def sql_normal(idc: str, stream: int, sd: float = 1.0) -> str:
    return (f"({sd} * sqrt(-2.0 * ln({sql_uniform_open(idc, stream)})) * "
            f"cos({2 * math.pi} * {sql_uniform(idc, stream + 1)}))")


def _lit_sql(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"cast({v!r} as double)" if isinstance(v, float) else repr(v)


def sql_choice(idc: str, stream: int, values: list) -> str:
    arr = "[" + ", ".join(_lit_sql(v) for v in values) + "]"
    return f"({arr})[cast(floor({sql_uniform(idc, stream)} * {len(values)}) as integer) + 1]"


def sql_weighted_choice(idc: str, stream: int, values: list, probs: list[float]) -> str:
    u = sql_uniform(idc, stream)
    parts, acc = [], 0.0
    for v, p in zip(values[:-1], probs[:-1]):
        acc += p
        parts.append(f"when {u} < {acc!r} then {_lit_sql(v)}")
    return "(case " + " ".join(parts) + f" else {_lit_sql(values[-1])} end)"
