"""Whitening and exact top-k search against plain arithmetic."""

import collections
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from helpers import EXTRA, SF

from voltaic.llm import queries, topk_search, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_vectors(spark, repeat=1):
    """Nulls, odd components, shorter and empty vectors, ties, repeated rows."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 20)], 0) for i in range(-20, 60)]
    rows += [(40, rows[3][1], 1), (40, rows[3][1], 1), (400, [0.5] * 20, 1), (401, [0.5] * 20, 1), (420, [0.25] * 3, 0), (421, [], 0)]
    rows += [(60, None, 0), (80, [1.0, None], 0), (100, [NAN] * 20, 0), (120, [INF, 1.0], 0), (None, [0.1] * 20, 0), (140, [1e30], 0)]
    df = spark.createDataFrame(rows * repeat, SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})
    return rows * repeat, df.repartition(3)


def numbers(vector):
    """floor(64 c) of a vector that takes part, else None."""
    if vector is None or any(c is None or not math.isfinite(np.float32(c)) or abs(64 * float(np.float32(c))) >= 2 ** 62 for c in vector):
        return None
    return [math.floor(64 * float(np.float32(c))) for c in vector]


def top_brute(rows, k, step):
    known = [(i, v) for i, v in ((r[0], numbers(r[1])) for r in rows) if i is not None and v is not None]
    out = []
    for at, (i, q) in enumerate(known):
        if i % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for other, (j, c) in enumerate(known) if other != at)
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"tile_rows": 7, "block_queries": 3}, {"tile_rows": 16, "task_pairs": 50}])
def test_op13_equals_brute_force_on_odd_vectors(spark, options):
    rows, df = odd_vectors(spark)
    got = sorted(tuple(r) for r in topk_search.top_k(df, k=9, query_step=20, **options).collect())
    assert got == top_brute(rows, 9, 20)


def test_op13_ties_few_candidates_and_empty_table(spark):
    rows = [(i, [0.5, 0.5], 0) for i in (0, 7, 3, 3, 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in topk_search.top_k(df, k=3, query_step=20).collect()) == top_brute(rows, 3, 20)
    assert sorted(tuple(r) for r in topk_search.top_k(df, k=30, query_step=20).collect()) == top_brute(rows, 30, 20)
    assert topk_search.top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [3e15, 1.0], 0), (1, [2e15, 1.0], 0), (2, [-3e15, 2.0], 0), (3, [0.125, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.score for r in topk_search.top_k(huge).collect()}
    assert got == {1: 2 ** 63 - 1, 3: 64 * 8 * 3 * 10 ** 15 + 64 * 128, 2: -2 ** 63}


def test_op13_bounds_leave_out_pairs_and_lose_none():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 20, (30, 64))
    x = np.rint(centres[rng.integers(0, 30, 3000)] + rng.normal(0, 4, (3000, 64))).astype(np.int64)
    best = topk_search.Best(np.arange(100), np.arange(100), x[:100].T, 20)
    seen = []
    plain = topk_search.Best._bounded

    def counted(self, *a):
        out = plain(self, *a)
        seen.append(len(out[0]))
        return out
    topk_search.Best._bounded = counted
    try:
        for a in range(0, 3000, 500):
            best.meet(np.arange(a, a + 500), np.arange(a, a + 500), x[a:a + 500].T)
    finally:
        topk_search.Best._bounded = plain
    scores = x[:100] @ x.T
    scores[np.arange(100), np.arange(100)] = -10 ** 9
    want = np.lexsort((np.broadcast_to(np.arange(3000), scores.shape), -scores), axis=1)[:, :20]
    assert (best.found == want).all()
    assert sum(seen) < 0.15 * scores.size


def test_op12_equals_exact_arithmetic(spark):
    d = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in d.embedding], object)
    n, dims = x.shape
    s = x.sum(0)
    want = np.array([[float(Fraction(int(n * (x[:, i] * x[:, j]).sum() - s[i] * s[j]), n * n)) for j in range(dims)] for i in range(dims)])
    got = queries.op12_whitening(spark, SF).toPandas()
    assert len(got) == n * 32 and set(got.component) == set(range(1, 33)) and (got.n == n).all()
    values = np.sort(np.linalg.eigvalsh(want))[::-1]
    per = got.drop_duplicates("component").sort_values("component")
    assert np.allclose(per.explained, values[:32] / np.trace(want), rtol=1e-9)
    deviation = {i: int(v) for i, v in zip(d.vec_id, ((n * x - s) ** 2).sum(1))}
    assert all(deviation[i] == v for i, v in zip(got.vec_id, got.deviation))
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[d.vec_id].to_numpy()
    error = np.abs(np.cov(w.T, bias=True) - np.eye(32)).max()
    assert error < 1e-9 and (got.identity_error < 1e-9).all()
    # the components are eigenvectors: undoing the scale gives rows that V stretches by e
    centred = (x * n - s).astype(float) / n
    vectors = np.linalg.lstsq(centred, w * np.sqrt(values[:32]), rcond=None)[0]
    assert np.allclose(want @ vectors, vectors * values[:32], atol=1e-6)


def test_op12_odd_vectors_empty_table_and_no_variance(spark):
    rows, df = odd_vectors(spark, 2)
    valid = [(r[0], numbers(r[1])) for r in rows if numbers(r[1]) is not None]
    x = np.array([[c + 1_000_000 for c in v] + [1_000_000] * (20 - len(v)) for _, v in valid], object)
    n, s = len(x), x.sum(0)
    got = whitening.whitened_rows(df).collect()
    assert collections.Counter(r.vec_id for r in got) == collections.Counter(i for i, _ in valid for _ in range(20))
    assert collections.Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == \
        collections.Counter((i, int(v)) for (i, _), v in zip(valid, ((n * x - s) ** 2).sum(1)))
    assert max(r.identity_error for r in got) < 1e-9
    assert whitening.whitened_rows(df.limit(0)).count() == 0
    assert whitening.whitened_rows(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], SCHEMA)).count() == 0
    line = spark.createDataFrame([(1, [0.5, 0.25, 3.0], 0), (2, [1.0, 0.25, 4.0], 0)], SCHEMA)
    assert [(r.component, round(r.explained, 9)) for r in whitening.whitened_rows(line).collect()] == [(1, 1.0), (1, 1.0)]


def test_op12_bit_sliced_scatter_is_exact_at_any_size(spark):
    rng = np.random.default_rng(2)
    for top in (1, 77, 10 ** 6, 10 ** 15):
        y = rng.integers(0, top + 1, (130, 5))
        bits = [int(c).bit_length() for c in y.max(0)]
        found = {(d, e): v for d, e, v in whitening.weighted(whitening.joint_counts(whitening.planes(y, bits)), bits)}
        big = y.astype(object)
        assert found == {**{(d, -1): int(big[:, d].sum()) for d in range(5)},
                         **{(d, e): int((big[:, d] * big[:, e]).sum()) for d in range(5) for e in range(d, 5)}}
    wide = spark.createDataFrame([(i, [float(1e14 * math.sin(i)), float(1e14 * math.cos(3 * i))], 0) for i in range(50)], "vec_id long, embedding array<double>, label int")
    model = whitening.fit(wide, 32)
    x = np.array([[math.floor(64 * 1e14 * math.sin(i)) + 1_000_000, math.floor(64 * 1e14 * math.cos(3 * i)) + 1_000_000] for i in range(50)], object)
    assert list(model.sums) == [int(v) for v in x.sum(0)]
    deviation = ((50 * x - x.sum(0)) ** 2).sum(1)
    assert sorted(int(r.deviation) for r in whitening.whiten(wide, model).collect()) == sorted(int(v) for v in deviation)
    assert all(r.deviation is None for r in whitening.whitened_rows(wide).collect())
