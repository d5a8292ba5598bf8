"""Linear models from sufficient statistics (M8a-d, M9 ridge and lasso, M12).

One aggregate gathers the sums of products X'X, X'y, y'y of every fold.  A fold's training
statistics are the total less the fold's own, so all folds, all penalties and the refit
are solved from that one scan, and so are the held-out errors.  What reaches the driver
is one row a fold of ``p * (p + 5) / 2 + 3`` numbers, whatever the table's size.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most features whose sums of products are gathered in one aggregate; wider tables go to
#: Spark's iterative solvers.
MAX_FEATURES = 150
KINDS = ("linear", "ridge", "lasso", "elastic_net")


@dataclass(frozen=True)
class Moments:
    """Sums over rows of z z', where z = (1, features, label less ``shift``)."""

    sums: np.ndarray
    shift: float

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.sums + other.sums, self.shift)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.sums - other.sums, self.shift)

    @property
    def n(self) -> float:
        return float(self.sums[0, 0])

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """(X'X, X'y) about the means."""
        s = self.sums - np.outer(self.sums[0], self.sums[0]) / self.n
        return s[1:-1, 1:-1], s[1:-1, -1]


@dataclass(frozen=True)
class Linear:
    coefficients: np.ndarray
    intercept: float


def moments(feats: DataFrame, label: str, fold: str | None = None, features: str = "features", p: int | None = None) -> dict[int, Moments]:
    """Moments per fold (fold 0 without a fold column), rows without a label left out; one
    aggregate.  ``features`` is a vector column of ``p`` places (asked of a row if not given)."""
    if p is None:
        first = feats.select(F.size(vector_to_array(features)).alias("p")).first()
        if first is None:
            return {}
        p = first["p"]
    if p > MAX_FEATURES:
        raise ValueError(f"{p} features; at most {MAX_FEATURES} are summed in one aggregate")
    shift = float(feats.agg(F.avg(label)).first()[0] or 0.0)
    x = F.col("x")
    z = [F.lit(1.0), *[x[i] for i in range(p)], F.col(label).cast("double") - shift]
    rows = (feats.where(F.col(label).isNotNull()).select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), label, vector_to_array(features).alias("x"))
            .select("fold", *[c.alias(f"z{i}") for i, c in enumerate(z)]))
    pairs = [(i, j) for i in range(p + 2) for j in range(i, p + 2)]
    out = {}
    for r in rows.groupBy("fold").agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).collect():
        s = np.zeros((p + 2, p + 2))
        for (i, j), v in zip(pairs, r[1:]):
            s[i, j] = s[j, i] = v
        out[r["fold"]] = Moments(s, shift)
    return out


def total(parts: dict[int, Moments]) -> Moments:
    first, *rest = parts.values()
    return sum(rest, first)


def solve(m: Moments, kind: str, alpha: float = 1.0, l1_ratio: float = 0.5) -> Linear:
    """The minimiser (intercept unpenalised) of SSE (``linear``: the one of least norm), SSE +
    alpha |w|^2 (``ridge``), SSE / 2n + alpha |w|_1 (``lasso``), or SSE / 2n + alpha r |w|_1 +
    alpha (1 - r) / 2 |w|^2 (``elastic_net``)."""
    xx, xy = m.centred()
    if kind == "linear":
        w = np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy
    elif kind == "ridge":
        w = np.linalg.solve(xx + alpha * np.eye(len(xy)), xy)
    elif kind in ("lasso", "elastic_net"):
        ratio = 1.0 if kind == "lasso" else l1_ratio
        w = _sparse_weights(xx / m.n, xy / m.n, alpha * ratio, alpha * (1 - ratio))
    else:
        raise ValueError(f"not a linear model: {kind}")
    means = m.sums[0] / m.n
    return Linear(w, float(means[-1] + m.shift - means[1:-1] @ w))


def _sparse_weights(g: np.ndarray, c: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The minimiser of w'g w / 2 - c'w + l1 |w|_1 + l2 w'w / 2 by search over signs: a column whose slope
    asks for a weight joins, the weights with known signs solve a linear system, and on the
    way there the best point before a weight changes sign is taken.  Every step descends,
    so no signs come twice and the search ends.  Columns without variance get no weight."""
    h, w = g + l2 * np.eye(len(c)), np.zeros(len(c))
    usable = np.diag(g) > 1e-12
    scale = np.abs(c).max(initial=0.0)

    def value(v: np.ndarray) -> float:
        return 0.5 * v @ h @ v - c @ v + l1 * np.abs(v).sum()

    for _ in range(100 * (len(c) + 1)):
        slope = np.where(usable & (w == 0), c - h @ w, 0.0)
        j = int(np.argmax(np.abs(slope))) if len(c) else 0
        if not len(c) or abs(slope[j]) <= l1 + 1e-11 * scale:
            return w
        sign = np.sign(w)
        sign[j] = np.sign(slope[j])
        for _ in range(10 * len(c)):
            on = np.flatnonzero(sign)
            goal = np.zeros(len(c))
            goal[on] = np.linalg.lstsq(h[np.ix_(on, on)], c[on] - l1 * sign[on], rcond=1e-13)[0]
            turns = [i for i in on if w[i] and goal[i] * w[i] < 0]
            points = []
            for t, i in [(1.0, None), *((w[i] / (w[i] - goal[i]), i) for i in turns)]:
                v = w + t * (goal - w)
                if i is not None:
                    v[i] = 0.0
                points.append((value(v), v, i))
            best = min(points, key=lambda x: x[0])
            w, sign = best[1], np.sign(best[1])
            if best[2] is None and not turns:
                break
    return w


def r2(fitted: Linear, test: Moments) -> float:
    """R^2 of a model on the rows that ``test`` sums."""
    v = np.concatenate([[fitted.intercept - test.shift], fitted.coefficients, [-1.0]])
    spread = test.sums[-1, -1] - test.sums[0, -1] ** 2 / test.n
    return float(1 - v @ test.sums @ v / spread)


def search(parts: dict[int, Moments], kind: str, alphas: list[float]) -> list[float]:
    """Mean held-out R^2 of each penalty over the folds."""
    everything = total(parts)
    return [float(np.mean([r2(solve(everything - held, kind, a), held) for held in parts.values()])) for a in alphas]


def spark_model(fitted: Linear, features: str = "features", prediction: str = "prediction") -> LinearRegressionModel:
    """The fit as a Spark ML model, to be scored, saved and loaded like any other."""
    from pyspark.ml.common import _py2java
    from pyspark.sql import SparkSession
    sc = SparkSession.getActiveSession().sparkContext
    vector = _py2java(sc, Vectors.dense(fitted.coefficients))
    made = sc._jvm.org.apache.spark.ml.regression.LinearRegressionModel(f"linear_{uuid.uuid4().hex[:12]}", vector, float(fitted.intercept))
    return LinearRegressionModel(made).setFeaturesCol(features).setPredictionCol(prediction)
