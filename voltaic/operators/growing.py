"""Growing tree ensembles on executors (M8e, M8f, M9).

Spark's trainer grows a forest level by level, in rounds of jobs whose tasks each hold the
statistics of a few nodes: a tree to depth 30 takes hundreds of rounds, and a boosting run a
handful for every stage.  Trees see a row through its bins alone (``MAX_BINS`` a feature), so
a table is small once it is binned: a byte a feature and the label.  It goes to every
executor, and a task grows whole trees (forests) or a whole run (boosting) on it.  Bins,
splits, stopping and boosting steps are those of Spark's trainer, and the outcome is written
in the format of Spark's own models and loaded as one.

Tables of more than ``TABLE_BYTES`` once binned go to Spark's trainer.  Boosting without
drawing rows is the same from the rows of equal bins put together, whatever their number,
so there only the distinct ones count.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Params
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import intermediate_path

# the workers need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a binned table up to which every executor gets it whole.
TABLE_BYTES = 32 << 20
#: Different rows, by their bins, up to which a larger table is put together for boosting.
CELLS = 1 << 19
#: Rows from which it is tried whether they fall into few.
ROWS_WORTH_FOLDING = 100_000
#: Bytes of the sums of a forest's samples, where rows are drawn into cells, that a task holds.
SAMPLE_BYTES = 128 << 20
#: Rows that decide where bins end (Spark's trainer takes 10,000).
ROWS_FOR_CUTS = 200_000
#: Statistics of nodes that a task holds at a time.
STATISTICS = 1 << 21

#: A tree as one row: its nodes in the order of a walk that goes left first.
PACKED = {"prediction": "double", "impurity": "double", "n": "double", "gain": "double", "left": "int", "right": "int", "feature": "int",
          "threshold": "double", "categories": "int"}
TREES = "tree int, " + ", ".join(f"{c} array<{kind}>" for c, kind in PACKED.items())


# --- the binned table --------------------------------------------------------------------------

@dataclass
class Table:
    """Rows by their bins.  ``n`` rows with the same bins, the sum ``s`` of their labels (less
    ``shift``) and ``q`` of the squares; of a table that is ``folded`` n may exceed one.  ``held`` rows
    have no part in training.  ``cuts`` are the bins' upper ends."""

    bins: np.ndarray
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    cuts: list[np.ndarray]
    binary: list[bool]
    shift: float
    folded: bool = False
    held: np.ndarray | None = None
    held_y: np.ndarray | None = None

    def __post_init__(self):
        if self.held is None:
            self.held, self.held_y = self.bins[:0], np.empty(0)


def _kinds(data: DataFrame, features: str) -> dict[int, int] | None:
    """The features of two categories, as their metadata tells; None where one has more."""
    attrs = data.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if any(len(a.get("vals", range(a.get("num_vals", 3)))) > 2 for a in attrs.get("nominal", [])):
        return None
    return {a["idx"]: 2 for kind in ("binary", "nominal") for a in attrs.get(kind, [])}


def cut_points(values: np.ndarray, most: int) -> np.ndarray:
    """Where Spark's trainer splits a feature of these values into at most ``most + 1`` bins: between all
    neighbouring values, or else where the count of rows comes nearest to each multiple of
    an equal share."""
    found, counts = np.unique(values, return_counts=True)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) <= most:
        return middle
    upto, share, at, out = np.cumsum(counts), len(values) / (most + 1), 0, []
    halfway = (upto[:-1] + upto[1:]) / 2                  # of the counts on both sides of the next value
    for k in range(1, most + 1):
        at = max(at, int(np.searchsorted(halfway, k * share, side="right")))
        if at >= len(middle):
            break
        out.append(middle[at])
        at += 1
    return np.array(out)


def _matrix(lists: pa.Array, p: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def _to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


def _find_cuts(rows: DataFrame, p: int, binary: dict[int, int], most: int) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.empty((0, p)), *(_matrix(b.column(0), p) for b in batches)])
        yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), pa.array([cut_points(x[:, j], most) for j in range(p)], pa.list_(pa.float64()))], ["feature", "cuts"])
    found = rows.select("x").repartition(1).mapInArrow(run, "feature int, cuts array<double>").collect()
    cuts = {r["feature"]: np.array(r["cuts"], dtype=float) for r in found}
    return [np.zeros(1) if j in binary else cuts[j] for j in range(p)]


def _rows(data: DataFrame, est, shift: float) -> DataFrame:
    return data.select(vector_to_array(est.getFeaturesCol()).alias("x"), (F.col(est.getLabelCol()).cast("double") - F.lit(shift)).alias("y"))


def binned(data: DataFrame, est, held: DataFrame | None = None, limit: int | None = None, cells: int = 0) -> Table | None:
    """The rows of ``data`` (and ``held``) by the bins of ``data``, on the driver.  Of many rows those of equal
    bins are put together where they lie, if that leaves at most ``cells`` (and pays); otherwise
    they may be ``limit`` bytes.  None where they are more, or Spark's trainer is needed."""
    limit = TABLE_BYTES if limit is None else limit
    binary = _kinds(data, est.getFeaturesCol())
    if binary is None:
        return None
    y = F.col(est.getLabelCol()).cast("double")
    seen = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).alias("bad"),
                    F.avg(y).alias("mean"), F.max(F.size(vector_to_array(est.getFeaturesCol()))).alias("p")).first()
    n, p = seen["n"], seen["p"]
    if not n or not p or seen["bad"]:                     # a label that is no number is an error, and Spark's trainer says which
        return None
    most, small = min(est.getMaxBins(), n) - 1, n * (p + 8) <= limit
    if not 1 <= most <= 254 or not (small or cells):
        return None
    rows = _rows(data, est, seen["mean"])
    cuts = _find_cuts(rows if n <= ROWS_FOR_CUTS else rows.sample(ROWS_FOR_CUTS / n, seed=est.getSeed()), p, binary, most)

    def dealt(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = _to_bins(_matrix(b.column(0), p), cuts)
                ends = np.arange(0, bins.size + 1, p, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(bins.tobytes())]), b.column(1)], ["b", "y"])
        return rows.mapInArrow(run, "b binary, y double")
    found, folded = None, False
    if cells and not (small and n <= ROWS_WORTH_FOLDING):
        few = min(cells, n // 8) if small else cells
        groups = dealt(rows).groupBy("b").agg(F.count("y").cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
        found = groups.limit(few + 1).toPandas()
        folded = len(found) <= few
        if not folded and not small:
            return None
    if not folded:
        found = dealt(rows).toPandas()
        found = found.assign(n=1.0, s=found["y"], q=found["y"] ** 2)
    bins = np.frombuffer(b"".join(found["b"]), np.uint8).reshape(-1, p)
    order = np.lexsort([found["s"].to_numpy(), *bins.T])                  # draws do not depend on how rows were dealt out
    made = Table(bins[order], *(found[c].to_numpy()[order] for c in "nsq"), cuts, [j in binary for j in range(p)], seen["mean"], folded)
    if held is not None:
        out = dealt(_rows(held, est, seen["mean"])).toPandas()
        made.held, made.held_y = np.frombuffer(b"".join(out["b"]), np.uint8).reshape(-1, p), out["y"].to_numpy()
    return made


# --- one tree ----------------------------------------------------------------------------------

class Layout:
    """Where the statistics of the features' bins lie: features of many bins first, each as wide as
    the widest, then those of two."""

    def __init__(self, table: Table):
        wide = [j for j, c in enumerate(table.cuts) if len(c) and not table.binary[j]]
        pairs = [j for j in range(len(table.cuts)) if table.binary[j]]
        self.features, self.wide, self.pairs = np.array(wide + pairs, dtype=np.int64), len(wide), len(pairs)
        self.width = 1 + max((len(table.cuts[j]) for j in wide), default=1)
        self.starts = np.concatenate([np.arange(self.wide) * self.width, self.wide * self.width + 2 * np.arange(self.pairs)]).astype(np.int32)
        self.size = self.wide * self.width + 2 * self.pairs

    def codes(self, bins: np.ndarray) -> np.ndarray:
        return bins[:, self.features].astype(np.int32) + self.starts

    def below(self, sums: np.ndarray) -> np.ndarray:
        """What lies at or below every split, from what lies in every bin."""
        edge = self.wide * self.width
        wide = sums[:, :edge].reshape(len(sums), self.wide, self.width).cumsum(2)[:, :, :-1]
        return np.concatenate([wide.reshape(len(sums), -1), sums[:, edge::2]], axis=1)

    def split(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the feature, bin) of splits numbered as in ``below``."""
        edge = self.wide * (self.width - 1)
        return np.where(at < edge, at // (self.width - 1), at - edge + self.wide), np.where(at < edge, at % (self.width - 1), 0)


def _best(layout: Layout, codes: np.ndarray, at: np.ndarray, n: np.ndarray, s: np.ndarray, whole_n: np.ndarray, whole_s: np.ndarray, least: int):
    """The best split of each node: (number, score, rows left, sum left); a score is the sum of squares that the two sides' means explain."""
    k, f = len(whole_n), codes.shape[1]
    step = max(1, STATISTICS // max(1, layout.size))
    found = [], [], [], []
    for lo in range(0, k, step):
        hi = min(k, lo + step)
        here = slice(None) if k <= step else np.flatnonzero((at >= lo) & (at < hi))
        c, a, nn, ss = codes[here], at[here], n[here], s[here]
        sums_n, sums_s = np.zeros((hi - lo) * layout.size), np.zeros((hi - lo) * layout.size)
        block = max(1, STATISTICS // max(1, f))
        for r in range(0, len(c), block):
            i = (((a[r:r + block] - lo) * layout.size)[:, None] + c[r:r + block]).ravel()
            sums_n += np.bincount(i, np.repeat(nn[r:r + block], f), len(sums_n))
            sums_s += np.bincount(i, np.repeat(ss[r:r + block], f), len(sums_s))
        ln, ls = layout.below(sums_n.reshape(hi - lo, -1)), layout.below(sums_s.reshape(hi - lo, -1))
        rn, rs = whole_n[lo:hi, None] - ln, whole_s[lo:hi, None] - ls
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((ln >= least) & (rn >= least), ls * ls / ln + rs * rs / rn, -np.inf)
        top = score.argmax(1)
        each = np.arange(hi - lo)
        for out, part in zip(found, (top, score[each, top], ln[each, top], ls[each, top])):
            out.append(part)
    return tuple(np.concatenate(x) for x in found)


def grow(table: Table, layout: Layout, codes: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, deepest: int, least: int,
         others: np.ndarray, cuts: tuple[int, ...] = ()) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, predictions for the training rows, for ``others``, for ``others`` with the tree cut at each depth).

    Nodes are split as Spark's trainer does: by the greatest gain in variance, the first of equal
    ones, both sides with ``least`` rows, until ``deepest``; their numbers are those of a walk
    that goes left first."""
    levels, depth, k = [], 0, 1
    mine, at = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    theirs, their_at = np.arange(len(others)), np.zeros(len(others), np.int64)
    out, their_out, seen = np.zeros(len(codes)), np.zeros(len(others)), np.zeros((len(cuts), len(others)))
    tiny = None
    while k:
        nn, ss, qq = (np.bincount(at, v[mine], k) for v in (n, s, q))
        value = ss / nn
        impurity = np.maximum(qq / nn - value * value, 0.0)
        if tiny is None:
            tiny = 1e-14 * impurity[0]                    # round-off, not gain
        out[mine], their_out[theirs] = value[at], value[their_at]
        for i, d in enumerate(cuts):
            if d >= depth:
                seen[i, theirs] = value[their_at]
        level = {"prediction": value, "impurity": impurity, "n": nn, "gain": np.full(k, -1.0),
                 "split": np.full(k, -1), "place": np.full(k, -1), "swapped": np.zeros(k, bool)}
        levels.append(level)
        open_ = np.flatnonzero((nn >= 2 * least) & (impurity > tiny)) if depth < deepest and layout.size else np.empty(0, int)
        if not len(open_):
            break
        local = np.full(k, -1)
        local[open_] = np.arange(len(open_))
        keep = local[at] >= 0
        mine, at = mine[keep], local[at[keep]]
        keep = local[their_at] >= 0
        theirs, their_at = theirs[keep], local[their_at[keep]]
        top, score, ln, ls = _best(layout, codes[mine], at, n[mine], s[mine], nn[open_], ss[open_], least)
        gain = (score - ss[open_] ** 2 / nn[open_]) / nn[open_]
        good = np.flatnonzero(gain > tiny)
        if not len(good):
            break
        place, edge = layout.split(top[good])
        with np.errstate(divide="ignore", invalid="ignore"):
            swapped = (place >= layout.wide) & (ls[good] / ln[good] > (ss[open_][good] - ls[good]) / (nn[open_][good] - ln[good]))
        node = open_[good]
        level["gain"][node], level["split"][node], level["place"][node], level["swapped"][node] = gain[good], edge, place, swapped
        rank = np.full(len(open_), -1)
        rank[good] = np.arange(len(good))
        where = layout.starts[place] + edge

        def down(rows: np.ndarray, at: np.ndarray, codes: np.ndarray):
            r = rank[at]
            rows, r = rows[r >= 0], r[r >= 0]
            left = (codes[rows, place[r]] <= where[r]) != swapped[r]
            return rows, 2 * r + ~left
        mine, at = down(mine, at, codes)
        theirs, their_at = down(theirs, their_at, others)
        depth, k = depth + 1, 2 * len(good)
    return _numbered(levels, table, layout), out, their_out, seen


def _numbered(levels: list[dict], table: Table, layout: Layout) -> dict[str, np.ndarray]:
    """The nodes of all levels, children by the numbers of a walk that goes left first."""
    sizes: list[np.ndarray] = []
    for i in range(len(levels) - 1, -1, -1):
        size = np.ones(len(levels[i]["n"]), np.int64)
        if i + 1 < len(levels):
            size[levels[i]["place"] >= 0] += sizes[0][0::2] + sizes[0][1::2]
        sizes.insert(0, size)
    ids, out = np.zeros(1, np.int64), []
    for i, level in enumerate(levels):
        inner = level["place"] >= 0
        left, right = np.full(len(ids), -1), np.full(len(ids), -1)
        if i + 1 < len(levels):
            left[inner] = ids[inner] + 1
            right[inner] = ids[inner] + 1 + sizes[i + 1][0::2]
        feature = np.where(inner, layout.features[level["place"]] if len(layout.features) else -1, -1)
        threshold, categories = np.full(len(ids), np.nan), np.full(len(ids), -1)
        for x in np.flatnonzero(inner):
            if table.binary[feature[x]]:
                threshold[x], categories[x] = float(level["swapped"][x]), 2
            else:
                threshold[x] = table.cuts[feature[x]][level["split"][x]]
        out.append({"id": ids, "left": left, "right": right, "feature": feature, "threshold": threshold, "categories": categories,
                    **{c: level[c] for c in ("prediction", "impurity", "n", "gain")}})
        if i + 1 < len(levels):
            ids = np.stack([left[inner], right[inner]], axis=1).ravel()
    return {c: np.concatenate([level[c] for level in out]) for c in out[0]}


def _packed(tree: int, nodes: dict[str, np.ndarray], shift: float = 0.0) -> pa.RecordBatch:
    """A tree as one row, for labels that are greater by ``shift``."""
    order = np.argsort(nodes["id"])
    columns = [pa.array([tree], pa.int32())]
    for c, kind in PACKED.items():
        values = nodes[c][order] + shift if c == "prediction" else nodes[c][order]
        ends = pa.array([0, len(order)], pa.int32())
        columns.append(pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float64 if kind == "double" else np.int32))))
    return pa.RecordBatch.from_arrays(columns, ["tree", *PACKED])


# --- forests -----------------------------------------------------------------------------------

def _drawn(table: Table, tree: int, seed: int, rate: float, bootstrap: bool) -> np.ndarray:
    """How often each row is in the sample of a tree."""
    draw = np.random.default_rng([seed & (2 ** 63 - 1), tree])
    if bootstrap:
        return draw.poisson(rate, len(table.n)).astype(float)
    return np.ones(len(table.n)) if rate >= 1 else (draw.random(len(table.n)) < rate).astype(float)


def _grow_sampled(table: Table, layout: Layout, codes: np.ndarray, tree: int, sampled: tuple, limits: tuple[int, int], others: np.ndarray, cuts: tuple[int, ...] = ()):
    w = _drawn(table, tree, *sampled)
    rows = np.flatnonzero(w)
    if not len(rows):                                     # a sample without rows: all of them
        w, rows = np.ones(len(w)), np.arange(len(w))
    w = w[rows]
    return grow(table, layout, codes[rows], w, w * table.s[rows], w * table.q[rows], *limits, others, cuts)


def _sampled_cells(rows: DataFrame, table: Table, trees: int, seed: int, rate: float, bootstrap: bool) -> DataFrame:
    """(``tree``, ``n``, ``s``, ``q``): how the sample of each tree falls into the cells of a folded table, as
    arrays.  Every row is drawn by itself, where it lies."""
    p, cuts, size = table.bins.shape[1], table.cuts, len(table.bins)
    while True:                                           # a number for every cell
        mix = np.random.default_rng(size).integers(1, 2 ** 63, p, dtype=np.uint64) | np.uint64(1)
        keys = (table.bins * mix).sum(1, dtype=np.uint64)
        if len(np.unique(keys)) == size:
            break
        size += 1
    order = np.argsort(keys)
    sent = rows.sparkSession.sparkContext.broadcast((mix, keys[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, keys, order = sent.value
        draw = np.random.default_rng([seed & (2 ** 63 - 1), TaskContext.get().partitionId()])
        sums = np.zeros((trees, 3, len(keys)))
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            cell = order[np.searchsorted(keys, (_to_bins(_matrix(b.column(0), p), cuts) * mix).sum(1, dtype=np.uint64))]
            for t in range(trees):
                w = draw.poisson(rate, len(y)) if bootstrap else np.ones(len(y)) if rate >= 1 else draw.random(len(y)) < rate
                at = np.flatnonzero(w)
                w, c, v = w[at].astype(float), cell[at], y[at]
                for i, x in enumerate((w, w * v, w * v * v)):
                    sums[t, i] += np.bincount(c, x, len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], ["tree", "sums"])
    return rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "tree int, sums binary")


class GrownForest(RandomForestRegressor):
    """A random forest whose trees are grown in tasks of their own (all features at every split).  Tables too
    large for that whose rows fall into few cells are drawn where they lie."""

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        spark, size = dataset.sparkSession, self.getNumTrees()
        every = self.getFeatureSubsetStrategy() == "all" or size == 1 and self.getFeatureSubsetStrategy() == "auto"
        table = binned(dataset, self, cells=SAMPLE_BYTES // (24 * size)) if every else None
        if table is None:
            from .trees import fit_forest
            return fit_forest(plain(self), dataset)
        sent = spark.sparkContext.broadcast(vars(table))
        sampled, limits = (self.getSeed(), self.getSubsamplingRate(), self.getBootstrap()), (self.getMaxDepth(), self.getMinInstancesPerNode())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = Table(**sent.value)
            layout = Layout(table)
            codes = layout.codes(table.bins)
            for b in batches:
                for tree in b.column(0).to_pylist():
                    yield _packed(tree, _grow_sampled(table, layout, codes, tree, sampled, limits, codes[:0])[0], table.shift)

        def run_cells(parts: pa.Table) -> pa.Table:
            table = Table(**sent.value)
            layout = Layout(table)
            n, s, q = sum(np.frombuffer(x).reshape(3, -1) for x in parts.column("sums").to_pylist())
            at = np.flatnonzero(n)
            nodes, *_ = grow(table, layout, layout.codes(table.bins[at]), n[at], s[at], q[at], *limits, layout.codes(table.bins[:0]))
            return pa.Table.from_batches([_packed(parts.column("tree")[0].as_py(), nodes, table.shift)])
        if table.folded:
            trees = _sampled_cells(_rows(dataset, self, table.shift), table, size, *sampled).groupBy("tree").applyInArrow(run_cells, TREES)
        else:
            trees = spark.range(0, size, 1, min(size, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, TREES)
        made = GrownForestModel()._resetUid(self.uid)
        made.grown, made.features = intermediate_path(spark, "grown_forest"), table.bins.shape[1]
        self._copyValues(made)
        trees.write.parquet(made.grown)
        sent.unpersist()
        return made


class GrownForestModel(RandomForestRegressionModel):
    """A grown forest.  It prices rows from its trees as they were written (a row a tree, under ``grown``), and
    is loaded as a model of Spark where it is saved or asked for more."""

    grown: str | None = None
    features = 0
    _loaded = None

    @property
    def _java_obj(self):
        if self._loaded is None and self.grown:
            spark = SparkSession.builder.getOrCreate()
            trees = spark.read.parquet(self.grown)
            self._loaded = as_spark_model(self, trees, [1.0] * trees.count(), self.features)._java_obj
        return self._loaded

    @_java_obj.setter
    def _java_obj(self, made):
        self._loaded = made

    @property
    def trees(self):
        return RandomForestRegressionModel(self._java_obj).trees

    def __del__(self):
        if self._loaded is not None:
            super().__del__()

    def copy(self, extra=None):
        that = Params.copy(self, extra)
        that._loaded = None
        return that

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.grown or self.getLeafCol():
            return super()._transform(dataset)
        spark, forest = dataset.sparkSession, []
        for t in spark.read.parquet(self.grown).select("left", "right", "feature", "threshold", "categories", "prediction").toArrow().to_batches():
            for i in range(len(t)):
                left, right, feature, threshold, categories, value = (c[i].values.to_numpy(zero_copy_only=False) for c in t.columns)
                turned = (categories == 2) & (threshold == 1)         # category 1 goes left: the same as what is above 0 does
                forest.append((np.where(turned, right, left), np.where(turned, left, right), feature, np.where(turned, 0.0, threshold), value))
        sent = spark.sparkContext.broadcast(forest)

        def price(x: pd.Series) -> pd.Series:
            x = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
            total = np.zeros(len(x))
            for left, right, feature, threshold, value in sent.value:
                at, moving = np.zeros(len(x), np.int64), np.arange(len(x))
                while len(moving):
                    here = at[moving]
                    moving, here = moving[left[here] >= 0], here[left[here] >= 0]
                    at[moving] = np.where(x[moving, feature[here]] <= threshold[here], left[here], right[here])
                total += value[at]
            return pd.Series(total / len(sent.value))
        return dataset.withColumn(self.getPredictionCol(), F.pandas_udf(price, "double")(vector_to_array(self.getFeaturesCol())))


def forest_grid(spark: SparkSession, tables: list[Table], forests: list[dict]) -> dict[tuple[int, int, int, int], float]:
    """R^2 on the held rows of every table (``tables``) of every forest: (table, forest, size, depth) -> R^2.  A forest is told by
    its ``sampled`` (seed, rate, bootstrap), ``limits`` (most depth, least rows of a leaf), ``sizes`` and the
    depths it is cut at, ``cuts``.  A task grows trees of one forest and keeps the sums of their predictions."""
    sent = spark.sparkContext.broadcast([vars(t) for t in tables])
    whole = sum(max(f["sizes"]) for f in forests) * len(tables)
    step = max(1, min(25, whole // (6 * spark.sparkContext.defaultParallelism)))
    pieces = []                                           # (table, forest, which of its sizes the trees are new in, trees from, to)
    for t in range(len(tables)):
        for f, forest in enumerate(forests):
            for i, (lo, hi) in enumerate(zip([0, *forest["sizes"]], forest["sizes"])):
                pieces += [(t, f, i, at, min(hi, at + step)) for at in range(lo, hi, step)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, f, i, lo, hi in b[["t", "f", "i", "lo", "hi"]].itertuples(index=False):
                table, forest = Table(**sent.value[t]), forests[f]
                layout = Layout(table)
                codes, others = layout.codes(table.bins), layout.codes(table.held)
                total = sum(_grow_sampled(table, layout, codes, tree, forest["sampled"], forest["limits"], others, forest["cuts"])[3] for tree in range(lo, hi))
                yield pd.DataFrame({"t": [t], "f": [f], "i": [i], "sums": [total.tobytes()]})

    def score(parts: pd.DataFrame) -> pd.DataFrame:
        t, f = int(parts["t"].iloc[0]), int(parts["f"].iloc[0])
        y, forest, out = sent.value[t]["held_y"], forests[f], []
        upto = np.zeros((len(forest["cuts"]), len(y)))
        for i, size in enumerate(forest["sizes"]):
            for sums in parts.loc[parts["i"] == i, "sums"]:
                upto = upto + np.frombuffer(sums).reshape(upto.shape)
            out += [(t, f, size, d, 1 - float(np.mean((y - upto[j] / size) ** 2) / np.var(y))) for j, d in enumerate(forest["cuts"])]
        return pd.DataFrame(out, columns=["t", "f", "size", "depth", "r2"])
    # dealt out one by one: tasks of equal work
    asked = spark.createDataFrame(spark.sparkContext.parallelize(pieces, len(pieces)), "t int, f int, i int, lo int, hi int")
    found = asked.mapInPandas(run, "t int, f int, i int, sums binary").groupBy("t", "f").applyInPandas(score, "t int, f int, size int, depth int, r2 double").collect()
    sent.unpersist()
    return {(r["t"], r["f"], r["size"], r["depth"]): r["r2"] for r in found}


# --- boosting ----------------------------------------------------------------------------------

def boost(table: Table, stages: int, rate: float, deepest: int, least: int, drawn: float, seed: int) -> tuple[list[dict], np.ndarray]:
    """(the trees of a boosting run for squared errors, its mean squared error on the held rows after each stage).
    As in Spark, the first tree counts whole and later ones learn twice the residual."""
    layout = Layout(table)
    codes, others = layout.codes(table.bins), layout.codes(table.held)
    so_far, their_so_far, trees, errors = np.zeros(len(codes)), np.zeros(len(others)), [], []
    for stage in range(stages):
        n, s, q = table.n, table.s, table.q
        if stage:                                         # sums of 2 (y - F) and its square
            s, q = 2 * (s - n * so_far), 4 * (q - 2 * so_far * s + n * so_far * so_far)
        if drawn < 1:
            w = np.random.default_rng([seed & (2 ** 63 - 1), stage]).random(len(n)) < drawn
            rows = np.flatnonzero(w) if w.any() else np.arange(len(n))
            nodes, _, there, _ = grow(table, layout, codes[rows], n[rows], s[rows], q[rows], deepest, least, np.concatenate([codes, others]))
            here, there = there[:len(codes)], there[len(codes):]
        else:
            nodes, here, there, _ = grow(table, layout, codes, n, s, np.maximum(q, 0.0), deepest, least, others)
        weight = 1.0 if stage == 0 else rate
        so_far, their_so_far = so_far + weight * here, their_so_far + weight * there
        errors.append(float(np.mean((table.held_y - their_so_far) ** 2)) if len(others) else np.nan)
        trees.append(nodes)
    return trees, np.array(errors)


def put_together(table: Table) -> Table:
    """The table with the rows of equal bins as one."""
    if not len(table.bins):
        return table
    keys = np.ascontiguousarray(table.bins).view([("", np.void, table.bins.shape[1])]).ravel()
    _, first, cell = np.unique(keys, return_index=True, return_inverse=True)
    if len(first) > len(keys) // 2:
        return table
    n, s, q = (np.bincount(cell, v, len(first)) for v in (table.n, table.s, table.q))
    return replace(table, bins=table.bins[first], n=n, s=s, q=q)


class GrownBoosting(GBTRegressor):
    """Gradient boosting for squared errors whose run is one task.  ``table`` gives the binned rows of a
    search's fold; then a fit returns the errors on its held rows after each stage."""

    table: Table | None = None

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel | np.ndarray:
        # rows drawn anew at every stage are drawn one by one; otherwise those of equal bins are one
        whole = self.getSubsamplingRate() >= 1
        table = self.table
        if table is None and self.getLossType() == "squared" and self.getFeatureSubsetStrategy() == "all":
            table = binned(dataset, self, cells=CELLS if whole else 0)
        if table is None:
            return plain(self)._fit(dataset)
        spark, scoring, stages = dataset.sparkSession, self.table is not None, self.getMaxIter()
        sent = spark.sparkContext.broadcast(vars(put_together(table) if whole else table))
        settings = (stages, self.getStepSize(), self.getMaxDepth(), self.getMinInstancesPerNode(), self.getSubsamplingRate(), self.getSeed())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    table = Table(**sent.value)
                    trees, errors = boost(table, *settings)
                    if scoring:
                        yield pa.RecordBatch.from_arrays([pa.array(range(stages), pa.int32()), pa.array(errors)], ["stage", "error"])
                    else:
                        yield from (_packed(i, nodes, 0.0 if i else table.shift) for i, nodes in enumerate(trees))
        made = spark.range(0, 1, 1, 1).mapInArrow(run, "stage int, error double" if scoring else TREES)
        if scoring:
            out = np.array([r["error"] for r in sorted(made.collect())])
        else:
            out = as_spark_model(self, made, [1.0] + [self.getStepSize()] * (stages - 1), table.bins.shape[1])
        sent.unpersist()
        return out


# --- as a model of Spark, or by its trainer -----------------------------------------------------------------------

def plain(est):
    """The same estimator as Spark has it (its parameters are still known by ``est``)."""
    made = (RandomForestRegressor if isinstance(est, RandomForestRegressor) else GBTRegressor)(**{p.name: v for p, v in est.extractParamMap().items()})
    return made._resetUid(est.uid)


def node_rows(trees: DataFrame) -> DataFrame:
    """A row a node: ``tree``, ``id`` and the columns of ``PACKED``."""
    return trees.select("tree", F.posexplode(F.arrays_zip(*PACKED)).alias("id", "node")).select("tree", "id", "node.*")


def as_spark_model(est, trees: DataFrame, weights: list[float], features: int):
    """The Spark model of these trees, loaded from files in Spark's own format, with the parameters of ``est``."""
    spark = trees.sparkSession
    path = intermediate_path(spark, "grown_trees")
    split = F.when(F.col("feature") >= 0, F.struct(F.col("feature").alias("featureIndex"), F.array("threshold").alias("leftCategoriesOrThreshold"), F.col("categories").alias("numCategories")))
    none = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    stats = F.array("n", F.col("n") * F.col("prediction"), F.col("n") * (F.col("impurity") + F.col("prediction") * F.col("prediction")))
    data = F.struct("id", "prediction", "impurity", stats.alias("impurityStats"), F.col("n").cast("long").alias("rawCount"), "gain",
                    F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), F.coalesce(split, none).alias("split"))
    node_rows(trees).select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.parquet(f"{path}/data")

    def about(kind: str, uid: str, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {"impurity": "variance"}, "defaultParamMap": {}, **more})
    metas = [(i, about("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}"), w) for i, w in enumerate(weights)]
    spark.createDataFrame(metas, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    model = GBTRegressionModel if isinstance(est, GBTRegressor) else RandomForestRegressionModel
    text = about(model.__name__, est.uid, numFeatures=features, numTrees=len(weights))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    made = model.load(path)
    est._copyValues(made)._transfer_params_to_java()
    return made
