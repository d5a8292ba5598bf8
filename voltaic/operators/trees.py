"""Tree ensembles as tables of nodes (M9 tree grids, M11).

An ensemble is saved by Spark as one row a node.  Two facts make grids cheap.  The first k
trees of a forest are the forest of k trees, and the first k stages of a boosting run are
the run of k stages (the same seed draws the same samples).  And where every split sees
all features, a tree grown to depth d is the deeper tree cut at d, since growing is greedy
and level by level.  So a search trains the largest model of each group of nested grid
points once per fold and reads all the others off its nodes in one pass over the fold.
"""

from __future__ import annotations

import functools
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import intermediate_path, materialize
from . import growing as GR


def is_forest(model) -> bool:
    """Whether the trees of a model or estimator are averaged (otherwise they are stages that add up)."""
    return isinstance(model, (RandomForestRegressionModel, RandomForestRegressor))


#: Trees that one run of Spark's trainer grows.
TREES_A_FIT = 5
#: Runs whose trees a grid search scores at once on a table of few rows (see ``nested_search``).
RUNS_A_SCORE = 4
#: Rows of a task of the trainer.
ROWS_A_TASK = 20_000


def forest_runs(est: RandomForestRegressor) -> list[RandomForestRegressor]:
    """The runs that grow the forest of ``est``, in the order of their trees."""
    est, size = est.copy(), est.getNumTrees()
    est.setCacheNodeIds(True)                         # keeps in which node a row is instead of passing trees on
    return [est.copy({est.numTrees: min(TREES_A_FIT, size - at), est.seed: est.getSeed() + 1_000_003 * at}) for at in range(0, size, TREES_A_FIT)]


def fit_forest(est: RandomForestRegressor, data: DataFrame, params: dict | None = None, parallelism: int = 16) -> RandomForestRegressionModel:
    """The forest of ``est`` on ``data``, grown ``TREES_A_FIT`` trees a run, ``parallelism`` runs at a time, and put
    together.  A run finds all splits of a small table in one task, so one run of all trees
    leaves the other cores idle.  Each run has a seed of its own (the first the estimator's),
    whatever the machine, and keeps in which node a row is instead of passing trees on."""
    if isinstance(est, GR.GrownForest):
        return est.fit(data, params or {})
    est = est.copy(params or {})
    est.setCacheNodeIds(True)
    runs = forest_runs(est)
    if len(runs) == 1:
        return est.fit(data)
    with ThreadPoolExecutor(parallelism) as pool:
        fitted = list(pool.map(lambda run: run.fit(data), runs))
    return put_together(est, fitted)


def put_together(est: RandomForestRegressor, fitted: list) -> RandomForestRegressionModel:
    """One forest of the trees of several, with the parameters of ``est``."""
    sc, size = SparkSession.builder.getOrCreate().sparkContext, sum(m.getNumTrees for m in fitted)
    kinds = sc._jvm.org.apache.spark.ml.regression
    trees = sc._gateway.new_array(kinds.DecisionTreeRegressionModel, size)
    for at, tree in enumerate(t for m in fitted for t in m._java_obj.trees()):
        trees[at] = tree
    made = RandomForestRegressionModel(kinds.RandomForestRegressionModel(f"forest_{uuid.uuid4().hex[:12]}", trees, fitted[0].numFeatures))
    est.copy({est.numTrees: size})._copyValues(made)._transfer_params_to_java()
    return made


def node_table(model) -> DataFrame:
    """(``tree``, ``weight``, ``id``, ``prediction``, ``impurity``, ``gain``, ``n``, ``left``, ``right``, ``feature``,
    ``threshold``, ``levels``): the nodes of a saved ensemble.  Leaves have no children;
    ``levels`` are the values that go left of a categorical split, else null."""
    spark = SparkSession.builder.getOrCreate()
    if isinstance(model, GR.GrownForestModel):
        nodes, inner, numeric = GR.node_rows(spark.read.parquet(model.grown)), F.col("left") >= 0, F.col("categories") < 0
        return nodes.select("tree", F.lit(1.0).alias("weight"), "id", "prediction", "impurity", "gain", "n", *[F.when(inner, F.col(c)).alias(c) for c in ("left", "right", "feature")],
                            F.when(inner & numeric, F.col("threshold")).alias("threshold"), F.when(inner & ~numeric, F.array("threshold")).alias("levels"))
    path = intermediate_path(spark, f"tree_nodes_{uuid.uuid4().hex[:8]}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").toDF("treeID", "nodeData")
    trees = spark.read.parquet(f"{path}/treesMetadata").toDF("of", "metadata", "weight").select("of", "weight")
    d = F.col("nodeData")
    split = d["split"]
    numeric = split["numCategories"] < 0
    return nodes.join(trees, nodes["treeID"] == trees["of"]).select(
        F.col("treeID").alias("tree"), "weight", d["id"].alias("id"), d["prediction"].alias("prediction"), d["impurity"].alias("impurity"),
        d["gain"].alias("gain"), d["impurityStats"][0].alias("n"), F.when(d["leftChild"] >= 0, d["leftChild"]).alias("left"),
        F.when(d["leftChild"] >= 0, d["rightChild"]).alias("right"), F.when(d["leftChild"] >= 0, split["featureIndex"]).alias("feature"),
        F.when(numeric, split["leftCategoriesOrThreshold"][0]).alias("threshold"), F.when(~numeric, split["leftCategoriesOrThreshold"]).alias("levels"))


def importances(model, names: list[str]) -> DataFrame:
    """(``feature``, ``importance``), most important first, features without a split too.  A
    feature's share of a tree is the sum over its splits of gain x rows, in forests relative
    to all splits of the tree; shares are summed over the trees and add up to one."""
    spark = SparkSession.builder.getOrCreate()
    splits = node_table(model).where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("g"))
    if is_forest(model):
        whole = splits.groupBy("tree").agg(F.sum("g").alias("whole")).where("whole > 0")
        splits = splits.join(whole, "tree").withColumn("g", F.col("g") / F.col("whole"))
    per = splits.groupBy("feature").agg(F.sum("g").alias("g"))
    found = per.crossJoin(F.broadcast(per.agg(F.sum("g").alias("every"))))        # one row
    labels = spark.createDataFrame(list(enumerate(names)), "at int, name string")
    return (labels.join(found, F.col("at") == F.col("feature"), "left")
            .select(F.col("name").alias("feature"), F.coalesce(F.col("g") / F.nullif("every", F.lit(0.0)), F.lit(0.0)).alias("importance"))
            .orderBy(F.desc("importance"), "feature"))


def _cut_tree(nodes: pd.DataFrame, depths: list[int]) -> pd.DataFrame:
    """The leaves of one tree, left to right, with the prediction of each at every cut."""
    nodes = nodes.sort_values("id")
    left, right, value = (nodes[c].to_numpy() for c in ("left", "right", "value"))
    seen, depth, front = np.full((len(nodes), len(depths)), np.nan), 0, np.zeros(1, dtype=left.dtype)
    while front.size:                                 # level by level: a cut's value goes down to the leaves
        for i, d in enumerate(depths):
            if d == depth:
                seen[front, i] = value[front]
        inner = front[left[front] >= 0]
        seen[left[inner]] = seen[right[inner]] = seen[inner]
        front, depth = np.concatenate([left[inner], right[inner]]), depth + 1
    ends = left < 0                                   # nodes are numbered left before right, so leaves come in their order
    cuts = np.where(np.isnan(seen[ends]), value[ends, None], seen[ends])
    return pd.DataFrame({"tree": nodes["tree"].iloc[0], "leaf": np.arange(len(cuts)), **{f"p{i}": cuts[:, i] for i in range(len(depths))}})


def cut_predictions(model, depths: list[int]) -> DataFrame:
    """(``tree``, ``leaf``, ``p0``, ``p1``, ...): what each tree predicts for the rows of a leaf (numbered
    as ``predictLeaf`` does) when cut at each of the depths, times the tree's weight.  A task
    holds the nodes of one tree."""
    nodes = node_table(model).select("tree", "id", F.coalesce("left", F.lit(-1)).alias("left"), F.coalesce("right", F.lit(-1)).alias("right"),
                                     (F.col("prediction") * F.col("weight")).alias("value"))
    schema = "tree int, leaf int, " + ", ".join(f"p{i} double" for i in range(len(depths)))
    return nodes.groupBy("tree").applyInPandas(lambda tree: _cut_tree(tree, depths), schema)


def forest_sums(model, held: DataFrame, label: str, key: str, sizes: list[int], depths: list[int], first: int = 0) -> DataFrame:
    """(``key``, ``label``, ``s0``, ``s1``, ...) of the held rows: for every size and depth, the sum of the predictions
    of those trees of ``model``, numbered from ``first``, that a forest of the size has."""
    found = model.setLeafCol("leaf").transform(held).select(key, label, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"))
    cells = [(k, i) for k in sizes for i in range(len(depths))]
    return (found.withColumn("leaf", F.col("leaf").cast("int")).join(cut_predictions(model, depths), ["tree", "leaf"]).groupBy(key, label)
            .agg(*[F.sum(F.when(F.col("tree") + first < k, F.col(f"p{i}")).otherwise(0.0)).alias(f"s{j}") for j, (k, i) in enumerate(cells)]))


def forest_scores(sums: DataFrame, label: str, sizes: list[int], depths: list[int]) -> dict[tuple[int, int], float]:
    """R^2 at every size and depth from the rows of ``forest_sums`` over all trees."""
    cells = [(k, d) for k in sizes for d in depths]
    errors = sums.agg(F.var_pop(label).alias("spread"), *[F.avg((F.col(label) - F.col(f"s{j}") / k) ** 2).alias(f"e{j}") for j, (k, _) in enumerate(cells)]).first()
    return {cell: 1 - errors[f"e{j}"] / errors["spread"] for j, cell in enumerate(cells)}


def nested_scores(model, held: DataFrame, label: str, key: str, sizes: list[int], depths: list[int]) -> dict[tuple[int, int], float]:
    """R^2 on ``held`` of the model's first ``sizes`` trees (forests: cut at each of the ``depths``), from one
    pass over its rows."""
    if is_forest(model):
        return forest_scores(forest_sums(model, held, label, key, sizes, depths), label, sizes, depths)
    spread = held.agg(F.var_pop(label)).first()[0]
    errors = model.evaluateEachIteration(held, "squared")       # of every number of stages
    return {(k, depths[-1]): 1 - errors[k - 1] / spread for k in sizes}


def _grown_scores(data: DataFrame, est, largest: dict, spans: dict, fold: str, folds: int, parallelism: int) -> dict | None:
    """R^2 of every group and fold from trees grown on binned rows (``growing``), by size and depth; None where
    Spark's trainer is needed.  ``largest`` are the groups' largest points."""
    tables = []
    for held in range(folds):
        found = GR.binned(data.where(F.col(fold) != held), est, data.where(F.col(fold) == held), GR.TABLE_BYTES // folds)
        if found is None:
            return None
        tables.append(found)
    groups = list(largest)
    if is_forest(est):
        if est.getFeatureSubsetStrategy() != "all":
            return None
        points = [est.copy(largest[g]) for g in groups]
        forests = [{"sampled": (e.getSeed(), e.getSubsamplingRate(), e.getBootstrap()), "limits": (e.getMaxDepth(), e.getMinInstancesPerNode()),
                    "sizes": spans[g][0], "cuts": tuple(spans[g][1])} for e, g in zip(points, groups)]
        scored: dict = {}
        for (held, at, k, depth), r in GR.forest_grid(data.sparkSession, tables, forests).items():
            scored.setdefault((groups[at], held), {})[k, depth] = r
        return scored

    def boosted(g: tuple, held: int) -> dict[tuple[int, int], float]:
        one = est.copy()
        one.table = tables[held]
        errors = one.fit(data.where(F.col(fold) != held), largest[g])
        return {(k, spans[g][1][-1]): 1 - float(errors[k - 1] / np.var(tables[held].held_y)) for k in spans[g][0]}
    with ThreadPoolExecutor(max(parallelism, data.sparkSession.sparkContext.defaultParallelism)) as pool:     # a run is one task
        jobs = {(g, held): pool.submit(boosted, g, held) for g in groups for held in range(folds)}
        return {cell: job.result() for cell, job in jobs.items()}


def nested_search(feats: DataFrame, est, grid_maps: list[dict], label: str, key: str, fold: str, folds: int, parallelism: int) -> list[float]:
    """Mean held-out R^2 of every grid point of a forest or boosting estimator.

    Grid points that differ in the number of trees alone (forests: or in the depth) are one
    group; its largest model is trained once a fold, ``parallelism`` at a time, and the
    others are parts of it.  A forest's part is a forest of that size from the same draw of
    samples, not the one that Spark draws for that size alone; boosting runs are the same."""
    forest = is_forest(est)
    size = est.numTrees if forest else est.maxIter
    inner = [size, est.maxDepth] if forest else [size]
    groups: dict[tuple, list[dict]] = {}
    for m in grid_maps:
        groups.setdefault(tuple(sorted((p.name, v) for p, v in m.items() if p not in inner)), []).append(m)
    spans = {g: (sorted({m[size] for m in members}), sorted({m.get(est.maxDepth, est.getMaxDepth()) for m in members})) for g, members in groups.items()}
    largest = {g: {**groups[g][0], size: spans[g][0][-1], est.maxDepth: spans[g][1][-1]} for g in groups}
    scored = None
    if isinstance(est, (GR.GrownForest, GR.GrownBoosting)):
        scored = _grown_scores(feats, est, largest, spans, fold, folds, parallelism)
        est = GR.plain(est)
    if scored is None:
        scored = _trained_scores(feats, est, largest, spans, label, key, fold, folds, parallelism)
    out = []
    for m in grid_maps:
        g = tuple(sorted((p.name, v) for p, v in m.items() if p not in inner))
        cell = (m[size], m.get(est.maxDepth, est.getMaxDepth()))
        out.append(sum(scored[g, held][cell] for held in range(folds)) / folds)
    return out


def _trained_scores(feats: DataFrame, est, largest: dict, spans: dict, label: str, key: str, fold: str, folds: int, parallelism: int) -> dict:
    """R^2 of every group and fold from models of Spark's trainer, by size and depth."""
    forest, groups = is_forest(est), list(largest)
    rows = feats.count()
    tasks = max(1, rows // ROWS_A_TASK)
    data = feats.coalesce(tasks).persist()

    def boosted(g: tuple, held: int) -> dict[tuple[int, int], float]:
        model = est.fit(data.where(F.col(fold) != held), largest[g])
        return nested_scores(model, data.where(F.col(fold) == held), label, key, *spans[g])

    def grown(g: tuple, held: int, at: int) -> DataFrame:
        train = data.where(F.col(fold) != held)
        model = put_together(est, [run.fit(train) for run in runs[g][at:at + block]])
        return materialize(forest_sums(model, data.where(F.col(fold) == held), label, key, *spans[g], at * TREES_A_FIT), "forest_sums")

    def gathered(g: tuple, parts: list) -> dict[tuple[int, int], float]:
        sums = functools.reduce(DataFrame.unionByName, [part.result() for part in parts])
        whole = sums.groupBy(key, label).agg(*[F.sum(c).alias(c) for c in sums.columns if c not in (key, label)])
        return forest_scores(whole, label, *spans[g])

    # the runs of all forests share one pool; of grown trees only their sums are kept.  A tree has as many nodes as
    # rows, so the more rows, the fewer trees are on the driver at a time (and the more tasks has each run)
    block = max(1, min(RUNS_A_SCORE, ROWS_A_TASK // max(rows, 1)))
    workers = max(1, 2 * parallelism // tasks) if forest else parallelism
    runs = {g: forest_runs(est.copy(largest[g])) for g in groups} if forest else {}
    with ThreadPoolExecutor(workers) as pool:
        cells = [(g, held) for g in groups for held in range(folds)]
        if forest:
            parts = {(g, held): [pool.submit(grown, g, held, at) for at in range(0, len(runs[g]), block)] for g, held in cells}
            scored = {cell: gathered(cell[0], parts[cell]) for cell in cells}
        else:
            jobs = {cell: pool.submit(boosted, *cell) for cell in cells}
            scored = {cell: job.result() for cell, job in jobs.items()}
    data.unpersist()
    return scored
