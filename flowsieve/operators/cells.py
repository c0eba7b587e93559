"""Rows that a tree learner cannot tell apart, counted instead of repeated.

A learner sees a feature as one of at most MAX_BINS bins.  Rows of the same bins
and label are one cell with a weight, so what a fit reads, keeps and goes
through at every level grows with the cells, which bins and features bound, and
not with the rows.  Every row is read for its bins and counted.

Sums of a tree over cells and weights are its sums over rows.  A forest's trees
see a row as often as a Poisson draw says; a cell of n rows is therefore drawn
from the sum of n such draws, a Poisson law of n times the mean, and every tree
is fitted on draws of its own.  The trees are fitted on numbers of bins and
stored with the cuts between them, so models score, store and explain like any
other.

Where all cells fit a task they are sent to the executors and ensembles are grown
there, by ``grow``: a boosted one, or a run of a forest's trees, a task.  Others
are grown by Spark, by a job per level.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, OneVsRest, OneVsRestModel, RandomForestClassificationModel
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.bounded import copy_stored, materialise, work_path
from flowsieve.functions.shipping import ship_package
from flowsieve.operators import grow
from flowsieve.operators.select import assemble

FEWEST_ROWS = 1_000_000     # tables up to this many rows are fitted as they are, which takes no longer
SHARE = 4                   # and those with fewer rows than this per cell
RANK_ERROR = 0.001          # of the quantiles at which a feature of many values is cut
PART_CELLS = 50_000         # cells of a partition
AT_ONCE = 8                 # trees of a forest being fitted side by side
MANY_ROUNDS = 20            # boosted ensembles of more rounds are grown in tasks, if cells of however few rows fit one
SENT_BYTES = 64 << 20       # of cells that are sent to executors,
TASK_BYTES = 256 << 20      # of what a task makes of them, some POINT_BYTES and its bins for each,
POINT_BYTES = 150
LABELS = 1000
LEVEL_SUMS = 1 << 23        # and of sums per node and bin of a level

NODES = ("id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int, "
         "split struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>")
_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
_NODE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                   ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", _SPLIT)])
_TREES = pa.schema([("model", pa.int32()), ("treeID", pa.int32()), ("nodeData", _NODE)])


@dataclass
class Cells:
    """(features, label_id, weight, number): features are numbers of bins, cuts the largest values of all bins but the last."""

    table: DataFrame
    cuts: list[list[float]]
    classes: int
    rows: int
    sent: list = field(default_factory=list)


def fold(ready: DataFrame, width: int, bins: int) -> Cells | None:
    """Cells of (features vector, label_id), or None where they would hardly be fewer than the rows."""
    total = ready.count()
    if total <= FEWEST_ROWS or not width:
        return None
    return _fold(ready, width, bins, total, True)


def fold_any(ready: DataFrame, width: int, bins: int, keep: tuple[str, ...] = ()) -> Cells | None:
    """The same for any number of rows, cells of rows that agree in ``keep`` too; None where they do not fit a task."""
    total = ready.count()
    held = _fold(ready, width, bins, total, total > FEWEST_ROWS and not keep, keep) if total and width else None
    return None if held is None or points(held, keep) is None else held


def _fold(ready: DataFrame, width: int, bins: int, total: int, fewer: bool, keep: tuple[str, ...] = ()) -> Cells | None:
    names = [f"_f{i}" for i in range(width)]
    plain = ready.select("label_id", *keep, vector_to_array("features").alias("_a"))
    # Several passes follow, over few columns.
    stored = materialise(plain.select("label_id", *keep, *[F.col("_a")[i].alias(f) for i, f in enumerate(names)]), "binned")
    top, *distinct = stored.agg(F.max("label_id"), *[F.approx_count_distinct(f) for f in names]).first()
    few = {}
    for f, about in zip(names, distinct):
        if about <= 2 * bins:
            found = sorted(r[0] for r in stored.select(f).distinct().limit(bins + 1).collect())
            if len(found) <= bins:
                few[f] = [(a + b) / 2 for a, b in zip(found, found[1:])]
    many = [f for f in names if f not in few]
    ranks = [i / bins for i in range(1, bins)]
    ranked = dict(zip(many, stored.approxQuantile(many, [*ranks, 1.0], RANK_ERROR))) if many else {}
    cuts = [few[f] if f in few else sorted(set(ranked[f][:-1]) - {ranked[f][-1]}) for f in names]
    binned = _binned(stored, names, cuts, keep)
    keys = ["label_id", *keep, *names]
    if fewer and binned.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0] * SHARE > total:
        return None
    counted = binned.groupBy(*keys).agg(F.count("*").cast("double").alias("weight")).withColumn("number", F.xxhash64(*keys))
    cells = materialise(assemble(counted, names).select("features", "label_id", *keep, "weight", "number"), "cells")
    parts = -(-cells.count() // PART_CELLS)
    return Cells(materialise(cells.repartition(parts, "number").sortWithinPartitions("number"), "cells"), cuts, int(top or 0) + 1, total)


def _binned(df: DataFrame, names: list[str], cuts: list[list[float]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Every column as the number of cuts its value is above."""
    cut = [i for i, own in enumerate(cuts) if own]
    out = {f"_b{i}": F.lit(0.0) for i in range(len(names))}
    if cut:
        # Buckets are open above; values up to a cut lie below the next larger number.
        splits = [[-math.inf, *[math.nextafter(c, math.inf) for c in cuts[i]], math.inf] for i in cut]
        df = Bucketizer(splitsArray=splits, inputCols=[names[i] for i in cut], outputCols=[f"_b{i}" for i in cut]).transform(df)
        out.update({f"_b{i}": F.col(f"_b{i}") for i in cut})
    return df.select("label_id", *keep, *[out[f"_b{i}"].alias(f) for i, f in enumerate(names)])


def points(cells: Cells, keep: tuple[str, ...] = ()) -> tuple[grow.Points, list[tuple]] | None:
    """(points, labels): how many rows there are of every combination of bins and of (kept columns, label); None if too many for a task.

    Fetched once.  Labels may be any numbers; rows without one fit nothing, and their table stays with Spark.
    """
    if not cells.sent:
        cells.sent.append(_fetched(cells, keep))
    return cells.sent[0]


def _fetched(cells: Cells, keep: tuple[str, ...]) -> tuple[grow.Points, list[tuple]] | None:
    width, kinds = len(cells.cuts), [*keep, "label_id"]
    found = cells.table.select(*kinds).distinct().limit(LABELS + 1).collect()
    labels = sorted(tuple(r) for r in found if None not in tuple(r) and not math.isnan(r["label_id"]))
    count = cells.table.count()
    if not labels or len(labels) < len(found) or len(found) > LABELS or count * (width + 8) > SENT_BYTES or count * (width + POINT_BYTES) > TASK_BYTES:
        return None
    if max(map(len, cells.cuts)) > 255:
        return None
    fetched = cells.table.select(*[vector_to_array("features")[i].cast("int").alias(f"_f{i}") for i in range(width)], *kinds, "weight").toArrow()
    bins = np.stack([fetched.column(i).to_numpy().astype(np.uint8) for i in range(width)])
    number = {label: i for i, label in enumerate(labels)}
    column = np.array([number[own] for own in zip(*(fetched.column(k).to_pylist() for k in kinds))], np.int64)
    order = np.lexsort(bins[::-1])
    bins, column, weight = bins[:, order], column[order], fetched.column("weight").to_numpy()[order]
    new = np.ones(bins.shape[1], bool)
    new[1:] = (bins[:, 1:] != bins[:, :-1]).any(axis=0)
    if int(new.sum()) * 8 * len(labels) > SENT_BYTES:
        return None
    at = np.cumsum(new) - 1
    counts = np.bincount(at * len(labels) + column, weight, int(new.sum()) * len(labels)).reshape(-1, len(labels))
    return grow.Points(np.ascontiguousarray(bins[:, new]), [len(c) + 1 for c in cells.cuts], counts), labels


def by_class(found: tuple[grow.Points, list[tuple]] | None, classes: int, part: tuple = ()) -> np.ndarray | None:
    """(points, classes) of rows, of those with ``part`` in the kept columns; None if labels are no class numbers."""
    if found is None or any(label[-1] != int(label[-1]) or not 0 <= label[-1] < classes for label in found[1]):
        return None
    out = np.zeros((found[0].counts.shape[0], classes))
    for i, label in enumerate(found[1]):
        if not part or label[:-1] == part:
            out[:, int(label[-1])] += found[0].counts[:, i]
    return out


def in_tasks(spark: SparkSession, jobs: list, work: Callable[[object], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``work`` makes of every job, each in a task of its own."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield work(jobs[number])

    return spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, schema)


def rounds_of(estimator) -> int:
    """Boosting rounds of an estimator, 0 for a forest."""
    return 0 if estimator.hasParam("numTrees") else _boosted(estimator).getMaxIter()


def _boosted(estimator):
    return estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator


def boosts_in_tasks(estimator) -> bool:
    """Whether ``grow`` boosts as the estimator does: every row and every feature in every round."""
    if estimator.hasParam("numTrees") or not suits(estimator):
        return False
    own = _boosted(estimator)
    return own.getFeatureSubsetStrategy() == "all" and 2 ** own.getMaxDepth() * 32 * 2 <= LEVEL_SUMS


def boosting_of(estimator) -> dict:
    """What ``grow.boost`` takes of an estimator."""
    own = _boosted(estimator)
    return {"rounds": own.getMaxIter(), "rate": own.getStepSize(), "depth": own.getMaxDepth(), "least": own.getMinInstancesPerNode(),
            "least_gain": own.getMinInfoGain()}


def one_of(counts: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are not and that are of class ``c``."""
    one = counts[:, c] if c < counts.shape[1] else np.zeros(len(counts))
    return counts.sum(axis=1) - one, one


def suits(estimator) -> bool:
    """Whether fits on cells and on rows are the same; boosting on a share of the rows draws single rows."""
    return estimator.hasParam("numTrees") or _boosted(estimator).getSubsamplingRate() >= 1.0


def _learner(estimator, least: int, total: float, **settings):
    """A copy that reads weights; a least number of rows in a node becomes a least weight."""
    copy = estimator.copy()
    params = {copy.getParam(k): v for k, v in {"weightCol": "weight", **settings}.items()}
    if least > 1:
        params.update({copy.getParam("minInstancesPerNode"): 1, copy.getParam("minWeightFractionPerNode"): min(0.499, (least - 0.5) / total)})
    return copy.copy(params)


def _labelled(table: DataFrame, classes: int) -> DataFrame:
    """Labels that say how many classes there are, whichever of them a tree has drawn."""
    label = F.col("label_id").alias("label_id", metadata={"ml_attr": {"type": "nominal", "num_vals": classes}})
    return table.select("features", label, "weight")


def fit_boosted(estimator, cells: Cells, finish, ridge: float = 0.0, most: int | None = None):
    """A boosted ensemble, or one per class, fitted on cells.

    Where tasks grow it, its leaves get what ``ridge`` and ``most`` say; else ``finish`` may change it while its cuts are numbers of bins.
    """
    several = isinstance(estimator, OneVsRest)
    counts = by_class(points(cells), cells.classes) if boosts_in_tasks(estimator) and (several or cells.classes <= 2) else None
    if counts is not None:
        return _boosted_in_tasks(estimator, cells, counts, range(cells.classes) if several else [1], ridge, most)
    ready = _labelled(cells.table, cells.classes).persist()
    try:
        if several:
            inner = estimator.getClassifier()
            own = _learner(inner, inner.getMinInstancesPerNode(), cells.rows)
            model = estimator.copy({estimator.classifier: own, estimator.weightCol: "weight"}).fit(ready)
        else:
            model = _learner(estimator, estimator.getMinInstancesPerNode(), cells.rows).fit(ready)
        model = finish(model, ready)
    finally:
        ready.unpersist()
    if isinstance(model, OneVsRestModel):
        return model._copyValues(OneVsRestModel([_with_cuts(part, cells.cuts) for part in model.models]))
    return _with_cuts(model, cells.cuts)


def _boosted_in_tasks(estimator, cells: Cells, counts: np.ndarray, classes, ridge: float, most: int | None):
    spark, learner, setting = cells.table.sparkSession, _boosted(estimator), boosting_of(estimator)
    sent, cuts = spark.sparkContext.broadcast((points(cells)[0], counts)), cells.cuts

    def work(c: int) -> pa.RecordBatch:
        own, of = sent.value
        _, trees = grow.boost(own, *one_of(of, c), ridge=ridge, most=most, cuts=cuts, **setting)
        return pa.RecordBatch.from_pylist([{"model": c, "treeID": t, "nodeData": r} for t, rows in enumerate(trees) for r in rows], _TREES)

    grown = materialise(in_tasks(spark, list(classes), work, f"model int, treeID int, nodeData struct<{_colons(NODES)}>"), "grown")
    sent.unpersist()
    # One round on two rows says how Spark stores an ensemble; its trees and their number are those grown above.
    path = _sample_model(spark, learner.copy({learner.maxIter: 1}), len(cuts), "boosted")
    rounds, rate = setting["rounds"], setting["rate"]
    models = []
    for c in classes:
        target = work_path(spark, "grown-boosted")
        _store_trees(spark, grown.filter(F.col("model") == c), path, target, [1.0] + [rate] * (rounds - 1), {"numTrees": rounds}, {"maxIter": rounds})
        models.append(GBTClassificationModel.load(target))
    return estimator._copyValues(OneVsRestModel(models)) if isinstance(estimator, OneVsRest) else models[0]


def _colons(fields: str) -> str:
    """Column definitions as fields of a struct."""
    return ",".join(":".join(part.split(" ", 1)) for part in fields.split(", "))


def _sample_model(spark: SparkSession, learner, width: int, name: str) -> str:
    path, zeros = work_path(spark, name), Vectors.dense([0.0] * width)
    learner.fit(spark.createDataFrame([(zeros, 0.0), (zeros, 1.0)], ["features", "label_id"])).write().save(path)
    return path


def _store_trees(spark: SparkSession, nodes: DataFrame, sample: str, target: str, weights: list[float], facts: dict, params: dict) -> None:
    """A model of ``nodes`` (treeID, nodeData) in the form of the stored ``sample``."""
    nodes.select("treeID", "nodeData").coalesce(1).write.parquet(f"{target}/data")
    first = spark.read.parquet(f"{sample}/treesMetadata").first()
    spark.createDataFrame([(t, first["_2"], w) for t, w in enumerate(weights)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{target}/treesMetadata")
    told = json.loads(spark.read.text(f"{sample}/metadata").first()[0])
    told.update(facts)
    told["paramMap"].update(params)
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{target}/metadata")


def _with_cuts(model: GBTClassificationModel, cuts: list[list[float]]) -> GBTClassificationModel:
    spark = SparkSession.getActiveSession()
    path, target = work_path(spark, "boosted"), work_path(spark, "unbinned")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    # Regression trees keep weight, sum and sum of squares.
    _unbinned(stored, cuts, F.get("nodeData.impurityStats", F.lit(0))).write.parquet(f"{target}/data")
    copy_stored(spark, path, target, ("metadata", "treesMetadata"))
    return GBTClassificationModel.load(target)


def _unbinned(stored: DataFrame, cuts: list[list[float]], weight: Column) -> DataFrame:
    """Stored nodes with cuts for numbers of bins and rows for cells."""
    limits = F.array(*[F.array(*[F.lit(float(c)) for c in own]) if own else F.array().cast("array<double>") for own in cuts])
    split = F.col("nodeData.split")
    # A node between two bins, or further apart, sends all up to the lower one to the left.
    cut = F.transform(split["leftCategoriesOrThreshold"], lambda t: F.get(F.get(limits, F.col("nodeData.split.featureIndex")), F.floor(t).cast("int")))
    node = F.col("nodeData").withField("split", split.withField("leftCategoriesOrThreshold", cut))
    return stored.select("treeID", node.withField("rawCount", F.round(weight).cast("bigint")).alias("nodeData"))


def fit_forest(estimator, cells: Cells) -> RandomForestClassificationModel:
    """A forest whose trees are fitted one by one, several at a time, on cells weighted by draws of their own."""
    spark = SparkSession.getActiveSession()
    shallow = 2 ** estimator.getMaxDepth() * 32 * cells.classes <= LEVEL_SUMS
    counts = by_class(points(cells), cells.classes) if shallow else None
    if counts is not None:
        return _forest_in_tasks(estimator, cells, counts)
    trees, rate, seed = estimator.getNumTrees(), estimator.getSubsamplingRate(), estimator.getSeed()
    least, key = estimator.getMinInstancesPerNode(), estimator.getSeed() & 0xFFFFFFFF

    @F.pandas_udf("array<int>")
    def drawn(number: pd.Series, weight: pd.Series) -> pd.Series:
        # A generator per cell, so that draws do not depend on partitions.
        return pd.Series([np.random.default_rng([key, n & 0xFFFFFFFFFFFFFFFF]).poisson(rate * w, trees).astype(np.int32)
                          for n, w in zip(number.tolist(), weight.tolist())])

    # A column a tree: a fit reads its own alone, by code that is the same, and compiled once, for all trees.
    every = cells.table.select("features", "label_id", drawn("number", "weight").alias("bag"))
    bags = every.select("features", "label_id", *[F.col("bag")[t].cast("double").alias(f"_w{t}") for t in range(trees)]).persist()
    path, target = work_path(spark, "trees"), work_path(spark, "forest")
    try:
        totals = bags.agg(*[F.sum(f"_w{t}") for t in range(trees)]).first()

        def grow(t: int) -> None:
            own = bags.select("features", "label_id", F.col(f"_w{t}").alias("weight")).filter("weight > 0")
            alone = _learner(estimator, least, totals[t], numTrees=1, bootstrap=False, subsamplingRate=1.0, seed=seed + t)
            alone.fit(_labelled(own, cells.classes)).write().save(f"{path}/{t}")

        with ThreadPoolExecutor(min(AT_ONCE, trees)) as pool:
            for finished in [pool.submit(inheritable_thread_target(spark)(grow), t) for t in range(trees)]:
                finished.result()
    finally:
        bags.unpersist()
    number = F.regexp_extract(F.input_file_name(), r"/(\d+)/[a-zA-Z]+/[^/]*$", 1).cast("int")
    stored = spark.read.parquet(*[f"{path}/{t}/data" for t in range(trees)]).withColumn("treeID", number)
    weight = F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda a, x: a + x)
    _unbinned(stored, cells.cuts, weight).write.parquet(f"{target}/data")
    spark.read.parquet(*[f"{path}/{t}/treesMetadata" for t in range(trees)]).withColumn("_1", number).coalesce(1).write.parquet(f"{target}/treesMetadata")
    told = json.loads(spark.read.text(f"{path}/0/metadata").first()[0])
    told["numTrees"] = trees
    told["paramMap"].update(numTrees=trees, subsamplingRate=rate, bootstrap=True, minInstancesPerNode=least, seed=seed)
    for own in ("weightCol", "minWeightFractionPerNode"):
        told["paramMap"].pop(own, None)
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{target}/metadata")
    return RandomForestClassificationModel.load(target)


def _forest_in_tasks(estimator, cells: Cells, counts: np.ndarray) -> RandomForestClassificationModel:
    """The same, a run of trees a task; the draws of a tree follow from its number and the order of the points."""
    spark = cells.table.sparkSession
    trees, rate, key = estimator.getNumTrees(), estimator.getSubsamplingRate(), estimator.getSeed() & 0xFFFFFFFF
    law, depth, least = grow.LAWS[estimator.getImpurity()], estimator.getMaxDepth(), estimator.getMinInstancesPerNode()
    least_gain, subset = estimator.getMinInfoGain(), grow.subset_size(estimator.getFeatureSubsetStrategy(), len(cells.cuts))
    sent, cuts = spark.sparkContext.broadcast((points(cells)[0], counts)), cells.cuts

    def work(run: list[int]) -> pa.RecordBatch:
        own, of = sent.value
        found = []
        for t in run:
            rng = np.random.default_rng([key, t])
            tree = grow.grow(own, list(grow.drawn(of, rate, rng).T.copy()), law, depth, least, least_gain, rng, subset)
            found += [{"model": 0, "treeID": t, "nodeData": r} for r in grow.stored(tree, law, cuts)[0]]
        return pa.RecordBatch.from_pylist(found, _TREES)

    grown = materialise(in_tasks(spark, runs(spark, trees), work, f"model int, treeID int, nodeData struct<{_colons(NODES)}>"), "grown")
    sent.unpersist()
    path, target = _sample_model(spark, estimator.copy({estimator.numTrees: 1}), len(cuts), "forest"), work_path(spark, "grown-forest")
    _store_trees(spark, grown, path, target, [1.0] * trees, {"numTrees": trees, "numClasses": cells.classes}, {"numTrees": trees})
    return RandomForestClassificationModel.load(target)


def runs(spark: SparkSession, trees: int) -> list[list[int]]:
    """Numbers of trees, a few for every task."""
    parts = min(trees, 2 * spark.sparkContext.defaultParallelism)
    return [list(range(i, trees, parts)) for i in range(parts)]


def ranking_shares(estimator, cells: Cells) -> np.ndarray | None:
    """Importances by a regression forest on the labels' numbers, as Spark takes them from its trees; None if cells do not fit a task."""
    found = points(cells)
    if found is None or 2 ** estimator.getMaxDepth() * 32 * 2 > LEVEL_SUMS:
        return None
    spark = cells.table.sparkSession
    trees, rate, key = estimator.getNumTrees(), estimator.getSubsamplingRate(), estimator.getSeed() & 0xFFFFFFFF
    depth, least, least_gain = estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain()
    values, width = np.array([label[-1] for label in found[1]]), len(cells.cuts)
    sent = spark.sparkContext.broadcast(found[0])

    def work(run: list[int]) -> pa.RecordBatch:
        own, shares = sent.value, []
        for t in run:
            seen = grow.drawn(own.counts, rate, np.random.default_rng([key, t]))
            tree = grow.grow(own, [seen.sum(axis=1), seen @ values, seen @ values ** 2], grow.Variance, depth, least, least_gain)
            shares.append(grow.importances(tree, grow.Variance, width).tolist())
        return pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(shares, pa.list_(pa.float64()))], names=["tree", "share"])

    grown = in_tasks(spark, runs(spark, trees), work, "tree int, share array<double>").collect()
    sent.unpersist()
    total = np.sum([row["share"] for row in sorted(grown, key=lambda row: row["tree"])], axis=0)
    return total / total.sum() if total.sum() > 0 else total
