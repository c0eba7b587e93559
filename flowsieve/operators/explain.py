"""Exact tree attributions and the views built on them.

Attributions are Shapley values of the path-dependent expectation of a tree
(Lundberg et al., "From local explanations to global understanding with
explainable AI for trees", 2020).  For one leaf the value function is a product
over the features of its path, so a feature's Shapley value is the integral
over t in [0, 1] of the product of (t * hit + (1 - t) * share) over the other
features (Owen's multilinear extension).

The product is carried down the tree as a polynomial in t, by its values at
Gauss-Legendre nodes, which integrate it exactly; the leaves' polynomials are
added up on the way back (Yu et al., "Linear TreeShap", 2022).  An edge divides
its feature's earlier factor out and multiplies its own in, and settles its
feature's share of all leaves below it at once.  Every edge of a tree is visited
twice, with one row of each cell between that tree's own cuts, whole batches of
them together.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.bounded import SMALL_BYTES, join_on, materialise, small_table, work_path
from flowsieve.functions.scalar import named
from flowsieve.functions.shipping import ship_package

GROUP_BYTES = 16 << 20      # trees of this size are held against a lane of rows at once
LANE_ROWS = 20_000          # cells that are, at most about
LEAST_ROWS = 500            # cells a lane has at least, where there are fewer than that for every core
SPREAD = (5, 25, 50, 75, 95)  # percentiles of attributions
SKETCH_K = 800              # size of a quantile sketch, for ranks within
RANK_ERROR = 0.005          # of all rows
CELL_LIMIT = 400_000        # rows x nodes of integration x outputs held per level of a tree


@dataclass
class Tree:
    """Nodes of one tree in preorder; what leads to a node stands with it."""

    feature: np.ndarray     # feature tested on the way in
    cut: np.ndarray
    left: np.ndarray        # whether values up to the cut come here
    share: np.ndarray       # product of child/parent covers over this feature's edges from the root on
    before: np.ndarray      # last node above whose edge tests the same feature, -1 if none
    parent: np.ndarray
    leaf: np.ndarray
    value: np.ndarray       # node x output, zero inside the tree
    base: np.ndarray        # expectation over all paths
    slots: int              # most different features on a path
    outputs: np.ndarray     # class code of every output

    def nbytes(self) -> int:
        return sum(a.nbytes for a in vars(self).values() if isinstance(a, np.ndarray))


def stored_trees(model) -> DataFrame:
    """(number, size, data) of every tree, built from the model's stored nodes by one task per tree."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import OneVsRestModel

    if isinstance(model, PipelineModel):
        return stored_trees(model.stages[-1])
    models = model.models if isinstance(model, OneVsRestModel) else [model]
    parts = [_trees_of(part, code) for code, part in (enumerate(models) if len(models) > 1 else [(1, models[0])])]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    place = F.row_number().over(W.orderBy("code", "treeID"))  # one row per tree, without its data
    numbers = table.select("code", "treeID").withColumn("number", place)
    return materialise(table.join(numbers, ["code", "treeID"]).select("number", "size", "data"), "trees")


def _trees_of(model, code: int) -> DataFrame:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    ship_package(spark)
    path = work_path(spark, "model")
    model.write().save(path)
    raw = spark.read.parquet(f"{path}/data")
    if "treeID" not in raw.columns:
        raw = raw.select(F.lit(0).alias("treeID"), F.struct(*raw.columns).alias("nodeData"))
    nodes = raw.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.rawCount",
                       "nodeData.leftChild", "nodeData.rightChild",
                       F.col("nodeData.split.featureIndex").alias("feature"),
                       F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
                       F.col("nodeData.split.numCategories").alias("categories"))
    kind = type(model).__name__
    boosted = list(model.treeWeights) if kind.startswith("GBT") else None
    trees = 1 if "DecisionTree" in kind else len(model.treeWeights)
    classes = model.numClasses if kind in ("RandomForestClassificationModel", "DecisionTreeClassificationModel") else 0

    def build(tree: pd.DataFrame) -> pd.DataFrame:
        number = int(tree["treeID"].iloc[0])
        built = _tree(tree, boosted[number] if boosted else 1.0 / trees, classes, code)
        return pd.DataFrame({"code": [code], "treeID": [number], "size": [built.nbytes()], "data": [pickle.dumps(built)]})

    return materialise(nodes.groupBy("treeID").applyInPandas(build, "code int, treeID int, size long, data binary"), "trees")


def _tree(table: pd.DataFrame, weight: float, classes: int, code: int) -> Tree:
    """Lay a tree's nodes out in preorder, each with the edge that leads to it."""
    node = table.set_index("id").to_dict("index")
    outputs = np.arange(classes) if classes else np.array([code])
    rows, slots = [], 1
    base = np.zeros(len(outputs))
    # (node id, parent's row, feature, cut, left, {feature: (row, share)} of the path, share of all covers)
    todo = [(0, -1, -1, np.nan, False, {}, 1.0)]
    while todo:
        number, parent, feature, cut, left, path, reached = todo.pop()
        at, row = node[number], len(rows)
        before, share = -1, 1.0
        if parent >= 0:
            before, share = path.get(feature, (-1, 1.0))
            share *= at["rawCount"] / node[rows[parent][-1]]["rawCount"]
            path = {**path, feature: (row, share)}
            slots = max(slots, len(path))
        leaf, value = at["leftChild"] < 0, np.zeros(len(outputs))
        if leaf:
            stats = np.asarray(at["impurityStats"], dtype=float)
            value = (stats / stats.sum() if classes else np.array([at["prediction"]])) * weight
            base += reached * value
        elif at["categories"] not in (-1, None):
            raise ValueError("categorical splits are not supported")
        else:
            for child, side in ((at["rightChild"], False), (at["leftChild"], True)):
                part = node[child]["rawCount"] / at["rawCount"]
                todo.append((child, row, int(at["feature"]), float(at["threshold"]), side, path, reached * part))
        rows.append((feature, cut, left, share, before, parent, leaf, value, number))
    columns = list(zip(*rows))
    kinds = (np.int32, np.float64, bool, np.float64, np.int32, np.int32, bool)
    return Tree(*[np.array(c, dtype=k) for c, k in zip(columns, kinds)], np.stack(columns[7]), base, slots, outputs)


def tree_attributions(tree: Tree, x: np.ndarray):
    """(phi rows x features x outputs, base outputs, output rows x outputs) of one tree."""
    first, place = _own_cells(tree, x)
    outputs = tree.value.shape[1]
    # Rows come last, so that every step goes through them side by side.
    phi, output = np.zeros((x.shape[1], outputs, len(first))), np.zeros((outputs, len(first)))
    t, weights = np.polynomial.legendre.leggauss(tree.slots // 2 + 1)
    t, weights = (t + 1) / 2, weights / 2
    step = max(1, CELL_LIMIT // (len(t) * outputs))
    for start in range(0, len(first), step):
        rows = slice(start, start + step)
        _down_and_up(tree, np.ascontiguousarray(x[first[rows]].T), t, weights, phi[..., rows], output[:, rows])
    return phi.transpose(2, 0, 1)[place], tree.base, output.T[place]


def _own_cells(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each of the cells between this tree's cuts, and the cell of every row: one tree has fewer cuts than all."""
    place, room = np.zeros(len(x), dtype=np.int64), 1
    for feature in np.unique(tree.feature[tree.feature >= 0]):
        cuts = np.unique(tree.cut[tree.feature == feature])
        if room * (len(cuts) + 1) >= 1 << 62:
            place = np.unique(place, return_inverse=True)[1]
            room = len(x)
        place = place * (len(cuts) + 1) + np.searchsorted(cuts, x[:, feature], side="left")
        room *= len(cuts) + 1
    return np.unique(place, return_index=True, return_inverse=True)[1:]


def _down_and_up(tree: Tree, x: np.ndarray, t: np.ndarray, weights: np.ndarray, phi: np.ndarray, output: np.ndarray) -> None:
    """Add a tree's attributions and output for some rows, which come last in all arrays; holds what stands on one path of the tree."""
    n = x.shape[1]
    product, total, reached = {0: np.ones((len(t), n))}, {}, {0: np.ones(n, dtype=bool)}
    hit, factor, gain, compared = {}, {}, {}, {}

    def leave(i: int) -> None:
        """Settle the edge above node ``i``, all of whose leaves are known."""
        below = total.pop(i)
        del product[i], reached[i]
        parent, before, feature = tree.parent[i], tree.before[i], tree.feature[i]
        if parent < 0:
            return
        change = gain.pop(i) if before < 0 else gain.pop(i) - gain[before]
        for part, own, weight in zip(change, below, weights):
            phi[feature] += weight * part * own
        total[parent] = total[parent] + below if parent in total else below
        del hit[i], factor[i]

    path = []
    for i in range(len(tree.parent)):
        parent = tree.parent[i]
        while path and path[-1] != parent:
            compared.pop(path[-1], None)
            leave(path.pop())
        if parent >= 0:
            if parent not in compared:
                compared[parent] = x[tree.feature[i]] <= tree.cut[i]
            inside = compared[parent] if tree.left[i] else ~compared[parent]
            before, share = tree.before[i], tree.share[i]
            hit[i] = inside if before < 0 else inside & hit[before]
            factor[i] = hit[i] * t[:, None] + ((1 - t) * share)[:, None]
            gain[i] = (hit[i] - share) / factor[i]
            product[i] = product[parent] * factor[i] if before < 0 else product[parent] * (factor[i] / factor[before])
            reached[i] = reached[parent] & inside
        if tree.leaf[i]:
            total[i] = product[i][:, None, :] * tree.value[i][:, None]
            output[:, reached[i]] += tree.value[i][:, None]
        path.append(i)
    while path:
        leave(path.pop())


def _cuts(trees: DataFrame, width: int) -> tuple[list[np.ndarray], int]:
    """Distinct cuts of every feature, ascending, and how many outputs the trees have; no more than the model has nodes."""

    def each(batches):
        for pdf in batches:
            for data in pdf["data"]:
                tree = pickle.loads(data)
                inner = tree.feature >= 0
                yield pd.DataFrame({"feature": np.append(tree.feature[inner], np.full(len(tree.outputs), -1)),
                                    "cut": np.append(tree.cut[inner], tree.outputs)}).drop_duplicates()

    found = trees.select("data").mapInPandas(each, "feature int, cut double").distinct().toPandas()
    cuts = [np.sort(found["cut"][found["feature"] == f].to_numpy(dtype=float)) for f in range(width)]
    return cuts, int((found["feature"] == -1).sum())


def _with_cells(rows: DataFrame, values: list[str], cuts: list[np.ndarray]) -> tuple[DataFrame, list[str]]:
    """Rows with the cell they lie in, as numbers in as many columns as it takes; rows of a cell pass every cut on the same side."""
    packed, room = [[]], 1
    for f, own in enumerate(cuts):
        if room * (len(own) + 1) >= 1 << 62:
            packed, room = [*packed, []], 1
        packed[-1].append(f)
        room *= len(own) + 1
    keys = [f"_cell{i}" for i in range(len(packed))]

    @F.pandas_udf(", ".join(f"{k} long" for k in keys))
    def cells(*columns: pd.Series) -> pd.DataFrame:
        found = {}
        for key, members in zip(keys, packed):
            number = np.zeros(len(columns[0]), dtype=np.int64)
            for f in members:
                # As many cuts as a value is above; what is missing or no number is above all.
                number = number * (len(cuts[f]) + 1) + np.searchsorted(cuts[f], columns[f].to_numpy(dtype=float), side="left")
            found[key] = number
        return pd.DataFrame(found)

    placed = rows.withColumn("_at", cells(*[F.col(v) for v in values]))
    return placed.select(*[named(c) for c in rows.columns], *[F.col(f"_at.{k}").alias(k) for k in keys]), keys


def attributions(df: DataFrame, model, row_id: str, features: list[str]) -> DataFrame:
    """(row_id, class_id, feature, value, phi, base_value, output) of every row."""
    return listed_attributions(explained_rows(df, model, row_id, features), row_id, features)


def listed_attributions(explained: DataFrame, row_id: str, features: list[str]) -> DataFrame:
    """Explained rows with a row per class and feature."""
    each = explained.select(named(row_id), "values", F.inline("classes"))
    listed = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("values").alias("value"), F.col("phi").alias("phi"))
    return (each.select(named(row_id), "class_id", "base_value", "output", F.inline(listed))
            .select(named(row_id), "class_id", "feature", "value", "phi", "base_value", "output"))


def explained_rows(df: DataFrame, model, row_id: str, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, kept columns, values, classes) of every row; classes is an array of (class_id, base_value, output, phi), phi and values an array by feature.

    Rows between the same cuts of all trees have the same attributions: these are found once per cell and joined to
    all its rows.  Cells are dealt to lanes of bounded size, trees to groups of bounded size, and every lane meets
    every group in a task of its own; neither passes through the driver, which sees the model's cuts alone.  With
    several groups, partial sums are added by a shuffle on the cell.  Per row, base_value plus the sum of phi equals output.
    """
    spark = df.sparkSession
    ship_package(spark)
    trees = stored_trees(model)
    upto = F.sum("size").over(W.orderBy("number").rowsBetween(W.unboundedPreceding, 0))  # one row per tree, without its data
    filled = trees.select("number", F.floor((upto - F.col("size")) / GROUP_BYTES).alias("_filled"))
    groups = materialise(filled.select("number", (F.dense_rank().over(W.orderBy("_filled")) - 1).alias("_part")), "groups")
    parts = groups.agg(F.max("_part")).first()[0] + 1
    cuts, outputs = _cuts(trees, len(features))
    values = [f"_x{i}" for i in range(len(features))]
    plain = df.select(named(row_id).alias(row_id), *[named(c) for c in keep], *[named(f).cast("double").alias(v) for f, v in zip(features, values)])
    placed, keys = _with_cells(plain, values, cuts)
    placed = materialise(placed, "explained")
    # Any values of a cell stand for it; a minimum needs no sort.
    cells = materialise(placed.groupBy(*keys).agg(*[F.min(v).alias(v) for v in values]).select(*keys, F.array(*values).alias("_x")), "cells")
    count = cells.count()
    lanes = max(1, -(-count // LANE_ROWS), min(spark.sparkContext.defaultParallelism, count // LEAST_ROWS))
    # Cells are sent once per group of trees, and every tree once per lane.
    laned = (cells.withColumn("_lane", F.pmod(F.xxhash64(*keys), F.lit(lanes)).cast("int"))
             .withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    sent = trees.join(groups, "number").select("_part", "number", "data", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_to"))
    schema = T.StructType([*[T.StructField(k, T.LongType()) for k in keys], T.StructField("class_id", T.IntegerType()),
                           T.StructField("base_value", T.DoubleType()), T.StructField("output", T.DoubleType()),
                           T.StructField("_phi", T.ArrayType(T.DoubleType()))])
    names = schema.names

    def explain(pdf: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or tables.empty:
            return pd.DataFrame({c: [] for c in names})
        held = [pickle.loads(d) for _, d in sorted(zip(tables["number"], tables["data"]))]
        codes = np.unique(np.concatenate([tree.outputs for tree in held]))
        x = np.stack(pdf["_x"].to_numpy()).astype(float)
        phi = np.zeros((len(x), x.shape[1], len(codes)))
        base, output = np.zeros(len(codes)), np.zeros((len(x), len(codes)))
        for tree in held:
            at = np.searchsorted(codes, tree.outputs)
            p, b, o = tree_attributions(tree, x)
            phi[:, :, at] += p
            base[at] += b
            output[:, at] += o
        return pd.concat([pdf[keys].assign(class_id=np.int32(code), base_value=base[c], output=output[:, c], _phi=list(phi[:, :, c]))
                          for c, code in enumerate(codes)])

    table = laned.groupBy("_lane", "_group").cogroup(sent.groupBy("_to", "_part")).applyInPandas(explain, schema)
    if parts > 1:
        added = [F.sum(F.col("_phi")[i]).alias(f"_p{i}") for i in range(len(features))]
        table = (table.groupBy(*keys, "class_id").agg(F.sum("base_value").alias("base_value"), F.sum("output").alias("output"), *added)
                 .select(*keys, "class_id", "base_value", "output", F.array(*[F.col(f"_p{i}") for i in range(len(features))]).alias("_phi")))
    own = F.struct("class_id", "base_value", "output", F.col("_phi").alias("phi"))
    table = materialise(table.groupBy(*keys).agg(F.sort_array(F.collect_list(own)).alias("classes")), "attributions")
    if count * outputs * 8 * (len(features) + len(keys) + 6) <= SMALL_BYTES:
        table = F.broadcast(table)
    return placed.join(table, keys).select(named(row_id), *[named(c) for c in keep], F.array(*values).alias("values"), "classes")


def global_importance(phi: DataFrame, top: int = 15) -> DataFrame:
    """(feature, importance): features with the largest mean absolute attribution."""
    mean = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))
    return mean.orderBy(F.col("importance").desc(), "feature").limit(top)


def class_attributions(phi: DataFrame, class_id: int) -> DataFrame:
    """Feature values and attributions of every row, for one class."""
    return phi.filter(F.col("class_id") == class_id)


def attribution_sketches(phi: DataFrame) -> DataFrame:
    """(class_id, feature, n, …, sketch): what the spread of attributions follows from, per class and feature.

    Rows of several batches are put together by ``merged_sketches``, so attributions may be summed up as they are
    made and a stored summary grows with classes and features only.  The sketch is a KLL quantile sketch.
    """
    value, own = F.col("value"), F.col("phi")
    both = value.isNotNull() & own.isNotNull()
    return phi.groupBy("class_id", "feature").agg(
        F.count(own).alias("n"), F.sum(F.abs(own)).alias("size"), F.kll_sketch_agg_double(own, SKETCH_K).alias("sketch"),
        F.count(F.when(both, 1)).alias("pairs"), F.avg(F.when(both, value)).alias("mean_value"), F.avg(F.when(both, own)).alias("mean_phi"),
        # Sums of squares and products around the means, which merge without cancelling.
        F.coalesce(F.var_pop(F.when(both, value)) * F.count(F.when(both, 1)), F.lit(0.0)).alias("square_value"),
        F.coalesce(F.var_pop(F.when(both, own)) * F.count(F.when(both, 1)), F.lit(0.0)).alias("square_phi"),
        F.coalesce(F.covar_pop(value, own) * F.count(F.when(both, 1)), F.lit(0.0)).alias("product"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of several batches as one row per class and feature."""
    weighted = {c: F.sum(F.col("pairs") * F.col(c)) / F.sum("pairs") for c in ("mean_value", "mean_phi")}
    held = sketches.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in weighted})
    parts = held.groupBy("class_id", "feature").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.kll_merge_agg_double("sketch").alias("sketch"),
        F.sum("pairs").alias("pairs"), *[mean.alias(c) for c, mean in weighted.items()],
        F.collect_list(F.struct("pairs", "mean_value", "mean_phi", "square_value", "square_phi", "product")).alias("_batches"))

    def around(own: str, one: str, two: str):
        """Sums around the batches' own means, moved to the common ones."""
        return F.aggregate("_batches", F.lit(0.0), lambda total, b: total + b[own] + b["pairs"] * (b[one] - F.col(one)) * (b[two] - F.col(two)))

    return parts.select("class_id", "feature", "n", "size", "sketch", "pairs", "mean_value", "mean_phi",
                        around("square_value", "mean_value", "mean_value").alias("square_value"),
                        around("square_phi", "mean_phi", "mean_phi").alias("square_phi"), around("product", "mean_value", "mean_phi").alias("product"))


def sketched_summary(sketches: DataFrame) -> DataFrame:
    """Spread of attributions per class and feature, and their relation to the value.

    Quantiles are those of a rank within RANK_ERROR of the one asked for.
    """
    scale = F.sqrt(F.col("square_value") * F.col("square_phi"))
    return sketches.select("class_id", "feature", (F.col("size") / F.col("n")).alias("importance"),
                           F.when(scale > 0, F.col("product") / scale).alias("direction"),
                           *[F.kll_sketch_get_quantile_double("sketch", F.lit(q / 100)).alias(f"p{q}") for q in SPREAD])


def class_summary(phi: DataFrame) -> DataFrame:
    """Spread of attributions per class and feature, and their relation to the value, in one pass."""
    return sketched_summary(attribution_sketches(phi))


def class_centres(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(label, n, features…): mean vector of every class, combined before the shuffle."""
    return df.groupBy(named(label).alias(label)).agg(
        F.count("*").alias("n"), *[F.avg(named(f)).alias(f) for f in features])


def representatives(df: DataFrame, row_id: str, label: str, features: list[str]) -> DataFrame:
    """(label, row_id, dist): the row nearest to its class mean; the lower id on ties."""
    centres = class_centres(df, label, features).drop("n").withColumnsRenamed({f: f"_c_{f}" for f in features})
    joined = join_on(df.select(named(row_id), named(label), *[named(f) for f in features]), small_table(centres), [label])
    square = sum(((named(f) - named(f"_c_{f}")) * (named(f) - named(f"_c_{f}")) for f in features), F.lit(0.0))
    placed = joined.select(named(row_id), named(label), F.round(F.sqrt(square), 9).alias("dist"))
    # Two hash aggregates instead of the minimum of a pair, which would sort all rows.
    closest = small_table(placed.groupBy(named(label).alias(label)).agg(F.min("dist").alias("_least")))
    ties = join_on(placed, closest, [label]).filter(F.col("dist") == F.col("_least"))
    return ties.groupBy(named(label).alias(label)).agg(F.min(named(row_id)).alias(row_id), F.min("dist").alias("dist"))


def class_coverage(rows: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """(label, n, absent): rows of every class in a sample; classes it lacks show 0."""
    present = sample.groupBy(named(label).alias(label)).agg(F.count("*").alias("_n"))
    joined = join_on(rows.select(named(label).alias(label)).distinct(), present, [label], "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select(label, n.alias("n"), (n == 0).alias("absent"))


def local_breakdown(phi: DataFrame, chosen: DataFrame, row_id: str) -> DataFrame:
    """From base value to output for chosen (row_id, class_id) pairs.

    Contributions come in order of size; ``start`` and ``stop`` are the running
    output before and after each.  Windows hold one row's features.
    """
    mine = join_on(phi, chosen.select(named(row_id), "class_id"), [row_id, "class_id"], "left_semi")
    order = W.partitionBy(named(row_id), "class_id").orderBy(F.abs("phi").desc(), "feature")
    upto = F.col("base_value") + F.sum("phi").over(order.rowsBetween(W.unboundedPreceding, 0))
    return (mine.withColumn("place", F.row_number().over(order)).withColumn("stop", upto)
            .withColumn("start", F.col("stop") - F.col("phi")))
