"""Leaf values with a ridge term and a bound on leaves for boosted trees.

Spark's boosting averages residuals in a leaf.  Here a fitted ensemble keeps its
splits, and its trees get new values one after the other: a leaf's value is
-G / (H + ridge), where G and H are sums of first and second derivatives of the
logistic loss over its rows, at the margins of the trees before it.  Before that,
splits are taken back from the weakest upwards until a tree has at most so many
leaves; a split's strength is what it takes off the loss, by the same sums
(weakest-link pruning, Breiman et al., 1984; Newton leaf values, Friedman, 2001).

A tree's sums are one grouped aggregate over all rows, of as many rows as the
tree has leaves.  Margins are stored every STORED trees.  The result is written
in the form in which Spark stores its models and loaded from there, so it scores,
stores and explains like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.bounded import copy_stored, materialise, work_path

STORED = 10


@dataclass
class Node:
    row: dict                   # as stored
    children: tuple = ()        # two nodes, or none
    first: float = 0.0          # sums of derivatives over its rows
    second: float = 0.0
    taken: tuple = ()           # leaves it had before its split was taken back

    def leaves(self) -> list["Node"]:
        return [self] if not self.children else [leaf for child in self.children for leaf in child.leaves()]

    def inner(self) -> list["Node"]:
        return [] if not self.children else [self, *[n for child in self.children for n in child.inner()]]

    def strength(self, ridge: float) -> float:
        """What its split takes off the loss, as far as second derivatives tell."""
        def own(node):
            return node.first ** 2 / (node.second + ridge) if node.second + ridge > 0 else 0.0
        return (sum(own(child) for child in self.children) - own(self)) / 2


def tree_of(rows: list[dict]) -> Node:
    """A tree from its stored nodes."""
    by_id = {r["id"]: Node(r) for r in rows}
    for node in by_id.values():
        if node.row["leftChild"] >= 0:
            node.children = by_id[node.row["leftChild"]], by_id[node.row["rightChild"]]
    return by_id[0]


def sum_up(tree: Node, sums: list[tuple[float, float]]) -> None:
    """Sums of the leaves, in order, and of all nodes above them."""
    for leaf, (first, second) in zip(tree.leaves(), sums):
        leaf.first, leaf.second = first, second
    for node in reversed(tree.inner()):
        node.first, node.second = (sum(getattr(c, k) for c in node.children) for k in ("first", "second"))


def prune(tree: Node, most: int, ridge: float) -> None:
    """Take back the weakest splits above two leaves until at most ``most`` leaves are left."""
    while len(tree.leaves()) > most:
        last = [n for n in tree.inner() if not any(c.children for c in n.children)]
        weakest = min(last, key=lambda n: (n.strength(ridge), n.row["id"]))
        weakest.taken = tuple(old for child in weakest.children for old in child.taken or (child,))
        weakest.children = ()


def stored_rows(tree: Node, ridge: float) -> list[dict]:
    """Nodes in preorder with new numbers, values and links."""
    rows = []

    def walk(node: Node) -> int:
        value = -node.first / (node.second + ridge) if node.second + ridge > 0 else 0.0
        row = {**node.row, "id": len(rows), "prediction": value}
        rows.append(row)
        if node.children:
            row["leftChild"], row["rightChild"] = walk(node.children[0]), walk(node.children[1])
        else:
            row.update(leftChild=-1, rightChild=-1, gain=-1.0,
                       split={"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1})
        return row["id"]

    walk(tree)
    return rows


def refit(model, ready: DataFrame, ridge: float = 0.0, most: int | None = None):
    """A boosted model, or one per class, with new leaf values; ``ready`` is (features, label_id) and may have a weight."""
    if isinstance(model, OneVsRestModel):
        parts = [_refit(part, ready.withColumn("label_id", (F.col("label_id") == c).cast("double")), ridge, most)
                 for c, part in enumerate(model.models)]
        return model._copyValues(OneVsRestModel(parts))
    return _refit(model, ready, ridge, most)


def _refit(model: GBTClassificationModel, ready: DataFrame, ridge: float, most: int | None) -> GBTClassificationModel:
    spark = ready.sparkSession
    path, target = work_path(spark, "boosted"), work_path(spark, "refitted")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    trees: dict[int, list[dict]] = {}
    # As many rows as the model has nodes, which the driver holds already.
    for row in stored.select("treeID", "nodeData").collect():
        trees.setdefault(row["treeID"], []).append(row["nodeData"].asDict(recursive=True))
    model = model.copy()
    sign = 2 * F.col("label_id") - 1
    scored = model.setLeafCol("_leaves").transform(ready)
    table = materialise(scored.select(sign.alias("y"), vector_to_array("_leaves").cast("array<int>").alias("leaves"), F.lit(0.0).alias("margin"),
                                      F.col("weight") if "weight" in ready.columns else F.lit(1.0).alias("weight")), "margins")
    y, margin, rows_of = F.col("y"), F.col("margin"), F.col("weight")
    first = -2 * y / (1 + F.exp(2 * y * margin))
    second = 4 / ((1 + F.exp(2 * margin)) * (1 + F.exp(-2 * margin)))
    written = []
    for number, weight in enumerate(model.treeWeights):
        tree = tree_of(trees[number])
        leaf = F.col("leaves")[number]
        found = {r["leaf"]: (r["g"], r["h"]) for r in
                 table.groupBy(leaf.alias("leaf")).agg(F.sum(rows_of * first).alias("g"), F.sum(rows_of * second).alias("h")).collect()}
        before = tree.leaves()
        sum_up(tree, [found.get(i, (0.0, 0.0)) for i in range(len(before))])
        if most is not None:
            prune(tree, most, ridge)
        rows = stored_rows(tree, ridge)
        written += [{"treeID": number, "nodeData": row} for row in rows]
        # The values of the leaves as they were numbered before: a leaf taken back has that of the node it went into.
        after = {id(old): -n.first / (n.second + ridge) if n.second + ridge > 0 else 0.0
                 for n in tree.leaves() for old in n.taken or (n,)}
        values = F.array(*[F.lit(after[id(old)]) for old in before])
        table = table.withColumn("margin", margin + weight * F.get(values, leaf))
        if number % STORED == STORED - 1:
            table = materialise(table, "margins")
    spark.createDataFrame(written, stored.select("treeID", "nodeData").schema).coalesce(1).write.parquet(f"{target}/data")
    copy_stored(spark, path, target, ("metadata", "treesMetadata"))
    return GBTClassificationModel.load(target)

