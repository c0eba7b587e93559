import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import explain, leaves, models

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=500) * 0.5 > 0.4).astype(int) + (x[:, 1] > 1)
    data = [(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, "row_id bigint, label_id int, a double, b double")


def values(model):
    """Leaf index to value of every tree, in order of leaves."""
    def walk(node):
        return [node.prediction()] if node.subtreeDepth() == 0 else walk(node.leftChild()) + walk(node.rightChild())
    return [walk(tree._call_java("rootNode")) for tree in model.trees]


def test_leaf_values_equal_a_plain_recomputation(rows):
    two = rows.withColumn("label_id", (F.col("label_id") > 0).cast("int"))
    ready = models.ready_rows(two, "label_id", FEATURES)
    setting = {"iterations": 12, "depth": 3, "learning_rate": 0.2}
    found = {}
    for ridge in (3.0, 30.0):
        model = models.fit("boost_bins", {**setting, "l2_leaf_reg": ridge}, ready, 2, 2)
        reached = np.array([[int(v) for v in r["at"]] for r in model.setLeafCol("at").transform(ready).select("at").collect()])
        y = np.array([2 * r.label_id - 1 for r in ready.select("label_id").collect()])
        margin = np.zeros(len(y))
        for tree, (own, weight) in enumerate(zip(values(model), model.treeWeights)):
            g = -2 * y / (1 + np.exp(2 * y * margin))
            h = 4 / ((1 + np.exp(2 * margin)) * (1 + np.exp(-2 * margin)))
            for leaf, value in enumerate(own):
                at = reached[:, tree] == leaf
                assert value == pytest.approx(-g[at].sum() / (h[at].sum() + ridge), abs=1e-9)
            margin += weight * np.array(own)[reached[:, tree]]
        found[ridge] = margin
    # A larger ridge gives another model, with smaller margins.
    assert np.abs(found[30.0]).mean() < 0.8 * np.abs(found[3.0]).mean()


def test_splits_are_taken_back_from_the_weakest(rows):
    two = rows.withColumn("label_id", (F.col("label_id") > 0).cast("int"))
    ready = models.ready_rows(two, "label_id", FEATURES)
    sizes = {}
    for most in (3, 7):
        model = models.fit("boost_leaves", {"n_estimators": 4, "num_leaves": most, "learning_rate": 0.3}, ready, 2, 2)
        sizes[most] = [len(v) for v in values(model)]
        assert max(sizes[most]) <= most
        phi = explain.attributions(two, model, "row_id", FEATURES)
        scores = {r.row_id: r.score for r in models.score(model, two, "row_id", "label_id", FEATURES).collect()}
        for r in phi.groupBy("row_id").agg((F.max("base_value") + F.sum("phi")).alias("total")).collect():
            assert 1 / (1 + np.exp(-2 * r.total)) == pytest.approx(scores[r.row_id][1], abs=1e-9)
    assert max(sizes[7]) > max(sizes[3])


def test_pruning_keeps_the_strongest_splits():
    def leaf(number, g, h):
        return leaves.Node({"id": number}, (), g, h)
    low = leaves.Node({"id": 1}, (leaf(2, 5.0, 4.0), leaf(3, 5.1, 4.0)))
    high = leaves.Node({"id": 4}, (leaf(5, -9.0, 4.0), leaf(6, 2.0, 4.0)))
    tree = leaves.Node({"id": 0}, (low, high))
    leaves.sum_up(tree, [(n.first, n.second) for n in tree.leaves()])
    leaves.prune(tree, 3, 1.0)
    assert not low.children and high.children and [n.row["id"] for n in low.taken] == [2, 3]
    assert [r["id"] for r in leaves.stored_rows(tree, 1.0)] == [0, 1, 2, 3, 4] and len(tree.leaves()) == 3
    leaves.prune(tree, 1, 1.0)
    assert len(tree.taken) == 4 and leaves.stored_rows(tree, 1.0)[0]["leftChild"] == -1


def test_one_model_per_class_is_refitted_class_by_class(rows):
    model = models.train("boost_bins", {"iterations": 3, "depth": 2, "learning_rate": 0.3, "l2_leaf_reg": 5.0}, rows, "label_id", FEATURES)
    plain = models.train("boost_bins", {"iterations": 3, "depth": 2, "learning_rate": 0.3}, rows, "label_id", FEATURES)
    assert len(model.models) == 3
    scored, before = (models.score(m, rows, "row_id", "label_id", FEATURES).orderBy("row_id").collect() for m in (model, plain))
    assert any(abs(a.score[0] - b.score[0]) > 1e-3 for a, b in zip(scored, before))
    assert np.mean([r.prediction == r.label_id for r in scored]) > 0.7
