"""Learners on cells: the same sums as on rows, the same interface of the model."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowsieve.operators import cells, explain, models

FEATURES = ["a", "b"]
ROWS = 6000


@pytest.fixture(scope="module")
def rows(spark):
    """Few distinct values, copies of all rows, a rare class."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 12, ROWS), rng.integers(0, 9, ROWS) / 3
    y = np.where(rng.random(ROWS) < 0.2, rng.integers(0, 2, ROWS), (a > 5) ^ (b > 1)).astype(int)
    return spark.createDataFrame([(i, int(c), float(u), float(v)) for i, (c, u, v) in enumerate(zip(y, a, b))],
                                 "row_id bigint, label_id int, a double, b double").repartition(4)


def fits(monkeypatch, slot, setting, table):
    """The slot fitted on rows and on cells."""
    plain = models.train(slot, setting, table, "label_id", FEATURES)
    monkeypatch.setattr(cells, "FEWEST_ROWS", 100)
    seen, fold = [], cells.fold
    monkeypatch.setattr(cells, "fold", lambda *a: seen.append(fold(*a)) or seen[-1])
    folded = models.train(slot, setting, table, "label_id", FEATURES)
    return plain, folded, seen[0]


def nodes(model, spark, path):
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    return [(r.treeID, r.id, r.leftChild, r.rightChild, r.rawCount, r.split.featureIndex, [round(t, 9) for t in r.split.leftCategoriesOrThreshold],
             round(r.prediction, 9)) for r in stored]


@pytest.mark.parametrize("slot,setting", [
    ("boost_depth", {"n_estimators": 4, "max_depth": 4, "learning_rate": 0.3}),
    ("boost_depth", {"n_estimators": 2, "max_depth": 5, "learning_rate": 0.3, "min_child_weight": 150}),
    ("boost_leaves", {"n_estimators": 3, "num_leaves": 5, "learning_rate": 0.1}),
    ("boost_bins", {"iterations": 3, "depth": 4, "learning_rate": 0.1, "l2_leaf_reg": 3.0})])
def test_boosted_slots_are_the_same_on_cells(spark, rows, monkeypatch, tmp_path, slot, setting):
    """Every node: splits, rows that reach it, values."""
    plain, folded, held = fits(monkeypatch, slot, setting, rows)
    assert held.table.count() <= 12 * 9 * 2 and held.table.agg(F.sum("weight")).first()[0] == ROWS
    assert nodes(folded, spark, str(tmp_path / "folded")) == nodes(plain, spark, str(tmp_path / "plain"))


def test_a_forest_on_cells_scores_explains_and_repeats(spark, rows, monkeypatch, tmp_path):
    setting = {"n_estimators": 30, "max_depth": 5, "subsample": 0.8, "max_features_share": 0.8, "min_samples_leaf": 3}
    plain, folded, held = fits(monkeypatch, "forest", setting, rows)
    assert folded.getNumTrees == 30 and folded.numClasses == 2
    both = [models.score(m, rows, "row_id", "label_id", FEATURES).select("row_id", F.get("score", F.lit(1)).alias(f"p{i}")) for i, m in enumerate((plain, folded))]
    gap = both[0].join(both[1], "row_id").agg(F.avg(F.abs(F.col("p0") - F.col("p1"))), F.max(F.abs(F.col("p0") - F.col("p1")))).first()
    assert gap[0] < 0.02 and gap[1] < 0.1
    found = nodes(folded, spark, str(tmp_path / "one"))
    # Every tree has drawn about its share of the rows, not of the cells, and leaves keep their least number.
    roots = [n[4] for n in found if n[1] == 0]
    assert len(roots) == 30 and len(set(roots)) > 1 and all(abs(r - 0.8 * ROWS) < 6 * (0.8 * ROWS) ** 0.5 for r in roots)
    assert min(n[4] for n in found) >= 3
    again = models.train("forest", setting, rows.repartition(2), "label_id", FEATURES)
    assert nodes(again, spark, str(tmp_path / "two")) == found
    few = rows.limit(50)
    phi = explain.attributions(few, folded, "row_id", FEATURES).groupBy("row_id", "class_id").agg((F.max("base_value") + F.sum("phi")).alias("total"))
    own = models.score(folded, few, "row_id", "label_id", FEATURES).select("row_id", F.posexplode("score").alias("class_id", "own"))
    assert phi.join(own, ["row_id", "class_id"]).agg(F.max(F.abs(F.col("total") - F.col("own")))).first()[0] < 1e-9


def test_draws_of_a_cell_are_a_sum_of_draws_of_its_rows(spark, rows, monkeypatch, tmp_path):
    """Trees differ by as much as Poisson draws of single rows do, not of whole cells."""
    monkeypatch.setattr(cells, "FEWEST_ROWS", 100)
    forest = models.train("forest", {"n_estimators": 100, "max_depth": 1, "subsample": 0.8}, rows, "label_id", FEATURES)
    roots = [n[4] for n in nodes(forest, spark, str(tmp_path / "m")) if n[1] == 0]
    assert 0.5 < np.var(roots) / (0.8 * ROWS) < 1.7 and abs(np.mean(roots) / (0.8 * ROWS) - 1) < 0.01


@pytest.mark.parametrize("slot", ["forest", "boost_leaves"])
def test_many_classes_and_long_features(spark, monkeypatch, slot):
    """One boosted ensemble per class; a class of few rows stays; features of many values and of one are cut and kept."""
    df = spark.range(0, 8000, 1, 4).select(F.col("id").alias("row_id"), F.when(F.col("id") < 3, 2).otherwise(F.col("id") % 2).cast("int").alias("label_id"),
                                           (F.col("id") % 4000 + F.col("id") % 2 * 3000).cast("double").alias("a"), F.lit(1.5).alias("b"))
    monkeypatch.setattr(cells, "FEWEST_ROWS", 100)
    ready = models.ready_rows(df, "label_id", FEATURES)
    held = cells.fold(ready, 2, 32)
    assert [len(c) for c in held.cuts] == [31, 0] and held.table.count() <= 96 and held.classes == 3
    placed = df.join(ready.select(vector_to_array("features")[0].alias("a")).distinct(), "a")
    sizes = [placed.filter((F.col("a") > lo) & (F.col("a") <= hi)).count() for lo, hi in zip(held.cuts[0], held.cuts[0][1:])]
    assert max(sizes) < 2 * 8000 / 32
    model = models.train(slot, {"n_estimators": 3, "num_leaves": 4} if slot != "forest" else {"n_estimators": 5, "max_depth": 3}, df, "label_id", FEATURES)
    scored = models.score(model, df, "row_id", "label_id", FEATURES)
    assert scored.filter(F.size("score") == 3).count() == 8000
    assert scored.filter(F.col("prediction") == F.col("label_id")).count() > 6500


def test_rows_that_hardly_fold_are_fitted_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(cells, "FEWEST_ROWS", 100)
    df = spark.range(0, 2000).select((F.col("id") % 2).cast("int").alias("label_id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    ready = models.ready_rows(df, "label_id", FEATURES)
    assert cells.fold(ready, 2, 32) is None and cells.fold(ready.limit(50), 2, 32) is None
    part = models.estimator("boost_depth", {"n_estimators": 2, "max_depth": 2, "subsample": 0.7}, 2, 2)
    assert not cells.suits(part)
