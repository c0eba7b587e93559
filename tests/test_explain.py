from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import explain, models


def expectation(node, tree, x, known):
    """Path-dependent expectation of a tree when only ``known`` features are fixed."""
    at = tree[node]
    if at["left"] is None:
        return at["value"]
    if at["feature"] in known:
        return expectation(at["left"] if x[at["feature"]] <= at["cut"] else at["right"], tree, x, known)
    share = tree[at["left"]]["cover"] / at["cover"]
    return share * expectation(at["left"], tree, x, known) + (1 - share) * expectation(at["right"], tree, x, known)


def shapley(tree, x, features):
    """Shapley values by enumerating all subsets."""
    phi = np.zeros(features)
    for f in range(features):
        others = [o for o in range(features) if o != f]
        for size in range(features):
            for s in combinations(others, size):
                w = factorial(size) * factorial(features - size - 1) / factorial(features)
                phi[f] += w * (expectation(0, tree, x, {*s, f}) - expectation(0, tree, x, set(s)))
    return phi


def grow(rng, depth, features):
    """A random tree in which features may repeat along a path."""
    tree, todo = {}, [(0, depth, 1000)]
    while todo:
        n, d, cover = todo.pop()
        if d == 0 or cover < 4:
            tree[n] = {"cover": cover, "left": None, "value": rng.normal()}
            continue
        left = int(rng.integers(1, cover))
        tree[n] = {"cover": cover, "left": 2 * n + 1, "right": 2 * n + 2, "feature": int(rng.integers(features)), "cut": rng.normal()}
        todo += [(2 * n + 1, d - 1, left), (2 * n + 2, d - 1, cover - left)]
    return tree


def as_table(tree):
    import pandas as pd
    rows = [{"id": n, "prediction": t.get("value", 0.0), "impurityStats": [1.0], "rawCount": t["cover"],
             "leftChild": -1 if t["left"] is None else t["left"], "rightChild": t.get("right", -1),
             "feature": t.get("feature", -1), "threshold": t.get("cut"), "categories": -1} for n, t in tree.items()]
    return explain._tree(pd.DataFrame(rows), 1.0, 0, 1)


@pytest.mark.parametrize("depth,features", [(0, 2), (2, 3), (4, 3), (6, 5), (7, 1)])
def test_tree_values_equal_subset_enumeration(depth, features):
    rng = np.random.default_rng(depth)
    tree = grow(rng, depth, features)
    x = rng.normal(size=(12, features))
    phi, base, output = explain.tree_attributions(as_table(tree), x)
    for i in range(len(x)):
        assert np.allclose(phi[i, :, 0], shapley(tree, x[i], features))
        assert output[i, 0] == pytest.approx(expectation(0, tree, x[i], set(range(features))))
    assert base[0] == pytest.approx(expectation(0, tree, x[0], set()))


def test_a_tree_goes_through_one_row_of_each_of_its_cells(monkeypatch):
    rng = np.random.default_rng(5)
    tree, x = as_table(grow(rng, 4, 3)), rng.normal(size=(5_000, 3))
    x[0, 1], x[1, 2], x[2, 0] = np.nan, np.inf, -np.inf
    cells = np.prod([len(np.unique(tree.cut[tree.feature == f])) + 1 for f in range(3)])
    seen, inner = [], explain._down_and_up
    monkeypatch.setattr(explain, "_down_and_up", lambda *args: (seen.append(args[-1].size), inner(*args)))
    phi, base, output = explain.tree_attributions(tree, x)
    assert sum(seen) <= cells < 1_000
    assert np.allclose(base + phi.sum(axis=1), output)
    alone = [explain.tree_attributions(tree, x[i:i + 1])[0][0] for i in range(50)]
    assert np.allclose(phi[:50], alone)


def test_cells_of_a_tree_with_more_cuts_than_fit_a_number():
    rng = np.random.default_rng(6)
    features, cuts = 40, 3
    # A chain that tests every feature at several cuts: 4 to the 40th cells.
    chain, number, cover = {}, 0, 10_000
    for step in range(features * cuts):
        chain[number] = {"cover": cover, "left": 2 * step + 1, "right": 2 * step + 2, "feature": step % features, "cut": rng.normal() - 2}
        chain[2 * step + 1] = {"cover": 10, "left": None, "value": rng.normal()}
        number, cover = 2 * step + 2, cover - 10
    chain[number] = {"cover": cover, "left": None, "value": rng.normal()}
    tree, x = as_table(chain), rng.normal(size=(300, features))
    x[150:] = x[:150]
    first, place = explain._own_cells(tree, x)
    assert len(first) <= 150 and (place[150:] == place[:150]).all()
    for f in range(features):
        for cut in tree.cut[tree.feature == f]:
            assert ((x[first[place], f] <= cut) == (x[:, f] <= cut)).all()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    y = (x[:, 0] > 0.5).astype(int) + (x[:, 1] > 0.7).astype(int)
    data = [(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, "row_id bigint, label_id int, a double, `b.1` double, c double")


FEATURES = ["a", "b.1", "c"]


@pytest.mark.parametrize("group_bytes", [64 << 20, 1])
def test_forest_attributions_add_up_to_probabilities(rows, monkeypatch, group_bytes):
    monkeypatch.setattr(explain, "GROUP_BYTES", group_bytes)
    model = models.train("forest", {"n_estimators": 4, "max_depth": 4}, rows, "label_id", FEATURES)
    phi = explain.attributions(rows, model, "row_id", FEATURES)
    sums = phi.groupBy("row_id", "class_id").agg((F.max("base_value") + F.sum("phi")).alias("total"), F.max("output").alias("output")).collect()
    want = {r.row_id: r.score for r in models.score(model, rows, "row_id", "label_id", FEATURES).collect()}
    assert len(sums) == 900
    for r in sums:
        assert r.total == pytest.approx(want[r.row_id][r.class_id], abs=1e-9)
        assert r.total == pytest.approx(r.output, abs=1e-9)
    top = [r.feature for r in explain.global_importance(phi, 2).collect()]
    assert top == ["a", "b.1"]


def test_boosted_attributions_add_up_to_raw_scores(rows):
    two = rows.withColumn("label_id", (F.col("label_id") > 0).cast("int"))
    model = models.train("boost_depth", {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3}, two, "label_id", FEATURES)
    phi = explain.attributions(two, model, "row_id", FEATURES)
    scores = {r.row_id: r.score for r in models.score(model, two, "row_id", "label_id", FEATURES).collect()}
    for r in phi.groupBy("row_id").agg((F.max("base_value") + F.sum("phi")).alias("total")).collect():
        assert 1 / (1 + np.exp(-2 * r.total)) == pytest.approx(scores[r.row_id][1], abs=1e-9)


def test_one_model_per_class_gives_one_attribution_per_class(rows):
    model = models.train("boost_leaves", {"n_estimators": 2, "num_leaves": 4, "learning_rate": 0.3}, rows, "label_id", FEATURES)
    phi = explain.attributions(rows, model, "row_id", FEATURES)
    scores = {r.row_id: r.score for r in models.score(model, rows, "row_id", "label_id", FEATURES).collect()}
    for r in phi.groupBy("row_id", "class_id").agg((F.max("base_value") + F.sum("phi")).alias("total")).collect():
        assert r.total == pytest.approx(scores[r.row_id][r.class_id], abs=1e-9)


def test_breakdown_runs_from_base_to_output(rows):
    model = models.train("forest", {"n_estimators": 3, "max_depth": 3}, rows, "label_id", FEATURES)
    phi = explain.attributions(rows, model, "row_id", FEATURES)
    typical = explain.representatives(rows, "row_id", "label_id", FEATURES)
    steps = explain.local_breakdown(phi, typical.withColumnRenamed("label_id", "class_id"), "row_id").collect()
    assert len(steps) == 9
    for row in {r.row_id for r in steps}:
        mine = sorted((r for r in steps if r.row_id == row), key=lambda r: r.place)
        assert mine[0].start == pytest.approx(mine[0].base_value) and mine[-1].stop == pytest.approx(mine[0].output)
        assert all(abs(a.phi) >= abs(b.phi) for a, b in zip(mine, mine[1:]))


def test_representative_is_nearest_to_the_mean(rows):
    pdf = rows.toPandas()
    for r in explain.representatives(rows, "row_id", "label_id", FEATURES).collect():
        mine = pdf[pdf.label_id == r.label_id]
        gap = np.linalg.norm(mine[FEATURES] - mine[FEATURES].mean(), axis=1)
        assert r.row_id == mine.row_id.to_numpy()[gap.argmin()]


def test_sketches_of_batches_merge_into_one_summary(spark):
    rng = np.random.default_rng(6)
    n = 9000
    value = rng.normal(size=n)
    phi = np.where(np.arange(n) % 3 == 0, 0.5 * value + 100, rng.exponential(size=n) - value)
    rows = spark.createDataFrame([(int(i % 2), f"f{i % 3}", float(v), float(p)) for i, (v, p) in enumerate(zip(value, phi))],
                                 "class_id int, feature string, value double, phi double")
    pdf = rows.toPandas()
    parts = [explain.attribution_sketches(rows.filter(F.pmod(F.xxhash64("phi"), F.lit(7)) == i)) for i in range(7)]
    parts.append(explain.attribution_sketches(rows.limit(0)))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    for summary in (explain.class_summary(rows), explain.sketched_summary(explain.merged_sketches(union))):
        got = summary.collect()
        assert len(got) == 6
        for r in got:
            own = pdf[(pdf.class_id == r.class_id) & (pdf.feature == r.feature)]
            assert r.importance == pytest.approx(own.phi.abs().mean()) and r.direction == pytest.approx(np.corrcoef(own.value, own.phi)[0, 1])
            for q in explain.SPREAD:
                below, upto = (own.phi < r[f"p{q}"]).mean(), (own.phi <= r[f"p{q}"]).mean()
                assert below - explain.RANK_ERROR <= q / 100 <= upto + explain.RANK_ERROR


def test_rows_between_the_same_cuts_are_explained_once(rows, spark, monkeypatch):
    """Copies, and values that no cut tells apart, cost no further walks through the trees."""
    model = models.train("forest", {"n_estimators": 4, "max_depth": 3}, rows, "label_id", FEATURES)
    more = rows.crossJoin(spark.range(40).withColumnRenamed("id", "r")).select(
        (F.col("row_id") * 40 + F.col("r")).alias("row_id"), "label_id", "a", F.col("`b.1`"), (F.col("c") + F.col("r") * 1e-12).alias("c"))
    written = {}
    kept = explain.materialise

    def counted(df, name, *more):
        out = kept(df, name, *more)
        written[name] = out.count()
        return out

    monkeypatch.setattr(explain, "materialise", counted)
    phi = explain.attributions(more, model, "row_id", FEATURES)
    assert written["cells"] <= 300 < written["explained"] == 12_000
    sums = phi.groupBy("row_id", "class_id").agg((F.max("base_value") + F.sum("phi")).alias("total"))
    scored = models.score(model, more, "row_id", "label_id", FEATURES).select("row_id", F.posexplode("score").alias("class_id", "own"))
    assert sums.join(scored, ["row_id", "class_id"]).agg(F.count("*"), F.max(F.abs(F.col("total") - F.col("own"))) < 1e-9).first()[:] == (36_000, True)
    assert phi.count() == 12_000 * 9


@pytest.mark.parametrize("small", [0, 32 << 20])
def test_missing_values_and_many_features_are_explained(spark, monkeypatch, small):
    monkeypatch.setattr(explain, "SMALL_BYTES", small)
    rng = np.random.default_rng(3)
    x = rng.random((400, 20))
    y = (x[:, :10].sum(axis=1) > 5).astype(int)
    names = [f"f{i}" for i in range(20)]
    table = spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x))],
                                  "row_id bigint, label_id int, " + ", ".join(f"{n} double" for n in names))
    model = models.train("forest", {"n_estimators": 60, "max_depth": 6}, table, "label_id", names)
    odd = table.withColumn("f1", F.when(F.col("row_id") % 3 == 0, F.lit(None)).when(F.col("row_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("f1")))
    phi = explain.attributions(odd, model, "row_id", names)
    total = {(r.row_id, r.class_id): r.total for r in phi.groupBy("row_id", "class_id").agg((F.max("base_value") + F.sum("phi")).alias("total")).collect()}
    own = models.score(model, odd.fillna(float("nan"), ["f1"]).withColumn("f1", F.coalesce("f1", F.lit(1e300))).replace(float("nan"), 1e300, ["f1"]),
                       "row_id", "label_id", names).collect()
    assert len(total) == 800
    for r in own:
        assert total[r.row_id, 1] == pytest.approx(r.score[1], abs=1e-9)
    assert phi.filter((F.col("feature") == "f1") & F.col("value").isNull()).count() == 2 * len(range(0, 400, 3))


def test_additivity_shuffles_no_attributions(spark):
    from flowsieve.queries import learning, load_all

    load_all()
    gaps = learning.attribution_additivity(spark, "/root/testdata/sf0.001")
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(class_id" in plan and "hashpartitioning(row_id" not in plan and "SortMergeJoin" not in plan
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert sorted((r.class_id, r.n, r.largest_gap) for r in gaps.collect()) == [(c, events, 0.0) for c in range(5)]
