from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.functions.bounded import materialise
from flowsieve.operators import balance, neighbors
from flowsieve.operators.neighbors import _Codes, nearest_neighbors, surviving


def brute(x, ids, k, classes=None):
    want = {}
    for i in range(len(x)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
        ok = np.ones(len(x), bool) if classes is None else classes == classes[i]
        ok[i] = False
        c = np.nonzero(ok)[0]
        order = c[np.lexsort((ids[c], d[c]))[:k]]
        want[ids[i]] = [(d[j], ids[j]) for j in order]
    return want


def table(spark, x, ids, classes):
    rows = [(int(i), str(c), *map(float, r)) for i, c, r in zip(ids, classes, x)]
    names = [f"f{j}" for j in range(x.shape[1])]
    return spark.createDataFrame(rows, f"row_id bigint, label string, {', '.join(n + ' double' for n in names)}"), names


@pytest.mark.parametrize("within,block_rows,max_pivots", [(None, 4096, 4096), (None, 40, 8), ("label", 25, 64)])
def test_neighbors_against_brute_force_with_a_hot_group_of_copies(spark, within, block_rows, max_pivots):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(420, 3)) * 4)
    x[:140] = x[0]  # a third of the rows are copies
    ids = rng.permutation(420)
    classes = np.where(rng.random(420) < 0.7, "big", "small")
    df, names = table(spark, x, ids, classes)
    got = nearest_neighbors(df, "row_id", names, 4, within=within, label="label", block_rows=block_rows,
                            max_pivots=max_pivots, deal=2).collect()
    want = brute(x, ids, 4, classes if within else None)
    by_id = dict(zip(ids, classes))
    assert len(got) == 420
    for row in got:
        assert [(n["dist"], n["id"]) for n in row["neighbors"]] == want[row["row_id"]]
        assert all(n["label"] == by_id[n["id"]] for n in row["neighbors"])


@pytest.mark.parametrize("classes", [1, 150])
def test_neighbors_of_vectors_without_structure(spark, classes):
    rng = np.random.default_rng(11)
    x, ids = rng.normal(size=(1500, 24)), rng.permutation(1500)
    labels = rng.integers(0, classes, 1500).astype(str)
    labels[:600] = "0"
    df, _ = table(spark, x, ids, labels)
    df = df.withColumn("x", F.array(*[f"f{j}" for j in range(24)]))
    want = brute(x, ids, 3, labels)
    for blocks in ({"block_rows": 64, "deal": 3}, {"block_rows": 64, "max_pivots": 2}, {}):
        got = nearest_neighbors(df, "row_id", "x", 3, within="label", **blocks).collect()
        assert {r["row_id"]: [(n["dist"], n["id"]) for n in r["neighbors"]] for r in got} == want


def test_rows_written_for_vectors_without_structure_grow_with_the_units(spark, monkeypatch):
    written = Counter()

    def counted(df, name, *args):
        stored = materialise(df, name, *args)
        written[name] += stored.count()
        assert name != "visits" or set(stored.columns) == {"guest", "cls", "cell", "block", "deal"}
        return stored

    monkeypatch.setattr(neighbors, "materialise", counted)
    rng, per_unit = np.random.default_rng(13), []
    for n in (1000, 4000):
        df, names = table(spark, rng.normal(size=(n, 64)), np.arange(n), np.zeros(n, int))
        df = df.select("row_id", F.array(*names).alias("x"))
        written.clear()
        assert nearest_neighbors(df, "row_id", "x", 3, block_rows=250).count() == n
        per_unit.append((written["survivors"] + written["visits"]) / n)
    assert per_unit[1] < 1.5 * per_unit[0]


def test_codes_bound_distances_with_outliers_and_constant_dimensions():
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(500, 6)), [[1e9, 0, 0, 0, 0, 0]]])
    x[:, 5] = 7.0
    inner = [np.quantile(c, np.linspace(0, 1, 20)[1:-1]) for c in x.T]
    codes = _Codes([np.unique(np.concatenate([[c.min(), c.max()], q])) if c.min() < c.max() else np.array([7.0, 7.0]) for c, q in zip(x.T, inner)])
    stood, slips = codes.encode(x)
    rows, found, lower, upper = surviving(x[:50], np.full(50, np.inf), [(codes.points(stood), slips, np.arange(501))], 4)
    true = np.linalg.norm(x[rows] - x[found], axis=1)
    assert (lower <= true + 1e-6).all() and (true <= upper + 1e-6).all()
    for i in range(50):
        assert set(np.argsort(np.linalg.norm(x - x[i], axis=1))[:4]) <= set(found[rows == i])


def test_oversampling_evens_out_classes_on_segments(spark):
    rng = np.random.default_rng(1)
    sizes = {"a": 3000, "b": 40, "c": 3}
    classes = np.array([c for c, n in sizes.items() for _ in range(n)])
    x = rng.normal(size=(len(classes), 2))
    df, names = table(spark, x, np.arange(len(classes)), classes)
    rows = balance.oversample(df, "row_id", "label", names).collect()
    assert Counter(r.label for r in rows) == {c: 3000 for c in sizes}
    assert len({r.row_id for r in rows}) == len(rows)
    for r in rows:
        if r.synthetic:
            a, b, new = x[r.base_id], x[r.neighbor_id], np.array([r.f0, r.f1])
            assert classes[r.base_id] == classes[r.neighbor_id] == r.label
            u = np.dot(new - a, b - a) / np.dot(b - a, b - a)
            assert 0 <= u < 1 and np.allclose(a + u * (b - a), new)


def test_expansion_over_several_tasks_gives_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    classes = np.array(["a"] * 300 + ["b"] * 3)
    df, names = table(spark, rng.normal(size=(303, 2)), np.arange(303), classes)
    want = sorted(map(tuple, balance.oversample(df, "row_id", "label", names).collect()), key=repr)
    monkeypatch.setattr(balance, "EXPAND_ROWS", 7)
    monkeypatch.setattr(balance, "TASK_ROWS", 50)
    assert sorted(map(tuple, balance.oversample(df, "row_id", "label", names).collect()), key=repr) == want


def test_single_row_class_is_an_error(spark):
    df, names = table(spark, np.zeros((4, 1)), np.arange(4), np.array(["a", "a", "a", "b"]))
    with pytest.raises(ValueError, match="single row"):
        balance.oversample(df, "row_id", "label", names)


def test_editing_drops_strays_and_their_neighbours(spark):
    # Two groups of six on a line; one row of each is mislabelled.
    x = np.array([[0.0], [1], [2], [3], [4], [5], [100], [101], [102], [103], [104], [105]])
    classes = np.array(list("aaaaab" + "bbbbba"))
    df, names = table(spark, x, np.arange(12), classes)
    kept = {r.row_id for r in balance.edit_neighbors(df, "row_id", "label", names).collect()}
    want = set()
    near = brute(x, np.arange(12), 3)
    for i in range(12):
        if all(classes[j] == classes[i] for _, j in near[i]):
            want.add(i)
    # Row 3 sees 2, 4 and, of the equally distant 1 and 5, the lower id; row 4 sees the stray.
    assert kept == want == {0, 1, 2, 3, 6, 7, 8, 9}


def test_oversample_and_edit_against_brute_force(spark):
    rng = np.random.default_rng(7)
    classes = np.array(["a"] * 60 + ["b"] * 25 + ["c"] * 10)
    x = rng.normal(size=(95, 2)) + np.array([{"a": 0, "b": 2.5, "c": 5}[c] for c in classes])[:, None]
    df, names = table(spark, x, np.arange(95), classes)
    grown = balance.oversample(df, "row_id", "label", names).collect()
    gx = np.array([[r.f0, r.f1] for r in grown])
    ids = np.array([r.row_id for r in grown])
    labels = np.array([r.label for r in grown])
    near = brute(gx, ids, 3)
    by_id = dict(zip(ids, labels))
    want = {i for i, c in zip(ids, labels) if all(by_id[j] == c for _, j in near[i])}
    got = balance.oversample_and_edit(df, "row_id", "label", names)
    assert {r.row_id for r in got.collect()} == want


@pytest.mark.parametrize("within,range_rows", [(None, 1_000_000), ("label", 1_000_000), (None, 15), ("label", 12)])
def test_one_feature_is_searched_in_value_order(spark, monkeypatch, within, range_rows):
    from flowsieve.operators import neighbors
    search = neighbors._on_a_line
    used = []

    def line(units, k):
        used.append(search(units, k, range_rows))
        return used[-1]

    monkeypatch.setattr(neighbors, "_on_a_line", line)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(240, 1)) * 20, 1)
    x[:80] = x[0]
    classes = np.where(rng.random(240) < 0.8, "big", "small")
    df, names = table(spark, x, rng.permutation(240), classes)
    ids = np.array([r.row_id for r in df.collect()])
    got = nearest_neighbors(df, "row_id", names, 3, within=within, label="label").collect()
    want = brute(x, ids, 3, classes if within else None)
    assert used[0] is not None and len(got) == 240
    for row in got:
        assert [(n["dist"], n["id"]) for n in row["neighbors"]] == want[row["row_id"]]


def test_near_ties_on_one_feature_fall_back_to_the_cell_search(spark):
    x = np.array([[i * 1e-12] for i in range(30)] + [[5.0 + i] for i in range(10)])
    ids = np.arange(40)[::-1].copy()
    df, names = table(spark, x, ids, np.array(["a"] * 40))
    want = brute(x, ids, 3)
    for row in nearest_neighbors(df, "row_id", names, 3).collect():
        assert [(n["dist"], n["id"]) for n in row["neighbors"]] == want[row["row_id"]]
