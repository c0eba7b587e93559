import random

import numpy as np
import pandas as pd
import pytest

from flowsieve.operators import calibrate, models


def plain_rising(hits, n):
    """Isotonic heights by the largest mean over all intervals that may hold a bin."""
    mean = lambda a, b: sum(hits[a:b]) / sum(n[a:b])
    return [max(min(mean(a, b) for b in range(i + 1, len(n) + 1)) for a in range(i + 1)) for i in range(len(n))]


@pytest.mark.parametrize("seed", range(20))
def test_curves_are_the_isotonic_regression(seed):
    rng = random.Random(seed)
    n = [rng.randint(1, 9) for _ in range(rng.randint(1, 15))]
    hits = [rng.randint(0, k) for k in n]
    means = sorted(rng.random() for _ in n)
    ends, heights = calibrate.rising(pd.DataFrame({"mean": means, "n": n, "hits": hits}))
    assert np.allclose(np.interp(means, ends, heights), plain_rising(hits, n))
    assert (np.diff(heights) >= 0).all()


def test_boosted_slots_give_probabilities_of_many_classes(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 6000)
    x = rng.normal(size=(6000, 2)) + np.stack([1.2 * y, -0.4 * y], axis=1)
    rows = spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x))], "row_id bigint, label_id int, a double, b double")
    train, test = rows.filter("row_id < 4500"), rows.filter("row_id >= 4500")
    model, curves = models.train_calibrated("boost_bins", {"iterations": 3, "depth": 3, "learning_rate": 0.3}, train, "row_id", "label_id", ["a", "b"], 3)
    raw = models.score(model, test, "row_id", "label_id", ["a", "b"])
    assert not models.has_probabilities(model) and curves.count() == 3
    got = calibrate.probabilities(raw, curves).collect()
    p = np.array([r.score for r in got])
    assert p.shape == (1500, 3) and np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    truth = np.eye(3)[[r.label_id for r in got]]
    shares = 1 / (1 + np.exp(-2 * np.array([r.score for r in sorted(raw.collect(), key=lambda r: r.row_id)])))
    shares /= shares.sum(axis=1, keepdims=True)
    order = np.argsort([r.row_id for r in got])
    assert ((p - truth) ** 2).mean() < 1.02 * ((shares - truth[order]) ** 2).mean()
    # Of rows given a class with about some probability, that share is of the class.
    for low in (0.1, 0.4, 0.7):
        near = (p >= low) & (p < low + 0.2)
        assert abs(truth[near].mean() - p[near].mean()) < 0.06
    # A class that no curve reaches keeps the shares.
    none = curves.withColumn("heights", calibrate.F.transform("heights", lambda h: h * 0))
    flat = np.array([r.score for r in sorted(calibrate.probabilities(raw, none).collect(), key=lambda r: r.row_id)])
    assert np.allclose(flat, shares)


def test_forests_need_no_curves(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i % 3)) for i in range(60)], "row_id bigint, label_id int, a double")
    model, curves = models.train_calibrated("forest", {"n_estimators": 2, "max_depth": 2}, rows, "row_id", "label_id", ["a"], 3)
    assert curves is None and models.has_probabilities(model)
