"""Ensembles grown in tasks: the results of Spark's learners, without a job per level."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor

from flowsieve.operators import cells, models, search, select
from flowsieve.queries import learning

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 8, 900), rng.integers(0, 6, 900)
    y = np.where(rng.random(900) < 0.25, rng.integers(0, 2, 900), (a + b) % 5 > 2)
    return spark.createDataFrame([(i, int(c), float(u), float(v)) for i, (c, u, v) in enumerate(zip(y, a, b))],
                                 "row_id bigint, label_id int, a double, b double").repartition(4)


def refuse(*_args, **_more):
    raise AssertionError("fitted by Spark on rows")


def test_baseline_comparison_fits_all_rounds_of_all_slots(spark, monkeypatch):
    seen = []

    def stop(*_args, **more):
        seen.append((_args[5:], more))
        raise KeyError

    monkeypatch.setattr(learning, "lines", lambda *_: spark.range(1).selectExpr("'train' AS split"))
    monkeypatch.setattr(models, "compare_slots", stop)
    with pytest.raises(KeyError):
        learning.baseline_comparison(spark, "")
    assert (seen[0][0] or (models.BASE_PARAMS,))[0] == models.BASE_PARAMS
    assert models.BASE_PARAMS["boost_depth"]["n_estimators"] == models.BASE_PARAMS["boost_bins"]["iterations"] == 100


def test_boosting_search_draws_all_trials_from_the_whole_space(spark, monkeypatch):
    seen = []

    def stop(*_args, **more):
        seen.append(more)
        raise KeyError

    monkeypatch.setattr(learning, "lines", lambda *_: spark.range(1).selectExpr("'train' AS split"))
    monkeypatch.setattr(search, "search", stop)
    with pytest.raises(KeyError):
        learning.boosting_search_best(spark, "")
    assert seen[0].get("trials") in (None, 20) and seen[0].get("space") in (None, search.SPACES["boost_bins"])


def test_long_trials_on_cells_log_what_rows_give(spark, rows, tmp_path, monkeypatch):
    """Few values, so cells and rows have the same cuts: equal losses, and no fit of Spark's."""
    space = {"iterations": ("quniform", 3, 4, 1), "depth": ("quniform", 2, 3, 1), "learning_rate": ("uniform", 0.1, 0.3), "l2_leaf_reg": ("uniform", 1, 10)}

    def losses(path):
        found = search.search(rows, "row_id", "label_id", FEATURES, "boost_bins", str(tmp_path / path), trials=2, space=space, chunk_rows=600)
        return {r.trial: (r.chunk, round(r.loss, 9)) for r in found.collect()}

    with monkeypatch.context() as held:
        held.setattr(cells, "MANY_ROUNDS", 2)
        held.setattr(models, "fit", refuse)
        own = losses("cells")
    assert own == losses("rows") and {c for c, _ in own.values()} == {0, 1}


def test_long_ensembles_of_few_rows_equal_those_of_spark(rows, monkeypatch):
    params = {"boost_bins": {"iterations": 4, "depth": 3, "learning_rate": 0.2, "l2_leaf_reg": 2.0}, "boost_leaves": {"n_estimators": 3, "num_leaves": 5, "learning_rate": 0.1}}

    def scores():
        scored = models.compare_slots(rows, rows, "row_id", "label_id", FEATURES, params, 2)
        return {(r.model, r.row_id): (r.prediction, round(r.score[1], 9)) for r in scored.collect()}

    plain = scores()
    monkeypatch.setattr(cells, "MANY_ROUNDS", 2)
    assert scores() == plain


def test_ranking_of_many_rows_reads_their_cells(rows, monkeypatch):
    plain = {r.feature: r.importance for r in select.rank_features(rows, "label_id", FEATURES, depth=3, row_share=0.5).collect()}
    monkeypatch.setattr(cells, "FEWEST_ROWS", 100)
    monkeypatch.setattr(RandomForestRegressor, "fit", refuse)
    own = {r.feature: r.importance for r in select.rank_features(rows, "label_id", FEATURES, depth=3, row_share=0.5).collect()}
    assert sum(own.values()) == pytest.approx(1) and all(abs(own[f] - plain[f]) < 0.1 for f in FEATURES)


def test_a_forest_of_many_rows_takes_no_job_a_tree(rows, monkeypatch):
    """By both impurities and with a share of the features a node."""
    plain = {s: models.train("forest", s_, rows, "label_id", FEATURES) for s, s_ in settings().items()}
    monkeypatch.setattr(cells, "FEWEST_ROWS", 100)
    monkeypatch.setattr(cells, "_learner", refuse)
    for name, setting in settings().items():
        model = models.train("forest", setting, rows, "label_id", FEATURES)
        assert model.getNumTrees == 40 and model.numClasses == 2
        both = [{r.row_id: r.score[1] for r in models.score(m, rows, "row_id", "label_id", FEATURES).collect()} for m in (model, plain[name])]
        assert np.mean([abs(both[0][i] - both[1][i]) for i in both[0]]) < 0.04


def settings():
    return {"gini": {"n_estimators": 40, "max_depth": 4, "subsample": 0.8},
            "entropy": {"n_estimators": 40, "max_depth": 4, "subsample": 0.8, "criterion": 1, "max_features": 1}}
