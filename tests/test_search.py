import random

import pytest

from flowsieve.operators import models, search, select
from flowsieve.sources import store

SPACE = {"n_estimators": ("quniform", 2, 3, 1), "max_depth": ("quniform", 2, 3, 1), "criterion": ("choice", 2)}


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(0)
    data = []
    for i in range(240):
        a, b = draw.random(), draw.random()
        data.append((i, int(a > 0.5), a, b))
    return spark.createDataFrame(data, "row_id bigint, label_id int, a double, `b c` double")


@pytest.mark.parametrize("slot", list(search.SPACES))
def test_points_stay_in_their_space(spark, slot):
    for trial in range(30):
        point = search.draw_point(search.SPACES[slot], 1, trial)
        assert point == search.draw_point(search.SPACES[slot], 1, trial)
        for name, (kind, *limits) in search.SPACES[slot].items():
            if kind == "choice":
                assert point[name] in range(limits[0])
            else:
                assert limits[0] <= point[name] <= limits[1]
                assert kind == "uniform" or point[name] % limits[2] == 0
        models.estimator(slot, point, 3, 20)


def test_a_resumed_search_tries_the_same_points(spark, rows, tmp_path):
    def run(path, trials):
        return search.search(rows, "row_id", "label_id", ["a", "b c"], "forest", path, trials=trials, chunk_rows=200, space=SPACE)

    whole = {r.trial: (r.params, r.chunk, r.loss) for r in run(str(tmp_path / "a"), 3).collect()}
    run(str(tmp_path / "b"), 1)
    resumed = {r.trial: (r.params, r.chunk, r.loss) for r in run(str(tmp_path / "b"), 3).collect()}
    assert resumed == whole
    assert [whole[t][1] for t in range(3)] == [0, 1, 0]
    best = store.best_params(store.load_trials(spark, str(tmp_path / "a"))).first()
    assert -1 <= best["loss"] <= -0.6
    model = search.train_best(store.load_trials(spark, str(tmp_path / "a")), rows, "label_id", ["a", "b c"], "forest", {"max_depth": 1})
    assert max(t.depth for t in model.trees) <= 1


def test_trials_side_by_side_log_what_they_log_one_after_another(spark, rows, tmp_path):
    logs = []
    for parallel in (1, 4):
        path = str(tmp_path / str(parallel))
        found = search.search(rows, "row_id", "label_id", ["a", "b c"], "forest", path, trials=4, space=SPACE, parallel=parallel)
        logs.append(sorted((r.trial, sorted(r.params.items()), r.loss) for r in found.collect()))
    assert logs[0] == logs[1] and len(logs[0]) == 4


def test_a_gap_in_the_log_is_filled(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    for trial in (0, 2):
        store.append_trial(spark, path, [("forest", trial, 0, {"n_estimators": 1.0}, -9.0)])
    found = search.search(rows, "row_id", "label_id", ["a", "b c"], "forest", path, trials=3, space=SPACE)
    assert {r.trial: r.loss == -9.0 for r in found.collect()} == {0: True, 1: False, 2: True}


def test_ranking_puts_the_informative_feature_first(rows):
    ranking = select.rank_features(rows, "label_id", ["a", "b c"], trees=5, depth=3, row_share=0.5)
    assert [r.feature for r in ranking.orderBy("rank").collect()] == ["a", "b c"]
    assert [r.feature for r in select.select_features(ranking, keep=1).collect()] == ["a"]
    weak = ranking.withColumn("importance", ranking.importance / 100)
    assert select.select_features(ranking, weak, keep=1).count() == 0


def test_parameters_map_to_the_learners(spark):
    forest = models.estimator("forest", {"n_estimators": 7.0, "max_depth": 44.0, "max_features": 29.0, "criterion": 1.0,
                                         "min_samples_leaf": 2.0, "min_samples_split": 9.0}, 3, 20)
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getFeatureSubsetStrategy(), forest.getImpurity(),
            forest.getMinInstancesPerNode()) == (7, 30, "20", "entropy", 5)
    leaves = models.estimator("boost_leaves", {"n_estimators": 330.0, "max_depth": 14.0, "num_leaves": 143.0,
                                               "learning_rate": 0.06, "subsample": 0.69, "colsample_bytree": 0.66}, 2, 20)
    assert (leaves.getMaxIter(), leaves.getMaxDepth(), leaves.getStepSize(), leaves.getFeatureSubsetStrategy()) == (330, 9, 0.06, "0.66")
