"""Parameter search with resumable trials.

Points are drawn from the space by a seeded generator, so trial t always tries
the same point and a restarted search continues where it stopped.  Each trial
is scored by 3-fold macro-F1, and several trials run side by side.

Long boosted ensembles, and those of many rows, are grown on cells in tasks: rows
of the same bins, label and fold are counted once, so a fold's fit reads the counts
of the other folds and its score those of its own.  Bins lie between quantiles of
all rows of the chunk, labels unseen.  Every other fit is Spark's, over the fold's
rows.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.bounded import PART_ROWS, local_table, materialise, spread
from flowsieve.functions.scalar import named
from flowsieve.operators import cells, evaluate, grow, models
from flowsieve.operators.sample import chunk_number, stratified_folds
from flowsieve.sources import store

# Search spaces as (kind, low, high, step) or (kind, number of options).
SPACES = {
    "forest": {
        "criterion": ("choice", 2),
        "max_depth": ("quniform", 5, 50, 1),
        "max_features": ("quniform", 1, 29, 1),
        "min_samples_leaf": ("quniform", 1, 11, 1),
        "min_samples_split": ("quniform", 2, 11, 1),
        "n_estimators": ("quniform", 10, 200, 1),
    },
    "boost_depth": {
        "n_estimators": ("quniform", 50, 500, 10),
        "max_depth": ("quniform", 3, 15, 1),
        "learning_rate": ("uniform", 0.01, 0.3),
        "subsample": ("uniform", 0.6, 1.0),
        "colsample_bytree": ("uniform", 0.6, 1.0),
        "gamma": ("uniform", 0, 5),
        "min_child_weight": ("quniform", 1, 10, 1),
    },
    "boost_bins": {
        "iterations": ("quniform", 50, 500, 10),
        "depth": ("quniform", 4, 10, 1),
        "learning_rate": ("uniform", 0.01, 0.3),
        "l2_leaf_reg": ("uniform", 1, 10),
    },
    "boost_leaves": {
        "n_estimators": ("quniform", 50, 500, 10),
        "max_depth": ("quniform", 3, 15, 1),
        "num_leaves": ("quniform", 20, 150, 1),
        "learning_rate": ("uniform", 0.01, 0.3),
        "subsample": ("uniform", 0.6, 1.0),
        "colsample_bytree": ("uniform", 0.6, 1.0),
    },
}

# Trials per slot, rows per rotating chunk, and the model seed.
TRIALS = {"forest": 25, "boost_depth": 20, "boost_bins": 20, "boost_leaves": 20}
CHUNK_ROWS = 500_000
MODEL_SEED = 106

# Trials under way at once.
PARALLEL = 4


def draw_point(space: dict, seed: int, trial: int) -> dict[str, float]:
    """The parameters trial number ``trial`` tries."""
    draw = random.Random(f"{seed}:{trial}")
    point = {}
    for name, (kind, *limits) in sorted(space.items()):
        if kind == "choice":
            point[name] = float(draw.randrange(limits[0]))
        elif kind == "uniform":
            point[name] = draw.uniform(*limits)
        else:
            low, high, step = limits
            point[name] = float(min(high, max(low, round(draw.uniform(low, high) / step) * step)))
    return point


def cross_validate(rows: DataFrame, row_id: str, label_id: str, features: list[str], slot: str, params: dict,
                   folds: int = 3, n_classes: int | None = None, seed: int = MODEL_SEED) -> DataFrame:
    """(fold, f1_macro): each fold scored by a model fitted on the others."""
    ready = models.ready_rows(rows, label_id, features, (row_id, "fold"))
    classes = n_classes or int(rows.agg(F.max(named(label_id))).first()[0]) + 1
    return _fold_scores(ready, row_id, len(features), slot, params, folds, classes, seed)


def _fold_scores(ready: DataFrame, row_id: str, width: int, slot: str, params: dict, folds: int, classes: int, seed: int = MODEL_SEED) -> DataFrame:
    parts = []
    for fold in range(folds):
        # Files are read back in as many partitions as there are cores, however many rows they hold.
        own = spread(ready.filter(F.col("fold") != fold), row_id)
        model = models.fit(slot, params, own.select("features", "label_id"), classes, width, seed)
        scored = models.score_ready(model, ready.filter(F.col("fold") == fold), row_id, "label_id")
        parts.append(scored.select(F.lit(fold).alias("fold"), "label_id", "prediction"))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return evaluate.macro_f1(evaluate.confusion_counts(table, "label_id", "prediction", ["fold"]), ["fold"])


def _cell_scores(held: cells.Cells, learner, params: dict, folds: int) -> DataFrame:
    """The same from cells of rows that agree in their fold, a task a fold."""
    found, several = cells.points(held, ("fold",)), learner.hasParam("classifier")
    own = [cells.by_class(found, held.classes, (fold,)) for fold in range(folds)]
    setting, (ridge, most) = cells.boosting_of(learner), models.leaf_rules(params)
    spark = held.table.sparkSession
    sent, classes = spark.sparkContext.broadcast((found[0], own)), range(held.classes) if several else [1]

    def work(fold: int) -> pa.RecordBatch:
        points, counts = sent.value
        others = sum(counts[i] for i in range(folds) if i != fold)
        margins = np.stack([grow.boost(points, *cells.one_of(others, c), ridge=ridge, most=most, **setting)[0] for c in classes])
        predicted = margins.argmax(axis=0) if several else (margins[0] > 0).astype(int)
        rows = [(fold, y, int(p), int(counts[fold][predicted == p, y].sum())) for p in np.unique(predicted) for y in range(counts[fold].shape[1])]
        columns = list(zip(*[row for row in rows if row[3]])) or [[]] * 4
        kinds = pa.int32(), pa.int32(), pa.int32(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["fold", "y", "pred", "n"])

    counts = local_table(spark, cells.in_tasks(spark, list(range(folds)), work, "fold int, y int, pred int, n bigint").toArrow(), "fold int, y int, pred int, n bigint")
    sent.unpersist()
    return evaluate.macro_f1(counts, ["fold"])


def mean_fold_score(scores: DataFrame, groups: list[str] = (), score: str = "f1_macro") -> DataFrame:
    """(groups, mean_score): the mean over folds that a trial is judged by."""
    return scores.groupBy(*groups).agg(F.avg(score).alias("mean_score"))


def search(rows: DataFrame, row_id: str, label_id: str, features: list[str], slot: str, trials_path: str,
           trials: int | None = None, chunk_rows: int | None = None, space: dict | None = None, folds: int = 3,
           seed: int = 42, parallel: int = PARALLEL) -> DataFrame:
    """Run the trials of a slot not yet in ``trials_path``; returns all of them.

    ``parallel`` trials run side by side, each in a scheduler pool of its own: the last tasks of one fit leave
    cores that another takes, and under ``spark.scheduler.mode`` FAIR none waits for the others.  All read one
    table whose folds are drawn and whose features are assembled once, in an order that follows from row ids, so a
    resumed search and an uninterrupted one log the same.

    With ``chunk_rows``, trial t works on chunk t mod n of the table, the chunks
    being stable hash buckets stored as folders so that a trial reads its own
    chunk only.
    """
    spark = rows.sparkSession
    space = space or SPACES[slot]
    wanted = TRIALS[slot] if trials is None else trials
    done = {r["trial"] for r in store.load_trials(spark, trials_path).filter(F.col("model") == slot).select("trial").collect()}
    missing = [t for t in range(wanted) if t not in done]
    if missing:
        columns = [row_id, label_id, *features]
        total, top = rows.agg(F.count("*"), F.max(label_id)).first()
        classes = int(top) + 1
        chunks = max(1, -(-total // chunk_rows)) if chunk_rows else 1
        folded = stratified_folds(rows.select(*[named(c) for c in columns]), [row_id], label_id, folds)
        numbered = chunk_number(folded, [row_id], chunks)
        ready = models.ready_rows(numbered, label_id, features, (row_id, "fold", "chunk"))
        drawn = {trial: draw_point(space, seed, trial) for trial in missing}
        learners = {trial: models.estimator(slot, point, classes, len(features), MODEL_SEED) for trial, point in drawn.items()}
        grown = {trial for trial, learner in learners.items()
                 if models.is_long(learner) or total > cells.FEWEST_ROWS and cells.boosts_in_tasks(learner)}

        def dealt() -> DataFrame:
            # A few files per chunk, not one per chunk and task; the second key keeps a large chunk from one task.
            files = max(8, -(-total // (chunks * PART_ROWS)))
            rows_of = ready.repartition(max(spark.sparkContext.defaultParallelism, int(chunks * files)), "chunk",
                                        F.pmod(F.xxhash64(named(row_id)), F.lit(files))).sortWithinPartitions("chunk", named(row_id))
            return materialise(rows_of, "folds", partition="chunk")

        # One chunk whose cells are counted is read once; else its rows are dealt out and stored.
        stored = dealt() if chunks > 1 or len(grown) < len(missing) else None
        held = {}
        for chunk in sorted({trial % chunks for trial in grown}):
            own = ready if stored is None else stored.filter(F.col("chunk") == chunk)
            held[chunk] = cells.fold_any(own.select("features", "label_id", "fold"), len(features), models.MAX_BINS, ("fold",))
            if held[chunk] is not None and cells.by_class(cells.points(held[chunk], ("fold",)), classes) is None:
                held[chunk] = None
            elif held[chunk] is not None:
                held[chunk].classes = classes
        if stored is None and None in held.values():
            stored = dealt()

        def run(trial: int) -> None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{slot}-{trial}")
            point, chunk = drawn[trial], trial % chunks
            if trial in grown and held[chunk] is not None:
                scores = _cell_scores(held[chunk], learners[trial], point, folds)
            else:
                scores = _fold_scores(stored.filter(F.col("chunk") == chunk), row_id, len(features), slot, point, folds, classes)
            loss = -mean_fold_score(scores).first()[0]
            store.append_trial(spark, trials_path, [(slot, trial, chunk, point, float(loss))])

        with ThreadPoolExecutor(max(1, min(parallel, len(missing)))) as pool:
            # A trial that fails ends the search with its error, after those under way are logged.
            for finished in [pool.submit(inheritable_thread_target(spark)(run), trial) for trial in missing]:
                finished.result()
    return store.load_trials(spark, trials_path).filter(F.col("model") == slot)


def train_best(trials: DataFrame, train_rows: DataFrame, label_id: str, features: list[str], slot: str,
               fixed: dict | None = None, n_classes: int | None = None):
    """Fit the parameters of the lowest loss on all training rows; ``fixed`` overrides some."""
    best = store.best_params(trials.filter(F.col("model") == slot)).first()
    return train_params(best["params"], train_rows, label_id, features, slot, fixed, n_classes)


def train_params(params: dict, train_rows: DataFrame, label_id: str, features: list[str], slot: str,
                 fixed: dict | None = None, n_classes: int | None = None):
    """Fit given parameters on all training rows; ``fixed`` overrides some."""
    return models.train(slot, {**params, **(fixed or {})}, train_rows, label_id, features, n_classes, MODEL_SEED)
