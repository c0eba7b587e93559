"""Training and scoring with Spark ML's tree learners.

Four slots keep the roles of the four classifiers being compared: one bagged
forest and three boosted ensembles.  Boosting more than two classes trains one
ensemble per class; its margins are calibrated into class probabilities.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.bounded import materialise, spread
from flowsieve.functions.scalar import named
from flowsieve.operators import calibrate, cells, evaluate, leaves
from flowsieve.operators.sample import stratified_folds
from flowsieve.operators.select import STATISTICS_MB, assemble

SLOTS = ("forest", "boost_depth", "boost_leaves", "boost_bins")

# Trees per model, bins per feature, and Spark's tree depth limit.
BASE_TREES = 100
MAX_BINS = 32
DEPTH_LIMIT = 30

# Baseline settings per slot in the vocabulary of the search spaces.
BASE_PARAMS = {
    "forest": {"n_estimators": BASE_TREES, "max_depth": 6, "subsample": 0.8, "max_features_share": 0.8},
    "boost_depth": {"n_estimators": BASE_TREES, "max_depth": 6, "learning_rate": 0.3},
    "boost_leaves": {"n_estimators": BASE_TREES, "num_leaves": 31, "learning_rate": 0.1},
    "boost_bins": {"iterations": BASE_TREES, "depth": 6, "learning_rate": 0.1, "l2_leaf_reg": 3.0},
}

# One fold in so many is kept for calibrating margins.
CALIBRATION_FOLDS = 5


def fit(slot: str, params: dict, ready: DataFrame, n_classes: int, n_features: int, seed: int = 42, held: cells.Cells | None = None):
    """Fit a slot on (features, label_id); a ridge term on leaf values and a number of leaves act afterwards.

    With ``held``, the cells of ``ready``, rows are not read again where a fit on cells is the same.
    """
    learner = estimator(slot, params, n_classes, n_features, seed)
    if held is None or not cells.suits(learner):
        model = learner.fit(ready)
        return model if slot == "forest" else _finish(params, model, ready)
    if slot == "forest":
        return cells.fit_forest(learner, held)
    return cells.fit_boosted(learner, held, lambda model, weighted: _finish(params, model, weighted), *leaf_rules(params))


def leaf_rules(params: dict) -> tuple[float, int | None]:
    """The ridge term on leaf values and the most leaves of a tree."""
    most = params.get("num_leaves")
    return float(params.get("l2_leaf_reg", 0.0)), None if most is None else int(most)


def _finish(params: dict, model, ready: DataFrame):
    ridge, most = leaf_rules(params)
    if not (ridge or most):
        return model
    return leaves.refit(model, ready, ridge, most)


def estimator(slot: str, params: dict, n_classes: int, n_features: int, seed: int = 42, parallelism: int = 4):
    """A Spark ML estimator for a slot from parameters of its search space."""
    common = {"featuresCol": "features", "labelCol": "label_id", "maxBins": MAX_BINS, "seed": seed,
              "maxMemoryInMB": STATISTICS_MB}
    depth = int(params.get("max_depth", params.get("depth", 6 if "num_leaves" not in params else DEPTH_LIMIT)))
    if "num_leaves" in params:
        # Room for uneven trees; what is too much is taken back.
        depth = min(depth, math.ceil(math.log2(params["num_leaves"])) + 1)
    depth = min(depth, DEPTH_LIMIT)
    if "min_child_weight" in params:
        leaf = int(params["min_child_weight"])
    else:
        leaf = max(int(params.get("min_samples_leaf", 1)), math.ceil(int(params.get("min_samples_split", 2)) / 2))
    common.update(maxDepth=depth, minInstancesPerNode=max(1, leaf), subsamplingRate=float(params.get("subsample", 1.0)))
    if slot == "forest":
        if "max_features" in params:
            columns = str(min(int(params["max_features"]), n_features))
        else:
            columns = str(float(params.get("max_features_share", 1.0)))
            columns = "all" if columns == "1.0" else columns
        impurity = "entropy" if int(params.get("criterion", 0)) == 1 else "gini"
        return RandomForestClassifier(numTrees=int(params["n_estimators"]), impurity=impurity,
                                      featureSubsetStrategy=columns, **common)
    share = float(params.get("colsample_bytree", 1.0))
    boosted = GBTClassifier(maxIter=int(params.get("n_estimators", params.get("iterations", BASE_TREES))),
                            stepSize=float(params.get("learning_rate", 0.1)), minInfoGain=float(params.get("gamma", 0.0)),
                            featureSubsetStrategy="all" if share >= 1.0 else str(share), **common)
    if n_classes <= 2:
        return boosted
    return OneVsRest(classifier=boosted, featuresCol="features", labelCol="label_id", parallelism=parallelism)


def ready_rows(rows: DataFrame, label_id: str, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(features vector, label_id, kept columns): what learners read; store it if several fits share it."""
    numeric = rows.select(named(label_id).cast("double").alias("label_id"), *[named(f) for f in features], *[named(c) for c in keep])
    return assemble(numeric, features).select("features", "label_id", *[named(c) for c in keep])


def train(slot: str, params: dict, rows: DataFrame, label_id: str, features: list[str], n_classes: int | None = None,
          seed: int = 42):
    """Fit a slot on a table of numeric features and label codes."""
    plain = ready_rows(rows, label_id, features)
    held = cells.fold(plain, len(features), MAX_BINS)
    if held is None and is_long(estimator(slot, params, n_classes or 2, len(features), seed)):
        held = cells.fold_any(plain, len(features), MAX_BINS)
    if held is not None and cells.boosts_in_tasks(estimator(slot, params, n_classes or held.classes, len(features), seed)):
        return fit(slot, params, plain, n_classes or held.classes, len(features), seed, held)
    ready = spread(plain).persist()
    try:
        classes = n_classes or (int(ready.agg(F.max("label_id")).first()[0]) + 1 if held is None else held.classes)
        return fit(slot, params, ready, classes, len(features), seed, held)
    finally:
        ready.unpersist()


def is_long(learner) -> bool:
    """Whether an ensemble has more rounds than are worth jobs of their own for every level."""
    return cells.boosts_in_tasks(learner) and cells.rounds_of(learner) > cells.MANY_ROUNDS


def score(model, rows: DataFrame, row_id: str, label_id: str, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, label_id, prediction, score, kept columns): score is per class, null if the model gives none."""
    return score_ready(model, assemble(rows, features), row_id, label_id, keep)


def score_ready(model, rows: DataFrame, row_id: str, label_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for rows whose features are a vector already."""
    ready = rows.select(named(row_id).alias("_id"), named(label_id).cast("int").alias("label_id"), "features", *[named(c) for c in keep])
    out = model.transform(ready)
    scores = next((c for c in ("probability", "rawPrediction") if c in out.columns), None)
    values = vector_to_array(scores) if scores else F.lit(None).cast("array<double>")
    return out.select(F.col("_id").alias(row_id), "label_id", F.col("prediction").cast("int").alias("prediction"), values.alias("score"),
                      *[named(c) for c in keep])


def has_probabilities(model) -> bool:
    """Whether a model's scores are class probabilities; one boosted model per class gives margins."""
    return not isinstance(model, OneVsRestModel)


def train_calibrated(slot: str, params: dict, rows: DataFrame, row_id: str, label_id: str, features: list[str],
                     n_classes: int, seed: int = 42):
    """(model, curves): a fitted slot, and what turns its margins into probabilities, None if it gives them itself.

    Margins are calibrated on a fold of CALIBRATION_FOLDS that the model was not fitted on.
    """
    if slot == "forest" or n_classes <= 2:
        return train(slot, params, rows, label_id, features, n_classes, seed), None
    folded = materialise(stratified_folds(rows, [row_id], label_id, CALIBRATION_FOLDS), "calibration")
    model = train(slot, params, folded.filter("fold <> 0"), label_id, features, n_classes, seed)
    held = score(model, folded.filter("fold = 0"), row_id, label_id, features)
    return model, materialise(calibrate.fit_curves(held, "label_id", "score"), "curves")


def evaluate_predictions(predictions: DataFrame, digits: int | None = None) -> dict[str, DataFrame]:
    """Report, confusion counts, ROC points, per-class and macro AUC of stored predictions.

    ROC tables are left out when the model gives no scores.
    """
    stored = materialise(predictions, "predictions")
    counts = evaluate.confusion_counts(stored, "label_id", "prediction")
    results = {"predictions": stored, "confusion": counts, "report": evaluate.report(counts, digits=digits),
               "overall": evaluate.overall_metrics(counts)}
    if stored.filter(F.col("score").isNotNull()).limit(1).count():
        by_score = evaluate.score_counts(evaluate.long_scores(stored, "label_id", "score"), ["class"])
        points = evaluate.roc_points(by_score, ["class"])
        macro = evaluate.macro_roc(points, [])
        results.update(roc=points, auc=evaluate.area_under_roc(by_score, ["class"]), macro_roc=macro,
                       macro_auc=evaluate.curve_area(macro, []))
    return results


def compare_slots(train_rows: DataFrame, test_rows: DataFrame, row_id: str, label_id: str, features: list[str],
                  params: dict[str, dict] | None = None, n_classes: int | None = None, seed: int = 42) -> DataFrame:
    """Fit every slot, score the test rows: (model, row_id, label_id, prediction, score).

    Both tables are assembled and stored once for all slots.
    """
    settings = params or BASE_PARAMS
    stored = materialise(ready_rows(train_rows, label_id, features), "ready")
    held = every = cells.fold(stored, len(features), MAX_BINS)
    learners = {slot: estimator(slot, setting, n_classes or 2, len(features), seed) for slot, setting in settings.items()}
    if held is None and any(is_long(learner) for learner in learners.values()):
        every = cells.fold_any(stored, len(features), MAX_BINS)
    ready = spread(stored).persist()
    test = materialise(assemble(test_rows, features).select(named(row_id), named(label_id), "features"), "test")
    classes = n_classes or (int(ready.agg(F.max("label_id")).first()[0]) + 1 if held is None else held.classes)
    models, spark = {}, stored.sparkSession
    # Ensembles that tasks grow leave most cores to the others.
    grown = [slot for slot, learner in learners.items() if every is not None and (is_long(learner) or held is not None and cells.boosts_in_tasks(learner))]
    try:
        with ThreadPoolExecutor(max(1, len(grown))) as pool:
            coming = {slot: pool.submit(inheritable_thread_target(spark)(fit), slot, settings[slot], ready, classes, len(features), seed, every)
                      for slot in grown}
            for slot, setting in settings.items():
                if slot not in coming:
                    models[slot] = fit(slot, setting, ready, classes, len(features), seed, held)
            models.update({slot: one.result() for slot, one in coming.items()})
    finally:
        ready.unpersist()
    parts = [score_ready(models[slot], test, row_id, label_id).select(F.lit(slot).alias("model"), "*") for slot in settings]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
