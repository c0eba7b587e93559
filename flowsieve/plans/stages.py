"""The five stages from flow files to explained models.

Every stage reads stored tables and stores its own, so a lost executor or a
restarted driver repeats one stage at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.bounded import materialise
from flowsieve.functions.scalar import named
from flowsieve.operators import balance, calibrate, clean, encode, explain, models, sample, search, select
from flowsieve.plans import presets
from flowsieve.plans.presets import Preset
from flowsieve.sources import flows, store

ID, CODE, SPLIT = "row_id", "label_id", "split"


@dataclass
class FeatureSet:
    """A stored table of (row_id, label_id, split, features…) and its label map."""

    rows: DataFrame
    labels: DataFrame
    features: list[str]

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col(SPLIT) == name).drop(SPLIT)


def prepare(landed: DataFrame, path: str, preset: Preset, label: str = "Label", source: str = "source_file") -> FeatureSet:
    """Landed flows to a sampled, cleaned, encoded, split and scaled feature set."""
    spark = landed.sparkSession
    thinned = sample.thin_common(landed.drop(flows.CORRUPT), [ID], source, label, list(preset.rare_labels),
                                 preset.fraction, presets.SEED).drop(source)
    cleaned = materialise(clean.clean_flows(thinned, label, ids=(ID,)), "cleaned")
    features = [c for c in cleaned.columns if c not in (ID, label)]
    labels = materialise(encode.label_map(cleaned, label), "labels")
    coded = encode.encode_labels(cleaned, labels, label).drop(label)
    parts = sample.stratified_split(coded, [ID], CODE, presets.TEST_FRACTION, presets.SEED, SPLIT)
    fitted = encode.fit_min_max(parts.filter(F.col(SPLIT) == "train"), features)
    scaled = clean.narrow(encode.apply_min_max(parts, fitted, features), features, [CODE])
    store.save_split(scaled, path, SPLIT)
    return FeatureSet(store.load_split(spark, path), labels, features)


def prepare_folder(spark: SparkSession, folder: str, path: str, preset: Preset, label: str = "Label") -> FeatureSet:
    """Same, starting from a folder of CSV files.

    What was left out is stored beside the set: ``<path>_skipped`` has the files without label or header with
    the reason, ``<path>_rejected`` the rows per file and how many of them did not fit their header, and
    ``<path>_malformed`` these rows as they were read; they are not part of the set.
    """
    headers = materialise(flows.file_headers(spark, folder, preset.recursive), "headers")
    flows.skipped_files(headers, label).write.mode("overwrite").parquet(f"{path}_skipped")
    landed = flows.number_rows(flows.read_flows(spark, folder, preset.recursive, label, headers), folder)
    flows.rejected_rows(landed).write.mode("overwrite").parquet(f"{path}_rejected")
    flows.malformed_rows(landed).write.mode("overwrite").parquet(f"{path}_malformed")
    return prepare(flows.fitting_rows(landed), path, preset, label)


def train_baselines(data: FeatureSet, params: dict[str, dict] | None = None, path: str | None = None) -> dict[str, dict]:
    """Fit and evaluate every slot; with ``path``, store models and reports there."""
    classes = data.labels.count()
    results = {}
    for slot, setting in (params or models.BASE_PARAMS).items():
        model, curves = models.train_calibrated(slot, setting, data.part("train"), ID, CODE, data.features, classes)
        results[slot] = _evaluated(slot, model, data.part("test"), data.features, path, curves)
    return results


def _evaluated(slot: str, model, test: DataFrame, features: list[str], path: str | None, curves: DataFrame | None = None) -> dict:
    """Reports and ROC curves of a model; margins are calibrated by ``curves``, which are stored beside the model."""
    scored = models.score(model, test, ID, CODE, features)
    if curves is not None:
        scored = calibrate.probabilities(scored, curves)
    results = {"model": model, "curves": curves, **models.evaluate_predictions(scored)}
    if path:
        store.save_model(model, f"{path}/{slot}/model")
        if curves is not None:
            curves.write.mode("overwrite").parquet(f"{path}/{slot}/curves")
        store.save_report_csv(results["report"], f"{path}/{slot}/report_csv")
        store.save_report_json(results["report"], f"{path}/{slot}/report_json", slot)
    return results


def select_and_balance(data: FeatureSet, path: str, preset: Preset, keep: int = select.KEPT_FEATURES) -> FeatureSet:
    """Keep the strongest features, then even out the classes of the train part."""
    spark = data.rows.sparkSession
    train = data.part("train")
    finder = select.rank_features(train, CODE, data.features, preset.finder_trees, row_share=preset.finder_rows)
    same = preset.finder_trees == select.RANK_TREES and preset.finder_rows == select.RANK_ROWS
    picker = None if same else select.rank_features(train, CODE, data.features)
    chosen = select.select_features(finder, picker, min(keep, len(data.features)))
    names = {r["feature"] for r in chosen.select("feature").collect()}
    features = [f for f in data.features if f in names]
    grow = balance.oversample_and_edit if preset.edit else balance.oversample
    grown = grow(train, ID, CODE, features).select(ID, CODE, *[named(f) for f in features]).withColumn(SPLIT, F.lit("train"))
    test = data.part("test").select(F.col(ID).cast("string").alias(ID), CODE, *[named(f) for f in features])
    both = grown.unionByName(test.withColumn(SPLIT, F.lit("test")))
    store.save_split(clean.narrow(both, features, [CODE]), path, SPLIT)
    return FeatureSet(store.load_split(spark, path), data.labels, features)


def evaluate_selection(data: FeatureSet, preset: Preset, params: dict[str, dict] | None = None,
                       path: str | None = None) -> dict[str, dict]:
    """Fit and evaluate every slot on the selected features and the balanced train part.

    With ``preset.fit_rows`` each classifier is fitted on a uniform sample of at most so many rows; the stored
    set stays whole, and every test row is scored.
    """
    train = data.part("train")
    if preset.fit_rows:
        train = materialise(sample.uniform_sample(train, [ID], preset.fit_rows, presets.SEED), "fit")
    classes, results = data.labels.count(), {}
    for slot, setting in (params or models.BASE_PARAMS).items():
        model, curves = models.train_calibrated(slot, setting, train, ID, CODE, data.features, classes)
        results[slot] = _evaluated(slot, model, data.part("test"), data.features, path, curves)
    return results


def tune(data: FeatureSet, path: str, preset: Preset, slots: tuple[str, ...] = models.SLOTS, trials: int | None = None,
         spaces: dict[str, dict] | None = None) -> dict[str, dict]:
    """Search each slot's space, refit the best point on all train rows and report.

    Stored best parameters end the search of their slot once they cover the trials asked for; a longer search
    replaces them.
    """
    spark = data.rows.sparkSession
    classes = data.labels.count()
    train, results = data.part("train"), {}
    for slot in slots:
        chunk = search.CHUNK_ROWS if slot == "forest" else None
        best_path, trials_path = f"{path}/{slot}/best_params", f"{path}/trials"
        best = store.load_best_params(spark, best_path)
        wanted = search.TRIALS[slot] if trials is None else trials
        if best is None or 0 < store.load_trials(spark, trials_path).filter(F.col("model") == slot).count() < wanted:
            log = search.search(train, ID, CODE, data.features, slot, trials_path, trials, chunk, (spaces or {}).get(slot))
            store.save_best_params(store.best_params(log), best_path)
            best = store.load_best_params(spark, best_path)
        fixed = preset.forest_fixed if slot == "forest" else None
        point = {**best.first()["params"], **(fixed or {})}
        model, curves = models.train_calibrated(slot, point, train, ID, CODE, data.features, classes, search.MODEL_SEED)
        results[slot] = _evaluated(slot, model, data.part("test"), data.features, path, curves)
    return results


def explain_model(data: FeatureSet, slot: str, model, path: str, rows: int | None = None) -> dict[str, DataFrame]:
    """Attributions of the test part with their global, class and local views.

    All test rows are explained, or with ``rows`` a sample of so many that keeps class shares (20 000, and
    10 000 for the forest, are the usual sizes: presets.EXPLAIN_ROWS, EXPLAIN_FOREST_ROWS).  ``model`` may be
    the path of a stored one.
    """
    spark = data.rows.sparkSession
    if isinstance(model, str):
        model = store.load_model(model)
    test = data.part("test")
    sampled = materialise(sample.stratified_sample(test, [ID], CODE, rows, presets.SEED) if rows else test, "explained")
    # The rows themselves are part of the key: a test part prepared anew is explained anew.
    content = sampled.agg(F.count("*"), F.sum(F.xxhash64(*[named(c) for c in sampled.columns]).cast("decimal(38,0)"))).first()
    key = store.fingerprint(slot, model.uid, data.features, rows, *[str(v) for v in content])
    phi = store.load_or_compute(spark, path, f"attributions-{slot}", key,
                                lambda: explain.attributions(sampled, model, ID, data.features))
    typical = explain.representatives(sampled, ID, CODE, data.features)
    predicted = models.score(model, sampled.join(typical.select(ID), ID, "left_semi"), ID, CODE, data.features)
    # A two-class boosted model explains its positive class only.
    explained = F.col("prediction") if len(phi.select("class_id").distinct().take(2)) > 1 else F.lit(1)
    chosen = encode.decode_labels(predicted.select(ID, "prediction", explained.alias("class_id")), data.labels,
                                  "prediction", "predicted_label")
    return {"attributions": phi, "importance": explain.global_importance(phi, presets.TOP_FEATURES),
            "classes": explain.class_summary(phi), "representatives": typical,
            "coverage": explain.class_coverage(test, sampled, CODE),
            "breakdown": explain.local_breakdown(phi, chosen, ID).join(F.broadcast(chosen.select(ID, "predicted_label")), ID)}
