"""Feature ranking, training, search and explanation.

Learners are not bit-comparable between engines, so most of these have no
check statement; the tests verify their properties instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.bounded import clearings, materialise, work_path
from flowsieve.operators import encode, evaluate, explain, models, sample, search, select
from flowsieve.plans import presets, stages
from flowsieve.queries import query
from flowsieve.queries.sampling import split_sql
from flowsieve.sources import store
from flowsieve.tables import table

EVENT_FEATURES = ["value", "k", "user"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Forests have all their trees; queries that do not compare all slots or search keep fewer boosting rounds than the
# presets, see the README.  Rows are whole.
SHORT_PARAMS = {
    "forest": models.BASE_PARAMS["forest"],
    "boost_depth": {**models.BASE_PARAMS["boost_depth"], "n_estimators": 5},
    "boost_leaves": {**models.BASE_PARAMS["boost_leaves"], "n_estimators": 5},
    "boost_bins": {**models.BASE_PARAMS["boost_bins"], "iterations": 5},
}
_shared: dict[tuple, object] = {}


def shared(spark, folder, name, build):
    """What several queries of one application start from, built once: a stored split, a fitted model."""
    key = (spark.sparkContext.applicationId, clearings(), folder, name)
    if key not in _shared:
        _shared[key] = build()
    return _shared[key]


def all_lines(spark, folder):
    """Line items with a key and a two-class code."""
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        (F.col("l_linestatus") == "O").cast("int").alias("label_id"), *LINE_FEATURES)


def lines(spark, folder):
    """The same with a split, stored once for all that reads it."""
    return shared(spark, folder, "lines", lambda: materialise(
        sample.stratified_split(all_lines(spark, folder), ["row_id"], "label_id"), "lines"))


def line_forest(spark, folder):
    """The forest slot fitted on the train part of the line items."""
    return shared(spark, folder, "line forest", lambda: models.train(
        "forest", models.BASE_PARAMS["forest"], parts(lines(spark, folder))[0], "label_id", LINE_FEATURES))


def events(spark, folder):
    """Events with numeric features and a five-class code."""
    df = table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("user_id").cast("double").alias("user"))
    return encode.encode_labels(df, encode.label_map(df, "event_type"), "event_type").drop("event_type")


def parts(df):
    return df.filter(F.col("split") == "train").drop("split"), df.filter(F.col("split") == "test").drop("split")


@query("feature_ranking")
def feature_ranking(spark, folder):
    """Importances of a regression forest on the label code."""
    return select.rank_features(all_lines(spark, folder), "label_id", LINE_FEATURES)


@query("selected_features")
def selected_features(spark, folder):
    """Features reaching the importance of the second-ranked one."""
    ranking = select.rank_features(events(spark, folder), "label_id", EVENT_FEATURES)
    return select.select_features(ranking, keep=2)


@query("nth_largest_value", """
SELECT min(o_totalprice) AS threshold FROM (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 20)""")
def nth_largest_value(spark, folder):
    """The 20th largest value as a threshold."""
    return select.nth_largest(table(spark, folder, "orders"), "o_totalprice", 20)


@query("baseline_comparison")
def baseline_comparison(spark, folder):
    """All four slots fitted on line items and compared on the test part."""
    train, test = parts(lines(spark, folder))
    scored = models.compare_slots(train, test, "row_id", "label_id", LINE_FEATURES, n_classes=2)
    counts = evaluate.confusion_counts(scored, "label_id", "prediction", ["model"])
    return evaluate.compare_models(counts, ["model"])


@query("forest_report")
def forest_report(spark, folder):
    """Per-class report of a forest on events."""
    train, test = parts(sample.stratified_split(events(spark, folder), ["row_id"], "label_id"))
    model = models.train("forest", SHORT_PARAMS["forest"], train, "label_id", EVENT_FEATURES)
    scored = models.score(model, test, "row_id", "label_id", EVENT_FEATURES)
    return evaluate.report(evaluate.confusion_counts(scored, "label_id", "prediction"), digits=4)


@query("class_probabilities")
def class_probabilities(spark, folder):
    """Class probabilities of every test row."""
    _, test = parts(lines(spark, folder))
    model = line_forest(spark, folder)
    return models.score(model, test, "row_id", "label_id", LINE_FEATURES)


@query("multiclass_boosting_auc")
def multiclass_boosting_auc(spark, folder):
    """One boosted ensemble per class, ranked by raw score."""
    train, test = parts(sample.stratified_split(events(spark, folder), ["row_id"], "label_id"))
    model = models.train("boost_leaves", {"n_estimators": 2, "num_leaves": 8, "learning_rate": 0.1}, train, "label_id", EVENT_FEATURES)
    scored = models.score(model, test, "row_id", "label_id", EVENT_FEATURES)
    return evaluate.area_under_roc(evaluate.score_counts(evaluate.long_scores(scored, "label_id", "score"), ["class"]), ["class"])


LINES_SQL = """keyed AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, (l_linestatus = 'O')::INT AS label_id
  FROM lineitem)"""


@query("stored_model_scores", f"""
WITH {LINES_SQL}, {split_sql('keyed', 'row_id', 'label_id')}
SELECT label_id, count(*) AS n, count(*) AS n_same FROM parts WHERE split = 'test' GROUP BY 1""")
def stored_model_scores(spark, folder):
    """A model saved, loaded and applied: how many predictions of both agree."""
    _, test = parts(lines(spark, folder))
    model = line_forest(spark, folder)
    path = work_path(spark, "forest")
    store.save_model(model, path)
    loaded = store.load_model(path)
    before = models.score(model, test, "row_id", "label_id", LINE_FEATURES).select("row_id", "label_id", "prediction")
    after = models.score(loaded, test, "row_id", "label_id", LINE_FEATURES).select("row_id", F.col("prediction").alias("again"))
    same = (F.col("prediction") == F.col("again")).cast("bigint")
    return before.join(after, "row_id").groupBy("label_id").agg(F.count("*").alias("n"), F.sum(same).alias("n_same"))


@query("reduced_feature_evaluation")
def reduced_feature_evaluation(spark, folder):
    """Slots fitted again on the selected features only."""
    data = lines(spark, folder)
    train, test = parts(data)
    kept = [r["feature"] for r in select.select_features(select.rank_features(train, "label_id", LINE_FEATURES), keep=2).collect()]
    scored = models.compare_slots(train, test, "row_id", "label_id", kept, {k: SHORT_PARAMS[k] for k in ("forest", "boost_depth")})
    counts = evaluate.confusion_counts(scored, "label_id", "prediction", ["model"])
    return evaluate.report(counts, ["model"], digits=4)


@query("forest_search_trials")
def forest_search_trials(spark, folder):
    """Two trials of the forest space on rotating chunks."""
    space = {**search.SPACES["forest"], "n_estimators": ("quniform", 5, 10, 1), "max_depth": ("quniform", 3, 6, 1)}
    return search.search(events(spark, folder), "row_id", "label_id", EVENT_FEATURES, "forest", work_path(spark, "trials"),
                         trials=2, chunk_rows=500_000, space=space)


@query("boosting_search_best")
def boosting_search_best(spark, folder):
    """Best of all trials of a whole boosted space, two classes."""
    train, _ = parts(lines(spark, folder))
    trials = search.search(train, "row_id", "label_id", LINE_FEATURES, "boost_bins", work_path(spark, "trials"))
    return store.best_params(trials)


@query("tuned_forest_report")
def tuned_forest_report(spark, folder):
    """Search, refit of the best point on all train rows, report on the test part."""
    train, test = parts(sample.stratified_split(events(spark, folder), ["row_id"], "label_id"))
    space = {**search.SPACES["forest"], "n_estimators": ("quniform", 5, 10, 1), "max_depth": ("quniform", 3, 6, 1)}
    trials = search.search(train, "row_id", "label_id", EVENT_FEATURES, "forest", work_path(spark, "trials"), trials=1, space=space)
    model = search.train_best(trials, train, "label_id", EVENT_FEATURES, "forest")
    scored = models.score(model, test, "row_id", "label_id", EVENT_FEATURES)
    return evaluate.report(evaluate.confusion_counts(scored, "label_id", "prediction"), digits=4)


def event_forest(spark, folder):
    """(events, forest): the forest slot fitted on all events."""
    def build():
        rows = materialise(events(spark, folder), "events")
        return rows, models.train("forest", models.BASE_PARAMS["forest"], rows, "label_id", EVENT_FEATURES)
    return shared(spark, folder, "event forest", build)


def explained_events(spark, folder):
    """A forest on events with every event explained: a row per event, and its attributions listed."""
    rows, model = event_forest(spark, folder)
    explained = shared(spark, folder, "explained events", lambda: explain.explained_rows(rows, model, "row_id", EVENT_FEATURES, ("label_id",)))
    return explained, model, explain.listed_attributions(explained, "row_id", EVENT_FEATURES)


@query("forest_attributions")
def forest_attributions(spark, folder):
    return explained_events(spark, folder)[2]


@query("boosted_attributions")
def boosted_attributions(spark, folder):
    """Attributions of a boosted model with base value."""
    rows = all_lines(spark, folder)
    model = models.train("boost_depth", {"n_estimators": 5, "max_depth": 4, "learning_rate": 0.3}, rows, "label_id", LINE_FEATURES)
    return explain.attributions(rows, model, "row_id", LINE_FEATURES)


@query("attribution_additivity", """
SELECT (row_number() OVER (ORDER BY event_type) - 1)::INT AS class_id,
       (SELECT count(*) FROM events)::BIGINT AS n, 0.0::DOUBLE AS largest_gap
FROM (SELECT DISTINCT event_type FROM events)""")
def attribution_additivity(spark, folder):
    """Largest gap between base plus attributions and the model's own score, per class."""
    explained, model, _ = explained_events(spark, folder)
    # A row carries its attributions to its score, so neither is shuffled.
    rows = explained.select("row_id", "label_id", "classes", *[F.col("values")[i].alias(f) for i, f in enumerate(EVENT_FEATURES)])
    scored = models.score(model, rows, "row_id", "label_id", EVENT_FEATURES, ("classes",))
    each = scored.select("score", F.inline("classes"))
    gap = F.col("base_value") + F.aggregate("phi", F.lit(0.0), lambda total, p: total + p) - F.get("score", F.col("class_id"))
    return each.groupBy("class_id").agg(F.count(gap).alias("n"), F.round(F.max(F.abs(gap)), 9).alias("largest_gap"))


@query("global_importance")
def global_importance(spark, folder):
    return explain.global_importance(explained_events(spark, folder)[2])


@query("class_attribution_summary")
def class_attribution_summary(spark, folder):
    return explain.class_summary(explained_events(spark, folder)[2])


@query("local_breakdown")
def local_breakdown(spark, folder):
    """From base value to prediction for the most typical row of every class."""
    rows, model = event_forest(spark, folder)
    typical = explain.representatives(rows, "row_id", "label_id", EVENT_FEATURES)
    picked = materialise(rows.join(typical.select("row_id"), "row_id", "left_semi"), "typical")
    phi = explain.attributions(picked, model, "row_id", EVENT_FEATURES)
    scored = models.score(model, picked, "row_id", "label_id", EVENT_FEATURES)
    return explain.local_breakdown(phi, scored.select("row_id", F.col("prediction").alias("class_id")), "row_id")


@query("prepared_feature_set")
def prepared_feature_set(spark, folder):
    """Stage 0 from CSV files derived from events to a stored feature set."""
    path = work_path(spark, "flows-csv")
    (table(spark, folder, "events").select(
        F.col("ts").cast("string").alias(" Timestamp"), F.when(F.col("value") < 5, "Infinity").otherwise(F.col("value").cast("string")).alias(" Flow Bytes/s"),
        F.get_json_object("props", "$.k").alias("Fwd Pkt.1"), F.col("user_id").alias("Dst Port "), F.col("event_type").alias("Label"))
     .write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    preset = presets.Preset(True, 0.5, ("error",), 15, 0.05, False, None)
    data = stages.prepare_folder(spark, path, work_path(spark, "features"), preset)
    return encode.decode_labels(data.rows, data.labels).groupBy("split", "label").agg(
        F.count("*").alias("n"), F.round(F.avg("`Flow Bytes/s`"), 6).alias("mean_bytes"), F.round(F.max("`Fwd Pkt.1`"), 6).alias("max_packets"))
