"""Properties of model queries that SQL can state exactly.

Learners differ between engines, so these do not compare scores; they reduce
the full result of the operator to what must hold for any model: row counts,
probabilities adding up, attributions adding up to the model's own score,
reports consistent with their lines, trials on the chunks they should read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.bounded import materialise, work_path
from flowsieve.operators import calibrate, evaluate, explain, models, sample, search, select
from flowsieve.plans import presets, stages
from flowsieve.queries import query
from flowsieve.queries.learning import (
    EVENT_FEATURES, LINE_FEATURES, LINES_SQL, SHORT_PARAMS, all_lines, event_forest, events, explained_events, line_forest, lines, parts,
)
from flowsieve.queries.sampling import split_sql
from flowsieve.tables import table

CODES_SQL = """codes AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INT AS class_id
  FROM (SELECT DISTINCT event_type FROM events))"""


@query("probability_sums", f"""
WITH {LINES_SQL}, {split_sql('keyed', 'row_id', 'label_id')}
SELECT label_id, count(*) AS n, count(*)::DOUBLE AS total, true AS in_range FROM parts WHERE split = 'test' GROUP BY 1""")
def probability_sums(spark, folder):
    """Class probabilities of every test row lie in [0, 1] and add up to one."""
    _, test = parts(lines(spark, folder))
    model = line_forest(spark, folder)
    scored = models.score(model, test, "row_id", "label_id", LINE_FEATURES)
    total = F.aggregate("score", F.lit(0.0), lambda a, p: a + p)
    return scored.groupBy("label_id").agg(F.count("*").alias("n"), F.round(F.sum(total), 6).alias("total"),
                                          F.bool_and(F.forall("score", lambda p: (p >= 0) & (p <= 1))).alias("in_range"))


@query("multiclass_probability_sums", f"""
WITH {CODES_SQL}, {split_sql('events', 'event_id', 'event_type')}
SELECT model, class_id AS label_id, count(*) AS n, count(*)::DOUBLE AS total, true AS in_range
FROM parts JOIN codes USING (event_type), (SELECT unnest(['boost_depth', 'boost_leaves', 'boost_bins']) AS model) WHERE split = 'test' GROUP BY ALL""")
def multiclass_probability_sums(spark, folder):
    """Boosted slots of many classes give calibrated probabilities in [0, 1] that add up to one for every test row."""
    train, test = parts(materialise(sample.stratified_split(events(spark, folder), ["row_id"], "label_id"), "events"))
    total, found = F.aggregate("score", F.lit(0.0), lambda a, p: a + p), None
    for slot, setting in {**SHORT_PARAMS, "boost_leaves": {"n_estimators": 2, "num_leaves": 8, "learning_rate": 0.1}}.items():
        if slot == "forest":
            continue
        rounds = {k: 2 for k in ("n_estimators", "iterations") if k in setting}
        model, curves = models.train_calibrated(slot, {**setting, **rounds}, train, "row_id", "label_id", EVENT_FEATURES, 5)
        scored = calibrate.probabilities(models.score(model, test, "row_id", "label_id", EVENT_FEATURES), curves)
        own = scored.groupBy("label_id").agg(F.count("*").alias("n"), F.round(F.sum(total), 6).alias("total"),
                                             F.bool_and(F.forall("score", lambda p: (p >= 0) & (p <= 1))).alias("in_range"))
        own = own.select(F.lit(slot).alias("model"), "*")
        found = own if found is None else found.unionByName(own)
    return found


@query("attribution_spread", f"""
WITH {CODES_SQL} SELECT class_id, feature, (SELECT count(*) FROM events)::BIGINT AS n, true AS within
FROM codes, (SELECT unnest(['value', 'k', 'user']) AS feature)""")
def attribution_spread(spark, folder):
    """Quantiles from sketches that were stored per batch and merged, held against the exact ranks of all attributions."""
    phi = explained_events(spark, folder)[2]
    batch = F.pmod(F.xxhash64("row_id"), F.lit(4))
    sketches = None
    for i in range(4):
        own = materialise(explain.attribution_sketches(phi.filter(batch == i)), "sketches")
        sketches = own if sketches is None else sketches.unionByName(own)
    summary = explain.sketched_summary(explain.merged_sketches(sketches))
    held = phi.select("class_id", "feature", "phi").join(F.broadcast(summary.drop("importance", "direction")), ["class_id", "feature"])
    ranks = [F.struct(F.avg((F.col("phi") < F.col(f"p{q}")).cast("int")).alias("below"), F.avg((F.col("phi") <= F.col(f"p{q}")).cast("int")).alias("upto")).alias(f"r{q}")
             for q in explain.SPREAD]
    near = F.lit(True)
    for q in explain.SPREAD:
        near = near & (F.col(f"r{q}.below") - explain.RANK_ERROR <= q / 100) & (F.col(f"r{q}.upto") + explain.RANK_ERROR >= q / 100)
    return held.groupBy("class_id", "feature").agg(F.count("*").alias("n"), *ranks).select("class_id", "feature", "n", near.alias("within"))


@query("report_consistency", f"""
WITH {CODES_SQL}, {split_sql('events', 'event_id', 'event_type')},
held AS (SELECT class_id::VARCHAR AS class, count(*) AS support FROM parts JOIN codes USING (event_type) WHERE split = 'test' GROUP BY 1)
SELECT class, support, true AS consistent FROM held
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), sum(support)::BIGINT, true FROM held""")
def report_consistency(spark, folder):
    """Support of every report line; averages follow from the class lines."""
    train, test = parts(materialise(sample.stratified_split(events(spark, folder), ["row_id"], "label_id"), "events"))
    model = models.train("forest", SHORT_PARAMS["forest"], train, "label_id", EVENT_FEATURES)
    scored = models.score(model, test, "row_id", "label_id", EVENT_FEATURES)
    rows = {r["class"]: r for r in evaluate.report(evaluate.confusion_counts(scored, "label_id", "prediction")).collect()}
    lines_ = {c: r for c, r in rows.items() if c not in ("accuracy", "macro avg", "weighted avg")}
    support = sum(r.support for r in lines_.values())

    def near(a, b):
        return abs(a - b) < 1e-9

    checks = {c: near(r.f1, 0 if not r.precision + r.recall else 2 * r.precision * r.recall / (r.precision + r.recall)) for c, r in lines_.items()}
    checks["accuracy"] = near(rows["accuracy"].f1, sum(r.recall * r.support for r in lines_.values()) / support)
    checks["macro avg"] = near(rows["macro avg"].f1, sum(r.f1 for r in lines_.values()) / len(lines_))
    checks["weighted avg"] = near(rows["weighted avg"].f1, sum(r.f1 * r.support for r in lines_.values()) / support)
    return spark.createDataFrame([(c, int(rows[c].support), ok) for c, ok in checks.items()], "class string, support bigint, consistent boolean")


@query("slot_supports", f"""
WITH {LINES_SQL}, {split_sql('keyed', 'row_id', 'label_id')}
SELECT model, label_id, count(*) AS n FROM parts, (SELECT unnest(['forest', 'boost_depth', 'boost_leaves', 'boost_bins']) AS model)
WHERE split = 'test' GROUP BY ALL""")
def slot_supports(spark, folder):
    """All four slots score every test row once."""
    train, test = parts(lines(spark, folder))
    scored = models.compare_slots(train, test, "row_id", "label_id", LINE_FEATURES, SHORT_PARAMS, n_classes=2)
    return scored.groupBy("model", "label_id").agg(F.count_distinct("row_id").alias("n"))


@query("ranked_known_label", "SELECT 'l_quantity' AS feature, 1 AS rank, true AS dominant")
def ranked_known_label(spark, folder):
    """Where the label follows from one feature, that feature ranks first and alone."""
    rows = all_lines(spark, folder).withColumn("label_id", (F.col("l_quantity") > 25).cast("int"))
    ranking = select.rank_features(rows, "label_id", LINE_FEATURES)
    kept = select.select_features(ranking, keep=1)
    return kept.select("feature", "rank", (F.col("importance") > 0.9).alias("dominant"))


@query("boosted_additivity", "SELECT 1 AS class_id, count(*) AS n, 0.0::DOUBLE AS largest_gap FROM lineitem")
def boosted_additivity(spark, folder):
    """Base value plus attributions of a boosted model equal its raw score on every line item."""
    rows = materialise(all_lines(spark, folder).withColumn("row_id", F.monotonically_increasing_id()), "lines")
    model = models.train("boost_depth", {"n_estimators": 5, "max_depth": 4, "learning_rate": 0.3}, rows, "label_id", LINE_FEATURES)
    phi = explain.attributions(rows, model, "row_id", LINE_FEATURES)
    sums = phi.groupBy("row_id", "class_id").agg((F.max("base_value") + F.sum("phi")).alias("total"))
    # The probability of class 1 is the logistic function of twice the margin.
    scored = models.score(model, rows, "row_id", "label_id", LINE_FEATURES).select("row_id", F.get("score", F.lit(1)).alias("p"))
    gap = F.abs(1 / (1 + F.exp(-2 * F.col("total"))) - F.col("p"))
    return sums.join(scored, "row_id").groupBy("class_id").agg(F.count("*").alias("n"), F.round(F.max(gap), 9).alias("largest_gap"))


@query("importance_from_attributions", """
SELECT (SELECT count(*) FROM events)::BIGINT AS n_rows, 3::BIGINT AS n_features, (SELECT count(DISTINCT event_type) FROM events)::BIGINT AS n_classes,
       true AS summary_agrees""")
def importance_from_attributions(spark, folder):
    """Global importance is the mean over classes of the class summaries, over every event, class and feature."""
    phi = explained_events(spark, folder)[2]
    overall = explain.global_importance(phi).select("feature", F.col("importance").alias("total"))
    by_class = explain.class_summary(phi).groupBy("feature").agg(F.avg("importance").alias("mean"))
    agree = overall.join(by_class, "feature").agg(F.count("*").alias("n_features"), F.bool_and(F.abs(F.col("total") - F.col("mean")) < 1e-9).alias("summary_agrees"))
    sizes = phi.agg(F.count_distinct("row_id").alias("n_rows"), F.count_distinct("class_id").alias("n_classes"))
    return agree.crossJoin(sizes).select("n_rows", "n_features", "n_classes", "summary_agrees")


@query("breakdown_ends", f"""
WITH {CODES_SQL} SELECT 3::BIGINT AS n_steps, count(*)::BIGINT AS n_rows, true AS ends_at_output FROM codes""")
def breakdown_ends(spark, folder):
    """A breakdown has a step per feature, falls in size and ends at the model's output."""
    rows, model = event_forest(spark, folder)
    typical = explain.representatives(rows, "row_id", "label_id", EVENT_FEATURES)
    picked = materialise(rows.join(typical.select("row_id"), "row_id", "left_semi"), "typical")
    phi = explain.attributions(picked, model, "row_id", EVENT_FEATURES)
    scored = models.score(model, picked, "row_id", "label_id", EVENT_FEATURES)
    steps = explain.local_breakdown(phi, scored.select("row_id", F.col("prediction").alias("class_id")), "row_id")
    own = scored.select("row_id", F.get("score", F.col("prediction")).alias("own"))
    ends = steps.groupBy("row_id").agg(F.count("*").alias("n_steps"), F.max_by("stop", "place").alias("stop")).join(own, "row_id")
    return ends.groupBy("n_steps").agg(F.count("*").alias("n_rows"), F.bool_and(F.abs(F.col("stop") - F.col("own")) < 1e-9).alias("ends_at_output"))


@query("trial_chunks", """
SELECT t::INT AS trial, (t % ceil(n / 4000.0))::INT AS chunk, true AS in_space FROM (SELECT count(*)::BIGINT AS n FROM events), range(3) r(t)""")
def trial_chunks(spark, folder):
    """Trials rotate through the chunks, with points inside the space."""
    space = {**search.SPACES["forest"], "n_estimators": ("quniform", 5, 10, 1), "max_depth": ("quniform", 3, 6, 1)}
    trials = search.search(events(spark, folder), "row_id", "label_id", EVENT_FEATURES, "forest", work_path(spark, "trials"),
                           trials=3, chunk_rows=4000, space=space)
    inside = F.lit(True)
    for name, (kind, *limits) in space.items():
        value = F.col("params")[name]
        low, high = (0, limits[0] - 1) if kind == "choice" else limits[:2]
        inside = inside & (value >= low) & (value <= high)
    return trials.select("trial", "chunk", (inside & (F.col("loss") <= 0) & (F.col("loss") >= -1)).alias("in_space"))


@query("prepared_set_sizes", """
WITH n AS (SELECT count(*) FILTER (event_type = 'error') AS rare, round_even(0.5 * (count(*) FILTER (event_type <> 'error'))::DOUBLE, 0)::BIGINT AS common FROM events),
s AS (SELECT rare, common, ceil(0.2 * (rare + common)::DOUBLE)::BIGINT AS test FROM n)
SELECT 'train' AS split, rare + common - test AS n, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM s
UNION ALL SELECT 'test', test, NULL, NULL FROM s""")
def prepared_set_sizes(spark, folder):
    """Stage 0 from one CSV file to a stored set: exact sizes, train features scaled to [0, 1]."""
    path = work_path(spark, "flows-csv")
    (table(spark, folder, "events").select(F.col("value").cast("string").alias(" Flow Bytes/s"), F.col("user_id").alias("Dst Port "),
                                           F.col("event_type").alias("Label"))
     .repartition(1).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    data = stages.prepare_folder(spark, path, work_path(spark, "features"), presets.Preset(True, 0.5, ("error",), 15, 0.05, False, None))
    both = F.least("`Flow Bytes/s`", "`Dst Port`"), F.greatest("`Flow Bytes/s`", "`Dst Port`")
    train = F.col("split") == "train"
    return data.rows.groupBy("split").agg(F.count("*").alias("n"), F.round(F.min(F.when(train, both[0])), 6).cast("double").alias("lo"),
                                          F.round(F.max(F.when(train, both[1])), 6).cast("double").alias("hi"))
