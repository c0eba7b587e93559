"""Confusion counts, reports, ROC curves and class centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.scalar import hash_key
from flowsieve.operators import evaluate
from flowsieve.queries import query
from flowsieve.tables import table

PRED_SQL = """p AS (SELECT event_id, event_type AS y,
  CASE WHEN value < 20 THEN 'click' WHEN value < 40 THEN 'error' ELSE event_type END AS pred FROM events)"""

MODELS_SQL = """p AS (
  SELECT 'low' AS model, event_type AS y, CASE WHEN value < 20 THEN 'click' ELSE event_type END AS pred FROM events
  UNION ALL SELECT 'mid', event_type, CASE WHEN value < 40 THEN 'error' ELSE event_type END FROM events
  UNION ALL SELECT 'high', event_type, CASE WHEN value < 80 THEN 'view' ELSE event_type END FROM events)"""

CLASS_SQL = """c AS (SELECT model, k AS class, sum((y = pred AND y = k)::INT)::DOUBLE AS tp,
        sum((pred = k)::INT)::DOUBLE AS pr, sum((y = k)::INT) AS su
      FROM p, (SELECT DISTINCT event_type AS k FROM events) GROUP BY 1, 2),
m AS (SELECT model, class, CASE WHEN pr = 0 THEN 0 ELSE tp / pr END AS pc,
             CASE WHEN su = 0 THEN 0 ELSE tp / su END AS rc,
             CASE WHEN pr + su = 0 THEN 0 ELSE 2 * tp / (pr + su) END AS f1, su, tp FROM c)"""


def predicted_events(spark, folder):
    """A deterministic prediction for every event."""
    value, kind = F.col("value"), F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id", kind.alias("y"),
        F.when(value < 20, "click").when(value < 40, "error").otherwise(kind).alias("pred"))


def three_predictors(spark, folder):
    """Three deterministic predictors in long form: (model, y, pred)."""
    value, kind = F.col("value"), F.col("event_type")
    guesses = F.array(*[F.struct(F.lit(m).alias("model"), F.when(value < cut, to).otherwise(kind).alias("pred"))
                        for m, cut, to in (("low", 20, "click"), ("mid", 40, "error"), ("high", 80, "view"))])
    return table(spark, folder, "events").select(kind.alias("y"), F.inline(guesses))


@query("confusion_counts", f"WITH {PRED_SQL} SELECT y, pred, count(*) AS n FROM p GROUP BY 1, 2")
def confusion_counts(spark, folder):
    return evaluate.confusion_counts(predicted_events(spark, folder), "y", "pred")


@query("confusion_matrix", f"""
WITH {PRED_SQL}, k AS (SELECT DISTINCT event_type AS c FROM events)
SELECT a.c AS y, b.c AS pred, count(p.y) AS n
FROM k a CROSS JOIN k b LEFT JOIN p ON p.y = a.c AND p.pred = b.c GROUP BY 1, 2""")
def confusion_matrix(spark, folder):
    """All class pairs with zeros."""
    return evaluate.confusion_matrix(evaluate.confusion_counts(predicted_events(spark, folder), "y", "pred"))


@query("overall_metrics", f"""
WITH {MODELS_SQL}, {CLASS_SQL}
SELECT model, round(sum(tp) / sum(su), 6) AS accuracy, round(sum(pc * su) / sum(su), 6) AS "precision",
       round(sum(rc * su) / sum(su), 6) AS recall, round(sum(f1 * su) / sum(su), 6) AS f1_score
FROM m GROUP BY 1""")
def overall_metrics(spark, folder):
    counts = evaluate.confusion_counts(three_predictors(spark, folder), "y", "pred", ["model"])
    table_ = evaluate.overall_metrics(counts, ["model"])
    return table_.select("model", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@query("class_report", f"""
WITH {MODELS_SQL}, {CLASS_SQL},
s AS (SELECT model, avg(pc) AS mp, avg(rc) AS mr, avg(f1) AS mf, sum(pc * su) / sum(su) AS wp,
             sum(rc * su) / sum(su) AS wr, sum(f1 * su) / sum(su) AS wf, sum(tp) / sum(su) AS acc, sum(su) AS su
      FROM m GROUP BY 1)
SELECT model, class, round(pc, 4) AS "precision", round(rc, 4) AS recall, round(f1, 4) AS f1, su::BIGINT AS support FROM m
UNION ALL SELECT model, 'accuracy', round(acc, 4), round(acc, 4), round(acc, 4), su::BIGINT FROM s
UNION ALL SELECT model, 'macro avg', round(mp, 4), round(mr, 4), round(mf, 4), su::BIGINT FROM s
UNION ALL SELECT model, 'weighted avg', round(wp, 4), round(wr, 4), round(wf, 4), su::BIGINT FROM s""")
def class_report(spark, folder):
    counts = evaluate.confusion_counts(three_predictors(spark, folder), "y", "pred", ["model"])
    return evaluate.report(counts, ["model"], digits=4)


@query("imbalanced_report", """
WITH p AS (SELECT l.toxic AS y, (d.n_chars > 2000)::INT AS pred FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT k AS class, sum((y = pred AND y = k)::INT)::DOUBLE AS tp, sum((pred = k)::INT) AS pr, sum((y = k)::INT) AS su
      FROM p, (VALUES (0), (1)) v(k) GROUP BY 1)
SELECT class::VARCHAR AS class, round(CASE WHEN pr = 0 THEN 0 ELSE tp / pr END, 6) AS "precision",
       round(CASE WHEN su = 0 THEN 0 ELSE tp / su END, 6) AS recall, su::BIGINT AS support FROM c""")
def imbalanced_report(spark, folder):
    """Per-class lines for a rare binary class."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("y"))
    docs = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("pred"))
    counts = evaluate.confusion_counts(labels.join(docs, "doc_id"), "y", "pred")
    return evaluate.class_metrics(counts).select(
        F.col("class").cast("string").alias("class"), F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"), "support")


@query("macro_f1", f"WITH {MODELS_SQL}, {CLASS_SQL} SELECT model, round(avg(f1), 6) AS f1_macro FROM m GROUP BY 1")
def macro_f1(spark, folder):
    counts = evaluate.confusion_counts(three_predictors(spark, folder), "y", "pred", ["model"])
    return evaluate.macro_f1(counts, ["model"]).withColumn("f1_macro", F.round("f1_macro", 6))


@query("model_comparison", f"""
WITH {MODELS_SQL}, {CLASS_SQL}
SELECT model, round(sum(pc * su) / sum(su), 6) AS "precision", round(sum(rc * su) / sum(su), 6) AS recall,
       round(sum(f1 * su) / sum(su), 6) AS f1, round(sum(tp) / sum(su), 6) AS accuracy,
       row_number() OVER (ORDER BY sum(f1 * su) / sum(su) DESC, model)::INT AS place
FROM m GROUP BY 1""")
def model_comparison(spark, folder):
    counts = evaluate.confusion_counts(three_predictors(spark, folder), "y", "pred", ["model"])
    compared = evaluate.compare_models(counts, ["model"])
    return compared.select("model", "place", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


# A reproducible score per event and class, raised for the true class.
SCORES_SQL = """s AS (
  SELECT event_id, c.class, (event_type = c.class)::INT AS positive,
         ('0x' || substr(md5('score:' || c.class || ':' || event_id::VARCHAR), 1, 3))::BIGINT / 4096.0::DOUBLE
           + CASE WHEN event_type = c.class THEN 0.25::DOUBLE ELSE 0 END AS score
  FROM events, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) c(class)),
d AS (SELECT class, score, sum(positive)::BIGINT AS p, sum(1 - positive)::BIGINT AS n FROM s GROUP BY 1, 2),
r AS (SELECT class, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp,
             sum(p) OVER (PARTITION BY class) AS pa, sum(n) OVER (PARTITION BY class) AS na,
             lead(p) OVER v AS np, lead(n) OVER v AS nn, row_number() OVER v AS i
      FROM d WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING),
                    v AS (PARTITION BY class ORDER BY score DESC)),
pts AS (SELECT class, score AS threshold, fp / na::DOUBLE AS fpr, tp / pa::DOUBLE AS tpr FROM r
        WHERE i = 1 OR np IS NULL OR np <> p OR nn <> n
        UNION ALL SELECT DISTINCT class, 'Infinity'::DOUBLE, 0.0, 0.0 FROM r)"""

CLASSES = ["click", "error", "purchase", "signup", "view"]


def class_scores(spark, folder):
    """(class, score, positive) for every event and class."""
    events = table(spark, folder, "events").select("event_id", "event_type")
    rows = evaluate.binarise(events, "event_type", CLASSES)
    draw = F.conv(F.substring(hash_key("score", "class", "event_id"), 1, 3), 16, 10).cast("double") / 4096.0
    return rows.select("class", "positive", (draw + F.when(F.col("positive") == 1, 0.25).otherwise(0.0)).alias("score"))


@query("roc_points", f"""
WITH {SCORES_SQL}
SELECT class, CASE WHEN isinf(threshold) THEN NULL ELSE round(threshold, 6) END AS threshold,
       round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts""")
def roc_points(spark, folder):
    """Curve points per class, straight pieces thinned."""
    counts = evaluate.score_counts(class_scores(spark, folder), ["class"])
    points = evaluate.roc_points(counts, ["class"])
    return points.select("class", F.when(F.col("threshold") < 1e300, F.round("threshold", 6)).alias("threshold"),
                         F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("area_under_roc", f"""
WITH {SCORES_SQL}, o AS (SELECT class, fpr, tpr, lag(fpr) OVER w AS f0, lag(tpr) OVER w AS t0 FROM pts
                         WINDOW w AS (PARTITION BY class ORDER BY fpr, tpr))
SELECT class, round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM o GROUP BY 1""")
def area_under_roc(spark, folder):
    counts = evaluate.score_counts(class_scores(spark, folder), ["class"])
    return evaluate.area_under_roc(counts, ["class"]).withColumn("auc", F.round("auc", 6))


@query("binary_auc", """
WITH r AS (SELECT (event_type = 'error')::INT AS y,
                  (rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0)::DOUBLE AS mid FROM events)
SELECT round((sum(mid) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0)::DOUBLE / (sum(y) * sum(1 - y))::DOUBLE, 6) AS auc FROM r""")
def binary_auc(spark, folder):
    """Event value as a score for one class, without grouping."""
    scored = table(spark, folder, "events").select(
        F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("positive"))
    return evaluate.area_under_roc(evaluate.score_counts(scored, []), []).select(F.round("auc", 6).alias("auc"))


MACRO_SQL = f"""{SCORES_SQL},
grid AS (SELECT DISTINCT fpr AS x FROM pts),
seg AS (SELECT class, fpr, max(tpr) AS hi, min(tpr) AS lo FROM pts GROUP BY 1, 2),
nxt AS (SELECT class, fpr, hi, lead(fpr) OVER w AS f1, lead(lo) OVER w AS t1 FROM seg
        WINDOW w AS (PARTITION BY class ORDER BY fpr)),
mean AS (SELECT x, avg(CASE WHEN f1 IS NULL THEN hi ELSE hi + (t1 - hi) * (x - fpr) / (f1 - fpr) END) AS tpr
         FROM grid JOIN nxt ON x >= fpr AND (f1 IS NULL OR x < f1) GROUP BY 1)"""


@query("macro_roc_curve", f"WITH {MACRO_SQL} SELECT round(x, 6) AS fpr, round(tpr, 6) AS tpr FROM mean")
def macro_roc_curve(spark, folder):
    """Mean of the class curves over the union of their false-positive rates."""
    points = evaluate.roc_points(evaluate.score_counts(class_scores(spark, folder), ["class"]), ["class"])
    return evaluate.macro_roc(points, []).select(F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("macro_roc_area", f"""
WITH {MACRO_SQL}, o AS (SELECT x, tpr, lag(x) OVER (ORDER BY x) AS x0, lag(tpr) OVER (ORDER BY x) AS t0 FROM mean)
SELECT round(sum((x - x0) * (tpr + t0) / 2), 6) AS auc FROM o""")
def macro_roc_area(spark, folder):
    points = evaluate.roc_points(evaluate.score_counts(class_scores(spark, folder), ["class"]), ["class"])
    return evaluate.curve_area(evaluate.macro_roc(points, []), []).select(F.round("auc", 6).alias("auc"))
