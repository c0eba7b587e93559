"""Confusion counts, reports and ROC curves.

Everything but the ROC curve is arithmetic on the confusion counts, a table of
at most classes x classes rows that one map-side combined aggregate produces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.bounded import join_on, materialise, small_table
from flowsieve.functions.ordered import running_before, with_next, with_ranges
from flowsieve.functions.scalar import named


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double, 0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def confusion_counts(df: DataFrame, truth: str, predicted: str, groups: list[str] = ()) -> DataFrame:
    """(groups, y, pred, n) of the pairs that occur.

    Counted once: the small result feeds every metric without another scan.
    """
    return small_table(df.groupBy(*groups, named(truth).alias("y"), named(predicted).alias("pred"))
                       .agg(F.count("*").alias("n")))


def confusion_matrix(counts: DataFrame, groups: list[str] = ()) -> DataFrame:
    """All class pairs, zeros included; classes are those seen on either side."""
    seen = counts.select(*groups, F.explode(F.array("y", "pred")).alias("y"))
    classes = seen.groupBy(*groups).agg(F.sort_array(F.collect_set("y")).alias("_classes"))
    cells = (classes.withColumn("y", F.explode("_classes")).withColumn("pred", F.explode("_classes"))
             .drop("_classes"))
    return join_on(cells, counts, [*groups, "y", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_counts(counts: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, class, tp, predicted, support) from one aggregate over the counts."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(F.struct(F.col("y").alias("class"), hit.cast("bigint").alias("tp"), zero.alias("predicted"),
                             F.col("n").alias("support")),
                    F.struct(F.col("pred").alias("class"), zero.alias("tp"), F.col("n").alias("predicted"),
                             zero.alias("support")))
    return (counts.select(*groups, F.inline(sides)).groupBy(*groups, "class")
            .agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support")))


def class_metrics(counts: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, class, precision, recall, f1, support); undefined ratios are 0."""
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return class_counts(counts, groups).select(
        *groups, "class", _ratio(tp, predicted).alias("precision"), _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, predicted + support).alias("f1"), "support", "tp")


def averages(per_class: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted averages as (groups, class, precision, recall, f1, support).

    Accuracy is the support-weighted recall, so published per-class rows are
    enough to recompute all three lines.
    """
    support = F.sum("support")
    stats = per_class.groupBy(*groups).agg(
        *[F.avg(m).alias(f"m_{m}") for m in ("precision", "recall", "f1")],
        *[_ratio(F.sum(F.col(m) * F.col("support")), support).alias(f"w_{m}") for m in ("precision", "recall", "f1")],
        support.alias("support"))
    acc = F.col("w_recall")
    lines = F.array(
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), F.col("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("m_precision").alias("precision"),
                 F.col("m_recall").alias("recall"), F.col("m_f1").alias("f1"), F.col("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("w_precision").alias("precision"),
                 F.col("w_recall").alias("recall"), F.col("w_f1").alias("f1"), F.col("support")))
    return stats.select(*groups, F.inline(lines))


def report(counts: DataFrame, groups: list[str] = (), digits: int | None = None) -> DataFrame:
    """Per-class lines followed by accuracy, macro and weighted averages."""
    per_class = class_metrics(counts, groups).drop("tp")
    lines = per_class.withColumn("class", F.col("class").cast("string")).unionByName(averages(per_class, groups))
    if digits is None:
        return lines
    return lines.withColumns({m: F.round(m, digits) for m in ("precision", "recall", "f1")})


def overall_metrics(counts: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, accuracy, precision, recall, f1_score): weighted averages."""
    per_class = class_metrics(counts, groups)
    support = F.sum("support")
    weighted = {m: _ratio(F.sum(F.col(m) * F.col("support")), support) for m in ("precision", "recall", "f1")}
    return per_class.groupBy(*groups).agg(
        _ratio(F.sum("tp"), support).alias("accuracy"), weighted["precision"].alias("precision"),
        weighted["recall"].alias("recall"), weighted["f1"].alias("f1_score"))


def macro_f1(counts: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, f1_macro): unweighted mean over classes, the search objective."""
    return class_metrics(counts, groups).groupBy(*groups).agg(F.avg("f1").alias("f1_macro"))


def binarise(df: DataFrame, truth: str, classes: list) -> DataFrame:
    """One row per row and class: (…, class, positive)."""
    listed = F.array(*[F.lit(c) for c in classes])
    return df.withColumn("class", F.explode(listed)).withColumn("positive", (named(truth) == F.col("class")).cast("int"))


def long_scores(df: DataFrame, truth: str, scores: str, keep: list[str] = ()) -> DataFrame:
    """Score array to (keep, class, score, positive), the class being the array position."""
    exploded = df.select(*keep, named(truth).alias("_y"), F.posexplode(named(scores)).alias("class", "score"))
    return exploded.withColumn("positive", (F.col("_y") == F.col("class")).cast("int")).drop("_y")


def score_counts(df: DataFrame, groups: list[str], score: str = "score", positive: str = "positive",
                 bins: int | None = None) -> DataFrame:
    """(groups, score, p, n): positives and negatives at every distinct score, stored.

    ``bins`` rounds scores in [0, 1] down to that many steps, for tables whose
    scores hardly repeat; the default is exact.
    """
    value = named(score).cast("double")
    if bins:
        value = F.floor(value * bins) / F.lit(float(bins))
    counts = df.groupBy(*groups, value.alias("score")).agg(
        F.sum(named(positive).cast("bigint")).alias("p"), F.sum((1 - named(positive)).cast("bigint")).alias("n"))
    return materialise(counts, "scores")


def _cumulative(counts: DataFrame, groups: list[str]) -> DataFrame:
    totals = small_table(counts.groupBy(*groups).agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all")))
    ranged = with_ranges(counts, "score")
    return join_on(running_before(ranged, groups, "score", ["p", "n"], descending=True), totals, groups)


def roc_points(counts: DataFrame, groups: list[str], drop_intermediate: bool = True) -> DataFrame:
    """(groups, threshold, fpr, tpr) from stored score counts.

    The curve starts at (0, 0) with an infinite threshold.  Points inside a
    straight piece are dropped: those whose following score has as many
    positives and negatives.  Rates without any positive (negative) are null.
    """
    cumulative = _cumulative(counts, groups)
    if drop_intermediate:
        after = with_next(cumulative, groups, "score", ["p", "n"], descending=True)
        first = (F.col("p_before") + F.col("n_before")) == 0
        bend = F.col("next_p").isNull() | (F.col("next_p") != F.col("p")) | (F.col("next_n") != F.col("n"))
        cumulative = after.filter(first | bend)
    fp, tp = F.col("n_before") + F.col("n"), F.col("p_before") + F.col("p")
    point = F.struct(F.col("score").alias("threshold"), F.try_divide(fp.cast("double"), F.col("n_all")).alias("fpr"),
                     F.try_divide(tp.cast("double"), F.col("p_all")).alias("tpr"))
    origin = F.struct(F.lit(float("inf")).alias("threshold"),
                      F.when(F.col("n_all") > 0, F.lit(0.0)).alias("fpr"),
                      F.when(F.col("p_all") > 0, F.lit(0.0)).alias("tpr"))
    first = (F.col("p_before") + F.col("n_before")) == 0
    points = F.when(first, F.array(origin, point)).otherwise(F.array(point))
    return cumulative.select(*groups, F.inline(points))


def area_under_roc(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, auc): each negative scores the positives above it, ties half."""
    cumulative = _cumulative(counts, groups)
    below = F.sum(F.col("n").cast("double") * (F.col("p_before") + F.col("p") / 2.0))
    pairs = F.max(F.col("p_all").cast("double") * F.col("n_all"))
    return cumulative.groupBy(*groups).agg(F.try_divide(below, pairs).alias("auc"))


def macro_roc(points: DataFrame, groups: list[str], cls: str = "class") -> DataFrame:
    """(groups, fpr, tpr): mean of the class curves over the union of their fpr values.

    Each class curve is a chain of straight pieces.  A piece enters the sum at
    its left end and leaves at its right end, so one running total over all ends
    gives slope and intercept of the summed curve everywhere; rows never
    multiply by the number of classes.
    """
    groups = list(groups)
    keys = [*groups, cls]
    ends = materialise(points.filter(F.col("fpr").isNotNull() & F.col("tpr").isNotNull())
                       .groupBy(*keys, "fpr").agg(F.min("tpr").alias("enter"), F.max("tpr").alias("leave")), "curve")
    classes = ends.groupBy(*groups).agg(F.count_distinct(named(cls)).alias("_classes"))
    pieces = with_next(with_ranges(ends, "fpr"), keys, "fpr", ["fpr", "enter"])
    slope = F.when(F.col("next_fpr").isNull(), 0.0).otherwise(
        (F.col("next_enter") - F.col("leave")) / (F.col("next_fpr") - F.col("fpr")))
    pieces = pieces.withColumn("_slope", slope).withColumn("_level", F.col("leave") - F.col("_slope") * F.col("fpr"))
    start = F.struct(F.col("fpr").alias("x"), F.col("_slope").alias("slope"), F.col("_level").alias("level"))
    stop = F.struct(F.col("next_fpr").alias("x"), (-F.col("_slope")).alias("slope"), (-F.col("_level")).alias("level"))
    changes = F.when(F.col("next_fpr").isNull(), F.array(start)).otherwise(F.array(start, stop))
    grid = materialise(pieces.select(*groups, F.inline(changes)).groupBy(*groups, "x")
                       .agg(F.sum("slope").alias("slope"), F.sum("level").alias("level")), "grid")
    summed = running_before(with_ranges(grid, "x"), groups, "x", ["slope", "level"])
    height = ((F.col("slope_before") + F.col("slope")) * F.col("x") + F.col("level_before") + F.col("level"))
    if groups:
        joined = join_on(summed, small_table(classes), groups)
    else:
        joined = summed.withColumn("_classes", F.lit(classes.first()["_classes"]))
    return joined.select(*groups, F.col("x").alias("fpr"), (height / F.col("_classes")).alias("tpr"))


def curve_area(curve: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, auc) of a curve with unique fpr values, by trapezoids."""
    stored = materialise(curve.select(*groups, "fpr", "tpr"), "curve")
    steps = with_next(with_ranges(stored, "fpr"), list(groups), "fpr", ["fpr", "tpr"])
    piece = (F.col("next_fpr") - F.col("fpr")) * (F.col("next_tpr") + F.col("tpr")) / 2.0
    return steps.groupBy(*groups).agg(F.sum(piece).alias("auc"))


def compare_models(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Model x metric table: (groups, precision, recall, f1, accuracy), best F1 first in ``place``."""
    from pyspark.sql import Window as W
    table = overall_metrics(counts, groups)
    stage = [g for g in groups if g != "model"]
    place = F.row_number().over(W.partitionBy(*stage).orderBy(F.col("f1_score").desc(), "model"))
    return table.select(*groups, "precision", "recall", F.col("f1_score").alias("f1"), "accuracy", place.alias("place"))
