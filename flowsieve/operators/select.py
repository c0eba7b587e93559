"""Feature ranking and selection."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsieve.functions.bounded import spread
from flowsieve.functions.scalar import named

# Features kept, and trees, depth and row share of the ranking forest.
KEPT_FEATURES = 20
RANK_TREES = 30
RANK_DEPTH = 10
RANK_ROWS = 0.1

# Split statistics a task may hold; more means fewer passes per tree level.
STATISTICS_MB = 512


def assemble(df: DataFrame, features: list[str], column: str = "features") -> DataFrame:
    """Feature columns as one vector, under plain names Spark ML accepts."""
    plain = [f"_f{i}" for i in range(len(features))]
    aliased = df.withColumns({p: named(f).cast("double") for p, f in zip(plain, features)})
    return VectorAssembler(inputCols=plain, outputCol=column).transform(aliased).drop(*plain)


def rank_features(df: DataFrame, label_id: str, features: list[str], trees: int = RANK_TREES, depth: int = RANK_DEPTH,
                  row_share: float = RANK_ROWS, seed: int = 42) -> DataFrame:
    """(rank, feature, importance) from a regression forest on the label code, of many rows on their cells."""
    forest = RandomForestRegressor(featuresCol="features", labelCol="_y", numTrees=trees, maxDepth=depth, maxBins=32,
                                   subsamplingRate=row_share, featureSubsetStrategy="all",
                                   maxMemoryInMB=STATISTICS_MB, seed=seed)
    from flowsieve.operators import cells  # which assembles rows as well

    plain = df.select(named(label_id).cast("double").alias("_y"), *[named(f) for f in features])
    held = cells.fold(assemble(plain, features).select("features", F.col("_y").alias("label_id")), len(features), forest.getMaxBins())
    weights = None if held is None else cells.ranking_shares(forest, held)
    if weights is None:
        rows = assemble(spread(plain), features).select("features", "_y").persist()
        try:
            weights = forest.fit(rows).featureImportances.toArray()
        finally:
            rows.unpersist()
    scored = df.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, weights)],
                                             "feature string, importance double")
    # One row per feature.
    order = W.orderBy(F.col("importance").desc(), "feature")
    return scored.select(F.row_number().over(order).alias("rank"), "feature", "importance")


def nth_largest(df: DataFrame, value: str, n: int) -> DataFrame:
    """One row: the n-th largest value, or the smallest if there are fewer."""
    top = df.select(named(value).alias("threshold")).orderBy(F.col("threshold").desc()).limit(n)
    return top.agg(F.min("threshold").alias("threshold"))


def select_features(finder: DataFrame, picker: DataFrame | None = None, keep: int = KEPT_FEATURES) -> DataFrame:
    """Features whose importance reaches the ``keep``-th largest of ``finder``.

    With a separate ``picker`` ranking, its importances are held against the
    threshold of ``finder``, so more or fewer than ``keep`` may remain.
    """
    threshold = nth_largest(finder, "importance", keep).first()["threshold"]
    return (finder if picker is None else picker).filter(F.col("importance") >= F.lit(threshold))
