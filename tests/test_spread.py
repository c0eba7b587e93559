import pytest
from pyspark.sql import functions as F

from flowsieve.functions import bounded
from flowsieve.operators import models, search


def loads(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("order", [None, "row.id"])
def test_partitions_grow_in_number_with_the_rows(spark, monkeypatch, order):
    """Even partitions stay as they are up to a number of rows, and are cut beyond it."""
    monkeypatch.setattr(bounded, "PART_ROWS", 100)
    few, many = (spark.range(0, n, 1, 8).withColumnRenamed("id", "row.id") for n in (800, 8000))
    assert bounded.spread(few, order) is few
    cut = bounded.spread(many, order)
    assert cut.rdd.getNumPartitions() == 80 and max(loads(cut)) < 200 and cut.distinct().count() == 8000


def test_slots_and_trials_train_on_partitions_of_bounded_size(spark, monkeypatch):
    rows = spark.range(0, 1200, 1, 2).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label_id"),
                                             (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    monkeypatch.setattr(bounded, "PART_ROWS", 50)
    seen, fit = [], models.fit

    def watched(slot, params, ready, *more):
        seen.append(max(loads(ready)))
        return fit(slot, params, ready, *more)

    monkeypatch.setattr(models, "fit", watched)
    small = {"forest": {"n_estimators": 2, "max_depth": 2}}
    models.compare_slots(rows, rows, "row_id", "label_id", ["a", "b"], small, 2).count()
    ready = models.ready_rows(rows.withColumn("fold", (F.col("row_id") % 3).cast("int")), "label_id", ["a", "b"], ("row_id", "fold"))
    search._fold_scores(bounded.materialise(ready, "folds"), "row_id", 2, "forest", small["forest"], 3, 2).count()
    assert len(seen) == 4 and max(seen) < 110
