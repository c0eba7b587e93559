"""Reading tables, size-checked broadcasts and written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsieve.functions.bounded import join_on, materialise

# A table is copied to every executor only if its measured size is below this.
BROADCAST_BYTES = 16 << 20


@contextmanager
def tidy() -> Iterator[None]:
    """Give what a task has freed back to the system when it ends.

    Python workers outlive tasks and stages; what they keep for later, the next stage's workers and the engine lack.
    """
    thresholds = gc.get_threshold()
    try:
        yield
    finally:
        gc.set_threshold(*thresholds)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not on every platform
            pass


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and the bytes they take at least: 8 a value, and what strings and arrays hold."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        column = F.col(quoted(name))
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith("array"):
            size = size + 8 * F.greatest(F.size(column), F.lit(0))
        size = size + 8
    row = df.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return row["n"], row["b"] or 0


def small_or_shuffled(df: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once, and marked for broadcast only if its measured bytes are below ``limit``.

    Above the limit the same join is shuffled, where adaptive execution splits hot keys.
    """
    stored = materialise(df, name)
    return F.broadcast(stored) if measured(stored)[1] <= limit else stored


def ranked(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank`` (from 0) and ``n`` inside its group; stored.

    Rows are dealt to sorted ranges.  Only a range's totals per group meet in a window: as many rows as there
    are ranges that a group reaches into.  Equal rows may take each other's rank.
    """
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*groups, *order, "_tie").sortWithinPartitions(*groups, *order, "_tie").drop("_tie")
    # The position of a row in its sorted range is the lower part of the increasing id.
    placed = materialise(dealt.withColumn("_range", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    totals = placed.groupBy(*groups, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    across = W.partitionBy(*groups)
    before = F.sum("_n").over(across.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    offsets = materialise(totals.select(*groups, "_range", (before - F.col("_first")).alias("_offset"),
                                        F.sum("_n").over(across).alias("n")), "offsets")
    if measured(offsets)[1] <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    joined = join_on(placed, offsets, [*groups, "_range"])
    return joined.withColumn("rank", F.col("_at") + F.col("_offset")).drop("_at", "_offset", "_range")
