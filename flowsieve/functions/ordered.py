"""Running totals and neighbours over long ordered tables.

A window over one group runs in one task.  Here each group is cut into value
ranges of bounded size; windows run inside a range, and a small table of range
totals carries sums from one range to the next.  Results are exact: the ranges
come from approximate quantiles, which only affects how even they are.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsieve.functions.bounded import join_on, small_table

RANGE = "_range"
RANGE_ROWS = 1_000_000


def with_ranges(df: DataFrame, order: str, rows: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``_range``: ascending value ranges of ``order`` with bounded row counts.

    ``df`` should be stored, as it is read again for the quantiles when large.
    Equal values share a range, so ``order`` must not repeat without bound.  A
    table that fits one range comes back without the column.
    """
    rows = df.count() if rows is None else rows
    parts = -(-rows // range_rows)
    if parts <= 1:
        return df
    steps = [i / parts for i in range(1, parts)]
    inner = sorted(set(df.approxQuantile(order, steps, 1.0 / (4 * parts))))
    splits = [float("-inf"), *[s for s in inner if abs(s) != float("inf")], float("inf")]
    return Bucketizer(splits=splits, inputCol=order, outputCol=RANGE, handleInvalid="keep").transform(df)


def running_before(df: DataFrame, groups: list[str], order: str, sums: list[str],
                   descending: bool = False) -> DataFrame:
    """Add ``<c>_before`` for each column in ``sums``: its total over earlier rows.

    ``df`` comes from ``with_ranges``; ``order`` is unique inside a group.
    """
    def direction(name):
        return F.col(name).desc() if descending else F.col(name)

    if RANGE not in df.columns:
        whole = W.partitionBy(*groups).orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({f"{c}_before": F.sum(c).over(whole) - F.col(c) for c in sums})
    inside = W.partitionBy(*groups, RANGE).orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*groups).orderBy(direction(RANGE)).rowsBetween(W.unboundedPreceding, 0)
    totals = df.groupBy(*groups, RANGE).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = small_table(totals.select(
        *groups, RANGE, *[(F.sum(f"_t_{c}").over(across) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in sums]))
    joined = join_on(df, offsets, [*groups, RANGE])
    return (joined.withColumns({f"{c}_before": F.sum(c).over(inside) - F.col(c) + F.col(f"_o_{c}") for c in sums})
            .drop(*[f"_o_{c}" for c in sums]))


def with_next(df: DataFrame, groups: list[str], order: str, columns: list[str],
              descending: bool = False) -> DataFrame:
    """Add ``next_<c>`` for each column: its value in the following row, or null."""
    def direction(name):
        return F.col(name).desc() if descending else F.col(name)

    if RANGE not in df.columns:
        whole = W.partitionBy(*groups).orderBy(direction(order))
        return df.withColumns({f"next_{c}": F.lead(c).over(whole) for c in columns})
    inside = W.partitionBy(*groups, RANGE).orderBy(direction(order))
    across = W.partitionBy(*groups).orderBy(direction(RANGE))
    pick = F.max_by if descending else F.min_by
    firsts = df.groupBy(*groups, RANGE).agg(pick(F.struct(*columns), order).alias("_head"))
    heads = small_table(firsts.select(*groups, RANGE, F.lead("_head").over(across).alias("_head")))
    joined = join_on(df, heads, [*groups, RANGE]).withColumn("_next", F.lead(F.struct(*columns)).over(inside))
    following = F.coalesce("_next", "_head")
    return (joined.withColumn("_next", following)
            .select(*df.columns, *[F.col("_next")[c].alias(f"next_{c}") for c in columns]))
