"""Label codes, min-max scaling and the joins that apply them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsieve.functions.bounded import join_on, small_table
from flowsieve.functions.scalar import named

# A column whose range is below this counts as constant (ten times double epsilon).
CONSTANT_RANGE = 10 * 2.220446049250313e-16


def label_map(df: DataFrame, label: str = "label") -> DataFrame:
    """(label_id, label): 0-based rank of every distinct label.

    The unpartitioned window sees distinct labels only.
    """
    distinct = df.select(named(label).alias("label")).filter(F.col("label").isNotNull()).distinct()
    code = F.row_number().over(W.orderBy("label")) - 1
    return distinct.select(code.cast("int").alias("label_id"), "label")


def encode_labels(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_id``."""
    right = small_table(mapping.select(F.col("label").alias(label), "label_id"))
    return join_on(df, right, [label], "left")


def decode_labels(df: DataFrame, mapping: DataFrame, code: str = "label_id", name: str = "label") -> DataFrame:
    """Add the label name of a code; unknown codes read ``Class_<code>``."""
    right = small_table(mapping.select(F.col("label_id").alias(code), F.col("label").alias("_name")))
    joined = join_on(df, right, [code], "left")
    default = F.concat(F.lit("Class_"), named(code).cast("string"))
    return joined.withColumn(name, F.coalesce("_name", default)).drop("_name")


def fit_min_max(df: DataFrame, features: list[str]) -> DataFrame:
    """One row with the struct (lo, hi) of every feature, from one pass."""
    return df.agg(*[F.struct(F.min(named(f)).cast("double").alias("lo"),
                             F.max(named(f)).cast("double").alias("hi")).alias(f) for f in features])


def apply_min_max(df: DataFrame, fitted: DataFrame | Row, features: list[str]) -> DataFrame:
    """Scale features with fitted minima and maxima, without clipping.

    The single fitted row is turned into literals, so this is a projection.
    """
    row = fitted.first() if isinstance(fitted, DataFrame) else fitted
    scaled = {}
    for f in features:
        lo, hi = row[f]["lo"], row[f]["hi"]
        if lo is None:
            scaled[f] = named(f).cast("double")
            continue
        width = hi - lo
        scaled[f] = (named(f) - F.lit(lo)) / F.lit(1.0 if width < CONSTANT_RANGE else width)
    return df.withColumns(scaled)


def min_max_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Fitted ranges in long form: (feature, lo, hi)."""
    row = fit_min_max(df, features)
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), named(f)["lo"].alias("lo"),
                                 named(f)["hi"].alias("hi")) for f in features])
    return row.select(F.inline(entries))
