"""Null, infinity and type rules for loosely typed flow tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.scalar import (
    blank_na, inf_to_zero, named, null_to_zero, to_number, trimmed_label,
)


def blank_na_markers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Map NA markers of text columns to null."""
    text = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: blank_na(named(c)) for c in text})


def non_null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_rows, n_present) of every column from a single pass."""
    columns = columns or df.columns
    row = df.agg(F.count("*").alias("_rows"), *[F.count(named(c)).alias(f"_n{i}") for i, c in enumerate(columns)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_rows").alias("n_rows"),
                                 F.col(f"_n{i}").alias("n_present")) for i, c in enumerate(columns)])
    return row.select(F.inline(entries))


def dense_columns(df: DataFrame, columns: list[str] | None = None, share: float = 0.5) -> list[str]:
    """Columns whose non-null count is at least ``share`` of the rows."""
    profile = non_null_profile(df, columns)
    kept = profile.filter(F.col("n_present") >= F.col("n_rows") * F.lit(share)).collect()
    return [r["column"] for r in kept]


def drop_sparse_columns(df: DataFrame, share: float = 0.5) -> DataFrame:
    kept = set(dense_columns(df, share=share))
    return df.select(*[named(c) for c in df.columns if c in kept])


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_header_rows(df: DataFrame, label: str = "Label") -> DataFrame:
    """Drop repeated header lines, recognised by the label column's own name."""
    return df.filter(named(label) != F.lit(label))


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns that exist; others are ignored."""
    return df.drop(*columns)


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[named(c) for c in columns])


def numbers_from_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; unreadable text and infinities become 0."""
    return df.withColumns({c: null_to_zero(inf_to_zero(to_number(named(c)))) for c in columns})


def zero_infinities(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: inf_to_zero(named(c)) for c in columns})


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: null_to_zero(named(c)) for c in columns})


def narrow(df: DataFrame, floats: list[str], longs: list[str]) -> DataFrame:
    """Store features as float and codes as bigint."""
    casts = {c: named(c).cast("float") for c in floats}
    casts.update({c: named(c).cast("bigint") for c in longs})
    return df.withColumns(casts)


def clean_labels(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, trimmed_label(named(label)))


def shape(df: DataFrame, step: str) -> DataFrame:
    """(step, n_rows, n_columns)."""
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(step).alias("step"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def class_histogram(df: DataFrame, label: str) -> DataFrame:
    """(label, n) of every class."""
    return df.groupBy(named(label).alias(label)).agg(F.count("*").alias("n"))


def rows_of_class(df: DataFrame, label: str, value) -> DataFrame:
    """Rows of one class."""
    return df.filter(named(label) == F.lit(value))


def class_values(df: DataFrame, label: str, value: str, column: str = "n_values") -> DataFrame:
    """(label, n_values): distinct classes and the number of distinct values inside each."""
    return df.groupBy(named(label).alias(label)).agg(F.count_distinct(named(value)).alias(column))


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def label_set(parts: list[tuple[DataFrame, str]], column: str = "label") -> DataFrame:
    """Distinct labels over several tables, made distinct in each before they meet."""
    sets = [df.select(named(label).alias(column)).distinct() for df, label in parts]
    return reduce(lambda a, b: a.union(b), sets).distinct()


def smallest_class(df: DataFrame, label: str) -> DataFrame:
    """(smallest, largest, n_classes) over the class histogram."""
    return class_histogram(df, label).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"),
                                          F.count("*").alias("n_classes"))


def clean_flows(df: DataFrame, label: str = "Label", dropped: tuple[str, ...] = ("Timestamp",),
                ids: tuple[str, ...] = (), share: float = 0.5) -> DataFrame:
    """All rules in their order, on an all-text table.

    NA markers become null; columns under half full go; rows with any null go;
    repeated headers go; remaining text becomes numbers with 0 for what is no
    finite number.  Header rows count while columns are judged.  Nulls in a
    column listed in ``dropped`` still remove their row, as the column is only
    dropped afterwards.
    """
    data = [c for c in df.columns if c not in ids]
    marked = blank_na_markers(df, data)
    kept = dense_columns(marked, data, share)
    if label not in kept:
        raise ValueError(f"label column {label!r} is missing or mostly null")
    whole = marked.select(*[named(c) for c in [*ids, *kept]]).na.drop("any", subset=[f"`{c}`" for c in kept])
    flows = drop_columns(drop_header_rows(whole, label), list(dropped))
    return numbers_from_text(flows, [c for c in kept if c != label and c not in dropped])
