"""Column-level helpers.  All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")

# The NA markers the pandas CSV reader treats as missing by default.
NA_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# try_cast alone would accept type suffixes such as '1d', so text is matched first.
NUMBER_PATTERN = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def named(name: str) -> Column:
    """Column by literal name; flow headers contain dots, slashes and blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def hash_key(seed: int | str, *ids: str) -> Column:
    """Reproducible pseudo-random order key: hex md5 of seed and row id.

    Depends on the row alone, so any partitioning, retry or engine orders rows
    the same way.
    """
    parts = [F.lit(str(seed)), *[named(i).cast("string") for i in ids]]
    return F.md5(F.concat_ws(":", *parts))


def unit_interval(key: Column) -> Column:
    """Map a hex md5 key to a double in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def hash_modulo(key: Column, n: Column | int) -> Column:
    """Map a hex md5 key to an integer in [0, n)."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, n if isinstance(n, Column) else F.lit(n))


def blank_na(col: Column) -> Column:
    """Turn NA markers in a text column into nulls."""
    return F.when(~col.isin(*NA_MARKERS), col)


def to_number(col: Column) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return F.when(col.rlike(NUMBER_PATTERN), F.trim(col).try_cast("double"))


def inf_to_zero(col: Column) -> Column:
    """Replace positive and negative infinity by 0."""
    return F.when(F.abs(col) == F.lit(INF), F.lit(0.0)).otherwise(col)


def null_to_zero(col: Column) -> Column:
    """Replace null and NaN by 0."""
    return F.coalesce(F.nanvl(col, F.lit(0.0)), F.lit(0.0))


def trimmed_label(col: Column) -> Column:
    return F.trim(col.cast("string"))


def trim_names(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*unique_names(c.strip() for c in df.columns))


def unique_names(names) -> list[str]:
    """Make names unique by appending .1, .2, ... to repetitions."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out
