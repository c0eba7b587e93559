"""Class probabilities from the margins of one boosted model per class.

A margin becomes a share: its logistic value over the sum of all classes'.  How
often a class is right at a share is counted on rows the models were not fitted
on, per bin of shares, so any number of rows leaves at most BINS counts a class;
isotonic regression by pooling adjacent violators (Ayer et al., 1955; Zadrozny
and Elkan, 2002) makes them a rising curve.  Calibrated shares add up to one
again after they are divided by their sum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowsieve.functions.bounded import small_rows
from flowsieve.functions.scalar import named
from flowsieve.functions.shipping import ship_package

BINS = 4096


def shares(margins: Column) -> Column:
    """Logistic values of margins, divided by their sum; a margin is half the log-odds."""
    each = F.transform(margins, lambda m: 1 / (1 + F.exp(-2 * m)))
    return F.transform(each, lambda p: p / F.aggregate(each, F.lit(0.0), lambda a, b: a + b))


def rising(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ends and heights of the pooled bins (mean, n, hits), which ascend."""
    blocks: list[list[float]] = []
    for mean, n, hits in pdf.sort_values("mean")[["mean", "n", "hits"]].itertuples(index=False):
        blocks.append([mean, mean, n, hits])
        # A block that is not above the one before joins it.
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, more, also = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + more, blocks[-1][3] + also]
    ends = np.array([e for low, high, _, _ in blocks for e in ((low, high) if high > low else (low,))])
    heights = np.array([hits / n for low, high, n, hits in blocks for _ in range(2 if high > low else 1)])
    return ends, heights


def fit_curves(scored: DataFrame, label_id: str, score: str, bins: int = BINS) -> DataFrame:
    """(class_id, ends, heights): a rising curve from share to probability for every class."""
    ship_package(scored.sparkSession)
    long = scored.select(named(label_id).alias("_label"), F.posexplode(shares(named(score))).alias("class_id", "share"))
    counted = long.groupBy("class_id", F.floor(F.col("share") * bins).alias("bin")).agg(
        F.avg("share").alias("mean"), F.count("*").alias("n"), F.sum((F.col("_label") == F.col("class_id")).cast("int")).alias("hits"))

    def curve(pdf):
        ends, heights = rising(pdf)
        return pd.DataFrame({"class_id": [pdf["class_id"].iloc[0]], "ends": [ends], "heights": [heights]})

    return counted.groupBy("class_id").applyInPandas(curve, "class_id int, ends array<double>, heights array<double>")


def probabilities(scored: DataFrame, curves: DataFrame, score: str = "score") -> DataFrame:
    """``scored`` with calibrated probabilities in place of margins.

    Where every class's curve is at zero the shares themselves stay.
    """
    fetched = small_rows(curves)
    if fetched is None:
        raise ValueError("too many classes to calibrate")
    shared = scored.sparkSession.sparkContext.broadcast({r["class_id"]: (np.array(r["ends"]), np.array(r["heights"])) for r in fetched})

    @pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        if not len(values):
            return values
        known = shared.value
        own = np.stack(values.to_numpy())
        out = np.stack([np.interp(own[:, c], *known[c]) if c in known else np.zeros(len(own)) for c in range(own.shape[1])], axis=1)
        total = out.sum(axis=1, keepdims=True)
        return pd.Series(list(np.where(total > 0, out / np.where(total > 0, total, 1), own)))

    return scored.withColumn(score, run(shares(named(score))))
