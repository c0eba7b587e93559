"""Document quality by hierarchical empirical Bayes.

Evidence.  A logistic classifier on a few properties of the text gives every
document log-odds of being good.

Sites.  Hosts and the paths in them have a rate of good documents each.  The
classifier's probabilities are summed per path and per host (a partial sum
leaves every task before rows move).  A host's rate is drawn to the global rate
with a weight that follows from how much hosts differ beyond chance, a path's
rate to its host's likewise, so a site with few documents says little.  The
document's own share is left out of its site's sums.  Score: log-odds of the
text plus those of its path against the global ones.

Fitting uses at most about FIT_ROWS labelled rows, chosen by their id's hash, and
none of the held-out fold; all counts are taken over all documents.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowsieve.functions.bounded import join_on, materialise
from flowsieve.functions.shipping import ship_package
from flowsieve.llm.shared import quoted, small_or_shuffled
from flowsieve.llm.toxicity import held_out

FIT_ROWS = 200_000
# Log-odds from the text are kept within this.
SURE = 12.0
# Bounds of how many documents a prior weighs.
WEIGHT_LOW, WEIGHT_HIGH = 2.0, 10_000.0

LETTERS = bytes(b for b in range(256) if chr(b).isalpha() and b < 128 or b >= 128)
PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b).isspace() or chr(b) in ".,;:!?'\"()-")
UPPER = bytes(range(65, 91))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalpha())


def properties(text: str | None) -> list[float]:
    """Shares of odd symbols, of capitals, of words without letters, of words equal to the one before, and of
    repeated lines; zeros for a text without words."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * 5
    letters = len(data) - len(data.translate(None, LETTERS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [len(data.translate(None, PLAIN)) / len(data),
            (len(data) - len(data.translate(None, UPPER))) / max(letters, 1),
            sum(not word.strip(MARKS) for word in words) / len(words),
            sum(map(eq, words, words[1:])) / len(words),
            1 - len(set(lines)) / len(lines)]


def properties_column(text: Column) -> Column:
    @pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([properties(t) for t in texts], dtype="object")
    return run(text)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        rows: int = FIT_ROWS) -> tuple[list[float], float]:
    """Weights and intercept of the text classifier.

    Rows with a null id or label are not used; a document labelled both ways counts as good.  Without labels of
    both kinds there is no evidence: all weights are zero.
    """
    ship_package(documents.sparkSession)
    known = (labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).na.drop().where(~held_out(F.col("i")))
             .groupBy("i").agg((F.max("y") > 0).cast("double").alias("label")))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
    # At most FIT_ROWS pairs of numbers, so they may be sent to every executor.
    texts = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(known), "i")
    sample = materialise(texts.select(properties_column(F.col("text")).alias("p"), "label"), "properties")
    if sample.select("label").distinct().count() < 2:
        return [0.0] * len(properties(None)), 0.0
    model = LogisticRegression(regParam=1e-3, maxIter=60).fit(sample.select(array_to_vector("p").alias("features"), "label"))
    return [float(w) for w in model.coefficients], float(model.intercept)


def evidence_column(text: Column, weights: list[float], intercept: float) -> Column:
    """Log-odds of a text being good, within SURE."""
    vector = np.array(weights)

    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        values = np.array([properties(t) for t in texts]).reshape(-1, len(vector)) @ vector + intercept
        return pd.Series(np.clip(values, -SURE, SURE))

    return run(text)


def _weight(rows: DataFrame, prior: Column) -> float:
    """How many documents the prior of the rates in ``rows`` (n, s) weighs, by moments: the spread of rates beyond chance."""
    rate = F.col("s") / F.col("n")
    total, spread, chance = rows.agg(F.sum("n"), F.sum(F.col("n") * F.pow(rate - prior, 2)), F.sum(prior * (1 - prior))).first()
    if not total:
        return WEIGHT_HIGH
    between = (spread - chance) / total
    inside = chance / rows.count()
    return WEIGHT_HIGH if between <= 0 else min(WEIGHT_HIGH, max(WEIGHT_LOW, inside / between - 1))


def _odds(rate: Column) -> Column:
    inside = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), rate))
    return F.log(inside / (1 - inside))


def site_rates(evidence: DataFrame, name: str = "sites") -> tuple[DataFrame, float, float, float]:
    """Counts per (host, path) with those of the host, the global rate, and the weights of both priors."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = materialise(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")), name)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    rate = total[1] / total[0] if total[0] else 0.5
    rate = min(1 - 1e-3, max(1e-3, rate))
    host_weight = _weight(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), F.lit(rate))
    both = join_on(paths, hosts, ["host"])
    host_rate = (F.col("host_s") + host_weight * rate) / (F.col("host_n") + host_weight)
    return both, rate, host_weight, _weight(both, host_rate)


def site_score(rate: float, host_weight: float, path_weight: float) -> Column:
    """Score from evidence, n, s, host_n and host_s, the document itself left out of its sites."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    host = (F.col("host_s") - p + host_weight * rate) / (F.col("host_n") - 1 + host_weight)
    path = (F.col("s") - p + path_weight * host) / (F.col("n") - 1 + path_weight)
    return 1 / (1 + F.exp(-(F.col("evidence") + _odds(path) - math.log(rate / (1 - rate)))))


def quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
            path_col: str = "lang") -> DataFrame:
    """(doc_id, evidence, site_n, score, kept) per row; kept where the score is at least one half.

    Null hosts and paths are sites of their own; null and empty texts have the properties of a text without
    odd traits; repeated rows keep a row each; an empty table gives no rows.
    """
    weights, intercept = fit(documents, labels, id_col, text_col)
    rows = materialise(documents.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"),
                                        evidence_column(F.col(text_col), weights, intercept).alias("evidence")), "evidence")
    rates, rate, host_weight, path_weight = site_rates(rows)
    met = join_on(rows, small_or_shuffled(rates, "rates"), ["host", "path"])
    return met.select("doc_id", "evidence", F.col("n").alias("site_n"), site_score(rate, host_weight, path_weight).alias("score")) \
        .withColumn("kept", F.col("score") >= 0.5)


def good_rows(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
              path_col: str = "lang") -> DataFrame:
    """Rows of ``documents`` with a score of at least one half, their columns unchanged.

    The text is read twice, once for the sites' sums, and moved only if the table of sites is too large to send.
    """
    names = documents.columns
    weights, intercept = fit(documents, labels, id_col, text_col)
    evidence = evidence_column(F.col(quoted(text_col)), weights, intercept)
    rates, rate, host_weight, path_weight = site_rates(
        documents.select(F.col(quoted(host_col)).alias("host"), F.col(quoted(path_col)).alias("path"), evidence.alias("evidence")))
    rows = documents.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("row"), F.col(quoted(host_col)).alias("host"),
                            F.col(quoted(path_col)).alias("path"), evidence.alias("evidence"))
    met = join_on(rows, small_or_shuffled(rates, "rates"), ["host", "path"])
    return met.where(site_score(rate, host_weight, path_weight) >= 0.5).select("row.*")
