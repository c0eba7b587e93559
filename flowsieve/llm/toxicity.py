"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens.  A word's rate of standing in toxic text is estimated under a chain of
Dirichlet priors: the rate of all words is the prior mean of every three-letter
beginning, that of its four-letter ones, and so on to the whole word, each with
weight STRENGTH.  A word never seen takes the rate of its longest known
beginning.  Its score is the log-odds of that rate against the rate of all words
(Monroe et al. 2008), less DRIFT so that ordinary text scores below zero.

Passages.  All maximal scoring segments of a text are found in one pass (Ruzzo
and Tompa 1999).  Under ordinary text the best segment's score follows an
extreme-value law (Karlin and Altschul 1990): lambda solves
sum p(s) exp(lambda s) = 1 over ordinary words, K comes from the mean of the
calibration texts' best scores.  A segment's evidence is lambda S - log(K n);
a text's evidence is the best one's plus that of all others expected less than
once in a text.  Passages are reported from evidence SIGNIFICANT on.  A logistic curve turns it
into a score.

Fitting uses at most about FIT_ROWS labelled rows, chosen by their id's hash;
half of them give the rates for calibrating on the other half, and all of them
the rates used in the end.  Equal texts count once.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowsieve.functions.bounded import materialise
from flowsieve.functions.shipping import ship_package

FIT_ROWS = 200_000
STRENGTH = 10.0
DRIFT = 0.5
BEGINNINGS = (3, 4, 5, 6)
# A node of the chain is kept if its score differs so much from its parent's.
DISTINCT = 0.75
# Ordinary text has such a passage about once in twenty texts.
SIGNIFICANT = 3.0
MEMO = 100_000
EULER = 0.5772156649015329
FOLDS = 5

words_of = re.compile(r"\w+").findall
word_spans = re.compile(r"\w+").finditer


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text is divisible by ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


class Scores(dict):
    """Word to score; unknown words are looked up along their beginnings and remembered."""

    def __init__(self, nodes: dict[str, float]):
        super().__init__()
        self.nodes = nodes

    def __missing__(self, word: str) -> float:
        score = self.nodes.get(word + "$")
        if score is None:
            for length in reversed(BEGINNINGS):
                if len(word) >= length and (score := self.nodes.get(word[:length])) is not None:
                    break
            else:
                score = 0.0
        score -= DRIFT
        if len(self) >= MEMO:
            self.clear()
        self[word] = score
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, first, after last) of all maximal scoring segments, in order.

    Only runs of positive scores enter the list of candidates; each is merged to the left as far as that raises
    its score, so every candidate is moved over once.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    cuts = np.flatnonzero(np.diff(positive) > 1)
    starts, ends = positive[np.concatenate([[0], cuts + 1])], positive[np.concatenate([cuts, [len(positive) - 1]])] + 1
    kept: list[tuple[int, int, float, float, int]] = []  # first, after last, total before, total after, nearest lower start
    for first, end in zip(starts.tolist(), ends.tolist()):
        before, after = float(total[first]), float(total[end])
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][2] >= before:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= after:
                kept.append((first, end, before, after, at))
                break
            first, before = kept[at][0], kept[at][2]
            del kept[at:]
    return [(after - before, first, end) for first, end, before, after, _ in kept]


@dataclass
class Model:
    """Node scores, extreme-value parameters and the logistic curve."""

    nodes: dict[str, float]
    decay: float
    log_k: float
    intercept: float
    slope: float

    def evidence(self, segments: list[float], words: int) -> float:
        """Evidence of the best passage plus that of the others above zero."""
        base = self.log_k + math.log(max(words, 1))
        each = sorted((self.decay * s - base for s in segments), reverse=True) or [-base]
        return each[0] + sum(e for e in each[1:] if e > 0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))


def word_scores(words: list[str], scores: Scores) -> np.ndarray:
    """Scores of a text's words; the k-th occurrence of a word above zero counts a k-th of it, as rates are by text."""
    values = np.fromiter(map(scores.__getitem__, words), dtype=np.float64, count=len(words))
    seen: dict[str, int] = {}
    for at in np.flatnonzero(values > 0).tolist():
        times = seen[words[at]] = seen.get(words[at], 0) + 1
        if times > 1:
            values[at] = (values[at] + DRIFT) / times - DRIFT
    return values


def _text_scores(text: str | None, scores: Scores) -> tuple[list[float], int]:
    words = words_of((text or "").lower())
    values = word_scores(words, scores)
    return [s for s, _, _ in maximal_segments(values)], len(words)


def _labelled(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(text, y, half) of distinct labelled texts outside the held-out fold; at most about ``rows`` of them."""
    known = (labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).na.drop().where(~held_out(F.col("i")))
             .groupBy("i").agg(F.max("y").alias("y")))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
    # At most FIT_ROWS pairs of numbers, so they may be sent to every executor.
    texts = documents.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "i").groupBy("text").agg(F.max("y").alias("y")).select(
        "text", "y", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))


def _counts(batches):
    """Documents a word occurs in, per half and label; added up per batch before they leave."""
    for batch in batches:
        found: dict[str, list[int]] = {}
        for text, y, half in zip(batch["text"], batch["y"], batch["half"]):
            column = 2 * half + (y > 0)
            for word in set(words_of(text.lower())):
                found.setdefault(word, [0, 0, 0, 0])[column] += 1
        yield pd.DataFrame([(w, *c) for w, c in found.items()], columns=["word", "a0", "a1", "b0", "b1"])


def _chained(words: DataFrame, zero: Column, one: Column) -> tuple[DataFrame, float]:
    """(node, score, parent score) for every beginning and word, and the rate of all words."""
    counted = words.select("word", zero.cast("double").alias("n0"), one.cast("double").alias("n1")).where("n0 + n1 > 0")
    all0, all1 = counted.agg(F.coalesce(F.sum("n0"), F.lit(0.0)), F.coalesce(F.sum("n1"), F.lit(0.0))).first()
    rate = (all1 + 1) / (all0 + all1 + 2)
    odds = math.log(rate / (1 - rate))

    def shrunk(prior):
        return (F.col("n1") + STRENGTH * prior) / (F.col("n0") + F.col("n1") + STRENGTH)

    # Words with the rates of their beginnings: each level is a small grouped table joined to the next.
    level = counted.select("word", "n0", "n1")
    parent, prior = None, F.lit(rate)
    tables = []
    for length in BEGINNINGS:
        own = level.where(F.length("word") >= length).groupBy(F.substring("word", 1, length).alias("node")).agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        if parent is not None:
            own = own.join(parent.select(F.col("node").alias("up"), F.col("r").alias("p")),
                           F.substring("node", 1, F.lit(length - 1)) == F.col("up"))
            prior = F.col("p")
        own = own.select("node", prior.alias("p"), shrunk(prior).alias("r"))
        parent = materialise(own, "beginnings")
        tables.append(parent)
    known = tables[0]
    for one_level in tables[1:]:
        known = known.unionByName(one_level)
    longest = F.substring("word", 1, F.least(F.length("word"), F.lit(BEGINNINGS[-1])))
    whole = counted.withColumn("up", longest).join(known.select(F.col("node").alias("up"), F.col("r").alias("q")), "up", "left")
    whole = whole.withColumn("q", F.coalesce("q", F.lit(rate))).select(
        F.concat("word", F.lit("$")).alias("node"), F.col("q").alias("p"), shrunk(F.col("q")).alias("r"))
    both = known.unionByName(whole)
    return both.select("node", (F.log(F.col("r") / (1 - F.col("r"))) - odds).alias("score"),
                       (F.log(F.col("p") / (1 - F.col("p"))) - odds).alias("above")), rate


def _kept_nodes(words: DataFrame, zero: Column, one: Column) -> dict[str, float]:
    """Scores of the nodes that differ from what stands above them; bounded as the sample they come from is."""
    chained, _ = _chained(words, zero, one)
    kept = chained.where((F.abs(F.col("score") - F.col("above")) >= DISTINCT) | ((F.length("node") == BEGINNINGS[0]) & ~F.endswith("node", F.lit("$"))))
    table = kept.select("node", "score").toArrow()
    return dict(zip(table["node"].to_pylist(), table["score"].to_pylist()))


def _decay(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    if not len(values) or values.max() <= 0:
        return 1.0
    shares = weights / weights.sum()
    low, high = 1e-6, 50.0 / values.max()
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if (shares * np.exp(middle * values)).sum() < 1 else (low, middle)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a weak pull to (0, 0); the slope is not negative."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weights * (y - p)) - 1e-2 * beta
        hessian = (design * (weights * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: int = FIT_ROWS) -> Model:
    """Model from labelled documents outside the held-out fold.

    Rows with a null id or label are not used; a document labelled both ways counts as toxic.  Without labels
    of both kinds every text scores the same, below one half.
    """
    spark = documents.sparkSession
    ship_package(spark)
    sample = materialise(_labelled(documents, labels, id_col, text_col, label_col, rows), "labelled")
    words = sample.mapInPandas(_counts, "word string, a0 long, a1 long, b0 long, b1 long")
    words = materialise(words.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")]), "words")
    half = spark.sparkContext.broadcast(_kept_nodes(words, F.col("a0"), F.col("a1")))

    @pandas_udf("double")
    def half_score(column: pd.Series) -> pd.Series:
        scores = Scores(half.value)
        return pd.Series([round(scores[w], 1) for w in column], dtype="float64")

    drawn = words.where("b0 > 0").groupBy(half_score("word").alias("s")).agg(F.sum("b0").alias("n")).toArrow()
    decay = _decay(np.array(drawn["s"].to_pylist(), dtype=float), np.array(drawn["n"].to_pylist(), dtype=float))

    def texts(batches):
        scores = Scores(half.value)
        for batch in batches:
            rows = [(int(y > 0), *_text_scores(t, scores)) for t, y in zip(batch["text"], batch["y"])]
            yield pd.DataFrame(rows, columns=["y", "segments", "n"])

    scored = materialise(sample.where("half = 1").mapInPandas(texts, "y int, segments array<double>, n long"), "calibration")
    best = F.coalesce(F.array_max("segments"), F.lit(0.0)) * decay - F.log(F.greatest("n", F.lit(1)))
    mean = scored.where("y = 0").agg(F.avg(best)).first()[0]
    log_k = (mean if mean is not None else 0.0) - EULER
    base = F.log(F.greatest("n", F.lit(1))) + log_k
    each = F.when(F.size("segments") > 0, F.transform("segments", lambda s: s * decay - base)).otherwise(F.array(-base))
    top = F.array_max(each)
    total = top + F.aggregate(each, F.lit(0.0), lambda a, e: a + F.greatest(e, F.lit(0.0))) - F.greatest(top, F.lit(0.0))
    points = scored.groupBy(F.round(total, 1).alias("x"), "y").agg(F.count("*").alias("n")).toArrow()
    x, y, n = (np.array(points[c].to_pylist(), dtype=float) for c in ("x", "y", "n"))
    if len(set(y.tolist())) < 2:
        return Model({}, decay, log_k, -4.0, 0.0)
    intercept, slope = _logistic(x, y, n)
    nodes = _kept_nodes(words, F.col("a0") + F.col("b0"), F.col("a1") + F.col("b1"))
    return Model(nodes, decay, log_k, intercept, slope)


def score_column(text: Column, model: Model, spark) -> Column:
    """Score of a text column, 0 to 1; null and word-less texts score as texts without passages."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    held: list[Scores] = []

    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        known = shared.value
        if not held:
            held.append(Scores(known.nodes))
        return pd.Series([known.probability(known.evidence(*_text_scores(t, held[0]))) for t in texts], dtype="float64")

    return run(text)


def passages(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = SIGNIFICANT) -> DataFrame:
    """(doc_id, first, last, evidence, passage) of every significant passage, by character offsets of the text."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        scores = Scores(known.nodes)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                spans = list(word_spans(text or ""))
                values = word_scores([s.group().lower() for s in spans], scores)
                base = known.log_k + math.log(max(len(spans), 1))
                for s, first, end in maximal_segments(values) if len(spans) else []:
                    if known.decay * s >= base + least:
                        a, b = spans[first].start(), spans[end - 1].end()
                        rows.append((doc, a, b, known.decay * s - base, text[a:b]))
            yield pd.DataFrame(rows, columns=["doc_id", "first", "last", "evidence", "passage"])

    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"doc_id {dict(source.dtypes)['doc_id']}, first long, last long, evidence double, passage string")


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; nulls and repeated rows are scored like any text.

    A null or empty text has no passage and the score of one; very long texts are scored whole, in one pass.  Equal
    texts get equal scores; a score of exactly one half is predicted toxic.  An empty table gives no rows, and
    without labels nothing is predicted toxic.
    """
    model = fit(documents, labels, id_col, text_col)
    scored = documents.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                              score_column(F.col(text_col), model, documents.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
