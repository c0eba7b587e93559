import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.functions import ordered
from flowsieve.operators import evaluate

# Per-class precision, recall, F1 and support of a published forest
# report, with its accuracy, macro and weighted lines.
PUBLISHED = [
    (0.35519713261648744, 0.6017000607164542, 0.4466982195176921, 1647),
    (0.6243592600846891, 0.7032760135559182, 0.6614721681128622, 7967),
    (0.05597964376590331, 0.3055555555555556, 0.09462365591397849, 72),
    (0.9997657431266904, 0.9580620803657068, 0.9784697471810584, 49001),
    (0.28194956078209127, 0.4930624380574827, 0.35875247881737876, 4036),
    (0.8750462107208873, 0.9382618174611039, 0.9055521017646215, 10091),
    (0.44509497788186314, 0.5333645151231681, 0.48524822695035463, 6414),
    (0.34811715481171546, 0.5561497326203209, 0.42820380854348944, 1496),
    (0.9999471767527996, 0.9878502865527413, 0.9938619233875389, 325769),
    (0.9788262138854401, 0.9329324847283078, 0.9553284862775921, 31267),
    (0.9984425881353532, 0.9479495722474531, 0.9725411390378809, 104149),
    (0.30140982012639767, 0.5327986250358063, 0.3850134547712689, 3491),
    (0.04294478527607362, 0.25925925925925924, 0.07368421052631578, 27),
    (0.6256769671870023, 0.6670440393977132, 0.6456986301369863, 8833),
    (0.322007722007722, 0.6177777777777778, 0.4233502538071066, 675),
    (0.12895927601809956, 0.4318181818181818, 0.1986062717770035, 132),
]
PUBLISHED_AVERAGES = {
    "accuracy": (0.9498222737074984,) * 3,
    "macro avg": (0.523982764573701, 0.6541789025170595, 0.5629440485326955),
    "weighted avg": (0.9639456239540697, 0.9498222737074984, 0.9558983846779181),
}


def test_published_averages(spark):
    rows = [(str(i), *r) for i, r in enumerate(PUBLISHED)]
    df = spark.createDataFrame(rows, "class string, precision double, recall double, f1 double, support bigint")
    for line in evaluate.averages(df).collect():
        assert (line["precision"], line["recall"], line["f1"]) == pytest.approx(PUBLISHED_AVERAGES[line["class"]], abs=1e-12)
        assert line["support"] == 555067


def test_report_with_a_class_never_predicted_and_one_never_true(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 3)], "y int, pred int")
    counts = evaluate.confusion_counts(df, "y", "pred")
    lines = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in evaluate.report(counts).collect()}
    assert lines["0"] == pytest.approx((2 / 3, 1.0, 0.8, 2))
    assert lines["1"] == (0.0, 0.0, 0.0, 2)
    assert lines["3"] == (0.0, 0.0, 0.0, 0)
    assert lines["accuracy"][0] == 0.5
    matrix = evaluate.confusion_matrix(counts).collect()
    assert len(matrix) == 9 and sum(r.n for r in matrix) == 4


def brute_curve(y, s):
    """ROC points over descending distinct scores, starting at the origin."""
    pts = [(0.0, 0.0)]
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        pts.append(((hit & (y == 0)).sum() / (y == 0).sum(), (hit & (y == 1)).sum() / (y == 1).sum()))
    return np.array(pts)


def scored(spark, n=400, classes=3, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(classes):
        y = rng.integers(0, 2, n)
        s = np.round(rng.random(n) * 0.7 + y * 0.2, 2)
        rows += [(c, float(a), int(b)) for a, b in zip(s, y)]
    return rows, spark.createDataFrame(rows, "class int, score double, positive int")


@pytest.mark.parametrize("range_rows", [10**6, 7])
def test_curves_against_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ordered, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(ordered.with_ranges, "__defaults__", (None, range_rows))
    rows, df = scored(spark)
    counts = evaluate.score_counts(df, ["class"])
    full = evaluate.roc_points(counts, ["class"], drop_intermediate=False)
    thin = evaluate.roc_points(counts, ["class"])
    areas = {r["class"]: r["auc"] for r in evaluate.area_under_roc(counts, ["class"]).collect()}
    curves = {}
    for c in range(3):
        y = np.array([r[2] for r in rows if r[0] == c])
        s = np.array([r[1] for r in rows if r[0] == c])
        want = brute_curve(y, s)
        got = np.array(sorted((r.fpr, r.tpr) for r in full.filter(F.col("class") == c).collect()))
        assert np.allclose(got, want)
        assert areas[c] == pytest.approx(np.trapezoid(want[:, 1], want[:, 0]))
        slim = np.array(sorted((r.fpr, r.tpr) for r in thin.filter(F.col("class") == c).collect()))
        assert len(slim) <= len(want) and np.trapezoid(slim[:, 1], slim[:, 0]) == pytest.approx(areas[c])
        curves[c] = slim
    grid = np.unique(np.concatenate([c[:, 0] for c in curves.values()]))
    mean = sum(np.interp(grid, c[:, 0], c[:, 1]) for c in curves.values()) / 3
    macro = evaluate.macro_roc(thin, [])
    got = np.array(sorted((r.fpr, r.tpr) for r in macro.collect()))
    assert np.allclose(got[:, 0], grid) and np.allclose(got[:, 1], mean)
    assert evaluate.curve_area(macro, []).first()["auc"] == pytest.approx(np.trapezoid(mean, grid))


def test_reversed_score_mirrors_the_area(spark):
    _, df = scored(spark)
    flipped = df.withColumn("score", -F.col("score"))
    areas = [{r["class"]: r["auc"] for r in evaluate.area_under_roc(evaluate.score_counts(d, ["class"]), ["class"]).collect()}
             for d in (df, flipped)]
    for c in range(3):
        assert areas[0][c] + areas[1][c] == pytest.approx(1.0)


def test_class_without_positives_has_no_area(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 0), ("b", 0.1, 0), ("b", 0.3, 1)], "class string, score double, positive int")
    areas = {r["class"]: r["auc"] for r in evaluate.area_under_roc(evaluate.score_counts(df, ["class"]), ["class"]).collect()}
    assert areas == {"a": None, "b": 1.0}


def test_binned_scores_stay_close(spark):
    _, df = scored(spark)
    exact = evaluate.area_under_roc(evaluate.score_counts(df, ["class"]), ["class"]).orderBy("class").collect()
    binned = evaluate.area_under_roc(evaluate.score_counts(df, ["class"], bins=64), ["class"]).orderBy("class").collect()
    assert all(abs(a.auc - b.auc) < 0.02 for a, b in zip(exact, binned))
