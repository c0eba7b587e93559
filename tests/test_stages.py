"""From CSV files to explained models on a small flow set."""

import random

import pytest
from pyspark.sql import functions as F

from flowsieve.plans import presets, stages

SPACE = {"forest": {"n_estimators": ("quniform", 10, 12, 1), "max_depth": ("quniform", 4, 5, 1)}}


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("flows")
    draw = random.Random(1)
    kinds = {"Benign": 400, "Bot": 120, "Infiltration": 12}
    lines = []
    for shift, (kind, n) in enumerate(kinds.items()):
        for _ in range(n):
            lines.append(f"{draw.gauss(3 * shift, 1):.4f},{draw.gauss(-2 * shift, 1):.4f},{draw.random():.4f},1,t,{kind}")
    draw.shuffle(lines)
    header = " Flow Duration,Fwd Header Length.1,Noise, Constant,Timestamp, Label\n"
    (root / "one.csv").write_text(header + "\n".join(lines[:300]) + "\n")
    (root / "two.csv").write_text(header + "\n".join(lines[300:]) + "\n")
    preset = presets.Preset(False, 0.5, ("Infiltration",), 5, 0.5, True, 200, {"max_depth": 3})
    data = stages.prepare_folder(spark, str(root), str(root / "stage0"), preset)
    return root, preset, data


def test_prepare(prepared):
    _, _, data = prepared
    assert data.features == ["Flow Duration", "Fwd Header Length.1", "Noise", "Constant"]
    assert {r.label: r.label_id for r in data.labels.collect()} == {"Benign": 0, "Bot": 1, "Infiltration": 2}
    counts = {r.label_id: r["count"] for r in data.rows.groupBy("label_id").count().collect()}
    assert counts[2] == 12 and 255 <= counts[0] + counts[1] <= 265
    train = data.part("train").agg(*[f(f"`{c}`").alias(f"{f.__name__}_{i}") for i, c in enumerate(data.features) for f in (F.min, F.max)]).first()
    assert [round(v, 5) for v in train] == [0, 1, 0, 1, 0, 1, 0, 0]
    assert dict(data.rows.dtypes)["Noise"] == "float"


def test_balance_tune_and_explain(spark, prepared):
    root, preset, data = prepared
    balanced = stages.select_and_balance(data, str(root / "stage2"), preset, keep=2)
    assert set(balanced.features) == {"Flow Duration", "Fwd Header Length.1"}
    sizes = {r.label_id: r["count"] for r in balanced.part("train").groupBy("label_id").count().collect()}
    assert set(sizes) == {0, 1, 2} and min(sizes.values()) > 50 and sum(sizes.values()) > 2 * preset.fit_rows
    reduced = stages.evaluate_selection(balanced, preset, {"forest": {"n_estimators": 3, "max_depth": 3}})
    assert reduced["forest"]["predictions"].count() == balanced.part("test").count()
    assert balanced.part("test").count() == data.part("test").count()
    tuned = stages.tune(balanced, str(root / "stage3"), preset, ("forest",), trials=1, spaces=SPACE)
    lines = {r["class"]: r for r in tuned["forest"]["report"].collect()}
    assert lines["accuracy"]["f1"] > 0.8
    assert tuned["forest"]["macro_auc"].first()["auc"] > 0.9
    again = stages.tune(balanced, str(root / "stage3"), preset, ("forest",), trials=1, spaces=SPACE)
    assert {r["class"]: r.f1 for r in again["forest"]["report"].collect()} == {c: r.f1 for c, r in lines.items()}
    assert spark.read.parquet(str(root / "stage0_rejected")).agg(F.sum("n_rows")).first()[0] == 532
    views = stages.explain_model(balanced, "forest", str(root / "stage3" / "forest" / "model"), str(root / "stage4"))
    assert views["attributions"].select("row_id").distinct().count() == balanced.part("test").count()
    some = stages.explain_model(balanced, "forest", tuned["forest"]["model"], str(root / "stage4"), rows=30)
    assert some["attributions"].select("row_id").distinct().count() == 30
    assert views["importance"].count() == 2
    assert views["coverage"].filter("absent").count() == 0
    assert {r.predicted_label for r in views["breakdown"].collect()} == {"Benign", "Bot", "Infiltration"}
    last = views["breakdown"].filter("place = 2").collect()
    assert all(abs(r.stop - r.output) < 1e-9 for r in last)


def test_baselines(prepared):
    _, _, data = prepared
    results = stages.train_baselines(data, {"forest": {"n_estimators": 3, "max_depth": 3}})
    assert results["forest"]["report"].count() == 6
    assert results["forest"]["auc"].count() == 3
