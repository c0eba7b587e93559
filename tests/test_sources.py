import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from flowsieve.functions.bounded import materialise
from flowsieve.operators import clean
from flowsieve.sources import flows, store


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "[flows]-set"
    (root / "sub").mkdir(parents=True)
    (root / "flows_a.csv").write_text(" Dst Port , Flow Bytes/s,Label\n80,1.5,Benign\n443,2.5,Bot\n22,3,Bot\n23,4,Bot\n")
    (root / "flows_b.csv").write_text("Dst Port,Flow Bytes/s,Extra,Timestamp,Label\n1,Infinity,7,t0,Benign\n"
                                      "Dst Port,Flow Bytes/s,Extra,Timestamp,Label\n2,NaN,8,t1,Bot\n3,abc,9,t2,Bot\n4,1d,9,t3,Bot\n")
    (root / "sub" / "flows_c.CSV").write_text("Label,Dst Port,Flow Bytes/s\nBenign,5,-inf\nBenign,6,\n")
    (root / "flows_nolabel.csv").write_text("a,b\n1,2\n")
    (root / "notes.txt").write_text("no csv")
    return str(root)


def test_headers_layouts_and_skipped_files(spark, folder):
    headers = flows.file_headers(spark, folder, recursive=True)
    union = [r["column"] for r in flows.header_union(headers).orderBy("position").collect()]
    assert set(union) == {"Dst Port", "Flow Bytes/s", "Label", "Extra", "Timestamp", "a", "b"}
    assert flows.file_layouts(headers).count() == 4
    skipped = flows.skipped_files(headers).collect()
    assert len(skipped) == 1 and skipped[0]["file"].endswith("flows_nolabel.csv")


def test_flat_scan_ignores_sub_folders(spark, folder):
    assert flows.list_files(spark, folder).count() == 3
    assert flows.list_files(spark, folder, recursive=True).count() == 4


def test_land_and_clean(spark, folder):
    landed = flows.land_flows(spark, folder, recursive=True)
    assert landed.count() == 11 and landed.select("row_id").distinct().count() == 11
    cleaned = clean.clean_flows(landed.drop("source_file", flows.CORRUPT), ids=("row_id",))
    assert set(cleaned.columns) == {"row_id", "Label", "Dst Port", "Flow Bytes/s"}
    got = sorted((r["Dst Port"], r["Flow Bytes/s"], r["Label"]) for r in cleaned.collect())
    # Infinity, garbage and a suffixed number become 0; NaN and blank rows go; the header row goes.
    assert got == [(1.0, 0.0, "Benign"), (3.0, 0.0, "Bot"), (4.0, 0.0, "Bot"), (5.0, 0.0, "Benign"),
                   (22.0, 3.0, "Bot"), (23.0, 4.0, "Bot"), (80.0, 1.5, "Benign"), (443.0, 2.5, "Bot")]
    assert {r.label for r in flows.label_values(landed).collect()} == {"Benign", "Bot"}


def test_column_exactly_half_full_is_kept(spark):
    df = spark.createDataFrame([("1", "1", "a"), ("2", "2", "a"), ("3", None, "a"), (None, None, "a")],
                               "most string, half string, Label string")
    assert clean.dense_columns(df) == ["most", "half", "Label"]
    less = spark.createDataFrame([("1", "a"), (None, "a"), (None, "a")], "x string, Label string")
    assert clean.dense_columns(less) == ["Label"]


def test_missing_label_column_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no CSV file with a column"):
        flows.read_flows(spark, str(tmp_path))


def test_rejected_lines_are_counted(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,Label\n1,x\n2,x,surplus\n3,y\n")
    landed = flows.land_flows(spark, str(tmp_path))
    assert tuple(flows.rejected_rows(landed).select("n_rows", "n_rejected").first()) == (3, 1)


def test_many_layouts_take_one_scan_and_no_path_to_the_driver(spark, tmp_path):
    columns = [f"c{i}" for i in range(9)] + ["Label"]
    rng, want = random.Random(4), []
    for number in range(240):
        own = rng.sample(columns[:9], rng.randint(1, 9)) + ["Label"]
        rng.shuffle(own)
        lines = [{c: f"{number}-{row}-{c}" for c in own} for row in range(3)]
        (tmp_path / f"f{number}.csv").write_text("\n".join([",".join(own), *[",".join(line[c] for c in own) for line in lines]]) + "\n")
        want += [tuple(line.get(c) for c in columns) for line in lines]
    headers = materialise(flows.file_headers(spark, str(tmp_path)), "headers")
    assert flows.file_layouts(headers).count() > 100
    read = flows.read_flows(spark, str(tmp_path), headers=headers)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_c8#") and plan.count(" csv") == 1
    assert sorted(map(tuple, read.select(*columns).collect()), key=repr) == sorted(want, key=repr)
    assert materialise(read, "read").filter(F.col(flows.CORRUPT).isNotNull()).count() == 0


def test_cells_may_hold_line_breaks_quotes_and_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,note,Label\n1,"two\nlines, and ""quotes""",A\n2,plain,B\n3,"a,b",C,surplus\n4,D\n')
    (tmp_path / "b.csv").write_text('Label,x\nE,5\n"F ""f""",6\n"G,g",7,8\n')
    rows = flows.read_flows(spark, str(tmp_path)).collect()
    got = {r.x: (r.note, r.Label, r[flows.CORRUPT] is not None) for r in rows}
    assert got == {"1": ('two\nlines, and "quotes"', "A", False), "2": ("plain", "B", False), "3": ("a,b", "C", True), "4": ("D", None, True),
                   "5": (None, "E", False), "6": (None, 'F "f"', False), "7": (None, "G,g", True)}
    assert flows.has_line_breaks(spark, str(tmp_path))
    landed = flows.land_flows(spark, str(tmp_path))
    assert flows.fitting_rows(landed).count() == 4 and flows.malformed_rows(landed).count() == 3


def test_unreadable_header_is_reported(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("\nx\n")
    row = flows.skipped_files(flows.file_headers(spark, str(tmp_path))).first()
    assert "empty file" in row["reason"]


def test_load_or_compute_runs_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.load_or_compute(spark, str(tmp_path), "x", store.fingerprint("a", 1), compute).count() == 3
    assert len(calls) == 1
    store.load_or_compute(spark, str(tmp_path), "x", store.fingerprint("a", 2), compute)
    assert len(calls) == 2


def test_a_step_stopped_before_its_commit_is_computed_again(spark, tmp_path, monkeypatch):
    root, key = str(tmp_path), store.fingerprint("step")
    rename = store.SparkContext.getOrCreate

    def stopped():
        raise KeyboardInterrupt

    monkeypatch.setattr(store.SparkContext, "getOrCreate", stopped)
    with pytest.raises(KeyboardInterrupt):
        store.load_or_compute(spark, root, "x", key, lambda: spark.range(5))
    monkeypatch.setattr(store.SparkContext, "getOrCreate", rename)
    # The rows and the manifest are there, but aside.
    assert not store.committed(spark, f"{root}/x-{key}") and len(list(tmp_path.iterdir())) == 1
    assert store.load_or_compute(spark, root, "x", key, lambda: spark.range(3)).count() == 3
    assert store.load_or_compute(spark, root, "x", key, lambda: spark.range(9)).count() == 3


def test_a_result_that_lacks_a_file_does_not_count_as_stored(spark, tmp_path):
    assert store.commit(spark, spark.range(8).repartition(2), str(tmp_path / "t"), note="x")
    assert store.committed(spark, str(tmp_path / "t"))
    next((tmp_path / "t").glob("*.parquet")).write_bytes(b"torn")
    assert not store.committed(spark, str(tmp_path / "t"))


def test_one_of_two_writers_wins(spark, tmp_path):
    path, key = str(tmp_path), store.fingerprint("two")

    def slow():
        # Another driver commits the same step while this one computes it.
        assert store.load_or_compute(spark, path, "x", key, lambda: spark.range(4)).count() == 4
        return spark.range(7)

    assert store.load_or_compute(spark, path, "x", key, slow).count() == 4
    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(lambda n: store.commit(spark, spark.range(n), f"{path}/y"), (1, 2, 3)))
    assert sum(won) == 1 and spark.read.parquet(f"{path}/y").count() == won.index(True) + 1
    for loss in (-0.5, -0.7):
        store.append_trial(spark, f"{path}/log", [("forest", 3, 0, {"n": 1.0}, loss)])
    assert [r.loss for r in store.load_trials(spark, f"{path}/log").collect()] == [-0.5]
    assert not [p for p in tmp_path.rglob("_writing*")]


def test_split_store_prunes_to_one_part(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "row_id bigint, split string")
    store.save_split(df, str(tmp_path / "s"))
    part = store.load_split(spark, str(tmp_path / "s"), "test")
    assert [tuple(r) for r in part.collect()] == [(2,)]


def test_report_and_params_files(spark, tmp_path):
    report = spark.createDataFrame([("0", 0.5, 1.0, 0.7, 3), ("accuracy", 0.5, 0.5, 0.5, 3)],
                                   "class string, precision double, recall double, f1 double, support bigint")
    store.save_report_json(report, str(tmp_path / "r"), "forest")
    text = next((tmp_path / "r").glob("part-*.json")).read_text()
    assert json.loads(text)["classification_report"]["accuracy"]["f1"] == 0.5
    path = str(tmp_path / "t")
    for trial, loss in ((0, -0.5), (1, -0.75), (2, -0.75)):
        store.append_trial(spark, path, [("forest", trial, trial % 2, {"n": float(trial)}, loss)])
    trials = store.load_trials(spark, path)
    assert store.resume_point(trials, 2).first()["next_trial"] == 3
    best = store.best_params(trials)
    assert (best.first()["trial"], best.first()["params"]) == (1, {"n": 1.0})
    store.save_best_params(best, str(tmp_path / "b"))
    assert store.load_best_params(spark, str(tmp_path / "b")).first()["params"] == {"n": 1.0}
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.json").write_text('{"model": "forest", "par')
    assert store.load_best_params(spark, str(tmp_path / "broken")) is None
    assert store.load_best_params(spark, str(tmp_path / "none")) is None


def test_row_ids_do_not_depend_on_partitions(spark, tmp_path):
    folder = tmp_path / "set"
    folder.mkdir()
    lines = [f"{i % 400},{i % 7},{'A' if i % 3 else ''}" for i in range(3000)] + ["1,1,A"] * 50
    (folder / "a.csv").write_text("x,y,Label\n" + "\n".join(lines) + "\n")
    (folder / "b.csv").write_text("y,Label,x\n" + "\n".join(lines[:100]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = flows.land_flows(spark, str(folder)).select("row_id", "x", "y", "Label").collect()
            found.append(sorted(map(tuple, rows), key=repr))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 3150


def test_intermediate_tables_can_be_removed(spark, tmp_path, monkeypatch):
    from flowsieve.functions import bounded
    monkeypatch.setattr(bounded, "work_root", lambda _: str(tmp_path))
    assert bounded.materialise(spark.range(3), "numbers").count() == 3
    assert list(tmp_path.iterdir())
    before = bounded.clearings()
    bounded.clear_work(spark)
    assert not list(tmp_path.iterdir()) and bounded.clearings() == before + 1
