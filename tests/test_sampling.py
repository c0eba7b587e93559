import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsieve.operators import encode, sample


def flows(spark, sizes, start=0):
    rows, i = [], start
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label, float(i % 7)))
            i += 1
    return spark.createDataFrame(rows, "row_id bigint, label string, x double")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def expected_train(sizes, fraction=0.2):
    """Largest remainder in plain integers."""
    total = sum(sizes.values())
    train = total - math.ceil(fraction * total)
    floor = {g: n * train // total for g, n in sizes.items()}
    rest = sorted(sizes, key=lambda g: (-(sizes[g] * train % total), g))
    for g in rest[: train - sum(floor.values())]:
        floor[g] += 1
    return floor


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(2, 60), min_size=2, max_size=5))
def test_split_is_exhaustive_and_meets_quotas(spark, counts):
    sizes = {f"c{i}": n for i, n in enumerate(counts)}
    parts = sample.stratified_split(flows(spark, sizes), ["row_id"], "label").collect()
    assert sorted(r.row_id for r in parts) == list(range(sum(counts)))
    assert Counter(r.label for r in parts if r.split == "train") == {g: n for g, n in expected_train(sizes).items() if n}


def test_split_rejects_single_row_class(spark):
    with pytest.raises(Exception, match="single row cannot be split: lonely"):
        sample.stratified_split(flows(spark, {"a": 20, "lonely": 1}), ["row_id"], "label").collect()


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_layout_does_not_matter(spark, partitions):
    df = flows(spark, {"hot": 400, "b": 30, "c": 5})
    want = rows_of(sample.stratified_split(df, ["row_id"], "label"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert rows_of(sample.stratified_split(df.repartition(partitions), ["row_id"], "label")) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_refined_prefixes_give_the_same_rows(spark):
    df = flows(spark, {"hot": 9000, "b": 10})
    quotas = sample.single_quota(F.lit(4321).cast("bigint"))
    plain = sample.first_rows(df, ["row_id"], 1, ["label"], quotas)
    refined = sample.first_rows(df, ["row_id"], 1, ["label"], quotas, ranked_rows=1)
    assert rows_of(plain) == rows_of(refined)
    assert plain.filter("label = 'hot'").count() == 4321


def test_thin_common_keeps_rare_and_null_labels_count_as_common(spark):
    df = spark.createDataFrame([(i, "rare" if i < 5 else None if i < 25 else "big", "f1") for i in range(125)],
                               "row_id bigint, label string, source string")
    kept = sample.thin_common(df, ["row_id"], "source", "label", ["rare"], 0.1).collect()
    assert sum(r.label == "rare" for r in kept) == 5
    assert len(kept) == 5 + 12


def test_uniform_sample_and_caps(spark):
    df = flows(spark, {"a": 100})
    assert sample.uniform_sample(df, ["row_id"], 40).count() == 40
    assert sample.uniform_sample(df, ["row_id"], 500).count() == 100
    assert sample.uniform_sample(df, ["row_id"], 0).count() == 0


def test_stratified_sample_keeps_shares(spark):
    got = sample.stratified_sample(flows(spark, {"a": 700, "b": 200, "c": 100}), ["row_id"], "label", 100)
    assert Counter(r.label for r in got.collect()) == {"a": 70, "b": 20, "c": 10}
    assert sample.stratified_sample(flows(spark, {"a": 7, "b": 2}), ["row_id"], "label", 100).count() == 9


def test_folds_match_dealing_sorted_labels(spark):
    sizes = {"a": 10, "b": 7, "c": 4}
    got = sample.stratified_folds(flows(spark, sizes), ["row_id"], "label", 3).collect()
    labels = sorted(g for g, n in sizes.items() for _ in range(n))
    assert Counter((r.label, r.fold) for r in got) == Counter((g, i % 3) for i, g in enumerate(labels))


def test_draws_of_draws_are_independent(spark):
    df = flows(spark, {"a": 20_000, "b": 20_000}).withColumn("source", F.lit("f"))
    thinned = sample.thin_common(df, ["row_id"], "source", "label", ["b"], 0.1)
    train = sample.stratified_split(thinned, ["row_id"], "label").filter("split = 'train'")
    got = Counter(r.label for r in sample.uniform_sample(train, ["row_id"], 4400).collect())
    assert abs(got["a"] - 400) < 80
    again = Counter(r.label for r in sample.uniform_sample(sample.stratified_sample(df, ["row_id"], "label", 8000), ["row_id"], 2000).collect())
    assert abs(again["a"] - 1000) < 120


def test_chunks_cover_the_table(spark):
    df = flows(spark, {"a": 50})
    ids = [r.row_id for t in range(4) for r in sample.chunk_slice(df, ["row_id"], t, 4).collect()]
    assert sorted(ids) == list(range(50))


def test_scaling_uses_train_ranges_and_zeroes_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (9.0, 6.0)], "x double, constant double")
    fitted = encode.fit_min_max(df.limit(2).filter("x < 5"), ["x", "constant"])
    got = [tuple(r) for r in encode.apply_min_max(df, fitted, ["x", "constant"]).orderBy("x").collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0), (4.0, 1.0)]


def test_label_codes_and_default_names(spark):
    df = flows(spark, {"b": 2, "A": 1, "a": 1})
    mapping = encode.label_map(df, "label")
    assert [tuple(r) for r in mapping.orderBy("label_id").collect()] == [(0, "A"), (1, "a"), (2, "b")]
    named = encode.decode_labels(spark.createDataFrame([(2,), (9,)], "label_id int"), mapping)
    assert {r.label_id: r.label for r in named.collect()} == {2: "b", 9: "Class_9"}
