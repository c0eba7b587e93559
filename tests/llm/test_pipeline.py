"""The pipeline against its stages by brute force, and odd tables through every stage."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from flowsieve.llm import bpe, decontaminate, toxicity
from tests.llm.test_models import corpus, edit_distance_in
from tests.llm.test_text import plain_fingerprint, plain_groups

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path(bpe.RANKS_FILE), "rb").read()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    docs, labels = corpus(rng, 260)
    rows = [d[:5] for d in docs]
    items = [(i, " ".join(rng.choices(rows[0][1].split() + rows[1][1].split(), k=25))) for i in range(6)]
    plain = [r for r, (_, good, toxic) in zip(rows, labels) if good and not toxic]
    for at, (_, item) in enumerate(items):
        rows.append((1000 + at, f"{plain[at][1][:200]} {item.upper()}. {plain[at + 9][1][:200]}", "en", "s1", 0))
    for at, r in enumerate(plain[20:30]):
        rows.append((2000 + at, r[1] if at % 2 else r[1].upper().lower() + " ", r[2], r[3], r[4]))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s0", 0), (None, "no id at all but plain words", "en", "s1", 3), rows[5]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items, {d: (q, t) for d, q, t in labels}


def test_pipeline_equals_its_stages_by_brute_force(spark, folder):
    path, rows, items, truth = folder
    good = [r for r in rows if truth.get(r[0], (1, 0))[0]]
    labels = spark.read.parquet(f"{path}/labels.parquet")
    scored = toxicity.toxicity(spark.createDataFrame(good, DOCS), labels).collect()
    rude = {r.doc_id for r in scored if r.predicted}
    assert sum((r.doc_id in rude) == bool(truth[r.doc_id][1]) for r in scored if r.doc_id in truth) >= 0.97 * len(truth) * len(good) / len(rows)
    civil = [r for r in good if r[0] not in rude]
    tops = plain_groups([plain_fingerprint(r[1]) for r in civil])
    single = [min((r for r, u in zip(civil, tops) if u == t), key=lambda r: (r[0] is None, r[0] or 0)) for t in dict.fromkeys(tops)]
    clean = []
    for r in single:
        text = decontaminate.normal(r[1])
        normal = [decontaminate.normal(t) for _, t in items]
        if not any(edit_distance_in(item, text) <= int(0.1 * len(item)) for item in normal):
            clean.append(r)
    assert 0 < len(clean) < len(single) < len(civil) < len(good) < len(rows)
    want = []
    for r in clean:
        ids = LIBRARY.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=repr) == sorted(want, key=repr)


def test_stages_keep_columns_and_take_odd_tables(spark, folder):
    path, rows, _, _ = folder
    odd = [(None, None, None, None, None, None, None)] * 2 + [(5007, "w " * 30_000, "en", "s0", 1, "x", 0.5), (5008, "", None, None, None, None, None),
                                                              (5009, "ordinary words in a row", "en", "s0", 1, "x", 0.5)]
    docs = spark.createDataFrame(odd, DOCS + ", row string, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, path)
        assert kept.columns == docs.columns, name
        assert {r.doc_id for r in kept.collect()} >= {5009}, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, path).count() == len(odd) and last(spark, docs.limit(0), path).count() == 0


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "byte_level_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
