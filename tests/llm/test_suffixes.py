"""Removed passages against a table of all strings, suffix sorting against sorted bytes."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from flowsieve.llm import suffixes

DOCS = "doc_id bigint, text string, window bigint, place string, spans int"


def plain(rows, width=suffixes.WIDTH):
    first, texts = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for p in range(len(t) - width + 1):
            if d is not None:
                s = t[p:p + width]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if d is not None and first[t[p:p + width]] < d:
                gone[p:p + width] = b"\1" * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng, count):
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(60)]

    def words(n):
        return " ".join(rng.choices(vocabulary, k=n))

    passages = [words(rng.randint(8, 40)) for _ in range(6)] + ["x" * 200, "ab" * 80]
    texts = []
    for _ in range(count):
        if texts and rng.random() < 0.25:
            text, at = rng.choice(texts), rng.randrange(40)
            texts.append(text if rng.random() < 0.5 else text[:at] + rng.choice(["", "q", "zz"]) + text[at + rng.randint(0, 3):])
        else:
            texts.append(" ".join(rng.choice([words(rng.randint(1, 60)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 20):]])
                                  for _ in range(rng.randint(1, 4))))
    texts += [None, "", "short", "y" * 49, "y" * 50, "y" * 51, "y" * 120]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    # Null ids, a repeated row, different texts of one id, and a passage that two others make up.
    return rows + [(None, texts[0]), (None, passages[0] * 2), rows[3], (ids[5], passages[1] + passages[2]), (ids[5], passages[1]),
                   (10 ** 15, passages[1] + "!" + passages[2])]


@pytest.mark.parametrize("seed, group", [(0, suffixes.GROUP), (1, 2)])
def test_removed_bytes_equal_brute_force(spark, seed, group):
    rows = corpus(random.Random(seed), 120)
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], DOCS).repartition(4)
    cleaned = suffixes.without_repeats(df, group=group)
    got = sorted(map(tuple, suffixes.digests(cleaned).collect()), key=repr)
    assert got == plain(rows) and sum(r[2] for r in got) > 1000
    assert suffixes.digests(suffixes.without_repeats(df.limit(0), group=group)).count() == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"abc", k=n)) for n in (0, 30, 5_000, 700, 2_000)]
    whole = sorted(zip(*(c.tolist() for c in suffixes.anchored(texts))))
    monkeypatch.setattr(suffixes, "PIECE", 256)
    suffixes._polynomial.cache_clear()
    assert sorted(zip(*(c.tolist() for c in suffixes.anchored(texts)))) == whole
    suffixes._polynomial.cache_clear()


@pytest.mark.parametrize("collide", [False, True])
def test_suffixes_are_sorted_also_if_all_hashes_collide(collide):
    rng = random.Random(5)
    words = sorted(((g, bytes(rng.choices(b"ab\0", k=rng.randint(0, 12)))) for g in range(40) for _ in range(rng.randint(1, 30))), key=lambda w: w[0])
    groups = np.array([g for g, _ in words])
    sizes = np.array([len(w) for _, w in words])
    rows = np.frombuffer(b"".join(w.ljust(12, b"\0") for _, w in words), np.uint8).reshape(-1, 12)
    order, shared = suffixes.sort_suffixes(rows, sizes, groups, np.zeros((len(words), 13), np.uint64) if collide else None)
    assert [words[i] for i in order] == sorted(words)
    for at in range(1, len(order)):
        (g, a), (h, b) = words[order[at - 1]], words[order[at]]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[at] == (same if g == h else 0)


def test_batches_of_many_entries_are_written_in_parts(monkeypatch):
    """A batch's wanted windows and spans never become objects all at once."""
    monkeypatch.setattr(suffixes, "CHUNK", 10)
    monkeypatch.setattr(suffixes, "WRITTEN", 4000)
    text, mark = bytes(range(200)) * 5, 1 << suffixes.PLACE_BITS
    wanted = [[{"window": w, "place": 40 * w + (mark if w % 4 == 3 else 0)} for w in range(20)] for _ in range(6)]
    kind = pa.list_(pa.struct([("window", pa.int64()), ("place", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([0] * 6, pa.int32()), pa.array([text] * 6, pa.binary()), pa.array(wanted, kind)],
                                       names=["doc", "number", "text", "wanted"])
    parts = list(suffixes._context_rows([batch]))
    assert max(p.num_rows for p in parts) <= 25 and len(parts) > 3
    found = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert found == [(w, d, 40 * w, text[max(0, 40 * w - suffixes.REACH):40 * w], text[40 * w:40 * w + suffixes.WIDTH]) for d in range(6) for w in range(20) if w % 4 != 3]
    kind = pa.list_(pa.struct([("number", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
    spans = [None, [], *[[{"number": n % 2, "first": 60 * n, "last": 60 * n + 20} for n in range(10)]] * 6]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(7)], pa.int64()), pa.array([0] * 8, pa.int32()), pa.array([text] * 7 + [None], pa.binary()), pa.array(spans, kind)],
                                       names=["doc", "number", "text", "spans"])
    parts = list(suffixes._deduplicated([batch]))
    rows = [r for p in parts for r in p.to_pylist()]
    assert len(parts) > 1 and [r["doc_id"] for r in rows] == [None, *range(7)] and rows[0]["kept"] == rows[1]["kept"] == text
    assert all(r["spans"] == [{"first": 60 * n, "last": 60 * n + 20} for n in range(0, 10, 2)] and len(r["kept"]) == 900 for r in rows[2:7])
    assert rows[7] == {"doc_id": 6, "n_bytes": 0, "spans": rows[7]["spans"], "kept": b""}
