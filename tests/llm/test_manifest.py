"""The manifest against trees built level by level."""

import hashlib
import random
import zlib

import pytest

from flowsieve.llm import manifest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, grp string, rank int, hash string, node int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """The last hash above ``nodes`` and every node's siblings, level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    steps = []
    for r in range(len(nodes)):
        steps.append([])
        for level in levels[:-1]:
            first = r // 3 * 3
            steps[-1].append(("".join(level[first:r]), "".join(level[r + 1:first + 3])))
            r //= 3
    return levels[-1][0], steps


def plain(rows):
    by = {}
    for d, t, lang, s, n in rows:
        changed = t.replace("\n", "") if t is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t
        by.setdefault(s, []).append((d, digest(*map(field, (d, s, lang, n, t))), digest(*map(field, (d, s, lang, n, changed)))))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    below = {s: tree([x[1] for x in by[s]]) for s in sources}
    root, over = tree([below[s][0] for s in sources])
    out = []
    for s, up in zip(sources, over):
        for (d, own, changed), low in zip(by[s], below[s][1]):
            steps, at = low + up, changed
            for left, right in steps:
                at = digest(left, at, right)
            out.append((d, own, below[s][0], root, digest(*[a + b for a, b in steps]), at, at == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "x\ny", "no" * rng.randint(1, 50), "l\n" * 9]), rng.choice(["en", None]),
             rng.choice(["a"] * 5 + ["b", None, "é", "z1", "z2"]), rng.choice([None, i])) for i in range(400)]
    return rows + [rows[5], (None, "q", "en", "a", 1), (None, "r\n", None, None, None), (1000, "solo\n", "en", "only", 3),
                   (1001, "long\n" * 50_000, "en", "a", None)]


@pytest.mark.parametrize("digits", [manifest.DIGITS, 1])
def test_manifest_equals_plain_trees(spark, rows, digits):
    odd = [(*r, "x", 7, "h", None) for r in rows]
    got = manifest.verified(manifest.manifest(spark.createDataFrame(odd, DOCS).repartition(5), digits))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_small_manifests(spark):
    for rows in ([(1, "a\n", "en", "s", 1)], [(4, None, None, None, None)] * 4, [(i, "t", "en", str(i), 0) for i in range(10)]):
        df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], DOCS)
        assert sorted(map(tuple, manifest.verified(manifest.manifest(df)).collect()), key=repr) == plain(rows)
    assert manifest.verified(manifest.manifest(df.limit(0))).count() == 0
