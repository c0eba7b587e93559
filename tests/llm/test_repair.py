"""Repairs against a table of best edits filled turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from flowsieve.llm import repair

TURNS = "conv_id bigint, turn bigint, role string, text string, gone string, block int, rank int"
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NAMES = {"u": "user", "a": "assistant"}


def best_edits(initials, kinds):
    """(cost, audit) by dynamic programming; kinds are 0 sound, 1 blank, 2 duplicate, 3 truncated."""
    best = [{"": (0, "")}] + [{} for _ in initials]

    def put(at, state, value):
        if state in best[at] and best[at][state] <= value:
            return False
        best[at][state] = value
        return True

    for i in range(len(initials) + 1):
        while any([put(i, MOVES[q, x], (c + 5, t + "I")) for q, (c, t) in list(best[i].items()) for x in "ua" if (q, x) in MOVES]):
            pass
        if i == len(initials):
            break
        for q, (c, t) in best[i].items():
            put(i + 1, q, (c + 2, t + "D"))
            if kinds[i] in (0, 3):
                c += 5 if kinds[i] == 3 else 0
                if (q, initials[i]) in MOVES:
                    put(i + 1, MOVES[q, initials[i]], (c, t + "K"))
                for x in "ua":
                    if (q, x) in MOVES:
                        put(i + 1, MOVES[q, x], (c + 1, t + "R"))
    return min(v for q, v in best[-1].items() if q in ("", "a"))


def plain(rows):
    talks = {}
    for conv, turn, role, text in rows:
        turns = talks.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        if draw:
            turns += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = []
    for conv, turns in talks.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        kinds = []
        for at, (_, role, text) in enumerate(turns):
            seen = (role, text) in [t[1:] for t in turns[:at]]
            bare = text.strip(" \t\n\x0b\x0c\r")
            kinds.append(1 if not bare else 2 if seen else 3 if bare[-1] not in ".!?" else 0)
        initials = [role[:1] for _, role, _ in turns]
        cost, audit = best_edits(initials, kinds)
        numbers = {t[0] for t in turns} - {None}
        lines, at, state = [], 0, ""
        for letter in audit:
            at += letter != "I"
            if letter == "D":
                continue
            role, text = turns[at - 1][1:] if letter != "I" else ("", "")
            role = role if letter == "K" else NAMES["a" if state == "u" else "u"]
            state = role[:1]
            lines.append(f"{role}:{text}")
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, kinds.count(1), kinds.count(2), kinds.count(3),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    roles, texts = ["user", "assistant"] * 3 + ["system", None, "tool", "", "upper"], [None, "", " \t", "Fine. ", "Cut", "What?\n", "é!", "Fine. "]
    rows = []
    for conv in range(90):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 13, 40]) if conv else 600):
            text = rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(40)}{rng.choice('.!? x')}"
            rows.append((conv + 10 ** 16 + 1 if conv % 7 == 0 else conv, rng.choice([turn] * 4 + [None, turn + 2]), rng.choice(roles), text))
    return rows + [(None,) * 4, (None, 3, "user", "Hi."), rows[3], (10 ** 6, 0, "user", "q."), (None, 4, "assistant", "long. " * 20_000)]


@pytest.mark.parametrize("block", [repair.BLOCK, 5, 10 ** 6])
def test_repair_equals_best_edits(spark, rows, block):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS).repartition(5)
    got = repair.repair(repair.damaged(df), block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    assert repair.repair(repair.damaged(df.limit(0)), block).count() == 0


def test_agenda_finds_the_smallest_of_random_chains():
    rng = random.Random(8)
    for _ in range(400):
        initials = rng.choices(["s", "u", "a", "t", ""], [1, 4, 4, 1, 1], k=rng.randrange(12))
        kinds = rng.choices(range(4), [6, 1, 1, 2], k=len(initials))
        steps = [repair.turn_edits(i, k) for i, k in zip(initials, kinds)]
        assert min(repair.lightest(steps, repair.START).values())[:2] == best_edits(initials, kinds)
