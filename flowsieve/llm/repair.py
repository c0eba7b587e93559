"""Repair of conversations by lightest derivations.

Faults.  A turn is blank, repeats an earlier one, or is truncated; roles have to
read as an optional system turn and then pairs of user and assistant.

Repair.  An item (i, q) says that the first i turns have been repaired and leave
the role automaton in state q.  It is deduced from (i - 1, p) and an edit of the
turn between them, or from (i, p) and an insertion; the cost of a deduction is
(cost, audit): the sum of costs, then the initials of the edits in order.  Both
only grow along a deduction, and of two derivations of one item the smaller one
stays smaller however it goes on: equal costs mean equally many insertions, so
neither audit begins the other.  These are the superior functions of Knuth's
generalisation of Dijkstra's algorithm (1977): the agenda pops items in order of
(cost, audit), an item's first pop is final, and the work ends with the goal.

Long conversations.  One above BLOCK turns is ranked without sorting it in one
task and cut into blocks.  A block is repaired from every state it may be
entered in; its lightest results are deductions (state at its start) x (block)
-> (state at its end), over which the same agenda runs once more.  The chosen
pieces go back to the blocks, which write their part of the repaired text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.bounded import join_on, materialise
from flowsieve.functions.shipping import ship_package
from flowsieve.llm.shared import quoted, ranked, small_or_shuffled

# Turns of a block, and result rows a task sends off at once.
BLOCK = 256
ROWS_OUT = 2_000
# Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
GOALS = (START, ASSISTANT)
# State after a role's initial, where the automaton takes it: (s?(ua)+)?
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
# The role an inserted or reroled turn takes in a state.
NEXT = {state: letter for (state, letter) in MOVES if letter != "s"}
LEGAL = {"su", "ua", "au"}
SOUND, BLANK, DUPLICATE, CUT = range(4)

visible = re.compile(r"[^\x20\x09-\x0D]").search
ends_whole = re.compile(r"[.!?][\x20\x09-\x0D]*\Z").search

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def fault(role: str, text: str, seen: bool) -> int:
    """The first fault of a turn; ``seen`` if an earlier one has its role and text."""
    if not visible(text):
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if ends_whole(text) else CUT


def turn_edits(initial: str, kind: int) -> dict[int, list[tuple[int, int, str]]]:
    """State before a turn -> (state after, cost, initial) of the edits it allows."""
    edits = {state: [(state, DELETE, "D")] for state in STATES}
    if kind in (BLANK, DUPLICATE):
        return edits
    extra = TRUNCATED if kind == CUT else 0
    for state in STATES:
        if (state, initial) in MOVES:
            edits[state].append((MOVES[state, initial], extra, "K"))
        edits[state].append((MOVES[state, NEXT[state]], REROLE + extra, "R"))
    return edits


def lightest(steps: list[dict[int, list[tuple[int, int, str]]]], start: int, goals=GOALS, insert: bool = True):
    """{goal state: (cost, audits)} by an agenda over items (steps taken, state), from ``start`` to the last step.

    ``steps`` lists deductions (state after, cost, audit) by the state before; ``audits`` keeps one entry per
    deduction used, insertions included as single letters of the entry that follows or closes them.
    """
    waiting = set(goals)
    agenda = [(0, "", 0, start, ())]
    final, found = set(), {}
    while agenda and waiting:
        cost, audit, at, state, path = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(steps) and state in waiting:
            waiting.discard(state)
            found[state] = (cost, audit, path)
        if insert and (at, after := MOVES[state, NEXT[state]]) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", at, after, path))
        if at < len(steps):
            for after, more, letters in steps[at].get(state, ()):
                if (at + 1, after) not in final:
                    heapq.heappush(agenda, (cost + more, audit + letters, at + 1, after, path if insert else (path, state, letters)))
    return found


def repaired(audit: str, state: int, turns: list[tuple[str, str]]) -> list[str]:
    """``role:text`` of the turns that an audit leaves, from the state it starts in."""
    lines, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        role, text = (NAMES[NEXT[state]], "") if letter == "I" else turns[at]
        if letter == "R":
            role = NAMES[NEXT[state]]
        at += letter != "I"
        lines.append(f"{role}:{text}")
        state = MOVES[state, role[:1]]
    return lines


def _there(part: dict) -> tuple[list[tuple[str, str]], list[int]]:
    """(role, text) of a group's turns without the dropped ones, and their places in the group."""
    places = [i for i, gone in enumerate(part["gone"]) if not gone]
    return [(part["role"][i], part["text"][i]) for i in places], places


def _whole(part: dict) -> tuple:
    """The result of a conversation that is in one block."""
    pairs, places = _there(part)
    if not pairs:
        return 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()
    seen, kinds = set(), []
    for pair in pairs:
        kinds.append(fault(*pair, pair in seen))
        seen.add(pair)
    initials = [role[:1] for role, _ in pairs]
    cost, audit, _ = min(lightest([turn_edits(i, k) for i, k in zip(initials, kinds)], START).values())
    numbers = {int(part["number"][i]) for i in places if part["number"][i] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    text = "\n".join(repaired(audit, START, pairs))
    return (gaps, *[kinds.count(k) for k in (BLANK, DUPLICATE, CUT)], _illegal(initials), cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict]:
    """Groups of a sorted partition as lists by column, whichever batches they reach into."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if pdf.empty:
            continue
        new = np.zeros(len(pdf) - 1, dtype=bool)
        for key in keys:
            values = pdf[key].astype(object).where(pdf[key].notna(), None).to_numpy()
            new |= values[1:] != values[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(pdf)]]).tolist()
        columns = {c: pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns}
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield {c: values[a:b] for c, values in columns.items()}
        held = pdf.iloc[cuts[-2]:]
    if held is not None and len(held):
        yield {c: held[c].astype(object).where(held[c].notna(), None).tolist() for c in held.columns}


def _mapped(df: DataFrame, keys: list[str], order: list, schema: str, make: Callable[[dict], list]) -> DataFrame:
    """``make`` for every group of ``keys``, its rows in ``order``; rows of (keys, what it lists).

    Keys travel as text, so that numbers beside nulls stay whole.
    """
    names = [*keys, *T._parse_datatype_string(schema).names]

    def run(batches):
        rows = []
        for group in _groups(batches, keys):
            head = [group[k][0] for k in keys]
            rows += [(*head, *row) for row in make(group)]
            if len(rows) >= ROWS_OUT:
                yield pd.DataFrame(rows, columns=names, dtype=object)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names, dtype=object)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    text = dealt.select(*[F.col(c).cast("string").alias(c) if c in keys else F.col(c) for c in df.columns])
    out = text.mapInPandas(run, ", ".join([*[f"{k} string" for k in keys], schema]))
    return out.select(*[F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys], *names[len(keys):])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after damage that follows from the checksum of ``conv_id:turn``.

    Null roles and texts, and nulls in the checksum's input, count as one space.  Dropped turns are marked, so
    that their conversation is not lost.
    """
    def said(name):
        return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.explode(F.array_repeat((draw == 0), F.when(draw == 3, 2).otherwise(1)))
    return conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(draw == 4, "user").otherwise(said("role")).alias("role"),
                                text.alias("text"), copies.alias("gone"))


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    ``turns`` is (conv_id, turn, role, text, gone), texts and roles without nulls.  Turns come by number, nulls
    first; of one number, by role and then by the digest of the text, so repeated rows stand together.  A null
    conv_id is a conversation.  A role without an initial fits nowhere.  Texts are taken whole.  A conversation
    without turns has zeros and an empty audit; an empty table gives no rows.
    """
    ship_package(turns.sparkSession)
    turns = turns.withColumn("digest", F.md5("text"))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("turns")).where(F.col("turns") > block)
    long = small_or_shuffled(sizes.select("conv_id"), "long")
    brief = join_on(turns, long, ["conv_id"], "left_anti")
    order = ["turn", "role", "digest"]
    numbered = brief.withColumn("number", F.col("turn").cast("string"))
    done = _mapped(numbered, ["conv_id"], order, RESULT, lambda part: [_whole(part)])
    if long.head(1):
        rows = ranked(join_on(turns, long, ["conv_id"], "left_semi"), ["conv_id"], order)
        done = done.unionByName(_in_blocks(rows, block))
    return done


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Results of conversations of several blocks; ``rows`` are ranked turns."""
    rows = rows.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    there = rows.where(~F.col("gone"))
    firsts = there.groupBy("conv_id", "role", "digest").agg(F.min("rank").alias("first"))
    known = join_on(rows, firsts, ["conv_id", "role", "digest"], "left").withColumn("seen", F.coalesce(F.col("first") < F.col("rank"), F.lit(False)))
    stored = materialise(known.select("conv_id", "block", "rank", "turn", "role", "text", "gone", "seen"), "turns")

    def items(part):
        pairs, places = _there(part)
        initials = [role[:1] for role, _ in pairs]
        kinds = [fault(*pair, part["seen"][i]) for pair, i in zip(pairs, places)]
        steps = [turn_edits(i, k) for i, k in zip(initials, kinds)]
        found = [(before, after, cost, audit) for before in STATES for after, (cost, audit, _) in lightest(steps, before, STATES).items()]
        return [([{"before": b, "after": a, "cost": c, "audit": t} for b, a, c, t in found], *[kinds.count(k) for k in (BLANK, DUPLICATE, CUT)],
                 _illegal(initials), initials[0] if initials else None, initials[-1] if initials else None)]

    blocks = materialise(_mapped(stored, ["conv_id", "block"], ["rank"], (
        "items array<struct<before:int,after:int,cost:long,audit:string>>, blank long, duplicate long, truncated long, illegal long, "
        "first string, last string"), items), "items")

    def joined(part):
        steps = []
        for listed in part["items"]:
            step = {}
            for item in listed:
                step.setdefault(item["before"], []).append((item["after"], item["cost"], item["audit"]))
            steps.append(step)
        cost, audit, path = min(lightest(steps, START, insert=False).values(), key=lambda f: f[:2])
        pieces = []
        while path:
            path, state, letters = path
            pieces.append((state, letters))
        ends = [(a, b) for a, b in zip(part["first"], part["last"]) if a is not None]
        across = sum(one[1] + two[0] not in LEGAL for one, two in zip(ends, ends[1:]))
        sums = [sum(part[c]) for c in ("blank", "duplicate", "truncated", "illegal")]
        pieces = [{"block": int(b), "state": s, "audit": a} for b, (s, a) in zip(part["block"], reversed(pieces))]
        return [(*sums[:3], sums[3] + across, cost, audit, pieces)]

    # One row per block of a conversation; as long as the audit that the result has to hold.
    chosen = materialise(_mapped(blocks, ["conv_id"], ["block"], (
        "blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<block:long,state:int,audit:string>>"),
        joined), "chosen")
    pieces = chosen.select("conv_id", F.inline("pieces"))

    def written(part):
        lines = repaired(part["audit"][0], part["state"][0], _there(part)[0])
        return [("\n".join(lines),)] if lines else []

    texts = _mapped(join_on(stored, pieces, ["conv_id", "block"]), ["conv_id", "block"], ["rank"], "part string", written)
    digests = _hashed(texts)
    turns = there.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    result = join_on(join_on(chosen.drop("pieces"), turns, ["conv_id"], "left"), digests, ["conv_id"], "left")
    return result.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                         F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _hashed(texts: DataFrame) -> DataFrame:
    """(conv_id, sha) of the parts of a text joined by line feeds; parts stream through, none are gathered."""
    def run(batches):
        own, digest, rows = None, None, []
        for pdf in batches:
            for key, part in zip(pdf["conv_id"].astype(object).where(pdf["conv_id"].notna(), None), pdf["part"]):
                if digest is None or key != own:
                    if digest is not None:
                        rows.append((own, digest.hexdigest()))
                    own, digest = key, hashlib.sha256(part.encode())
                else:
                    digest.update(b"\n" + part.encode())
        if digest is not None:
            yield pd.DataFrame([*rows, (own, digest.hexdigest())], columns=["conv_id", "sha"], dtype=object)

    dealt = texts.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    out = dealt.select(F.col("conv_id").cast("string").alias("conv_id"), "part").mapInPandas(run, "conv_id string, sha string")
    return out.select(F.col("conv_id").cast(texts.schema["conv_id"].dataType).alias("conv_id"), "sha")
