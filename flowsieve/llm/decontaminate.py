"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may stand in a text with at most k = ERROR * n edits.
Cut into k + 1 pieces, at least one piece then occurs unchanged, and where it
does the item lies within k characters of where the piece puts it.  All pieces
of all items are found in one pass over a text by an Aho-Corasick automaton.  The
pieces are the leaves of a tree, and if c neighbouring pieces hold less than c
edits, so does one of their two halves for its own pieces: a hit is carried up
the tree, from two pieces with one edit to the whole with k, and dropped where
a step fails.  Hits of one item that point to overlapping places share a window
for the last step.  Every step is Myers' bit-parallel algorithm (1999), which
gives the least edit distance of a pattern to any part of a window.  Texts and items are compared in lower case with everything
but letters and digits as single spaces.

Items are handled in blocks of bounded size, each broadcast and held against
all rows in a map, so texts are never moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowsieve.functions.shipping import ship_package
from flowsieve.llm.shared import tidy

ERROR = 0.1
# Bytes of item texts that one pass holds.
BLOCK_BYTES = 4 << 20

gaps = re.compile(r"[\W_]+")
words = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return gaps.sub(" ", (text or "").lower()).strip()


def normal_with_places(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The normal text and, per word, (place in it, place in ``text``, length in ``text``)."""
    parts, places, at = [], [], 0
    for match in words.finditer(text):
        for word in normal(match.group()).split(" "):
            if word:
                parts.append(word)
                places.append((at, match.start(), match.end() - match.start()))
                at += len(word) + 1
    return " ".join(parts), places


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``errors`` + 1 pieces of near equal length."""
    count = min(errors + 1, len(item))
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(masks: dict[str, int], length: int, text: str, limit: int, any_near: bool = False) -> tuple[int, int]:
    """(distance, end) of the best approximate occurrence in ``text``; the distance is limit + 1 if none is near.

    With ``any_near`` the first one within the limit is enough.

    ``masks`` has a bit per position of the pattern for every character: Myers' vertical difference vectors
    in one whole number each.
    """
    full, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = limit + 1, -1
    get = masks.get
    for at, char in enumerate(text, 1):
        match = get(char, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | full & ~(diagonal | plus)
        down = plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, end = score, at
                if any_near:
                    break
        # An occurrence may begin anywhere: the top row of the distance table stays zero.
        up = up << 1 & full
        plus = down << 1 & full | full & ~(diagonal | up)
        minus = up & diagonal
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for at, char in enumerate(pattern):
        out[char] = out.get(char, 0) | 1 << at
    return out


def chains(item: str, pieces: list[tuple[int, str]]) -> list[list[tuple[int, int, int, dict[str, int]]]]:
    """For every piece the parts of the item above it, from small to large, without the whole.

    A part is (offset, length, edits allowed, masks).
    """
    above: list[list] = [[] for _ in pieces]

    def halve(low: int, high: int) -> None:
        if high - low > 1:
            middle = (low + high) // 2
            halve(low, middle)
            halve(middle, high)
            if high - low < len(pieces):
                first, last = pieces[low][0], pieces[high - 1][0] + len(pieces[high - 1][1])
                part = (first, last - first, high - low - 1, masks_of(item[first:last]))
                for at in range(low, high):
                    above[at].append(part)

    halve(0, len(pieces))
    return above


class Matcher:
    """Pieces of a block of items; finds the items that stand in a text."""

    def __init__(self, items: list[tuple[int, str]], error: float = ERROR):
        self.items = [(i, text, int(len(text) * error)) for i, text in ((i, normal(t)) for i, t in items) if text]
        places: dict[str, list[tuple[int, int, list]]] = {}
        for number, (_, text, errors) in enumerate(self.items):
            pieces = pieces_of(text, errors)
            for (offset, piece), above in zip(pieces, chains(text, pieces)):
                places.setdefault(piece, []).append((number, offset, above))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}

    def _masks(self, number: int) -> tuple[dict[str, int], dict[str, int]]:
        if number not in self.masks:
            text = self.items[number][1]
            self.masks[number] = masks_of(text), masks_of(text[::-1])
        return self.masks[number]

    def windows(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first, last) of the places that piece hits leave open, overlapping ones as one."""
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            begin = end + 1 - length
            for number, offset, above in where:
                start = begin - offset
                for first, long, allowed, masks in above:
                    at = start + first - allowed
                    window = text[max(0, at):max(0, at + long + 2 * allowed)]
                    if best_match(masks, long, window, allowed, True)[0] > allowed:
                        break
                else:
                    starts.setdefault(number, set()).add(start)
        out = []
        for number, found in starts.items():
            _, item, errors = self.items[number]
            first = last = None
            for start in sorted(found):
                if start + len(item) + errors <= 0 or start - errors >= len(text):
                    continue
                if first is None or start - errors > last:
                    if first is not None:
                        out.append((number, max(0, first), last))
                    first = start - errors
                last = start + len(item) + errors
            if first is not None:
                out.append((number, max(0, first), last))
        return out

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(item id, distance, errors allowed, first, last) of every item in a text, by places in its normal form."""
        if not self.items:
            return []
        plain = normal(text)
        found: dict[int, tuple[int, int, int]] = {}
        for number, first, last in self.windows(plain):
            _, item, errors = self.items[number]
            known = found.get(number)
            limit = errors if known is None else known[0] - 1
            if limit < 0:
                continue
            window = plain[first:last]
            whole = window.find(item)
            if whole >= 0:
                found[number] = 0, first + whole, first + whole + len(item)
            else:
                distance, end = best_match(self._masks(number)[0], len(item), window, limit)
                if distance > limit:
                    continue
                # The same search from the end backwards finds where the occurrence begins.
                _, length = best_match(self._masks(number)[1], len(item), window[:end][::-1], distance)
                found[number] = distance, first + end - length, first + end
            if first_only:
                break
        return [(self.items[n][0], d, self.items[n][2], a, b) for n, (d, a, b) in sorted(found.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The items in lists of about BLOCK_BYTES, one at a time."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    for block in range(count):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == block)
        yield [(r["i"], r["t"]) for r in part.collect()]


def matched_items(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", error: float = ERROR) -> DataFrame:
    """(doc_id, item_id, distance, allowed, first, last) of every item that stands in a document.

    first and last are places in the original text.  Null and empty texts match nothing, null items and items
    without letters or digits are not searched; repeated rows of either table give repeated or single results
    (documents keep a row each, equal items count once).  Very long texts are searched whole.  An item gives one
    row per document, its least distance; of places at that distance, which may overlap, the first one found.  An
    empty table gives no rows.
    """
    spark = documents.sparkSession
    ship_package(spark)
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(source.dtypes)['doc_id']}, item_id long, distance int, allowed int, first int, last int"
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, error)
            for batch in batches:
                rows = []
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    found = matcher.matches(text)
                    if not found:
                        continue
                    _, places = normal_with_places(text)
                    for item, distance, allowed, first, last in found:
                        inside = [p for p in places if p[0] < last and p[0] + max(1, p[2]) > first]
                        begin = inside[0][1] if inside else 0
                        finish = inside[-1][1] + inside[-1][2] if inside else 0
                        rows.append((doc, item, distance, allowed, begin, finish))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "allowed", "first", "last"])

        part = source.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _any_match(shared, error: float):
    @pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with tidy():
            matcher = Matcher(shared.value, error)
            for texts in batches:
                yield pd.Series([bool(matcher.matches(t, first_only=True)) for t in texts], dtype="bool")

    return run


def contaminated(text: Column, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text",
                 error: float = ERROR) -> Column:
    """Whether any item stands in a text; false for null and empty texts."""
    spark = benchmark.sparkSession
    ship_package(spark)
    out = F.lit(False)
    for items in _blocks(benchmark, item_col, item_text_col):
        out = out | _any_match(spark.sparkContext.broadcast(items), error)(text)
    return out
