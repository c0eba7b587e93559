"""Repeated passages across documents by hash-compared sparse suffix sorting.

A byte goes if a string of WIDTH bytes that covers it also starts in a document
with a smaller id.

Anchors.  Of the WIDTH - GRAM + 1 windows of GRAM bytes inside such a string,
the one with the least hash (each, if several) is its anchor; two equal strings
have the same anchors in the same places.  Only suffixes at anchors, about one
in 18 positions, are looked at.  An anchor's context is what its strings can
reach: REACH bytes to either side, less at the ends of a text.

Equal contexts.  Prefix polynomial hashes give every anchor 64 bits of its
window and, by another polynomial, 64 bits of its context.  Rows meet by the
window; a context that an earlier document has as well is covered whole.  Rows of
one input batch that repeat a context are settled before the exchange.

Unequal contexts.  Where contexts differ around one window - at the ends of
passages - the bytes are fetched once per distinct context and sorted as
suffixes, to the right and to the left of the window: a mergesort whose
comparisons find the common extension by binary search over prefix hashes.  The
extensions of neighbours are then verified byte by byte; should hashes collide,
the bytes are sorted directly.  Contexts that share at least d bytes to the right
and WIDTH - d to the left stand next to each other in both orders, which gives
the smallest document of each of their strings.

A window with more than GROUP unequal contexts does not enter a task: its
strings of WIDTH bytes become rows whose smallest document is a grouped minimum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowsieve.functions.bounded import materialise
from flowsieve.functions.shipping import ship_package
from flowsieve.llm.shared import quoted, ranked, small_or_shuffled

WIDTH = 50
GRAM = 16
REACH = WIDTH - GRAM
SPAN = REACH + WIDTH
# Bytes hashed at once, anchors settled at once, contexts sorted at once and at most per window, bytes written at once.
PIECE = 1 << 18
SETTLED = 1 << 19
CHUNK = 20_000
GROUP = 20_000
WRITTEN = 4 << 20
# A place holds a position and, above these bits, the number of the text among those of its id.
PLACE_BITS = 40

# Odd bases of the two polynomials and the multiplier that mixes hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIXER = np.uint64(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIXER
    values = (values ^ (values >> np.uint64(32))) * MIXER
    return values ^ (values >> np.uint64(32))


@lru_cache
def _polynomial(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, and powers of a base and of its inverse modulo 2**64."""
    base = BASES[which]
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[1 - which]))

    def powers(factor):
        steps = np.full(PIECE + 4 * SPAN, factor, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return table, powers(base), powers(pow(base, -1, 1 << 64))


class Prefixes:
    """Prefix hashes of a buffer; the hash of any part of it is a difference of two."""

    def __init__(self, data: np.ndarray, which: int):
        table, powers, self.inverse = _polynomial(which)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * powers[:len(data)], out=self.sums[1:])

    def part(self, first: np.ndarray | slice, last: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        return (self.sums[last] - self.sums[first]) * self.inverse[at]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` neighbours, by doubling."""
    reach = 1
    while reach * 2 <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    return pick(values[:len(values) - (width - reach)], values[width - reach:]) if reach < width else values


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, window hash, context hash) of all anchors of texts that stand one after another in ``data``.

    ``ends`` are the texts' ends; a context is what of its text is inside ``data``.
    """
    if len(data) < WIDTH:
        nothing = np.zeros(0, dtype=np.uint64)
        return nothing.astype(np.int64), nothing, nothing
    first, count = Prefixes(data, 0), len(data) - GRAM + 1
    grams = mixed(first.part(slice(0, count), slice(GRAM, None), slice(0, count))) | np.uint64(1)
    least = _sliding(grams, WIDTH - GRAM + 1, np.minimum)
    # Strings that reach over the end of a text choose nothing.
    over = np.unique(np.concatenate([np.arange(max(0, e - WIDTH + 1), min(e, len(least))) for e in ends[:-1]] or [np.zeros(0, np.int64)]))
    least[over] = 0
    none = np.zeros(WIDTH - GRAM, dtype=np.uint64)
    chosen = np.flatnonzero(grams == _sliding(np.concatenate([none, least, none]), WIDTH - GRAM + 1, np.maximum))
    own = np.searchsorted(ends, chosen, side="right")
    starts = np.concatenate([[0], ends[:-1]])
    left, right = np.maximum(chosen - REACH, starts[own]), np.minimum(chosen + WIDTH, ends[own])
    shape = ((chosen - left) * (WIDTH + 1) + right - chosen).astype(np.uint64)
    context = mixed(Prefixes(data, 1).part(left, right, left) + shape * np.uint64(BASES[0]))
    return chosen, grams[chosen], context


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
    """Buffers of about PIECE bytes: [(text, offset of its part, bytes of it that only lend context)], data, ends."""
    parts, size = [], 0
    for number, text in enumerate(texts):
        for first in range(0, max(1, len(text)), PIECE):
            low, high = max(0, first - SPAN), min(len(text), first + PIECE + SPAN)
            if parts and size + high - low > PIECE + 2 * SPAN:
                yield _joined(parts, texts)
                parts, size = [], 0
            parts.append((number, low, high))
            size += high - low
    if parts:
        yield _joined(parts, texts)


def _joined(parts, texts):
    data = np.frombuffer(b"".join(texts[n][low:high] for n, low, high in parts), dtype=np.uint8)
    return parts, data, np.cumsum([high - low for _, low, high in parts])


def anchored(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, window hash, context hash) of every anchor of the texts, whole contexts only."""
    found = []
    for parts, data, ends in _pieces(texts):
        at, window, context = anchors(data, ends)
        own = np.searchsorted(ends, at, side="right")
        number, low, high = (np.array(c, dtype=np.int64) for c in zip(*parts))
        starts = np.concatenate([[0], ends[:-1]])
        position = at - starts[own] + low[own]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)[number]
        # A part of a long text leaves the anchors whose context it cuts to its neighbour, which has them whole.
        cut = ((low[own] > 0) & (position - REACH < low[own])) | ((high[own] < sizes[own]) & (position + WIDTH > high[own]))
        found.append(tuple(c[~cut] for c in (number[own], position, window, context)))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    number, position, window, context = (np.concatenate(c) for c in zip(*found))
    keep = np.unique(number * np.int64(1 << PLACE_BITS) + position, return_index=True)[1] if any(len(t) > PIECE for t in texts) else slice(None)
    return number[keep], position[keep], window[keep], context[keep]


def _settled(doc, place, window, context):
    """Rows of a batch: of every context those of its smallest document; the others are known to be covered.

    Covered rows have a negative place, and keys of their own so that they are spread by their document.
    """
    order = np.lexsort((doc, context, window))
    doc, place, window, context = doc[order], place[order], window[order], context[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (window[1:] != window[:-1]) | (context[1:] != context[:-1])
    smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    covered = doc > smallest
    window = np.where(covered, mixed(doc.astype(np.uint64)), window).view(np.int64)
    context = np.where(covered, place.astype(np.uint64), context).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(window), pa.array(context), pa.array(doc), pa.array(np.where(covered, -1 - place, place))],
                                      names=["window", "context", "doc", "place"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        docs, numbers = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        texts, first, total = batch.column(2), 0, 0
        for at in range(len(docs)):
            total += len(texts[at].as_buffer() or b"")
            if total >= 8 * PIECE or at + 1 == len(docs):
                number, position, window, context = anchored([texts[i].as_py() or b"" for i in range(first, at + 1)])
                number = number + first
                held.append((docs[number], position + (numbers[number].astype(np.int64) << PLACE_BITS), window, context))
                size += len(number)
                first, total = at + 1, 0
            if size >= SETTLED:
                yield _settled(*map(np.concatenate, zip(*held)))
                held, size = [], 0
    if size:
        yield _settled(*map(np.concatenate, zip(*held)))


# --- sorting of suffixes ---

def common(hashes: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows ``one`` and ``two``, by binary search over their prefix hashes."""
    low = np.zeros(len(one), dtype=np.int64)
    high = np.minimum(sizes[one], sizes[two])
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) // 2
        same = hashes[one, middle] == hashes[two, middle]
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)


def _before(rows, hashes, sizes, one, two):
    """Whether suffix ``one`` sorts before ``two``; equal ones do not."""
    length = common(hashes, one, two, sizes)
    ended = length == np.minimum(sizes[one], sizes[two])
    at = np.minimum(length, rows.shape[1] - 1)
    return np.where(ended, sizes[one] < sizes[two], rows[one, at] < rows[two, at])


def sort_suffixes(rows: np.ndarray, sizes: np.ndarray, groups: np.ndarray, hashes: np.ndarray | None = None):
    """(order, shared): suffixes sorted inside their ascending ``groups``, and how many bytes each shares with the one before.

    ``rows`` holds a suffix a row, of ``sizes`` bytes.  Bottom-up mergesort of all groups at once: the place of a
    row after a merge is its own plus the rows of the other run that go before it, found by binary search.
    """
    count, width = rows.shape
    if hashes is None:
        table, powers, _ = _polynomial(0)
        hashes = np.zeros((count, width + 1), dtype=np.uint64)
        np.cumsum(table[rows] * powers[:width], axis=1, out=hashes[:, 1:])
    order = np.arange(count)
    begin = np.searchsorted(groups, groups, side="left")
    size = np.searchsorted(groups, groups, side="right") - begin
    inside = order - begin
    run = 1
    while count and run < size.max():
        at = np.flatnonzero(size > run)
        block = inside[at] // (2 * run) * (2 * run)
        right = inside[at] - block >= run
        other = begin[at] + block + np.where(right, 0, run)
        length = np.clip(size[at] - block - np.where(right, 0, run), 0, run)
        low, high = np.zeros(len(at), dtype=np.int64), length.copy()
        mine = order[at]
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            middle = (low[todo] + high[todo]) // 2
            theirs, own = order[other[todo] + middle], mine[todo]
            # A row of the right run goes after its equals of the left run.
            ahead = np.where(right[todo], ~_before(rows, hashes, sizes, own, theirs), _before(rows, hashes, sizes, theirs, own))
            low[todo], high[todo] = np.where(ahead, middle + 1, low[todo]), np.where(ahead, high[todo], middle)
        place = begin[at] + block + np.where(right, inside[at] - block - run, inside[at] - block) + low
        merged = order.copy()
        merged[place] = mine
        order = merged
        run *= 2
    shared = np.zeros(count, dtype=np.int64)
    together = np.flatnonzero(groups[1:] == groups[:-1]) + 1
    one, two = order[together - 1], order[together]
    shared[together] = common(hashes, one, two, sizes)
    # Verification: the bytes found common are, and the next ones are in order.
    columns = np.arange(width)
    same = ((rows[one] == rows[two]) | (columns >= shared[together][:, None])).all(axis=1)
    at = np.minimum(shared[together], width - 1)
    ended = shared[together] == np.minimum(sizes[one], sizes[two])
    ordered = np.where(ended, sizes[one] <= sizes[two], rows[one, at] < rows[two, at])
    if not (same & ordered).all():
        return _sorted_bytes(rows, sizes, groups)
    return order, shared


def _sorted_bytes(rows: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
    """The same by comparing bytes; for the case that hashes collide."""
    keys = [(g, rows[i, :n].tobytes()) for i, (g, n) in enumerate(zip(groups.tolist(), sizes.tolist()))]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
    shared = np.zeros(len(order), dtype=np.int64)
    for at in range(1, len(order)):
        (g, a), (h, b) = keys[order[at - 1]], keys[order[at]]
        if g == h:
            shared[at] = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return order, shared


def extents(windows: np.ndarray, docs: np.ndarray, left: list[bytes], right: list[bytes]):
    """(left, right) bytes around each window that strings of WIDTH bytes of earlier documents cover; -1 if none.

    ``left`` are the up to REACH bytes before the windows, ``right`` the up to WIDTH bytes from their start.
    """
    windows = np.unique(windows, return_inverse=True)[1]
    turn = np.lexsort((docs, windows))
    windows, docs = windows[turn], docs[turn]
    sides = []
    for texts, width, backward in ((left, REACH, True), (right, WIDTH, False)):
        sizes = np.array([len(texts[i]) for i in turn], dtype=np.int64)
        rows = np.frombuffer(b"".join((texts[i][::-1] if backward else texts[i]).ljust(width, b"\0") for i in turn), np.uint8).reshape(-1, width)
        order, shared = sort_suffixes(rows, sizes, windows)
        group = windows[order]
        fresh = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        sides.append((sizes, order, shared, fresh))
    most, least = np.full(len(docs), -1, dtype=np.int64), np.full(len(docs), REACH + 1, dtype=np.int64)
    for reach in range(REACH + 1):
        names, fits = [], np.ones(len(docs), dtype=bool)
        for (sizes, order, shared, fresh), depth in zip(sides, (reach, WIDTH - reach)):
            name = np.empty(len(docs), dtype=np.int64)
            name[order] = np.cumsum(fresh | (shared < depth))
            names.append(name)
            fits &= sizes >= depth
        at = np.flatnonzero(fits)
        # Rows are in order of documents inside a window, so the first of a class is the smallest.
        _, first, back = np.unique(names[0][at] * (len(docs) + 1) + names[1][at], return_index=True, return_inverse=True)
        hit = at[docs[at][first][back] < docs[at]]
        most[hit] = reach
        least[hit] = np.minimum(least[hit], reach)
    out_left, out_right = np.empty_like(most), np.empty_like(most)
    out_left[turn], out_right[turn] = most, np.where(most < 0, -1, REACH - least)
    return out_left, out_right


def _extent_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Covered parts (doc, place, first, last) around the windows of a partition sorted by window."""
    held = []

    def solve(pdf):
        left, right = extents(pdf["window"].to_numpy(), pdf["doc"].to_numpy(), pdf["before"].tolist(), pdf["after"].tolist())
        hit = left >= 0
        at = pdf["place"].to_numpy()[hit] & ((1 << PLACE_BITS) - 1)
        return pd.DataFrame({"doc": pdf["doc"].to_numpy()[hit], "place": pdf["place"].to_numpy()[hit],
                             "first": at - left[hit], "last": at + GRAM + right[hit]})

    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= CHUNK:
            whole = pd.concat(held, ignore_index=True)
            window = whole["window"].to_numpy()
            cut = np.searchsorted(window, window[-1], side="left")
            held = [whole.iloc[cut:]]
            if cut:
                yield solve(whole.iloc[:cut])
    if held and sum(map(len, held)):
        yield solve(pd.concat(held, ignore_index=True))


def _listed(column: pa.Array, *names: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(first, last, fields) of a list of structs: where each row's entries stand in the fields, which hold those of all rows.

    Numbers stay in arrays; as objects of Python a batch's entries would take some hundred bytes each.
    """
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    last = np.cumsum(sizes)
    entries = column.flatten()
    return last - sizes, last, [entries.field(name).to_numpy(zero_copy_only=False) for name in names]


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, doc, place, before, after): the bytes around the wanted windows of each text, at most CHUNK rows and one text's at once."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def written(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)],
                                          names=["window", "doc", "place", "before", "after"])

    for batch in batches:
        docs, numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        first, last, (windows, places) = _listed(batch.column(3), "window", "place")
        rows = []
        for i in range(len(docs)):
            own = np.flatnonzero(places[first[i]:last[i]] >> PLACE_BITS == numbers[i]) + first[i]
            text = batch.column(2)[i].as_py()
            for low in range(0, len(own), CHUNK):
                part = own[low:low + CHUNK]
                for window, place in zip(windows[part].tolist(), places[part].tolist()):
                    at = place & ((1 << PLACE_BITS) - 1)
                    rows.append((window, docs[i], place, text[max(0, at - REACH):at], text[at:at + WIDTH]))
                if len(rows) >= CHUNK:
                    yield written(rows)
                    rows = []
        yield written(rows)


def removed_spans(size: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the covered parts, inside a text of ``size`` bytes."""
    runs = []
    for first, last in sorted((max(0, a), min(size, b)) for a, b in spans):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(last, runs[-1][1]))
        else:
            runs.append((first, last))
    return runs


def _deduplicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, spans, kept), about WRITTEN bytes and CHUNK spans at once."""
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def written(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, (pa.int64(), pa.int64(), span, pa.binary()))],
                                          names=["doc_id", "n_bytes", "spans", "kept"])

    for batch in batches:
        numbers = batch.column(1).to_numpy(zero_copy_only=False)
        begin, end, (of, firsts, lasts) = _listed(batch.column(3), "number", "first", "last")
        rows, size = [], 0
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py() or b""
            own = np.flatnonzero(of[begin[i]:end[i]] == numbers[i]) + begin[i]
            runs = removed_spans(len(text), list(zip(firsts[own].tolist(), lasts[own].tolist())))
            kept, at = [], 0
            for first, last in runs:
                kept.append(text[at:first])
                at = last
            kept.append(text[at:])
            rows.append((batch.column(0)[i].as_py(), len(text), [{"first": a, "last": b} for a, b in runs], b"".join(kept)))
            size += len(text) + WRITTEN // CHUNK * len(runs)
            if size >= WRITTEN:
                yield written(rows)
                rows, size = [], 0
        yield written(rows)


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, number, text): texts as bytes, numbered from 0 among the different ones of an id."""
    docs = df.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary").alias("text"))
    repeated = docs.where("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc")
    repeated = small_or_shuffled(repeated, "repeated")
    if not repeated.head(1):
        return docs.select("doc", F.lit(0).alias("number"), "text")
    marked = docs.withColumn("mark", F.md5("text"))
    different = materialise(marked.join(repeated, "doc", "left_semi").select("doc", "mark").distinct(), "different")
    numbers = ranked(different, ["doc"], ["mark"]).select("doc", "mark", F.col("rank").cast("int").alias("number"))
    return marked.join(numbers, ["doc", "mark"], "left").select("doc", F.coalesce("number", F.lit(0)).alias("number"), "text")


def covered_spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc, number, first, last): parts of texts that strings of earlier documents cover, possibly overlapping."""
    rows = docs.where("doc IS NOT NULL").mapInArrow(_anchor_rows, "window long, context long, doc long, place long")
    same, window = W.partitionBy("window", "context"), W.partitionBy("window")
    # One exchange by the window serves both windows.
    met = (rows.repartition("window").withColumn("own", F.min("doc").over(same))
           .withColumn("least", F.min("own").over(window)).withColumn("most", F.max("own").over(window)))
    covered = (F.col("place") < 0) | (F.col("doc") > F.col("own"))
    found = materialise(met.where(covered | (F.col("least") < F.col("most"))).select(
        F.when(~covered, F.col("window")).alias("window"), "doc", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("place")),
        "anchors")
    at = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    number = F.shiftright("place", PLACE_BITS).cast("int")
    whole = found.where("window IS NULL").select("doc", number.alias("number"), (at - REACH).alias("first"), (at + WIDTH).alias("last"))
    open_ = found.where("window IS NOT NULL")
    wanted = open_.groupBy("doc").agg(F.collect_list(F.struct("window", "place")).alias("wanted"))
    contexts = (docs.join(wanted, "doc").select("doc", "number", "text", "wanted")
                .mapInArrow(_context_rows, "window long, doc long, place long, before binary, after binary"))
    crowded = small_or_shuffled(open_.groupBy("window").agg(F.count("*").alias("n")).where(F.col("n") > group).select("window"), "crowded")
    many = bool(crowded.head(1))
    few = contexts.join(crowded, "window", "left_anti") if many else contexts
    parts = (few.repartition("window").sortWithinPartitions("window")
             .mapInPandas(_extent_rows, "doc long, place long, first long, last long"))
    parts = parts.select("doc", number.alias("number"), "first", "last")
    if many:
        parts = parts.unionByName(_crowded(contexts.join(crowded, "window", "left_semi")))
    return whole.unionByName(parts)


def _crowded(contexts: DataFrame) -> DataFrame:
    """The same for windows with very many contexts: each of their strings is a row, and its first document a minimum."""
    low = F.greatest(F.lit(0), F.lit(WIDTH) - F.octet_length("after"))
    each = contexts.where(low <= F.octet_length("before")).withColumn("reach", F.explode(F.sequence(low, F.octet_length("before"))))
    text = F.concat("before", "after")
    strings = materialise(each.select("doc", "place", "reach", F.substring(text, F.octet_length("before") - F.col("reach") + 1, F.lit(WIDTH)).alias("string")),
                          "strings")
    earliest = strings.groupBy("string").agg(F.min("doc").alias("least"))
    hit = strings.join(earliest, "string").where("least < doc").groupBy("doc", "place").agg(F.max("reach").alias("l"), F.min("reach").alias("r"))
    at = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return hit.select("doc", F.shiftright("place", PLACE_BITS).cast("int").alias("number"), (at - F.col("l")).alias("first"),
                      (at + WIDTH - F.col("r")).alias("last"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): maximal removed runs of every text's UTF-8 bytes, and the bytes that stay.

    Null texts count as empty; texts below WIDTH bytes lose nothing.  Rows that repeat an id are texts of their
    own, none earlier than the other.  A null id is earlier than none and no other is earlier than it.  Very long
    texts are hashed in overlapping parts.  ``kept`` may begin or end inside a character.  An empty table gives no
    rows; other columns are not read.
    """
    ship_package(df.sparkSession)
    docs = _numbered(df, id_col, text_col)
    spans = covered_spans(docs, group).groupBy("doc").agg(F.collect_list(F.struct("number", "first", "last")).alias("spans"))
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    known = docs.where("doc IS NOT NULL").join(spans, "doc", "left").select("doc", "number", "text", "spans")
    unknown = docs.where("doc IS NULL").select("doc", "number", "text", none)
    return known.unionByName(unknown).mapInArrow(_deduplicated, "doc_id long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary")


def digests(cleaned: DataFrame) -> DataFrame:
    """Counts and the digest of what ``without_repeats`` keeps."""
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return cleaned.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))
