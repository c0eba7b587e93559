"""Near-duplicate documents by SimHash fingerprints within a Hamming distance.

Fingerprints.  Words of the ASCII-lower-cased text (split at ASCII white space),
shingles of three words, XXH64 with seed 42 of each; a bit is set if over half
the hashes set it.

Links.  Equal fingerprints are folded first, so copies never meet.  The 64 bits
are cut into BLOCKS pieces; fingerprints at most DISTANCE bits apart agree on
all bits of at least BLOCKS - DISTANCE pieces, so a row per choice of pieces
(ten of about 26 bits) meets every close partner.  Small blocks are joined with
themselves and the distance is verified in the join.  A block of more than
SMALL fingerprints is cut into pieces of PIECE; each pair of pieces is compared
whole, by vectorised exclusive or, and only links that connect something not
yet connected leave the task, so neither pairs nor partners are capped.  The
comparisons in such a block are quadratic in its distinct fingerprints at about
a nanosecond each, its rows are n * n / PIECE.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowsieve.functions.bounded import materialise
from flowsieve.functions.shipping import ship_package
from flowsieve.llm.components import components
from flowsieve.llm.shared import quoted, small_or_shuffled

WORDS = 3
DISTANCE = 3
BLOCKS = 5
SMALL = 64
PIECE = 2048
# Hashes counted at once; bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text; 0 where there are no words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8", count=len(shingles))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_column(text: Column) -> Column:
    """Signed 64-bit fingerprint of a text column; null and word-less texts give 0."""
    @pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        prints = np.fromiter((fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(prints.view(np.int64))
    return run(text)


def _masks(blocks: int, distance: int) -> list[int]:
    """Signed masks of every choice of ``blocks - distance`` pieces of the 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    pieces = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(pieces, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _connect(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """A spanning forest of the links found, by union and find over positions of the values."""
    if not pairs:
        return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
    left, right = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    values, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(values)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for a, b in zip(at[:len(left)].tolist(), at[len(left):].tolist()):
        a0, b0 = top(a), top(b)
        if a0 != b0:
            parent[max(a0, b0)] = min(a0, b0)
            kept.append((a, b))
    kept = np.array(kept, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": values[kept[:, 0]], "v": values[kept[:, 1]]})


def _compare(distance: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left = np.unique(rows.loc[rows["side"] == 0, "fp"].to_numpy().view(np.uint64))
        right = left if rows["same"].iloc[0] else np.unique(rows.loc[rows["side"] == 1, "fp"].to_numpy().view(np.uint64))
        pairs = []
        for at in range(0, len(left), 128):
            near = np.bitwise_count(left[at:at + 128, None] ^ right[None, :]) <= distance
            i, j = np.nonzero(near)
            a, b = left[at:at + 128][i], right[j]
            apart = a != b
            if apart.any():
                found = _connect([(a[apart].view(np.int64), b[apart].view(np.int64))])
                pairs.append((found["u"].to_numpy(), found["v"].to_numpy()))
        return _connect(pairs)
    return run


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, small: int = SMALL,
          piece: int = PIECE) -> DataFrame:
    """(u, v) that connect all distinct fingerprints in column ``fp`` at most ``distance`` bits apart.

    Blocks up to ``small`` give every close pair, larger ones a spanning forest of their close pairs.
    """
    ship_package(prints.sparkSession)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                               for i, m in enumerate(_masks(blocks, distance))]))
    rows = prints.select("fp").distinct().select("fp", keys.alias("k")).select("fp", "k.c", "k.key")
    sizes = rows.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = materialise(rows.join(sizes, ["c", "key"]), "blocks")
    few = dealt.where(F.col("n") <= small).select("c", "key", "fp")
    pairs = (few.select("c", "key", F.col("fp").alias("u")).join(few.select("c", "key", F.col("fp").alias("v")), ["c", "key"])
             .where(F.col("u") < F.col("v")).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
             .select("u", "v"))
    count = F.ceil(F.col("n") / piece).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("count")).cast("int")
    many = dealt.where(F.col("n") > small).withColumn("count", count).withColumn("own", own)
    # Piece i meets every piece j >= i: as the left side there, as the right side for those before it.
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    many = many.select("c", "key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("same"))
    forest = many.groupBy("c", "key", "i", "j").applyInPandas(_compare(distance), "u long, v long")
    return pairs.union(forest)


def fingerprint_groups(prints: DataFrame, **how) -> DataFrame:
    """(fp, root) of every distinct fingerprint; root is the least fingerprint it is linked to, itself if alone."""
    distinct = materialise(prints.select("fp").distinct(), "prints")
    found = components(links(distinct, **how))
    return (distinct.join(found, F.col("fp") == F.col("node"), "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``df``.

    Null texts count as empty, which have fingerprint zero and are linked like any other.  Rows that repeat an
    id keep a row each; a null id belongs to its group but names it only if the group has no other id (null
    then).  Other columns are not read; an empty table gives an empty result.
    """
    ship_package(df.sparkSession)
    rows = materialise(df.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = fingerprint_groups(rows, **how)
    named = groups.join(least, "fp")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = materialise(named.join(names, "root").select("fp", "component_id"), "components")
    return rows.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of ``df``, one of each group of near duplicates: that with the smallest id.

    Of rows that repeat the id one is kept; a group whose ids are all null keeps one row.  Texts are read once
    for their fingerprints and moved once, to meet the kept ids.
    """
    ship_package(df.sparkSession)
    slim = materialise(df.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp"),
                                 F.xxhash64(F.col(text_col)).alias("h")), "fingerprints")
    return least_rows(df, slim, fingerprint_groups(slim, **how), id_col, text_col)


def least_rows(df: DataFrame, slim: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row with the smallest id of each group; ``slim`` (id, fp, h) per row of ``df``, ``groups`` (fp, root)."""
    best = slim.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("b"))
    chosen = groups.join(best, "fp").groupBy("root").agg(F.min("b").alias("b")).select(F.col("b.id").alias("_id"), F.col("b.h").alias("_h"))
    same = slim.groupBy("id", "h").agg(F.count("*").alias("_n"))
    chosen = small_or_shuffled(chosen.join(same, F.col("_id").eqNullSafe(F.col("id")) & F.col("_h").eqNullSafe(F.col("h")))
                               .select("_id", "_h", "_n"), "chosen")
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), F.col(quoted(id_col)).alias("id"),
                     F.xxhash64(F.col(quoted(text_col))).alias("h"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h")))
    # Only rows that repeat the kept id and text need to meet once more.
    return kept.where("_n = 1").select("row.*").unionByName(kept.where("_n > 1").dropDuplicates(["_id", "_h"]).select("row.*"))
