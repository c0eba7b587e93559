"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each source partition sends to each target is drawn first, with
row sums equal to the partitions' row counts and column sums equal to the exact
target sizes: the law these counts have under a uniform permutation of all rows
(Sanders 1998; Gupta et al., "Random permutations on parallel machines").  Then
every partition permutes its rows and cuts them by its row of the matrix, rows
are exchanged, and every target permutes what it received.  A target is a block
of consecutive slots of a shard, so no task sorts more than a block.

Only counts reach the driver: at most PARTITIONS of them, and a matrix of at
most PARTITIONS x TARGETS cells.  All row work is DataFrame operations.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsieve.functions.bounded import materialise
from flowsieve.llm.shared import BROADCAST_BYTES, quoted

# Source partitions are dealt to so many groups at most; targets are so many at most.
PARTITIONS = 1024
TARGETS = 2048
# Rows of a block, as long as TARGETS allows.
BLOCK_ROWS = 4_000_000


def near_equal(total: int, parts: int) -> list[int]:
    """Sizes at most one apart that add up to ``total``."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken from good + bad are good: inversion outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def chosen(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    left = rng.random()
    at_mode = math.exp(chosen(good, mode) + chosen(bad, draws - mode) - chosen(good + bad, draws))
    if left < at_mode:
        return mode
    left -= at_mode
    up = down = mode
    p_up = p_down = at_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if left < p_up:
                return up
            left -= p_up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if left < p_down:
                return down
            left -= p_down
        if p_up < 1e-18 and p_down < 1e-18:  # what rounding has left over
            return mode
    return mode


def communication_matrix(rows: list[int], targets: list[int], seed: int) -> list[list[int]]:
    """Random counts with the given row and column sums, as a uniform permutation would give."""
    rng = random.Random(seed)
    room, matrix = list(targets), []
    for count in rows:
        line, left, others = [], count, sum(room)
        for t, free in enumerate(room):
            others -= free
            taken = hypergeometric(rng, free, others, left) if left else 0
            line.append(taken)
            left -= taken
            room[t] -= taken
        matrix.append(line)
    return matrix


def uniform_shards(df: DataFrame, shards: int = 16, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with columns shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    Shard sizes are at most one apart and the order is a uniform shuffle.  Rows are told apart by their
    place alone: repeated rows, nulls in any column and empty texts are rows like any other.  An empty table
    gives no rows.  Columns of ``df`` named shard or slot are replaced.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # Stored, so that every later stage, also one run again, sees the same partitions and draws.
    tagged = materialise(
        df.select(F.struct(*[F.col(quoted(c)) for c in columns]).alias("row"),
                  F.pmod(F.spark_partition_id(), F.lit(PARTITIONS)).alias("part"),
                  F.rand(seed).alias("first"), F.rand(seed + 1).alias("second")), "tagged")
    counts = {r["part"]: r["n"] for r in tagged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts, total = sorted(counts), sum(counts.values())
    sizes = near_equal(total, shards)
    blocks = max(1, min(math.ceil(max(sizes) / block_rows), TARGETS // shards))
    targets = [size for shard in sizes for size in near_equal(shard, blocks)]
    matrix = communication_matrix([counts[p] for p in parts], targets, seed)
    lines = []
    for part, line in zip(parts, matrix):
        ends, until = [], 0
        for shard in range(shards):
            own = []
            for taken in line[shard * blocks:(shard + 1) * blocks]:
                until += taken
                own.append(until)
            ends.append(own)
        lines.append((part, [own[-1] for own in ends], ends))
    cuts = spark.createDataFrame(lines, "part int, shard_ends array<bigint>, block_ends array<array<bigint>>")
    if 8 * len(lines) * (len(targets) + shards) <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)

    def reached(ends, rank):
        return F.size(F.filter(ends, lambda end: end < rank))

    local = tagged.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("first", "second")))
    sent = (local.join(cuts, "part").withColumn("shard", reached(F.col("shard_ends"), F.col("rank")))
            .withColumn("block", reached(F.element_at("block_ends", F.col("shard") + 1), F.col("rank")))
            .select("row", "second", "shard", "block"))
    # Blocks of a shard are one row longer up to some block: where they start follows from the two sizes.
    of_shard = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    short = F.floor(of_shard / blocks).cast("long")
    start = F.col("block") * short + F.least(F.col("block").cast("long"), of_shard - short * blocks)
    placed = Window.partitionBy("shard", "block").orderBy("second")
    return sent.select("row.*", "shard", (start + F.row_number().over(placed) - 1).cast("long").alias("slot"))


def sized_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes plus one, and the text's checksum; a null text counts as empty."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    return documents.select(F.col(quoted(id_col)).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
                            F.crc32(text.cast("binary")).alias("text_crc32"))
