"""Reproducible sampling and splitting with exact counts.

Rows are ordered by an md5 key of their id.  "The first n rows of a class" is
then a filter ``key <= cut`` once the key at rank n is known.  To find it, a
class of many rows is narrowed by histograms of key prefixes until few rows
remain, and only those are ranked.  The flow table is scanned for two columns
and never shuffled or sorted, however large its largest class is.  Ids have to
be unique; rows with equal ids share a key and stay together.

Every kind of draw salts its keys with its own name, so a sample of a sample, or
a split of it, is independent of how its rows were drawn before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsieve.functions.bounded import join_on, local_table, small_arrow, small_table
from flowsieve.functions.scalar import hash_key, hash_modulo, named

# Hex digits added per histogram level (4096 prefixes) and the number of rows of
# a group, or of one prefix of it, that are ranked without another level.
PREFIX_DIGITS = 3
RANKED_ROWS = 20_000
KEY_DIGITS = 32
ALL_ROWS = "g"

QuotaFn = Callable[[DataFrame], DataFrame]


def rank_cuts(keyed: DataFrame, groups: list[str], quotas: QuotaFn,
              ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Order keys found at given ranks of each group.

    ``keyed`` has the group columns and ``_key``.  ``quotas`` maps the group
    counts (groups, ``n``) to rows (groups, ``slot``, ``rank``).  Returns
    (groups, ``slot``, ``cut``).  Rank 0 gives the empty cut, which no key reaches,
    and a rank of all rows the cut "g", which no hex key exceeds; neither is
    searched for.
    """
    counts = keyed.groupBy(*groups).agg(F.count("*").alias("n"))
    rank, every = F.col("rank").cast("bigint"), F.col("rank") >= F.col("n")
    start = quotas(counts).select(*groups, "slot", F.lit("").alias("_prefix"), F.col("n").alias("_n"),
                                  F.when(every, 0).otherwise(rank).alias("_rank"),
                                  F.when(every, ALL_ROWS).otherwise("").alias("_cut"))
    located, biggest, small = _settled(start)
    digits = 0
    while biggest > ranked_rows and digits < KEY_DIGITS:
        wide = located.filter((F.col("_n") > ranked_rows) & (F.col("_rank") > 0))
        finer = digits + PREFIX_DIGITS
        inside = _inside(keyed, wide, groups, small)
        histogram = (inside.groupBy(*groups, "_prefix", F.substring("_key", 1, finer).alias("_finer"))
                     .agg(F.count("*").alias("_n")))
        narrow = located.filter((F.col("_n") <= ranked_rows) | (F.col("_rank") <= 0))
        located, biggest, small = _settled(narrow.unionByName(_refine(histogram, wide, groups)))
        digits = finer
    order = W.partitionBy(*groups, "_prefix").orderBy("_key")
    ranked = (_inside(keyed, located.filter(F.col("_rank") > 0), groups, small)
              .withColumn("_rank", F.row_number().over(order).cast("bigint")))
    cuts = join_on(located, ranked, [*groups, "_prefix", "_rank"], "left")
    return cuts.select(*groups, "slot", F.coalesce("_key", "_cut").alias("cut"))


def _settled(located: DataFrame) -> tuple[DataFrame, int, bool]:
    """Materialise located prefixes; also the largest row count and whether the table is small."""
    fetched = small_arrow(located)
    if fetched is None:
        wanted = located.filter(F.col("_rank") > 0)
        return located, wanted.agg(F.max("_n")).first()[0] or 0, False
    sizes = [n for n, rank in zip(fetched["_n"].to_pylist(), fetched["_rank"].to_pylist()) if rank > 0]
    return local_table(located.sparkSession, fetched, located.schema), max(sizes, default=0), True


def _refine(histogram: DataFrame, located: DataFrame, groups: list[str]) -> DataFrame:
    """One more level: from a located prefix to a longer one holding the rank."""
    upto = F.sum("_n").over(W.partitionBy(*groups, "_prefix").orderBy("_finer")
                            .rowsBetween(W.unboundedPreceding, 0))
    keys = [*groups, "_prefix"]
    hit = join_on(histogram.withColumn("_upto", upto), located.drop("_n"), keys)
    before = F.col("_upto") - F.col("_n")
    return (hit.filter((before < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
            .select(*groups, "slot", F.col("_finer").alias("_prefix"), "_n",
                    (F.col("_rank") - before).cast("bigint").alias("_rank"), "_cut"))


def _inside(keyed: DataFrame, located: DataFrame, groups: list[str], small: bool) -> DataFrame:
    """Rows under a located prefix, with that prefix.

    Prefixes of one group may differ in length, so each row looks up its group's
    prefixes in a table of a few entries per group.
    """
    wanted = located.groupBy(*groups).agg(F.collect_set("_prefix").alias("_prefixes"))
    wanted = F.broadcast(wanted) if small else wanted
    own = F.filter("_prefixes", lambda p: F.col("_key").startswith(p))
    return (join_on(keyed, wanted, groups).withColumn("_prefix", F.explode(own)).drop("_prefixes"))


def take_slots(df: DataFrame, ids: list[str], seed: int | str, groups: list[str],
               quotas: QuotaFn, slot: str, ranked_rows: int = RANKED_ROWS, slots: int = 1) -> DataFrame:
    """Add ``slot``: the number of the ``slots`` cuts of its group a row's key lies beyond.

    Slot 0 holds the first ``rank`` rows of the first quota, slot 1 those up to
    the second, and so on.
    """
    if not groups:
        # A constant group keeps one code path; its cuts become literals.
        keyed = df.select(F.lit(0).alias("_all"), hash_key(seed, *ids).alias("_key"))
        cuts = rank_cuts(keyed, ["_all"], quotas, ranked_rows).orderBy("slot").collect()
        level = sum((F.when(F.col("_key") > F.lit(r.cut), 1).otherwise(0) for r in cuts), F.lit(0))
        return df.withColumn("_key", hash_key(seed, *ids)).withColumn(slot, level).drop("_key")
    keyed = df.select(*[named(g) for g in groups], hash_key(seed, *ids).alias("_key"))
    cuts = rank_cuts(keyed, groups, quotas, ranked_rows)
    table = small_table(cuts.groupBy(*groups).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("slot", "cut"))), lambda s: s["cut"]).alias("_cuts")))
    joined = join_on(df.withColumn("_key", hash_key(seed, *ids)), table, groups, "left")
    beyond = sum((F.when(F.col("_key") > F.get("_cuts", F.lit(i)), 1).otherwise(0) for i in range(slots)), F.lit(0))
    return joined.withColumn(slot, beyond).drop("_key", "_cuts")


def first_rows(df: DataFrame, ids: list[str], seed: int | str, groups: list[str],
               quotas: QuotaFn, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Keep the first ``rank`` rows of every group."""
    return (take_slots(df, ids, seed, groups, quotas, "_slot", ranked_rows)
            .filter(F.col("_slot") == 0).drop("_slot"))


# --------------------------------------------------------------------- quotas

def single_quota(rank: Column) -> QuotaFn:
    """Same rank expression over ``n`` for every group."""
    def quotas(counts: DataFrame) -> DataFrame:
        return counts.withColumn("slot", F.lit(0)).withColumn("rank", rank.cast("bigint"))
    return quotas


def proportional_quota(groups: list[str], total: int | None = None,
                       test_fraction: float | None = None) -> QuotaFn:
    """Share a train size among classes in proportion, by largest remainder.

    The train size is ``n - ceil(test_fraction * n)`` or ``n - total``.  Integer
    arithmetic in decimal(38) keeps the shares exact; equal remainders go to the
    lower label.
    """
    def quotas(counts: DataFrame) -> DataFrame:
        # One row per class: the unpartitioned windows run over classes, not flows.
        everything = W.partitionBy()
        n_all = F.sum("n").over(everything).cast("decimal(19,0)")
        if test_fraction is not None:
            held = F.ceil(F.lit(float(test_fraction)) * F.sum("n").over(everything).cast("double"))
        else:
            held = F.least(F.lit(int(total)).cast("bigint"), F.sum("n").over(everything))
        table = counts.withColumn("_all", n_all).withColumn("_train", n_all - held.cast("decimal(19,0)"))
        product = F.col("n").cast("decimal(19,0)") * F.col("_train")
        table = table.withColumn("_floor", F.floor(product / F.col("_all")).cast("bigint"))
        # Division of wide decimals is rounded; correct the floor where it overshot.
        rest = product - F.col("_floor").cast("decimal(19,0)") * F.col("_all")
        table = table.withColumn("_floor", F.when(rest < 0, F.col("_floor") - 1).otherwise(F.col("_floor")))
        rest = product - F.col("_floor").cast("decimal(19,0)") * F.col("_all")
        table = table.withColumn("_rest", rest)
        missing = F.col("_train").cast("bigint") - F.sum("_floor").over(everything)
        by_rest = W.orderBy(F.col("_rest").desc(), *[named(g) for g in groups])
        extra = F.when(F.row_number().over(by_rest) <= missing, 1).otherwise(0)
        return table.withColumn("slot", F.lit(0)).withColumn("rank", F.col("_floor") + extra)
    return quotas


def fold_quota(groups: list[str], folds: int) -> QuotaFn:
    """Cumulative fold sizes per class: sorted labels are dealt to folds in turn."""
    def quotas(counts: DataFrame) -> DataFrame:
        order = W.orderBy(*[named(g) for g in groups]).rowsBetween(W.unboundedPreceding, 0)
        start = F.sum("n").over(order) - F.col("n")
        table = counts.withColumn("_start", start).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(folds - 2))))
        # Positions start .. start+n-1 congruent to 0..slot modulo folds.
        size = sum((_dealt(F.col("_start") + F.col("n"), f, folds) - _dealt(F.col("_start"), f, folds))
                   * (F.col("slot") >= f).cast("bigint") for f in range(folds - 1))
        return table.withColumn("rank", size.cast("bigint"))
    return quotas


def _dealt(position: Column, fold: int, folds: int) -> Column:
    """How many of the positions below ``position`` go to ``fold``."""
    return F.floor((position + F.lit(folds - 1 - fold)) / F.lit(folds)).cast("bigint")


# ------------------------------------------------------------------ operators

def stratified_split(df: DataFrame, ids: list[str], label: str, test_fraction: float = 0.2,
                     seed: int = 42, column: str = "split") -> DataFrame:
    """Mark each row ``train`` or ``test``, keeping class shares."""
    quotas = _checked(proportional_quota([label], test_fraction=test_fraction))
    slotted = take_slots(df, ids, f"{seed}:split", [label], quotas, "_slot")
    return slotted.withColumn(column, F.when(F.col("_slot") == 0, "train").otherwise("test")).drop("_slot")


def _checked(quotas: QuotaFn) -> QuotaFn:
    """Reject classes that cannot be split, with the label in the message."""
    def checked(counts: DataFrame) -> DataFrame:
        groups = [c for c in counts.columns if c != "n"]
        message = F.concat_ws(" ", F.lit("classes with a single row cannot be split:"),
                              *[named(g).cast("string") for g in groups])
        rank = F.when(F.col("n") < 2, F.raise_error(message).cast("bigint")).otherwise(F.col("rank"))
        return quotas(counts).withColumn("rank", rank)
    return checked


def stratified_sample(df: DataFrame, ids: list[str], label: str, size: int, seed: int = 42) -> DataFrame:
    """Sample of ``min(size, rows)`` rows keeping class shares."""
    slotted = take_slots(df, ids, f"{seed}:sample", [label], proportional_quota([label], total=size), "_slot")
    return slotted.filter(F.col("_slot") == 1).drop("_slot")


def uniform_sample(df: DataFrame, ids: list[str], size: int, seed: int = 42) -> DataFrame:
    """Uniform sample without replacement of ``min(size, rows)`` rows."""
    quotas = single_quota(F.least(F.lit(int(size)).cast("bigint"), F.col("n")))
    return first_rows(df, ids, f"{seed}:uniform", [], quotas)


def thin_common(df: DataFrame, ids: list[str], source: str | None, label: str, rare: list[str],
                fraction: float, seed: int = 42) -> DataFrame:
    """Keep all rare-class rows and an exact fraction of the others per source file.

    The fraction of n rows is rounded half to even.  Null labels count as common.
    With very many files the table of cuts is joined by a shuffle instead of sent.
    """
    is_rare = F.coalesce(named(label).isin(list(rare)), F.lit(False))
    flagged = df.withColumn("_rare", is_rare)
    groups = ["_rare"]
    if source:
        flagged = flagged.withColumn("_source", named(source))
        groups.append("_source")
    part = F.bround(F.lit(float(fraction)) * F.col("n"))
    kept = first_rows(flagged, ids, f"{seed}:thin", groups, single_quota(F.when(F.col("_rare"), F.col("n")).otherwise(part)))
    return kept.drop("_rare", "_source")


def thin_common_fast(df: DataFrame, ids: list[str], label: str, rare: list[str],
                     fraction: float, seed: int = 42) -> DataFrame:
    """Same, with an expected instead of an exact count: one pass, no fitting."""
    from flowsieve.functions.scalar import unit_interval
    is_rare = F.coalesce(named(label).isin(list(rare)), F.lit(False))
    return df.filter(is_rare | (unit_interval(hash_key(f"{seed}:thin", *ids)) < F.lit(float(fraction))))


def stratified_folds(df: DataFrame, ids: list[str], label: str, folds: int = 3,
                     seed: int = 42, column: str = "fold") -> DataFrame:
    """Assign each row to one of ``folds`` folds, keeping class shares."""
    return take_slots(df, ids, f"{seed}:fold", [label], fold_quota([label], folds), column, slots=folds - 1)


def chunk_number(df: DataFrame, ids: list[str], chunks: int, seed: int | str = "chunk",
                 column: str = "chunk") -> DataFrame:
    """Stable chunk number in [0, chunks) for rotating through a large table."""
    return df.withColumn(column, hash_modulo(hash_key(seed, *ids), chunks).cast("int"))


def chunk_slice(df: DataFrame, ids: list[str], trial: int, chunks: int, seed: int | str = "chunk") -> DataFrame:
    """The rows trial number ``trial`` works on: chunk ``trial mod chunks``."""
    numbered = chunk_number(df, ids, chunks, seed, "_chunk")
    return numbered.filter(F.col("_chunk") == trial % chunks).drop("_chunk")


def pick_rows(df: DataFrame, chosen: DataFrame, ids: list[str]) -> DataFrame:
    """Rows whose id occurs in ``chosen``."""
    return df.join(chosen.select(*ids).distinct(), ids, "left_semi")
