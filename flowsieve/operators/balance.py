"""Class rebalancing: neighbour-based oversampling and editing.

Oversampling: Chawla et al., "SMOTE: synthetic minority over-sampling
technique", 2002.  Editing: Wilson, "Asymptotic properties of nearest neighbor
rules using edited data", 1972.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.bounded import join_on, materialise, small_table
from flowsieve.functions.scalar import hash_key, hash_modulo, named, unit_interval
from flowsieve.operators.clean import class_histogram
from flowsieve.operators.neighbors import class_key, nearest_neighbors
from flowsieve.operators.sample import single_quota, take_slots

# Synthetic rows one input record expands to inside a task, and rows per task.
EXPAND_ROWS = 1_000
TASK_ROWS = 500_000


def neighbor_count(smallest: int, k: int = 5) -> int:
    """Neighbours usable with the smallest class; a class of one row is an error."""
    usable = min(k, smallest - 1)
    if usable < 1:
        raise ValueError("a class has a single row: sample more of it before rebalancing")
    return usable


def oversample(df: DataFrame, row_id: str, label: str, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Grow every class to the size of the largest with interpolated rows.

    Each row of a class gets an equal number of synthetic rows, the remainder
    going to the first rows in hash order.  A synthetic row lies at a
    reproducible point between its base row and one of the base row's k nearest
    neighbours of the same class.  Returns (row_id as string, label, features…,
    synthetic, base_id, neighbor_id).  Only classes below the largest size take
    part in the neighbour search, so the dominant class is never shuffled.
    """
    histogram = materialise(class_histogram(df, label), "classes")
    largest, smallest, rows, classes = histogram.agg(F.max("n"), F.min("n"), F.sum("n"), F.count("*")).first()
    if not classes:
        largest = smallest = rows = 2
    k = neighbor_count(smallest, k)
    created = largest * classes - rows if classes else 0
    id_type = df.schema[row_id].dataType.simpleString()
    originals = df.select(named(row_id).cast("string").alias(row_id), named(label).alias(label),
                          *[named(f).cast("double").alias(f) for f in features], F.lit(False).alias("synthetic"),
                          F.lit(None).cast(id_type).alias("base_id"), F.lit(None).cast(id_type).alias("neighbor_id"))
    if created == 0:
        return originals
    minority = small_table(histogram.filter(F.col("n") < largest))
    lacking = join_on(df.select(named(row_id), named(label), *[named(f) for f in features]), minority, [label])
    slots = take_slots(lacking, [row_id], f"{seed}:grow", [label],
                       single_quota(F.pmod(F.lit(largest) - F.col("n"), F.col("n"))), "_slot")
    share = F.floor((F.lit(largest) - F.col("n")) / F.col("n")).cast("bigint")
    bases = slots.select(named(row_id), named(label), F.array(*[named(f).cast("double") for f in features]).alias("_x"),
                         (share + F.when(F.col("_slot") == 0, 1).otherwise(0)).alias("_copies"))
    near = nearest_neighbors(lacking, row_id, features, k, within=label, vectors=True).select(row_id, "neighbors")
    ready = bases.join(near, row_id).filter(F.col("_copies") > 0)

    # Expand in two steps with a shuffle in between: a lone rare row may have to
    # produce as many rows as the largest class has.
    tasks = max(1, -(-created // TASK_ROWS))
    started = ready.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1,
                                                             F.lit(EXPAND_ROWS).cast("bigint"))))
    spread = started.repartition(int(tasks), row_id, "_from") if tasks > 1 else started
    last = F.least(F.col("_from") + EXPAND_ROWS, F.col("_copies")) - 1
    drawn = (spread.withColumn("_copy", F.explode(F.sequence("_from", last)))
             .withColumn("_key", hash_key(f"{seed}:point", row_id, "_copy"))
             .withColumn("_n", F.element_at("neighbors", hash_modulo(F.col("_key"), F.size("neighbors")).cast("int") + 1))
             .withColumn("_u", unit_interval(F.substring("_key", 9, 8)))
             .withColumn("_new", F.zip_with("_x", F.col("_n")["vec"], lambda a, b: a + F.col("_u") * (b - a))))
    synthetic = drawn.select(
        F.concat_ws("#", named(row_id).cast("string"), F.col("_copy").cast("string")).alias(row_id), named(label).alias(label),
        *[F.col("_new")[i].alias(f) for i, f in enumerate(features)], F.lit(True).alias("synthetic"),
        named(row_id).alias("base_id"), F.col("_n")["id"].alias("neighbor_id"))
    return originals.unionByName(synthetic)


def _with_agreement(df: DataFrame, row_id: str, label: str, features: list[str] | str, k: int) -> DataFrame:
    """All columns plus n_neighbors and n_same; one join on the row id."""
    owned = df.withColumn("_own", class_key(named(label)))
    near = nearest_neighbors(owned, row_id, features, k, label="_own")
    same = F.size(F.filter("neighbors", lambda e: e["label"] == F.col("_own")))
    return (owned.join(near, row_id).withColumn("n_neighbors", F.size("neighbors")).withColumn("n_same", same)
            .drop("_own", "neighbors"))


def neighbor_agreement(df: DataFrame, row_id: str, label: str, features: list[str] | str, k: int = 3) -> DataFrame:
    """(row_id, label, n_neighbors, n_same): how many of the k nearest share the class."""
    return _with_agreement(df, row_id, label, features, k).select(row_id, label, "n_neighbors", "n_same")


def edit_neighbors(df: DataFrame, row_id: str, label: str, features: list[str] | str, k: int = 3) -> DataFrame:
    """Drop every row whose k nearest neighbours do not all share its class."""
    agreed = _with_agreement(df, row_id, label, features, k).filter(F.col("n_same") == F.col("n_neighbors"))
    return agreed.select(*[named(c) for c in df.columns])


def oversample_and_edit(df: DataFrame, row_id: str, label: str, features: list[str], k: int = 5,
                        edit_k: int = 3, seed: int = 42) -> DataFrame:
    """Oversample all classes, then edit the result."""
    grown = materialise(oversample(df, row_id, label, features, k, seed), "grown")
    return edit_neighbors(grown, row_id, label, features, edit_k)
