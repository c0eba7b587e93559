"""Exact k nearest neighbours of every row, within a class or over all rows.

Method: pivot-based partitioning (Lu et al., "Efficient processing of k nearest
neighbor joins using MapReduce", 2012) over vector approximations (Weber, Schek
and Blott, "A quantitative analysis and performance study for similarity-search
methods in high-dimensional spaces", 1998), written as Spark jobs.

1. Identical vectors are folded into one unit that keeps its k+1 lowest ids; no
   other copy can be among anyone's k nearest.  The fold is a rank limit that
   Spark applies before the shuffle, so a hot group of copies never travels.
2. Classes that fit a block are compared whole.  Units of larger ones go to the
   cell of their nearest pivot; cells above a block size are split by hash, so no
   task sees more than about one block.  Large classes beyond the number of pivots
   are one cell each.
3. Searching the own block bounds the distance of the k-th neighbour.  A block
   asks the other blocks of those cells only that the triangle inequality or the
   bisecting plane leaves room for inside that bound.
4. What is asked are codes: a byte a dimension, with the distance between a
   vector and the point its code stands for.  The distance to that point, less and
   plus the stored one, bounds the true distance from both sides.  A task takes
   one block of vectors and DEAL blocks of codes, keeps the k+1 lowest upper
   bounds and sends off only the ids whose lower bound is not above them.
5. Vectors of those ids are fetched, and the exact distances ranked.

Where vectors have structure few blocks are asked.  Where they have none, the
comparisons grow with the square of the units, as any exact method's do, but the
rows written do not: (units / block)^2 rows name blocks, and a unit has about k+1
surviving ids per DEAL blocks of codes.

Neighbours are ordered by distance rounded to 9 decimals, then by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.bounded import materialise, small_table
from flowsieve.functions.ordered import RANGE, RANGE_ROWS, with_ranges
from flowsieve.functions.scalar import hash_key, hash_modulo, named
from flowsieve.functions.shipping import ship_package
from flowsieve.operators.sample import first_rows

BLOCK_ROWS = 2048      # units a task compares with at once, up to
WIDE_ROWS = 8192       # this many where there are enough for all cores
MAX_PIVOTS = 65_536    # over all classes
PIVOT_BYTES = 64 << 20 # with the line above, bounds what every task holds
DEAL = 32              # blocks of codes a task compares a block of vectors with
MAX_TASKS = 20_000     # tasks that blocks of vectors meet blocks of codes in
HELD = 500_000         # distances a task computes at once, and candidates it keeps before it goes through them again
SLACK = 2e-9           # twice the rounding step of distances
INNER_MARKS = 127      # marks of a dimension at equal shares of units, and as many at equal steps


def nearest_ids(queries, points, id_ranks, offsets, count, limit=None):
    """Flat (query, point, id position, distance) of the nearest ids per query.

    ``id_ranks[offsets[p]:offsets[p + 1]]`` orders the ids of point ``p``.  A
    matrix product selects candidates with room for its rounding error; their
    distances are then computed directly.
    """
    dims = points.shape[1]
    centre = points.mean(axis=0)
    x = points - centre
    x_norm = np.einsum("ij,ij->i", x, x)
    keep = min(count, len(points))
    step = max(1, HELD // max(1, len(points)))
    found = []
    for start in range(0, len(queries), step):
        part = queries[start:start + step]
        q = part - centre
        q_norm = np.einsum("ij,ij->i", q, q)
        rough = np.maximum(q_norm[:, None] + x_norm[None, :] - 2.0 * (q @ x.T), 0.0)
        reach = np.partition(rough, keep - 1, axis=1)[:, keep - 1]
        if len(points) < count:
            reach = np.full(len(part), np.inf)
        if limit is not None:
            bound = limit[start:start + step]
            reach = np.minimum(reach, np.square(bound + SLACK))
        error = 1e-14 * (dims + 4) * (q_norm + x_norm.max())
        reach = reach + 2 * error + 4 * SLACK * np.sqrt(reach) + SLACK * SLACK
        rows, cols = np.nonzero(rough <= reach[:, None])
        if not len(rows):
            continue
        gaps = part[rows] - points[cols]
        dist = np.round(np.sqrt(np.einsum("ij,ij->i", gaps, gaps)), 9)
        sizes = offsets[cols + 1] - offsets[cols]
        flat = np.repeat(np.arange(len(rows)), sizes)
        position = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[cols][flat]
        rows, cols, dist = rows[flat], cols[flat], dist[flat]
        order = np.lexsort((id_ranks[position], dist, rows))
        rows, cols, dist, position = rows[order], cols[order], dist[order], position[order]
        begin = np.searchsorted(rows, rows, side="left")
        best = np.arange(len(rows)) - begin < count
        found.append((rows[best] + start, cols[best], position[best], dist[best]))
    if not found:
        nothing = np.empty(0, dtype=np.int64)
        return nothing, nothing, nothing, np.empty(0)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _unpack(pdf):
    """Matrix, flat ids, flat labels and offsets of a block of units."""
    matrix = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
    sizes = pdf["ids"].map(len).to_numpy()
    ids = np.concatenate([np.asarray(v) for v in pdf["ids"]])
    labels = np.concatenate([np.asarray(v) for v in pdf["labels"]])
    ranks = np.unique(ids, return_inverse=True)[1]
    return matrix, ids, labels, ranks, np.concatenate([[0], np.cumsum(sizes)])


class _Cells:
    """Pivots with the class, size and radii of their cells; bounded by PIVOT_BYTES.

    Squared distances come from matrix products.  ``error`` bounds their rounding
    and is taken off every bound, so pruning stays exact.
    """

    def __init__(self, classes, matrix):
        self.classes, self.matrix = classes, matrix
        self.centre = matrix.mean(axis=0)
        self.moved = matrix - self.centre
        self.norms = np.einsum("ij,ij->i", self.moved, self.moved)
        self.members = {c: np.nonzero(classes == c)[0] for c in set(classes)}
        self.size = self.low = self.high = None

    def squares(self, vectors, cells):
        """Squared distances to the pivots of ``cells`` and the bound of their error."""
        x = vectors - self.centre
        norms = np.einsum("ij,ij->i", x, x)
        square = np.maximum(norms[:, None] + self.norms[cells][None, :] - 2.0 * (x @ self.moved[cells].T), 0.0)
        return square, 4e-15 * (x.shape[1] + 4) * (norms.max() + self.norms[cells].max())

    def nearest(self, vectors, cls):
        """Cell and radius of every row of one class."""
        cells = self.members[cls]
        cell, radius = np.empty(len(vectors), dtype=np.int32), np.empty(len(vectors))
        step = max(1, HELD // len(cells))
        for s in range(0, len(vectors), step):
            best = self.squares(vectors[s:s + step], cells)[0].argmin(axis=1)
            cell[s:s + step] = cells[best]
            gaps = vectors[s:s + step] - self.matrix[cells[best]]
            radius[s:s + step] = np.sqrt(np.einsum("ij,ij->i", gaps, gaps))
        return cell, radius

    def visits(self, vectors, own, reach, ids_needed):
        """All cells that may hold rows within reach of a row of cell ``own``, ascending."""
        cells = self.members[self.classes[own]]
        size, low, high = self.size[cells], self.low[cells], self.high[cells]
        between = np.linalg.norm(self.matrix[cells] - self.matrix[own], axis=1)
        mine = np.nonzero(cells == own)[0][0]
        step = max(1, HELD // len(cells))
        asked = np.zeros(len(cells), dtype=bool)
        for s in range(0, len(vectors), step):
            square, error = self.squares(vectors[s:s + step], cells)
            gap, margin = np.sqrt(square), np.sqrt(error)
            far = gap + high + margin
            bound = np.minimum(reach[s:s + step], np.where(size >= ids_needed, far, np.inf).min(axis=1))
            if len(cells) >= ids_needed:
                bound = np.minimum(bound, np.partition(far, ids_needed - 1, axis=1)[:, ids_needed - 1])
            lower = np.maximum(gap - high, low - gap) - margin
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (square - square[:, [mine]] - 4 * error) / (2 * between)
            plane[:, between == 0] = -np.inf
            lower = np.maximum(lower, plane)
            asked |= ((lower * (1 - 1e-12) <= bound[:, None] + SLACK) & (size > 0)).any(axis=0)
        return np.sort(cells[asked])


def class_key(col: Column) -> Column:
    """A class as non-null text that tells a missing class from an empty one."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def nearest_neighbors(df: DataFrame, row_id: str, features: list[str] | str, k: int, within: str | None = None,
                      label: str | None = None, vectors: bool = False, block_rows: int | None = None,
                      max_pivots: int = MAX_PIVOTS, deal: int = DEAL) -> DataFrame:
    """(row_id, [within], neighbors): the k nearest other rows of every row.

    ``features`` is a list of numeric columns or one array column.  ``neighbors``
    is an array of (dist, id, label[, vec]) ordered by distance, then id.  With
    ``within``, only rows of the same class are neighbours.  ``label`` is carried
    along for the neighbours.
    """
    ship_package(df.sparkSession)
    vec = (named(features) if isinstance(features, str) else F.array(*[named(f) for f in features])).cast("array<double>")
    cls = class_key(named(within)) if within else F.lit("")
    payload = named(label).cast("string") if label else F.lit("")
    base = df.select(named(row_id).alias("id"), cls.alias("cls"), vec.alias("vec"),
                     F.coalesce(payload, F.lit("")).alias("label"))
    units = materialise(_fold_copies(base, k), "units")
    id_type = base.schema["id"].dataType.simpleString()

    single = not isinstance(features, str) and len(features) == 1
    candidates = _on_a_line(units, k) if single else None
    if candidates is None:
        if block_rows is None:
            block_rows = min(WIDE_ROWS, max(BLOCK_ROWS, units.count() // (4 * df.sparkSession.sparkContext.defaultParallelism)))
        assigned, cells = _in_blocks(units, block_rows, max_pivots)
        candidates = _search(assigned, cells, k, id_type, deal)
    else:
        assigned = units

    best = F.row_number().over(W.partitionBy("uid").orderBy("dist", "nid"))
    closest = candidates.withColumn("_place", best).filter(F.col("_place") <= k + 1).drop("_place")
    if vectors:
        reps = assigned.select("vec", F.explode("ids").alias("nid")).withColumnRenamed("vec", "nvec")
        closest = closest.join(reps, "nid")
    entry = F.struct("dist", F.col("nid").alias("id"), F.col("nlabel").alias("label"),
                     *([F.col("nvec").alias("vec")] if vectors else []))
    lists = closest.groupBy("uid").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    members = units.select("cls", F.col("ids")[0].alias("uid"), F.explode("ids").alias("id"))
    own = members.join(lists, "uid").select(
        "id", "cls", F.slice(F.filter("_all", lambda e: e["id"] != F.col("id")), 1, k).alias("neighbors"))
    result = own.unionByName(_copies(base, units, k, vectors)) if _has_full_units(units, k) else own
    named_result = result.withColumnRenamed("id", row_id)
    if not within:
        return named_result.drop("cls")
    own_class = F.when(F.col("cls") != "", F.substring("cls", 2, 1 << 30))
    return named_result.withColumn("cls", own_class).withColumnRenamed("cls", within)


def _on_a_line(units: DataFrame, k: int, range_rows: int = RANGE_ROWS) -> DataFrame | None:
    """(uid, dist, nid, nlabel) of a single feature: the nearest stand next to each other in value order.

    Windows look k + 1 units to either side inside value ranges of bounded size; a range also gets the units next
    to it.  Distances are rounded, so units beyond the window might tie with the last one needed: then None is
    returned and the search in cells takes over.
    """
    count = k + 1
    slim = materialise(units.select("cls", F.col("vec")[0].alias("v"), F.col("ids")[0].alias("uid"), "ids", "labels"), "line")
    ranged = with_ranges(slim, "v", range_rows=range_rows)
    groups = ["cls"]
    ranged = ranged.withColumn("_pad", F.lit(False))
    if RANGE in ranged.columns:
        groups.append(RANGE)
        inside = W.partitionBy(*groups)
        ends = (ranged.withColumn("_a", F.row_number().over(inside.orderBy("v"))).withColumn("_b", F.row_number().over(inside.orderBy(F.desc("v"))))
                .filter((F.col("_a") <= count) | (F.col("_b") <= count)))
        # A few units per range and class, so a class's ends stand in one window.
        unit = F.struct("v", "uid", "ids", "labels")
        across = W.partitionBy("cls").orderBy("v")
        ends = ends.withColumn("_before", F.collect_list(unit).over(across.rowsBetween(-count, -1))).withColumn(
            "_after", F.collect_list(unit).over(across.rowsBetween(1, count)))
        sides = [ends.filter(F.col("_a") == 1).select(*groups, F.explode("_before").alias("u")),
                 ends.filter(F.col("_b") == 1).select(*groups, F.explode("_after").alias("u"))]
        pads = sides[0].unionByName(sides[1]).select(*groups, "u.*").withColumn("_pad", F.lit(True))
        ranged = ranged.unionByName(pads)
    order = W.partitionBy(*groups).orderBy("v")
    listed = F.struct("v", "ids", "labels")
    near = ranged.withColumn("_low", F.collect_list(listed).over(order.rowsBetween(-count, -1))).withColumn(
        "_high", F.collect_list(listed).over(order.rowsBetween(0, count))).filter(~F.col("_pad"))
    units_near = near.select("uid", "v", "_low", "_high", F.explode(F.concat("_low", "_high")).alias("u"))
    each = units_near.select("uid", F.round(F.abs(F.col("u.v") - F.col("v")), 9).alias("dist"), F.inline(F.arrays_zip(
        F.col("u.ids").alias("nid"), F.col("u.labels").alias("nlabel"))))
    candidates = materialise(each, "near")
    rank = F.row_number().over(W.partitionBy("uid").orderBy("dist", "nid"))
    last = candidates.withColumn("_place", rank).filter(F.col("_place") == count).select("uid", F.col("dist").alias("_last"))
    edge = near.select("uid", F.when(F.size("_low") == count, F.round(F.col("v") - F.col("_low")[0]["v"], 9)).alias("_left"),
                       F.when(F.size("_high") == count + 1, F.round(F.col("_high")[count]["v"] - F.col("v"), 9)).alias("_right"))
    tied = edge.join(last, "uid").filter((F.col("_left") <= F.col("_last")) | (F.col("_right") <= F.col("_last")))
    return None if tied.limit(1).count() else candidates


def _fold_copies(base: DataFrame, k: int) -> DataFrame:
    """(cls, vec, ids, labels): distinct vectors with their k+1 lowest ids."""
    place = F.row_number().over(W.partitionBy("cls", "vec").orderBy("id"))
    lowest = base.withColumn("_place", place).filter(F.col("_place") <= k + 1)
    listed = lowest.groupBy("cls", "vec").agg(F.sort_array(F.collect_list(F.struct("id", "label"))).alias("_ids"))
    return listed.select("cls", "vec", F.transform("_ids", lambda s: s["id"]).alias("ids"),
                         F.transform("_ids", lambda s: s["label"]).alias("labels"))


def _has_full_units(units: DataFrame, k: int) -> bool:
    """Whether any vector has k+1 or more copies, so some rows were folded away."""
    return bool(units.filter(F.size("ids") > k).limit(1).count())


def _copies(base: DataFrame, units: DataFrame, k: int, vectors: bool) -> DataFrame:
    """Rows folded away: their neighbours are the k lowest copies, at distance 0."""
    full = small_table(units.filter(F.size("ids") > k))
    heads = full.withColumn("_last", F.col("ids")[k]).select(
        "cls", "vec", "_last", F.slice(F.arrays_zip("ids", "labels"), 1, k).alias("_head"))
    joined = base.join(heads, ["cls", "vec"]).filter(F.col("id") > F.col("_last"))
    entries = F.transform("_head", lambda p: F.struct(
        F.lit(0.0).alias("dist"), p["ids"].alias("id"), p["labels"].alias("label"), *([F.col("vec").alias("vec")] if vectors else [])))
    return joined.select("id", "cls", entries.alias("neighbors"))


def _choose_pivots(units: DataFrame, large: DataFrame, block_rows: int, max_pivots: int) -> _Cells:
    """One pivot per block of units of the ``large`` classes, taken by hash; shared out when over the maximum.

    Above the maximum of classes the largest get the pivots.
    """
    first = units.head(1)
    if not first:
        return _Cells(np.empty(0, dtype=object), np.zeros((1, 1)))
    limit = max(1, min(max_pivots, PIVOT_BYTES // (8 * max(1, len(first[0]["vec"])))))
    chosen = small_table(large.orderBy(F.desc("n"), "cls").limit(max(1, limit // 2)).select("cls"))

    def shares(counts):
        total = F.sum("n").over(W.partitionBy())  # one row per chosen class
        share = F.ceil(F.col("n") / F.lit(float(block_rows)))
        fair = F.ceil(F.col("n") * F.lit(float(limit)) / total)
        return counts.withColumn("slot", F.lit(0)).withColumn("rank", F.least(share, fair).cast("bigint"))

    keyed = units.join(chosen, "cls").select("cls", "vec", F.col("ids")[0].alias("_first"))
    # At most two pivots per chosen class above the limit, from rounding shares up.
    fetched = first_rows(keyed, ["_first"], "pivot", ["cls"], shares).select("cls", "vec").toArrow()
    if not fetched.num_rows:
        return _Cells(np.empty(0, dtype=object), np.zeros((1, len(first[0]["vec"]))))
    return _Cells(np.array(fetched.column("cls").to_pylist(), dtype=object),
                  np.array(fetched.column("vec").to_pylist(), dtype=np.float64))


class _Codes:
    """Marks that cut every dimension, and the points that codes stand for."""

    def __init__(self, marks: list[np.ndarray]):
        self.marks = marks
        self.middles = [(m[1:] + m[:-1]) / 2 for m in marks]

    def encode(self, vectors):
        """A byte a dimension, and the distance of every vector from the point its bytes stand for."""
        codes = np.empty(vectors.shape, dtype=np.uint8)
        for j, marks in enumerate(self.marks):
            codes[:, j] = np.searchsorted(marks[1:-1], vectors[:, j], side="right")
        return codes, np.linalg.norm(vectors - self.points(codes), axis=1) * (1 + 1e-12)

    def points(self, codes):
        return np.stack([middles[codes[:, j]] for j, middles in enumerate(self.middles)], axis=1)


def _choose_marks(units: DataFrame, dims: int) -> _Codes:
    """Marks at equal shares of the units and at equal steps, so that neither outliers nor dense places blur all codes."""
    shares = [i / (INNER_MARKS + 1) for i in range(1, INNER_MARKS + 1)]
    value = [F.col("vec")[j] for j in range(dims)]
    row = units.agg(*[F.struct(F.min(v).alias("low"), F.max(v).alias("high"), F.percentile_approx(v, shares, 1000).alias("inner")).alias(f"d{j}")
                      for j, v in enumerate(value)]).first()
    return _Codes([np.unique(np.concatenate([[d["low"], d["high"]], d["inner"], np.linspace(d["low"], d["high"], INNER_MARKS + 2)]))
                   if d["low"] < d["high"] else np.array([d["low"], d["low"]], dtype=float) for d in row])


def _in_blocks(units: DataFrame, block_rows: int, max_pivots: int) -> tuple[DataFrame, _Cells]:
    """Units with uid, cell, radius and block, and the cells' statistics; cell -1 is a class without pivots."""
    sizes = materialise(units.groupBy("cls").agg(F.count("*").alias("n")), "classes")
    large = sizes.filter(F.col("n") > block_rows)
    cells = _choose_pivots(units, large, block_rows, max_pivots)
    schema = T.StructType([*units.schema.fields, T.StructField("uid", units.schema["ids"].dataType.elementType),
                           T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])

    shared = units.sparkSession.sparkContext.broadcast(cells)

    def nearest_pivot(batches):
        pivots = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            vecs = np.stack(pdf["vec"].to_numpy())
            cell, radius = np.full(len(pdf), -1, dtype=np.int32), np.zeros(len(pdf))
            for c, rows in pdf.groupby("cls").indices.items():
                if c in pivots.members:
                    cell[rows], radius[rows] = pivots.nearest(vecs[rows], c)
            yield pdf.assign(uid=pdf["ids"].map(lambda v: v[0]), cell=cell, radius=radius)

    assigned = materialise(units.mapInPandas(nearest_pivot, schema), "cells")
    stats = assigned.filter("cell >= 0").groupBy("cell").agg(F.sum(F.size("ids")).alias("ids"), F.min("radius").alias("low"),
                                                             F.max("radius").alias("high")).toPandas()
    number = len(cells.classes)
    cells.size, cells.low, cells.high = np.zeros(number), np.full(number, np.inf), np.full(number, np.inf)
    at = stats["cell"].to_numpy(dtype=np.int64)
    cells.size[at], cells.low[at], cells.high[at] = stats["ids"], stats["low"], stats["high"]
    counts = small_table(assigned.groupBy("cls", "cell").agg(F.ceil(F.count("*") / F.lit(float(block_rows))).alias("_blocks")))
    blocks = hash_modulo(hash_key("block", "uid"), F.col("_blocks")).cast("int")
    return assigned.join(counts, ["cls", "cell"]).withColumn("block", blocks).drop("_blocks"), cells


def _search(assigned: DataFrame, cells: _Cells, k: int, id_type: str, deal: int) -> DataFrame:
    """(uid, dist, nid, nlabel) candidates from all blocks that may matter."""
    count = k + 1
    flat = f"uid {id_type}, dist double, nid {id_type}, nlabel string"
    keys = ["cls", "cell", "block"]

    def own_block(pdf):
        matrix, ids, labels, ranks, offsets = _unpack(pdf)
        rows, _, position, dist = nearest_ids(matrix, matrix, ranks, offsets, count)
        uid = pdf["uid"].to_numpy()
        return pd.DataFrame({"uid": uid[rows], "dist": dist, "nid": ids[position], "nlabel": labels[position]})

    first = assigned.groupBy(*keys).applyInPandas(own_block, flat)
    # A class in several blocks: its blocks have something to ask each other.
    several = assigned.groupBy("cls").agg(F.count_distinct("cell", "block").alias("_n")).filter("_n > 1").select("cls")
    several = small_table(materialise(several, "large"))
    if not several.head(1):
        return first
    first = materialise(first, "near")
    reach = first.groupBy("uid").agg(F.max("dist").alias("dist"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= count, F.col("dist")).otherwise(F.lit(float("inf")))
    asking = assigned.join(several, "cls").join(reach.select("uid", bound.alias("reach")), "uid")
    dims = len(assigned.head(1)[0]["vec"])
    shared = assigned.sparkSession.sparkContext.broadcast((cells, _choose_marks(assigned.join(several, "cls"), dims)))

    def pack(pdf):
        """One row per block: its vectors, its codes and how far these may be off, and the cells its units have to ask."""
        pivots, codes = shared.value
        pdf = pdf.sort_values("uid", ignore_index=True)
        vecs, own = np.stack(pdf["vec"].to_numpy()).astype(np.float64), int(pdf["cell"].iloc[0])
        bytes_, slips = codes.encode(vecs)
        reach = pdf["reach"].to_numpy(dtype=np.float64)
        asked = np.array([-1]) if own < 0 else pivots.visits(vecs, own, reach, count)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "uids": [pdf["uid"].tolist()], "vecs": [vecs.tobytes()],
                             "reach": [reach.tobytes()], "codes": [bytes_.tobytes()], "slips": [slips.tobytes()], "asked": [asked.tolist()]})

    packed = materialise(asking.select(*keys, "uid", "vec", "reach").groupBy(*keys).applyInPandas(
        pack, f"cls string, cell int, block int, uids array<{id_type}>, vecs binary, reach binary, codes binary, slips binary, asked array<int>"), "packed")
    guests = packed.select(F.concat_ws(":", F.md5("cls"), "cell", "block").alias("guest"), "cls", F.explode("asked").alias("cell"),
                           F.col("cell").alias("_own"), F.col("block").alias("_block"))
    names = packed.select(*keys)
    pairs = guests.join(names, ["cls", "cell"]).filter((F.col("cell") != F.col("_own")) | (F.col("block") != F.col("_block")))
    # Nearby cells are often numbered far apart; any order of a guest's hosts gives the same result.
    place = F.row_number().over(W.partitionBy("guest").orderBy("cell", "block")) - 1
    visits = materialise(pairs.select("guest", *keys, F.floor(place / deal).cast("int").alias("deal")), "visits")
    hosts = visits.join(packed.select(*keys, F.col("uids").alias("nuids"), "codes", "slips"), keys).drop(*keys)
    asked = visits.select(F.col("guest").alias("asker"), F.col("deal").alias("turn")).distinct()
    asks = asked.join(packed.select(F.concat_ws(":", F.md5("cls"), "cell", "block").alias("asker"), "uids", "vecs", "reach"), "asker")

    def visit(guest, host):
        empty = pd.DataFrame({"uid": [], "nuid": [], "lower": [], "upper": []})
        if guest.empty or host.empty:
            return empty
        codes = shared.value[1]
        row = guest.iloc[0]
        asked = np.frombuffer(row["vecs"]).reshape(-1, dims)
        rows, uids, lower, upper = surviving(asked, np.frombuffer(row["reach"]), (
            (codes.points(np.frombuffer(c, dtype=np.uint8).reshape(-1, dims)), np.frombuffer(s), np.asarray(n))
            for c, s, n in zip(host["codes"], host["slips"], host["nuids"])), count)
        return pd.DataFrame({"uid": np.asarray(row["uids"])[rows], "nuid": uids, "lower": lower, "upper": upper}) if len(rows) else empty

    # Few bytes are much work here, so groups are not put together by their bytes.
    tasks = max(1, min(MAX_TASKS, asked.count()))
    found = asks.repartition(tasks, "asker", "turn").groupBy("asker", "turn").cogroup(
        hosts.repartition(tasks, "guest", "deal").groupBy("guest", "deal")).applyInPandas(
        visit, f"uid {id_type}, nuid {id_type}, lower double, upper double")
    found = materialise(found, "survivors")
    # The k+1 lowest upper bounds of all deals bound what has to be looked at.
    last = found.withColumn("_place", F.row_number().over(W.partitionBy("uid").orderBy("upper", "nuid"))).filter(F.col("_place") == count)
    kept = found.join(last.select("uid", F.col("upper").alias("_most")), "uid", "left").filter(
        F.col("_most").isNull() | (F.col("lower") <= F.col("_most") + SLACK)).select("uid", "nuid")
    points = assigned.select(F.col("uid").alias("nuid"), F.col("vec").alias("nvec"), "ids", "labels")
    fetched = kept.join(assigned.select("uid", "vec"), "uid").join(points, "nuid")

    def exact(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            gaps = np.stack(pdf["vec"].to_numpy()) - np.stack(pdf["nvec"].to_numpy())
            yield pdf[["uid", "ids", "labels"]].assign(dist=np.round(np.sqrt(np.einsum("ij,ij->i", gaps, gaps)), 9))

    second = fetched.mapInPandas(exact, f"uid {id_type}, ids array<{id_type}>, labels array<string>, dist double")
    return first.unionByName(second.select("uid", "dist", F.inline(F.arrays_zip(F.col("ids").alias("nid"), F.col("labels").alias("nlabel")))))


def _outside(vectors, others):
    """Distance of every vector from the box around the others, not above that from any of them."""
    gaps = np.maximum(np.maximum(others.min(axis=0) - vectors, vectors - others.max(axis=0)), 0.0)
    return np.sqrt(np.einsum("ij,ij->i", gaps, gaps)) * (1 - 1e-12)


def surviving(asked, reach, blocks, count):
    """(row, id, lower, upper) of all points that may be among the ``count`` nearest of the ``asked`` vectors.

    ``blocks`` yields (points, slips, ids): a true point is at most its slip away from the one given.
    """
    best = np.full((len(asked), count), np.inf)
    limit = np.array(reach, dtype=np.float64)
    norms = np.einsum("ij,ij->i", asked, asked)
    found, size, most_held = [], 0, HELD

    def near():
        """What was found and still is within the limits, which only fall."""
        rows, uids, lower, upper = (np.concatenate(c) for c in zip(*found))
        still = lower * (1 - 1e-12) <= limit[rows] + SLACK
        return rows[still], uids[still], lower[still], upper[still]

    for points, slips, ids in blocks:
        # Only what lies at the other side's border can be in reach of it.
        at = np.nonzero(_outside(asked, points) - slips.max() <= (limit + SLACK) * (1 + 1e-9))[0]
        if not len(at):
            continue
        most = limit[at].max() + SLACK
        border = np.nonzero(_outside(points, asked[at]) - slips <= most * (1 + 1e-9))[0]
        if not len(border):
            continue
        points, slips, ids = points[border], slips[border], ids[border]
        sizes = np.einsum("ij,ij->i", points, points)
        error = 1e-14 * (points.shape[1] + 4) * (norms.max() + sizes.max())
        step = max(1, HELD // len(points))
        for s in range(0, len(at), step):
            part = at[s:s + step]
            square = norms[part, None] + sizes[None, :] - 2.0 * (asked[part] @ points.T)
            upper = np.sqrt(np.maximum(square + error, 0.0)) + slips
            keep = min(count, len(points))
            lowest = np.partition(upper, keep - 1, axis=1)[:, :keep]
            best[part] = np.partition(np.concatenate([best[part], lowest], axis=1), count - 1, axis=1)[:, :count]
            limit[part] = np.minimum(limit[part], best[part].max(axis=1))
            lower = np.sqrt(np.maximum(square - error, 0.0)) - slips
            row, col = np.nonzero(lower * (1 - 1e-12) <= limit[part, None] + SLACK)
            found.append((part[row], ids[col], lower[row, col], upper[row, col]))
            size += len(row)
            if size > most_held:
                found = [near()]
                size = len(found[0][0])
                most_held = max(HELD, 2 * size)
    if not found:
        nothing = np.empty(0, dtype=np.int64)
        return nothing, nothing, np.empty(0), np.empty(0)
    return near()
