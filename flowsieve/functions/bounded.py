"""Size-checked small tables and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A fitted table of at most this many rows and bytes is copied to every executor.
SMALL_ROWS = 50_000
SMALL_BYTES = 32 << 20

# Rows of a partition that a learner trains on; a forest of 100 trees keeps some 560 bytes of each.
PART_ROWS = 200_000


def small_arrow(df: DataFrame, limit: int = SMALL_ROWS):
    """Arrow table of ``df`` if it has at most ``limit`` rows, else None."""
    fetched = df.limit(limit + 1).toArrow()
    return fetched if fetched.num_rows <= limit else None


def small_rows(df: DataFrame, limit: int = SMALL_ROWS):
    """Rows of ``df`` as dicts if it has at most ``limit`` of them, else None."""
    fetched = small_arrow(df, limit)
    return None if fetched is None else fetched.to_pylist()


def local_table(spark: SparkSession, fetched, schema) -> DataFrame:
    """A fetched small table as a local relation marked for broadcast."""
    return F.broadcast(spark.createDataFrame(fetched, schema))


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Materialise a fitted table and mark it for broadcast if it is small.

    A table above the limit comes back unchanged and unhinted, so joins against
    it are shuffled and left to adaptive skew handling.
    """
    fetched = small_arrow(df, limit)
    if fetched is None or fetched.nbytes > SMALL_BYTES:
        return df
    return local_table(df.sparkSession, fetched, df.schema)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join keeping the key columns of the left side."""
    renamed = right
    condition = None
    for i, key in enumerate(keys):
        renamed = renamed.withColumnRenamed(key, f"_right_{i}")
        term = left["`" + key.replace("`", "``") + "`"].eqNullSafe(F.col(f"_right_{i}"))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def work_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder; on a cluster executors would not share it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="flowsieve-")
        sc.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, inside one folder per application.

    Intermediate tables outlive the query that reads them; drop the folder
    ``flowsieve-<application id>`` once an application's results are stored.
    """
    application = spark.sparkContext.applicationId
    return f"{work_root(spark).rstrip('/')}/flowsieve-{application}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    The copy is on reliable storage, so losing executors costs no recomputation.
    With ``partition``, rows of one value share a folder and can be read alone.
    """
    path = work_path(df.sparkSession, name)
    writer = df.write if partition is None else df.write.partitionBy(partition)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def copy_stored(spark: SparkSession, source: str, target: str, parts: tuple[str, ...]) -> None:
    """Copy parts of a stored model from one folder to another."""
    jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
    for part in parts:
        own = jvm.org.apache.hadoop.fs.Path(f"{source}/{part}")
        system = own.getFileSystem(configuration)
        jvm.org.apache.hadoop.fs.FileUtil.copy(system, own, system, jvm.org.apache.hadoop.fs.Path(f"{target}/{part}"), False, configuration)


def hinted(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, and marked for broadcast if its measured strings and arrays leave it small.

    Unlike ``small_table`` its rows never pass through Python; above the limit the same join is shuffled.
    """
    stored = materialise(df, name)
    size = F.lit(0).cast("bigint")
    for column, kind in stored.dtypes:
        value = F.col("`" + column.replace("`", "``") + "`")
        own = F.octet_length(value) if kind in ("string", "binary") else 8 * F.size(value) if kind.startswith("array<") else F.lit(0)
        size = size + 16 + F.greatest(F.coalesce(own, F.lit(0)), F.lit(0))
    rows, total = stored.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(stored) if rows <= SMALL_ROWS and (total or 0) <= SMALL_BYTES else stored


_cleared = 0


def clearings() -> int:
    """How often intermediate tables were removed; what is remembered across queries is void after one."""
    return _cleared


def clear_work(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once its results are stored elsewhere.

    Frames that still read them fail afterwards.
    """
    global _cleared
    _cleared += 1
    folder = f"{work_root(spark).rstrip('/')}/flowsieve-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, order: str | None = None) -> DataFrame:
    """Partitions for iterative training: even, and of at most about PART_ROWS rows.

    Learners keep what they make of a partition's rows together and read it whole in one task.  Counting rows per
    partition reads no columns; a table that is already even and cut finely enough is returned as it is, without a
    shuffle.  With ``order``, a column of unique values, rows are dealt and sorted by it, so that fits repeat.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    loads = df.groupBy(F.spark_partition_id().alias("_part")).agg(F.count("*").alias("_n"))
    largest, total = loads.agg(F.max("_n"), F.sum("_n")).first()
    if not largest or (largest * width <= 2 * total and largest <= PART_ROWS):
        return df
    parts = max(width, -(-total // PART_ROWS))
    if order is None:
        return df.repartition(parts)
    key = "`" + order.replace("`", "``") + "`"
    return df.repartition(parts, key).sortWithinPartitions(key)
