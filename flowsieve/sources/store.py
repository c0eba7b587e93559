"""Stored feature sets, reports, models, trials and cached steps."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIALS_SCHEMA = "model string, trial int, chunk int, params map<string,double>, loss double"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def save_split(df: DataFrame, path: str, split: str = "split") -> None:
    """Store features, code and id in one row, one folder per part."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def load_split(spark: SparkSession, path: str, part: str | None = None, split: str = "split") -> DataFrame:
    """Load a stored set; naming a part prunes the other folder."""
    df = spark.read.parquet(path)
    return df if part is None else df.filter(F.col(split) == part).drop(split)


def fingerprint(*parts) -> str:
    """Stable digest of whatever a cached step depends on."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


MANIFEST = "_manifest"


def commit(spark: SparkSession, df: DataFrame, path: str, **facts) -> bool:
    """Store ``df`` as the folder ``path``, whole or not at all; False if another writer was first.

    The rows are written aside, a manifest of their files and of ``facts`` is added, and the folder is renamed.
    A rename that finds its target there fails, so of several drivers one wins and the others drop what they
    wrote.  A driver lost on the way leaves a hidden folder beside the target, which no read looks at.
    """
    jvm = spark._jvm
    parent, name = path.rstrip("/").rsplit("/", 1)
    aside = jvm.org.apache.hadoop.fs.Path(f"{parent}/_writing-{name}-{uuid.uuid4().hex}")
    target = jvm.org.apache.hadoop.fs.Path(path)
    configuration = spark._jsc.hadoopConfiguration()
    system = target.getFileSystem(configuration)
    df.write.parquet(aside.toString())
    files = sorted((f.getPath().getName(), f.getLen()) for f in system.listStatus(aside) if f.getPath().getName().endswith(".parquet"))
    stream = system.create(jvm.org.apache.hadoop.fs.Path(aside, MANIFEST))
    try:
        stream.write(bytearray(json.dumps({"files": files, **facts}, sort_keys=True).encode()))
    finally:
        stream.close()
    none = SparkContext.getOrCreate()._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), configuration).rename(aside, target, none)
    except Py4JJavaError:
        system.delete(aside, True)
        if not committed(spark, path):
            raise
        return False
    return True


def committed(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds all the files its manifest lists, in their sizes."""
    if not path_exists(spark, f"{path}/{MANIFEST}"):
        return False
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {f.getPath().getName(): f.getLen() for f in system.listStatus(folder)}
    stream = system.open(jvm.org.apache.hadoop.fs.Path(folder, MANIFEST))
    try:
        content = bytes(stream.readAllBytes())
    finally:
        stream.close()
    return all(there.get(name) == size for name, size in json.loads(content)["files"])


def load_or_compute(spark: SparkSession, root: str, name: str, key: str,
                    compute: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a stored result of the same fingerprint, else compute and store it.

    A result counts as stored once it is committed with its manifest, so a job lost half-way is computed again.
    Of two drivers that compute it at once both return what the first one stored.
    """
    path = f"{root.rstrip('/')}/{name}-{key}"
    if not committed(spark, path):
        commit(spark, compute(), path, key=key)
    return spark.read.parquet(path)


def save_report_csv(report: DataFrame, path: str) -> None:
    """One row per class or average, one column per metric."""
    report.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def save_report_json(report: DataFrame, path: str, model: str, class_column: str = "class") -> None:
    """One document per model: class -> metrics, and the overall metrics."""
    metrics = [c for c in report.columns if c not in ("model", class_column)]
    entry = F.struct(F.col(class_column).alias("key"), F.struct(*metrics).alias("value"))
    nested = report.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("classification_report"))
    nested.select(F.lit(model).alias("model"), "classification_report").coalesce(1).write.mode("overwrite").json(path)


def append_trial(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Add finished trials to a log.  Each is committed once by model and number; a second try changes nothing."""
    for row in rows:
        commit(spark, spark.createDataFrame([row], TRIALS_SCHEMA).coalesce(1), f"{path.rstrip('/')}/{row[0]}-{row[1]:06d}")


def load_trials(spark: SparkSession, path: str) -> DataFrame:
    """The trials committed so far, one row each; an empty table before the first."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], TRIALS_SCHEMA)
    return (spark.read.schema(TRIALS_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
            .dropDuplicates(["model", "trial"]))


def resume_point(trials: DataFrame, chunks: int) -> DataFrame:
    """(model, completed, next_trial, next_chunk) to continue a search from."""
    last = F.max("trial")
    return trials.groupBy("model").agg(F.count("*").alias("completed"), (last + 1).alias("next_trial"),
                                       F.pmod(last + 1, F.lit(chunks)).cast("int").alias("next_chunk"))


def best_params(trials: DataFrame) -> DataFrame:
    """(model, trial, loss, params) of the lowest loss; the earlier trial on ties."""
    best = F.min_by(F.struct("trial", "loss", "params"), F.struct("loss", "trial"))
    return trials.groupBy("model").agg(best.alias("b")).select("model", "b.trial", "b.loss", "b.params")


def save_best_params(best: DataFrame, path: str) -> None:
    best.select("model", "trial", "loss", F.to_json("params").alias("params")).coalesce(1).write.mode("overwrite").json(path)


def load_best_params(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored parameters, or None if there are none or they do not parse."""
    if not path_exists(spark, path):
        return None
    raw = spark.read.schema("model string, trial int, loss double, params string").json(path)
    parsed = raw.withColumn("params", F.from_json("params", "map<string,double>"))
    return None if parsed.filter(F.col("model").isNull() | F.col("params").isNull()).head(1) else parsed


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    """A stored model of any slot: forest, boosted or one boosted model per class.

    The class is read from the stored metadata.
    """
    return DefaultParamsReader.loadParamsInstance(path, SparkContext.getOrCreate())
