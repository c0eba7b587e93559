"""Flow CSV folders: discovery, headers, landing and rejected rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.bounded import hinted, materialise, small_table
from flowsieve.functions.scalar import named, unique_names
from flowsieve.functions.shipping import ship_package

CSV_SUFFIX = "*.[cC][sS][vV]"
CORRUPT = "_corrupt"
HEADER_BYTES = 1 << 16
# Copies of one line written out by one input row.
COPY_ROWS = 10_000


def escape_glob(path: str) -> str:
    """Escape characters Hadoop would read as a pattern, such as brackets."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, length, file) of every CSV file; ``file`` names it as rows read from it do.  Contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", CSV_SUFFIX)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(escape_glob(folder)).select("path", "length", F.col("_metadata.file_path").alias("file"))


def read_text_csv(spark: SparkSession, folder: str, schema: T.StructType | None = None,
                  recursive: bool = False) -> DataFrame:
    """CSV folder with every column as text, plus the file each row came from.

    Without a schema the header of the first file names the columns; values are
    never inferred, so no extra pass over the data is made.  A file with another
    header ends the read with an error; ``read_flows`` takes those by name.
    """
    reader = spark.read.option("header", "true").option("pathGlobFilter", CSV_SUFFIX).option("enforceSchema", "false")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(escape_glob(folder))
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def file_headers(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(file, position, column, error): header names of every file.

    Tasks open the listed files and read only their first line.  A file that
    cannot be opened gives one row with ``error`` set instead of being skipped
    silently.
    """
    ship_package(spark)
    schema = "file string, position int, column string, error string"

    def first_lines(batches):
        import csv
        from urllib.parse import quote

        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, file in zip(batch["path"], batch["file"]):
                try:
                    local = re.match(r"file:/+(.*)", path)
                    if local:
                        system, name = fs.LocalFileSystem(), "/" + local.group(1)
                    else:
                        system, name = fs.FileSystem.from_uri(quote(path, safe="/:@"))
                    with system.open_input_stream(name) as stream:
                        head = b""
                        while b"\n" not in head:
                            part = stream.read(HEADER_BYTES)
                            if not part:
                                break
                            head += part
                    line = head.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")
                    if not line:
                        raise ValueError("empty file")
                    names = unique_names(c.strip() for c in next(csv.reader([line])))
                    rows.extend((file, i, c, None) for i, c in enumerate(names))
                except Exception as e:  # reported as a row
                    rows.append((file, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["file", "position", "column", "error"]).astype({"position": "Int32"})

    return list_files(spark, folder, recursive).select("path", "file").mapInPandas(first_lines, schema)


def header_union(headers: DataFrame) -> DataFrame:
    """(position, column): distinct header names in order of first appearance."""
    first = (headers.filter(F.col("column").isNotNull()).groupBy("column")
             .agg(F.min(F.struct("file", "position")).alias("first")))
    # One row per distinct header name.
    place = F.row_number().over(W.orderBy("first", "column")) - 1
    return first.select(place.cast("int").alias("position"), "column")


def headed_files(headers: DataFrame) -> DataFrame:
    """(file, columns): the header of every readable file."""
    listed = F.sort_array(F.collect_list(F.struct("position", "column")))  # one file's header
    return (headers.filter(F.col("column").isNotNull()).groupBy("file")
            .agg(F.transform(listed, lambda s: s["column"]).alias("columns")))


def file_layouts(headers: DataFrame) -> DataFrame:
    """(columns, n_files): distinct headers and how many files have them."""
    return headed_files(headers).groupBy("columns").agg(F.count("*").alias("n_files"))


def skipped_files(headers: DataFrame, label: str = "Label") -> DataFrame:
    """(file, reason) of files that cannot be used: unreadable or without label."""
    per_file = headers.groupBy("file").agg(F.max("error").alias("error"),
                                           F.max((F.col("column") == label).cast("int")).alias("has_label"))
    reason = F.coalesce("error", F.lit(f"no column {label}"))
    return (per_file.filter(F.col("error").isNotNull() | (F.coalesce("has_label", F.lit(0)) == 0))
            .select("file", reason.alias("reason")))


def has_line_breaks(spark: SparkSession, folder: str, recursive: bool = False) -> bool:
    """Whether a cell of any file goes on in the next line: some line then has an odd number of quotes.

    A scan of the folder as text without its lines leaving the engine.
    """
    reader = spark.read.option("pathGlobFilter", CSV_SUFFIX)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return bool(reader.text(escape_glob(folder)).agg(F.max(quotes % 2)).first()[0])


def cells_in(line: Column) -> Column:
    """Number of cells of a raw record; separators inside quotes do not count."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def read_flows(spark: SparkSession, folder: str, recursive: bool = False, label: str = "Label",
               headers: DataFrame | None = None, line_breaks: bool | None = None) -> DataFrame:
    """Union by name of all files that carry the label column, all text.

    One scan reads cells by position, whatever the files' headers; a join on the file's path tells which position
    holds which column, and only names of columns come to the driver.  ``headers`` may be passed if they are
    known.  Cells with line breaks are read whole, from files that are then not split; unless ``line_breaks`` says
    whether there are any, the folder is scanned for them first.  Columns a file lacks are null.  Adds
    ``source_file`` and ``_corrupt`` (the raw record of a row that does not fit its header).
    """
    known = materialise(headers if headers is not None else file_headers(spark, folder, recursive), "headers")
    usable = headed_files(known).filter(F.array_contains("columns", label)).withColumn("layout", F.md5(F.to_json("columns")))
    usable = materialise(usable, "usable")
    width = usable.agg(F.max(F.size("columns"))).first()[0]
    if width is None:
        raise ValueError(f"no CSV file with a column {label!r} under {folder}")
    names = [r["column"] for r in header_union(known.join(usable.select("file"), "file", "left_semi")).orderBy("position").collect()]
    place = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: (F.array_position("columns", n) - 1).cast("int"))
    layouts = usable.dropDuplicates(["layout"]).select(F.col("layout").alias("_layout"), F.size("columns").alias("_width"), place.alias("_place"))
    files = usable.select(F.col("file").alias("_file"), F.col("layout").alias("_layout"))

    if line_breaks is None:
        line_breaks = has_line_breaks(spark, folder, recursive)
    numbered = [f"_c{i}" for i in range(width)]
    reader = (spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in [*numbered, CORRUPT]]))
              .option("header", "true").option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE")
              .option("escape", '"').option("multiLine", str(line_breaks).lower()).option("pathGlobFilter", CSV_SUFFIX))
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    rows = reader.csv(escape_glob(folder)).withColumn("source_file", F.col("_metadata.file_path"))
    joined = rows.join(hinted(files, "files"), F.col("source_file") == F.col("_file")).join(hinted(layouts, "layouts"), "_layout")
    cells = F.array(*numbered)
    # The engine keeps the raw record of every row that has not as many cells as the widest header; others are written again.
    fits = F.when(F.col(CORRUPT).isNull(), F.lit(width)).otherwise(cells_in(F.col(CORRUPT))) == F.col("_width")
    return joined.select(*[F.get(cells, F.when(F.col("_place")[i] >= 0, F.col("_place")[i])).alias(n) for i, n in enumerate(names)],
                         F.when(~fits, F.coalesce(CORRUPT, F.to_csv(F.struct(*numbered)))).alias(CORRUPT), "source_file")


def land_flows(spark: SparkSession, folder: str, recursive: bool = False, label: str = "Label") -> DataFrame:
    """Read flow files once, give their rows ids and keep them as parquet.

    CSV rows have no key.  A row's id is a hash of its file's name inside the
    folder and its content, and of its number among equal lines of the file, so
    ids - and all samples and splits - do not depend on how files were cut into
    partitions.
    """
    return number_rows(read_flows(spark, folder, recursive, label), folder)


def number_rows(flows: DataFrame, folder: str = "") -> DataFrame:
    """``flows`` with a text ``row_id`` that follows from file and content alone.

    Lines that a file repeats are folded and counted; as they are equal, their
    numbers can be written out by any task, in pieces of ``COPY_ROWS``.
    """
    names = flows.columns
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.substring_index("source_file", f"/{base}/", -1) if base else F.col("source_file")
    # Every value is marked, so that a missing one differs from an empty one.
    cells = [F.coalesce(F.concat(F.lit("="), named(c)), F.lit("-")) for c in sorted(names) if c != "source_file"]
    keyed = materialise(flows.withColumn("_line", F.md5(F.to_json(F.array(inside, *cells)))), "lines")
    repeated = small_table(keyed.groupBy("_line").agg(F.count("*").alias("_n")).filter("_n > 1"))
    single = keyed.join(repeated, "_line", "left_anti").withColumn("row_id", F.col("_line"))
    folded = keyed.join(repeated, "_line").dropDuplicates(["_line"])
    started = folded.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(COPY_ROWS).cast("bigint"))))
    dealt = started.repartition("_line", "_from")
    copies = dealt.withColumn("_at", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPY_ROWS, F.col("_n")) - 1)))
    copies = copies.withColumn("row_id", F.when(F.col("_at") == 0, F.col("_line")).otherwise(
        F.md5(F.concat_ws(":", "_line", F.col("_at").cast("string")))))
    columns = [named(c) for c in names] + [F.col("row_id")]
    return materialise(single.select(*columns).unionByName(copies.select(*columns)), "flows")


def fitting_rows(flows: DataFrame) -> DataFrame:
    """Rows that fit their header, without the marker; the others are half empty or hold surplus cells."""
    return flows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed_rows(flows: DataFrame) -> DataFrame:
    """(source_file, row_id, record) of landed rows that do not fit their header."""
    return flows.filter(F.col(CORRUPT).isNotNull()).select("source_file", "row_id", F.col(CORRUPT).alias("record"))


def rejected_rows(flows: DataFrame) -> DataFrame:
    """(source_file, n_rows, n_rejected) per file of landed flows.

    Whether a line fits its header shows only when all its fields are parsed,
    so this works on the landed table, not on a pruned CSV scan.
    """
    return flows.groupBy("source_file").agg(
        F.count("*").alias("n_rows"), F.count(named(CORRUPT)).alias("n_rejected"))


def label_values(flows: DataFrame, label: str = "Label") -> DataFrame:
    """Distinct trimmed labels over all files, without repeated headers."""
    value = F.trim(named(label).cast("string"))
    return (flows.select(value.alias("label")).filter((F.col("label") != label) & F.col("label").isNotNull())
            .distinct())
