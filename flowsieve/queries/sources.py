"""CSV folders and stored results.

The queries write whole tables as CSV or parquet into the shared work folder
and read them back with the source operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.bounded import work_path
from flowsieve.operators import evaluate, sample, search
from flowsieve.queries import query
from flowsieve.queries.evaluation import predicted_events
from flowsieve.queries.sampling import split_sql
from flowsieve.sources import flows, store
from flowsieve.tables import table


def order_files(spark, folder) -> str:
    """Orders as CSV files in one folder."""
    path = work_path(spark, "orders-csv")
    (table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
     .write.option("header", "true").csv(path))
    return path


def party_files(spark, folder) -> str:
    """Customers and suppliers as nested CSV folders with different headers."""
    path = work_path(spark, "parties-csv")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias(" Key"), F.col("c_acctbal").alias(" Balance "), F.col("c_mktsegment").alias("Label"))
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("Balance"), F.col("s_suppkey").alias("Key"), F.col("s_nationkey").alias(" Nation"),
        F.lit("SUPPLIER").alias(" Label"))
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("Key"), F.col("n_name").alias("Name"))
    # Leading blanks in headers have to survive the writer.
    for name, df in (("customers", customers), ("deep/suppliers", suppliers), ("nations", nations)):
        (df.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false")
         .option("ignoreTrailingWhiteSpace", "false").csv(f"{path}/{name}"))
    return path


PARTIES_SQL = """parties AS (
  SELECT c_custkey::VARCHAR AS "Key", c_acctbal AS "Balance", c_mktsegment AS "Label", NULL::VARCHAR AS "Nation" FROM customer
  UNION ALL SELECT s_suppkey::VARCHAR, s_acctbal, 'SUPPLIER', s_nationkey::VARCHAR FROM supplier)"""


@query("csv_flat_scan", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority FROM orders")
def csv_flat_scan(spark, folder):
    return flows.read_text_csv(spark, order_files(spark, folder)).select("o_orderkey", "o_orderpriority")


@query("csv_recursive_scan", f"""
WITH {PARTIES_SQL} SELECT "Key", round("Balance", 2) AS "Balance", "Label", "Nation" FROM parties""")
def csv_recursive_scan(spark, folder):
    """Nested folders, two headers, one folder without the label column."""
    df = flows.read_flows(spark, party_files(spark, folder), recursive=True)
    return df.select("Key", F.round(F.col("Balance").cast("double"), 2).alias("Balance"), "Label", "Nation")


@query("csv_typed_after_read", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS has_lineage FROM orders GROUP BY 1""")
def csv_typed_after_read(spark, folder):
    """All-text read, typed afterwards, with the source file of every row."""
    df = flows.read_text_csv(spark, order_files(spark, folder))
    return df.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"),
        F.every(F.col("source_file").endswith(".csv")).alias("has_lineage"))


@query("csv_label_values", """
SELECT DISTINCT c_mktsegment AS label FROM customer UNION SELECT 'SUPPLIER' FROM supplier""")
def csv_label_values(spark, folder):
    """Distinct labels over all files, reading the label column only."""
    return flows.label_values(flows.read_flows(spark, party_files(spark, folder), recursive=True))


@query("csv_header_union", """
SELECT * FROM (VALUES ('Key', 3), ('Balance', 2), ('Label', 2), ('Nation', 1), ('Name', 1)) v("column", n_layouts)
WHERE (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) > 0""")
def csv_header_union(spark, folder):
    """Union of the headers of all files, and in how many layouts each occurs."""
    headers = flows.file_headers(spark, party_files(spark, folder), recursive=True)
    layouts = flows.file_layouts(headers).select(F.explode("columns").alias("column"))
    counts = layouts.groupBy("column").agg(F.count("*").cast("int").alias("n_layouts"))
    return flows.header_union(headers).join(counts, "column").select("column", "n_layouts")


@query("csv_files_without_label", """
SELECT 'no column Label' AS reason, (SELECT count(*) FROM nation) AS n_rows""")
def csv_files_without_label(spark, folder):
    """Files left out for want of a label column, with their row count."""
    path = party_files(spark, folder)
    skipped = flows.skipped_files(flows.file_headers(spark, path, recursive=True))
    rows = flows.read_text_csv(spark, path, recursive=True).groupBy("source_file").agg(F.count("*").alias("n"))
    same = F.regexp_replace(skipped["file"], "^file:/+", "/") == F.regexp_replace(rows["source_file"], "^file:/+", "/")
    return skipped.join(rows, same).groupBy("reason").agg(F.sum("n").alias("n_rows"))


@query("csv_rejected_rows", """
SELECT count(*) AS n_rows, count(CASE WHEN value < 10 THEN 1 END) AS n_rejected FROM events""")
def csv_rejected_rows(spark, folder):
    """Lines that do not fit their header, counted instead of dropped silently."""
    path = work_path(spark, "broken-csv")
    events = table(spark, folder, "events")
    line = F.concat_ws(",", "event_id", "value", "event_type")
    # One column named like a whole header line, written without quotes, gives raw lines under a header.
    whole = F.when(F.col("value") < 10, F.concat(line, F.lit(",surplus"))).otherwise(line).alias("event_id,value,Label")
    events.select(whole).write.option("header", "true").option("sep", "\u0001").option("quote", "").csv(path)
    return flows.rejected_rows(flows.land_flows(spark, path, recursive=True)).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_rejected").alias("n_rejected"))


@query("landed_flows", f"""
WITH {PARTIES_SQL}
SELECT "Label", count(*) AS n, count(*) AS n_ids, round(sum("Balance"), 2) AS balance FROM parties GROUP BY 1""")
def landed_flows(spark, folder):
    """Flow files landed as parquet with unique row ids."""
    df = flows.land_flows(spark, party_files(spark, folder), recursive=True)
    return df.groupBy("Label").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_ids"),
                                   F.round(F.sum(F.col("Balance").cast("double")), 2).alias("balance"))


@query("stored_split", f"""
WITH {split_sql('events', 'event_id', 'event_type')}
SELECT event_id, event_type, round(value, 2) AS value FROM parts WHERE split = 'test'""")
def stored_split(spark, folder):
    """Store a split set, load the test part only."""
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    path = work_path(spark, "split")
    store.save_split(sample.stratified_split(events, ["event_id"], "event_type"), path)
    return store.load_split(spark, path, "test").withColumn("value", F.round("value", 2))


@query("load_or_compute", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def load_or_compute(spark, folder):
    """The second call reads what the first stored."""
    root = work_path(spark, "cache")
    key = store.fingerprint("event means", folder)

    def compute():
        return table(spark, folder, "events").groupBy("event_type").agg(
            F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))

    store.load_or_compute(spark, root, "means", key, compute)
    return store.load_or_compute(spark, root, "means", key, lambda: compute().limit(0))


@query("report_csv_roundtrip", """
WITH p AS (SELECT event_type AS y, CASE WHEN value < 20 THEN 'click' WHEN value < 40 THEN 'error' ELSE event_type END AS pred FROM events),
c AS (SELECT k AS class, sum((y = pred AND y = k)::INT) AS tp, sum((pred = k)::INT) AS pr, sum((y = k)::INT) AS su
      FROM p, (SELECT DISTINCT event_type AS k FROM events) GROUP BY 1)
SELECT class, round(CASE WHEN pr = 0 THEN 0 ELSE tp / pr END, 6) AS "precision",
       round(tp / su, 6) AS recall, su::BIGINT AS support FROM c""")
def report_csv_roundtrip(spark, folder):
    """A report written as CSV (one row per class) and JSON, read back."""
    counts = evaluate.confusion_counts(predicted_events(spark, folder), "y", "pred")
    path = work_path(spark, "report")
    lines = evaluate.report(counts)
    store.save_report_csv(lines, path + "/csv")
    store.save_report_json(lines, path + "/json", "thresholds")
    back = spark.read.schema("class string, precision double, recall double, f1 double, support bigint").option(
        "header", "true").csv(path + "/csv")
    return (back.filter(~F.col("class").isin("accuracy", "macro avg", "weighted avg"))
            .select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support"))


TRIALS_SQL = """trials AS (
  SELECT event_type AS model, user_id::INT AS trial, round(avg(value), 6) AS loss, count(*) AS n
  FROM events GROUP BY 1, 2)"""


def event_trials(spark, folder) -> str:
    """A trials table derived from events: one trial per class and user."""
    trials = (table(spark, folder, "events").groupBy(F.col("event_type").alias("model"), F.col("user_id").cast("int").alias("trial"))
              .agg(F.round(F.avg("value"), 6).alias("loss"), F.count("*").cast("double").alias("n"))
              .select("model", "trial", F.pmod("trial", F.lit(4)).cast("int").alias("chunk"),
                      F.create_map(F.lit("n"), "n").alias("params"), "loss"))
    path = work_path(spark, "trials")
    trials.write.mode("append").parquet(path)
    return path


@query("best_params_store", f"""
WITH {TRIALS_SQL}
SELECT model, arg_min(trial, loss * 1e9 + trial)::INT AS trial, min(loss) AS loss,
       arg_min(n, loss * 1e9 + trial)::DOUBLE AS n FROM trials GROUP BY 1""")
def best_params_store(spark, folder):
    """Lowest loss per model, stored as JSON and loaded back."""
    path = work_path(spark, "best")
    store.save_best_params(store.best_params(store.load_trials(spark, event_trials(spark, folder))), path)
    return store.load_best_params(spark, path).select("model", "trial", "loss", F.col("params")["n"].alias("n"))


@query("trials_resume", f"""
WITH {TRIALS_SQL}
SELECT model, count(*) AS completed, (max(trial) + 1)::INT AS next_trial, ((max(trial) + 1) % 4)::INT AS next_chunk
FROM trials GROUP BY 1""")
def trials_resume(spark, folder):
    return store.resume_point(store.load_trials(spark, event_trials(spark, folder)), chunks=4)


@query("mean_fold_score", """
SELECT event_type AS model, avg(s) AS mean_score FROM
  (SELECT event_type, user_id % 3 AS fold, round(avg(value), 6) AS s FROM events GROUP BY 1, 2) GROUP BY 1
""".replace("avg(s)", "round(avg(s), 6)"))
def mean_fold_score(spark, folder):
    """Mean over folds of a per-fold score."""
    folds = (table(spark, folder, "events").groupBy(F.col("event_type").alias("model"), F.pmod("user_id", F.lit(3)).alias("fold"))
             .agg(F.round(F.avg("value"), 6).alias("s")))
    return search.mean_fold_score(folds, ["model"], "s").withColumn("mean_score", F.round("mean_score", 6))
