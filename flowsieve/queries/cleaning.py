"""Cleaning, projections and counts.

The tables hold no dirty values, so queries derive text with infinities, NA
markers and garbage from the value ranges of clean columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions import scalar
from flowsieve.operators import clean, evaluate
from flowsieve.queries import query
from flowsieve.tables import table

DIRTY_SQL = """dirty AS (
  SELECT event_id, ts, user_id, event_type, value, props,
    CASE WHEN value < 2 THEN 'Infinity' WHEN value < 4 THEN '-inf' WHEN value < 6 THEN 'NaN'
         WHEN value < 8 THEN '' WHEN value < 10 THEN 'abc' WHEN value < 12 THEN '1d'
         ELSE ' ' || value::DECIMAL(18,2)::VARCHAR || ' ' END AS raw,
    CASE WHEN value < 200 THEN NULL ELSE user_id::VARCHAR END AS mostly_missing,
    CASE WHEN value < 3 THEN 'n/a' ELSE user_id::VARCHAR END AS rarely_missing,
    CASE WHEN value >= 150 AND event_type = 'click' THEN 'Label' ELSE ' ' || event_type || ' ' END AS "Label"
  FROM events)"""

NA_SQL = ", ".join("'" + m.replace("'", "''") + "'" for m in scalar.NA_MARKERS)
NUMBER_SQL = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def dirty_events(spark, folder):
    value = F.col("value")
    raw = (F.when(value < 2, "Infinity").when(value < 4, "-inf").when(value < 6, "NaN").when(value < 8, "")
           .when(value < 10, "abc").when(value < 12, "1d")
           .otherwise(F.concat(F.lit(" "), value.cast("decimal(18,2)").cast("string"), F.lit(" "))))
    user = F.col("user_id").cast("string")
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props", raw.alias("raw"),
        F.when(value >= 200, user).alias("mostly_missing"),
        F.when(value < 3, "n/a").otherwise(user).alias("rarely_missing"),
        F.when((value >= 150) & (F.col("event_type") == "click"), "Label")
        .otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))).alias("Label"))


@query("trimmed_columns", """
SELECT c_custkey AS "Cust Key", c_acctbal AS "Acct Bal", c_mktsegment AS "Label" FROM customer""")
def trimmed_columns(spark, folder):
    padded = table(spark, folder, "customer").select(
        F.col("c_custkey").alias(" Cust Key"), F.col("c_acctbal").alias("Acct Bal  "), F.col("c_mktsegment").alias(" Label "))
    return scalar.trim_names(padded)


@query("dropped_columns", "SELECT event_id, event_type, value FROM events")
def dropped_columns(spark, folder):
    """Drop listed columns; one of them does not exist."""
    return clean.drop_columns(table(spark, folder, "events"), ["ts", "user_id", "props", "Timestamp"])


@query("kept_columns", "SELECT l_quantity, l_tax, l_returnflag FROM lineitem")
def kept_columns(spark, folder):
    return clean.keep_columns(table(spark, folder, "lineitem"), ["l_quantity", "l_tax", "l_returnflag"])


@query("numeric_coercion", f"""
WITH {DIRTY_SQL}
SELECT event_id, isinf(n) AS infinite, CASE WHEN isinf(n) THEN NULL ELSE n END AS number
FROM (SELECT event_id, CASE WHEN regexp_matches(raw, '{NUMBER_SQL}') THEN try_cast(trim(raw) AS DOUBLE) END AS n FROM dirty)""")
def numeric_coercion(spark, folder):
    """Text to number; what is no number becomes null."""
    number = dirty_events(spark, folder).select("event_id", scalar.to_number(F.col("raw")).alias("n"))
    infinite = F.abs("n") == F.lit(scalar.INF)
    return number.select("event_id", infinite.alias("infinite"), F.when(~infinite, F.col("n")).alias("number"))


@query("null_filled", f"""
WITH {DIRTY_SQL}
SELECT event_id, coalesce(try_cast(mostly_missing AS DOUBLE), 0) AS filled FROM dirty""")
def null_filled(spark, folder):
    df = dirty_events(spark, folder).select("event_id", F.col("mostly_missing").try_cast("double").alias("filled"))
    return clean.fill_zero(df, ["filled"])


@query("infinity_to_zero", """
SELECT event_id, CASE WHEN value < 4 THEN 0 ELSE value END AS value FROM events""")
def infinity_to_zero(spark, folder):
    value = F.col("value")
    signed = F.when(value < 2, F.lit(scalar.INF)).when(value < 4, F.lit(-scalar.INF)).otherwise(value)
    return clean.zero_infinities(table(spark, folder, "events").select("event_id", signed.alias("value")), ["value"])


@query("numbers_from_text", f"""
WITH {DIRTY_SQL}
SELECT event_id, CASE WHEN value < 12 THEN 0 ELSE round(value, 2) END AS raw FROM dirty""")
def numbers_from_text(spark, folder):
    df = clean.numbers_from_text(dirty_events(spark, folder).select("event_id", "raw"), ["raw"])
    return df.withColumn("raw", F.round("raw", 2))


@query("narrowed_types", """
SELECT o_orderkey, round(o_totalprice::FLOAT::DOUBLE, 3) AS o_totalprice, o_custkey::BIGINT AS o_custkey FROM orders""")
def narrowed_types(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("int").alias("o_custkey"))
    narrow = clean.narrow(df, ["o_totalprice"], ["o_custkey"])
    return narrow.withColumn("o_totalprice", F.round(F.col("o_totalprice").cast("double"), 3))


@query("clean_label_text", f"""
WITH {DIRTY_SQL} SELECT trim("Label") AS "Label", count(*) AS n FROM dirty GROUP BY 1""")
def clean_label_text(spark, folder):
    return clean.class_histogram(clean.clean_labels(dirty_events(spark, folder), "Label"), "Label")


@query("binarised_labels", """
SELECT event_id, c.class, (event_type = c.class)::INT AS positive
FROM events, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) c(class)""")
def binarised_labels(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    classes = ["click", "error", "purchase", "signup", "view"]
    return evaluate.binarise(events, "event_type", classes).select("event_id", "class", "positive")


@query("rare_and_common", """
SELECT o_orderpriority IN ('1-URGENT', '2-HIGH') AS rare, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1""")
def rare_and_common(spark, folder):
    """Membership in a list and its complement."""
    orders = table(spark, folder, "orders").select("o_orderpriority", "o_totalprice")
    return (orders.groupBy(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("rare"))
            .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query("whole_rows", f"""
WITH {DIRTY_SQL}
SELECT event_id, raw, rarely_missing FROM dirty
WHERE raw NOT IN ({NA_SQL}) AND rarely_missing NOT IN ({NA_SQL})""")
def whole_rows(spark, folder):
    """Drop rows with any missing value after NA markers became null."""
    df = dirty_events(spark, folder).select("event_id", "raw", "rarely_missing")
    return clean.drop_null_rows(clean.blank_na_markers(df))


@query("dense_columns", f"""
WITH {DIRTY_SQL}, p AS (
  SELECT 'raw' AS "column", count(*) AS n_rows, count(CASE WHEN raw NOT IN ({NA_SQL}) THEN 1 END) AS n_present FROM dirty
  UNION ALL SELECT 'mostly_missing', count(*), count(mostly_missing) FROM dirty
  UNION ALL SELECT 'rarely_missing', count(*), count(CASE WHEN rarely_missing NOT IN ({NA_SQL}) THEN 1 END) FROM dirty)
SELECT "column", n_rows, n_present, n_present >= 0.5 * n_rows AS kept FROM p""")
def dense_columns(spark, folder):
    """Share of present values per column and the columns at least half full."""
    df = clean.blank_na_markers(dirty_events(spark, folder).select("raw", "mostly_missing", "rarely_missing"))
    kept = clean.drop_sparse_columns(df).columns
    return clean.non_null_profile(df).withColumn("kept", F.col("column").isin(kept))


@query("header_rows_dropped", f"""
WITH {DIRTY_SQL} SELECT event_id, "Label" FROM dirty WHERE "Label" <> 'Label'""")
def header_rows_dropped(spark, folder):
    return clean.drop_header_rows(dirty_events(spark, folder)).select("event_id", "Label")


@query("rows_of_class", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def rows_of_class(spark, folder):
    return clean.rows_of_class(table(spark, folder, "embeddings"), "label", 3).select("vec_id", "label")


@query("cleaned_flows", f"""
WITH {DIRTY_SQL}
SELECT event_id, "Label", CASE WHEN value < 12 THEN 0 ELSE round(value, 2) END AS raw,
       rarely_missing::DOUBLE AS rarely_missing
FROM dirty WHERE raw NOT IN ({NA_SQL}) AND rarely_missing NOT IN ({NA_SQL}) AND "Label" <> 'Label'""")
def cleaned_flows(spark, folder):
    """All cleaning rules in order on a text table."""
    df = dirty_events(spark, folder).select("event_id", F.col("ts").cast("string").alias("Timestamp"), "raw",
                                            "mostly_missing", "rarely_missing", "Label")
    return clean.clean_flows(df, ids=("event_id",)).withColumn("raw", F.round("raw", 2))


@query("step_counts", f"""
WITH {DIRTY_SQL}
SELECT 'read' AS step, count(*) AS n_rows, 10 AS n_columns FROM dirty
UNION ALL SELECT 'whole', count(*), 10 FROM dirty WHERE mostly_missing IS NOT NULL
UNION ALL SELECT 'clean', count(*), 10 FROM dirty WHERE mostly_missing IS NOT NULL AND "Label" <> 'Label'""")
def step_counts(spark, folder):
    """Row and column counts after each step."""
    read = dirty_events(spark, folder)
    whole = clean.drop_null_rows(read)
    headed = clean.drop_header_rows(whole)
    return (clean.shape(read, "read").unionByName(clean.shape(whole, "whole"))
            .unionByName(clean.shape(headed, "clean")))


@query("class_values", "SELECT DISTINCT l_returnflag, count(DISTINCT l_linestatus) AS n_status FROM lineitem GROUP BY 1")
def class_values(spark, folder):
    """Distinct classes and the number of distinct values inside each."""
    return clean.class_values(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", "n_status")


@query("class_histogram", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def class_histogram(spark, folder):
    return clean.class_histogram(table(spark, folder, "orders"), "o_orderpriority")


@query("smallest_class", """
SELECT min(n) AS smallest, max(n) AS largest, count(*) AS n_classes
FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)""")
def smallest_class(spark, folder):
    return clean.smallest_class(table(spark, folder, "labels"), "toxic")


@query("non_null_counts", """
SELECT 'c_custkey' AS "column", count(*) AS n_rows, count(c_custkey) AS n_present FROM customer
UNION ALL SELECT 'c_name', count(*), count(c_name) FROM customer
UNION ALL SELECT 'c_nationkey', count(*), count(c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', count(*), count(c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(c_mktsegment) FROM customer""")
def non_null_counts(spark, folder):
    return clean.non_null_profile(table(spark, folder, "customer"))


@query("union_by_name", """
SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, NULL AS nation FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier""")
def union_by_name(spark, folder):
    """Union of sources with different columns; absent ones are null."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return clean.union_by_name([customers, suppliers])


@query("label_set_union", """
SELECT event_type AS label FROM events UNION SELECT o_orderpriority FROM orders UNION SELECT l_returnflag FROM lineitem""")
def label_set_union(spark, folder):
    """Distinct label values over several sources."""
    parts = [("events", "event_type"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag")]
    return clean.label_set([(table(spark, folder, t), c) for t, c in parts])
