"""Sampling, splitting, encoding and scaling over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import encode, sample
from flowsieve.queries import query
from flowsieve.tables import table


def split_sql(source: str, key: str, label: str, fraction: float = 0.2, seed: int = 42) -> str:
    """CTEs ending in ``parts``: the source rows with their split."""
    return f"""
    counts AS (SELECT {label} AS g, count(*) AS n FROM {source} GROUP BY 1),
    total AS (SELECT sum(n)::HUGEINT AS n_all,
                     sum(n)::HUGEINT - ceil({fraction} * sum(n)::DOUBLE)::HUGEINT AS n_train FROM counts),
    shares AS (SELECT g, (n::HUGEINT * n_train) // n_all AS base,
                      (n::HUGEINT * n_train) % n_all AS rest, n_train FROM counts, total),
    quota AS (SELECT g, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, g)
                                         <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM shares),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {label}
                      ORDER BY md5('{seed}:split:' || {key}::VARCHAR)) AS rk FROM {source}),
    parts AS (SELECT r.*, CASE WHEN r.rk <= q.k THEN 'train' ELSE 'test' END AS split
              FROM ranked r JOIN quota q ON r.{label} = q.g)"""


@query("split_scale_summary", f"""
WITH {split_sql('events', 'event_id', 'event_type')},
train AS (SELECT min(value) AS lo, max(value) AS hi FROM parts WHERE split = 'train')
SELECT split, event_type, count(*) AS n,
       round(avg((value - lo) / (hi - lo)), 6) AS mean_scaled,
       round(min((value - lo) / (hi - lo)), 6) AS min_scaled,
       round(max((value - lo) / (hi - lo)), 6) AS max_scaled
FROM parts, train GROUP BY 1, 2""")
def split_scale_summary(spark, folder):
    """Stratified split, scaling fitted on the train part, mean per part and class."""
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    parts = sample.stratified_split(events, ["event_id"], "event_type")
    fitted = encode.fit_min_max(parts.filter(F.col("split") == "train"), ["value"])
    scaled = encode.apply_min_max(parts, fitted, ["value"])
    return scaled.groupBy("split", "event_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 6).alias("mean_scaled"),
        F.round(F.min("value"), 6).alias("min_scaled"),
        F.round(F.max("value"), 6).alias("max_scaled"))


@query("stratified_split_rows", f"""
WITH {split_sql('events', 'event_id', 'event_type')}
SELECT event_id, event_type, split FROM parts""")
def stratified_split_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return sample.stratified_split(events, ["event_id"], "event_type")


@query("thin_common_rows", """
WITH flagged AS (SELECT *, o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') AS rare FROM orders),
counts AS (SELECT rare, o_orderstatus AS src, count(*) AS n FROM flagged GROUP BY ALL),
ranked AS (SELECT f.*, n, row_number() OVER (PARTITION BY f.rare, f.o_orderstatus
                  ORDER BY md5('42:thin:' || o_orderkey::VARCHAR)) AS rk
           FROM flagged f JOIN counts c ON f.rare = c.rare AND f.o_orderstatus = c.src)
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM ranked
WHERE rk <= CASE WHEN rare THEN n ELSE round_even(0.02 * n::DOUBLE, 0) END""")
def thin_common_rows(spark, folder):
    """All rare-class rows, exactly 2 % of the others per source."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return sample.thin_common(orders, ["o_orderkey"], "o_orderstatus", "o_orderpriority",
                              ["1-URGENT", "4-NOT SPECIFIED"], 0.02)


@query("thin_common_fast_rows", """
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED')
   OR ('0x' || substr(md5('42:thin:' || o_orderkey::VARCHAR), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 0.1""")
def thin_common_fast_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return sample.thin_common_fast(orders, ["o_orderkey"], "o_orderpriority",
                                   ["1-URGENT", "4-NOT SPECIFIED"], 0.1)


@query("stratified_sample_rows", """
WITH counts AS (SELECT event_type AS g, count(*) AS n FROM events GROUP BY 1),
total AS (SELECT sum(n)::HUGEINT AS n_all, sum(n)::HUGEINT - least(2000, sum(n)::HUGEINT) AS n_train FROM counts),
shares AS (SELECT g, n, (n::HUGEINT * n_train) // n_all AS base, (n::HUGEINT * n_train) % n_all AS rest, n_train
           FROM counts, total),
quota AS (SELECT g, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, g)
                                     <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM shares),
ranked AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
                  ORDER BY md5('42:sample:' || event_id::VARCHAR)) AS rk FROM events)
SELECT event_id, event_type FROM ranked JOIN quota ON event_type = g WHERE rk > k""")
def stratified_sample_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return sample.stratified_sample(events, ["event_id"], "event_type", 2000)


@query("uniform_sample_rows", """
SELECT o_orderkey, o_totalprice FROM
  (SELECT *, row_number() OVER (ORDER BY md5('42:uniform:' || o_orderkey::VARCHAR)) AS rk FROM orders)
WHERE rk <= 5000""")
def uniform_sample_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sample.uniform_sample(orders, ["o_orderkey"], 5000)


@query("chained_samples", """
WITH flagged AS (SELECT *, o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') AS rare FROM orders),
sizes AS (SELECT rare, o_orderstatus AS src, count(*) AS n FROM flagged GROUP BY ALL),
thin AS (SELECT o_orderkey, o_orderpriority FROM (SELECT f.*, n, row_number() OVER (PARTITION BY f.rare, f.o_orderstatus
                  ORDER BY md5('42:thin:' || o_orderkey::VARCHAR)) AS rk
           FROM flagged f JOIN sizes c ON f.rare = c.rare AND f.o_orderstatus = c.src)
         WHERE rk <= CASE WHEN rare THEN n ELSE round_even(0.2 * n::DOUBLE, 0) END),
""" + split_sql("thin", "o_orderkey", "o_orderpriority").strip() + """
SELECT o_orderkey, o_orderpriority FROM
  (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY md5('42:uniform:' || o_orderkey::VARCHAR)) AS place
   FROM parts WHERE split = 'train')
WHERE place <= 2000""")
def chained_samples(spark, folder):
    """A uniform sample of the train part of a thinned table: each draw is independent of those before."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    thinned = sample.thin_common(orders, ["o_orderkey"], "o_orderstatus", "o_orderpriority", ["1-URGENT", "4-NOT SPECIFIED"], 0.2)
    parts = sample.stratified_split(thinned, ["o_orderkey"], "o_orderpriority")
    return sample.uniform_sample(parts.filter(F.col("split") == "train"), ["o_orderkey"], 2000).select("o_orderkey", "o_orderpriority")


@query("stratified_folds_rows", """
WITH sorted AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS pos FROM events),
sizes AS (SELECT event_type, (pos % 3)::INT AS fold, count(*) AS n FROM sorted GROUP BY ALL),
upto AS (SELECT event_type, fold, sum(n) OVER (PARTITION BY event_type ORDER BY fold) AS k FROM sizes),
ranked AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
                  ORDER BY md5('42:fold:' || event_id::VARCHAR)) AS rk FROM events)
SELECT r.event_id, r.event_type, min(u.fold)::INT AS fold
FROM ranked r JOIN upto u ON r.event_type = u.event_type AND r.rk <= u.k GROUP BY ALL""")
def stratified_folds_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return sample.stratified_folds(events, ["event_id"], "event_type")


@query("chunk_slice_rows", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE ('0x' || substr(md5('chunk:' || o_orderkey::VARCHAR), 1, 8))::UBIGINT % 4 = 2""")
def chunk_slice_rows(spark, folder):
    """The rotating chunk that trial 6 of 4 chunks reads."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sample.chunk_slice(orders, ["o_orderkey"], trial=6, chunks=4)


@query("sampled_row_lookup", """
WITH picked AS (SELECT o_orderkey FROM
  (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:uniform:' || o_orderkey::VARCHAR)) AS rk FROM orders)
  WHERE rk <= 1000)
SELECT l_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS amount
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM picked) GROUP BY 1""")
def sampled_row_lookup(spark, folder):
    """Rows selected by a sampled id set."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    picked = sample.uniform_sample(orders, ["o_orderkey"], 1000, seed=7)
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice")
    chosen = sample.pick_rows(lines, picked.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"])
    return chosen.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"),
                                            F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("label_codes", """
SELECT (row_number() OVER (ORDER BY event_type) - 1)::INT AS label_id, event_type AS label
FROM (SELECT DISTINCT event_type FROM events)""")
def label_codes(spark, folder):
    return encode.label_map(table(spark, folder, "events"), "event_type")


@query("encoded_rows", """
SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS label_id FROM events""")
def encoded_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    mapping = encode.label_map(events, "event_type")
    return encode.encode_labels(events, mapping, "event_type").select("event_id", "label_id")


@query("label_name_lookup", """
WITH codes AS (SELECT (row_number() OVER (ORDER BY event_type) - 1)::INT AS id, event_type AS label
               FROM (SELECT DISTINCT event_type FROM events))
SELECT v.vec_id, v.label AS label_id, coalesce(c.label, 'Class_' || v.label::VARCHAR) AS label_name
FROM embeddings v LEFT JOIN codes c ON v.label = c.id""")
def label_name_lookup(spark, folder):
    """Code to name with a default for codes the map lacks."""
    mapping = encode.label_map(table(spark, folder, "events"), "event_type")
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("label_id"))
    return encode.decode_labels(rows, mapping, "label_id", "label_name")


@query("train_ranges", f"""
WITH {split_sql('events', 'event_id', 'event_type')}
SELECT 'value' AS feature, min(value) AS lo, max(value) AS hi FROM parts WHERE split = 'train'
UNION ALL SELECT 'k', min(json_extract(props, '$.k')::DOUBLE), max(json_extract(props, '$.k')::DOUBLE)
FROM parts WHERE split = 'train'""")
def train_ranges(spark, folder):
    """Minimum and maximum of every feature over the train part."""
    events = table(spark, folder, "events").select(
        "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    parts = sample.stratified_split(events, ["event_id"], "event_type")
    return encode.min_max_table(parts.filter(F.col("split") == "train"), ["value", "k"])


@query("scaled_rows", f"""
WITH {split_sql('orders', 'o_orderkey', 'o_orderpriority')},
train AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM parts WHERE split = 'train')
SELECT o_orderkey, split, round((o_totalprice - lo) / (hi - lo), 6) AS o_totalprice,
       0.0::DOUBLE AS constant_feature FROM parts, train""")
def scaled_rows(spark, folder):
    """Train-fitted scaling of both parts; a constant feature becomes 0."""
    orders = (table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
              .withColumn("constant_feature", F.lit(7.0)))
    features = ["o_totalprice", "constant_feature"]
    parts = sample.stratified_split(orders, ["o_orderkey"], "o_orderpriority")
    fitted = encode.fit_min_max(parts.filter(F.col("split") == "train"), features)
    scaled = encode.apply_min_max(parts, fitted, features)
    return scaled.select("o_orderkey", "split", F.round("o_totalprice", 6).alias("o_totalprice"), "constant_feature")


@query("line_feature_ranges", """
SELECT 'l_quantity' AS feature, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem
UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount) FROM lineitem
UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem""")
def line_feature_ranges(spark, folder):
    return encode.min_max_table(table(spark, folder, "lineitem"),
                                ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
