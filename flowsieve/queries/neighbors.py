"""Nearest neighbours, rebalancing and class centres on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import balance, explain, neighbors
from flowsieve.queries import query
from flowsieve.tables import table

DIMS = 64
FEATURES = [f"x{i}" for i in range(DIMS)]


def vectors(spark, folder):
    """Embeddings with one column per dimension."""
    df = table(spark, folder, "embeddings")
    return df.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)])


def pairs_sql(k: int, same_class: bool) -> str:
    where = "AND a.label = b.label" if same_class else ""
    return f"""
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.vec_id AS neighbor_id, b.label AS neighbor_label, b.e AS ne, a.e,
             round(list_distance(a.e, b.e), 9) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbor_id) AS place FROM d),
near AS (SELECT * FROM r WHERE place <= {k})"""


def listed(near):
    """One row per neighbour with its place."""
    exploded = near.select("vec_id", F.posexplode("neighbors").alias("place", "n"))
    return exploded.select("vec_id", (F.col("place") + 1).alias("place"), F.col("n.id").alias("neighbor_id"),
                           F.round("n.dist", 6).alias("dist"))


@query("neighbors_in_class", f"""
WITH {pairs_sql(5, True)} SELECT vec_id, place::INT AS place, neighbor_id, round(dist, 6) AS dist FROM near""")
def neighbors_in_class(spark, folder):
    return listed(neighbors.nearest_neighbors(table(spark, folder, "embeddings"), "vec_id", "embedding", 5, within="label"))


@query("neighbors_all", f"""
WITH {pairs_sql(3, False)} SELECT vec_id, place::INT AS place, neighbor_id, round(dist, 6) AS dist FROM near""")
def neighbors_all(spark, folder):
    return listed(neighbors.nearest_neighbors(table(spark, folder, "embeddings"), "vec_id", "embedding", 3))


@query("oversampled_rows", f"""
WITH {pairs_sql(5, True)},
c AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS top FROM embeddings GROUP BY 1),
b AS (SELECT v.vec_id, v.label, v.e, (top - n) // n + CASE WHEN row_number() OVER
        (PARTITION BY v.label ORDER BY md5('42:grow:' || v.vec_id::VARCHAR)) <= (top - n) % n THEN 1 ELSE 0 END AS copies
      FROM v JOIN c USING (label)),
g AS (SELECT vec_id, label, e, unnest(range(copies)) AS j FROM b WHERE copies > 0),
h AS (SELECT *, md5('42:point:' || vec_id::VARCHAR || ':' || j::VARCHAR) AS key FROM g),
s AS (SELECT h.vec_id::VARCHAR || '#' || h.j::VARCHAR AS vec_id, h.label, h.vec_id AS base_id, n.neighbor_id,
             h.e, n.ne, ('0x' || substr(h.key, 9, 8))::UBIGINT / 4294967296.0::DOUBLE AS u
      FROM h JOIN near n ON n.vec_id = h.vec_id AND n.place = ('0x' || substr(h.key, 1, 8))::UBIGINT % 5 + 1)
SELECT vec_id::VARCHAR AS vec_id, label, false AS synthetic, NULL AS base_id, NULL AS neighbor_id,
       round(embedding[1]::DOUBLE, 6) AS x0, round(embedding[64]::DOUBLE, 6) AS x63 FROM embeddings
UNION ALL SELECT vec_id, label, true, base_id, neighbor_id, round(e[1] + u * (ne[1] - e[1]), 6),
       round(e[64] + u * (ne[64] - e[64]), 6) FROM s""")
def oversampled_rows(spark, folder):
    """Every class grown to the largest by interpolation between neighbours."""
    grown = balance.oversample(vectors(spark, folder), "vec_id", "label", FEATURES)
    return grown.select("vec_id", "label", "synthetic", "base_id", "neighbor_id",
                        F.round("x0", 6).alias("x0"), F.round("x63", 6).alias("x63"))


@query("neighbor_agreement", f"""
WITH {pairs_sql(3, False)}
SELECT vec_id, label, count(*)::INT AS n_neighbors, sum((label = neighbor_label)::INT)::INT AS n_same
FROM near GROUP BY 1, 2""")
def neighbor_agreement(spark, folder):
    return balance.neighbor_agreement(table(spark, folder, "embeddings"), "vec_id", "label", "embedding")


LINES = ["l_quantity", "l_extendedprice"]


@query("edited_rows", """
WITH v AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
s AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM v),
d AS (SELECT a.o_orderkey, a.o_orderstatus, b.o_orderstatus AS other,
             row_number() OVER (PARTITION BY a.o_orderkey
                                ORDER BY round(abs(a.o_totalprice - b.o_totalprice), 9), b.o_orderkey) AS place
      FROM s a JOIN s b ON b.i BETWEEN a.i - 40 AND a.i + 40 AND a.i <> b.i)
SELECT o_orderkey, o_orderstatus FROM d WHERE place <= 3
GROUP BY 1, 2 HAVING bool_and(o_orderstatus = other)""")
def edited_rows(spark, folder):
    """Orders whose three nearest by price share their status."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return balance.edit_neighbors(orders, "o_orderkey", "o_orderstatus", ["o_totalprice"]).select("o_orderkey", "o_orderstatus")


@query("oversampled_and_edited", """
WITH e AS (SELECT event_id, event_type, value::DOUBLE AS x, json_extract_string(props, '$.k')::DOUBLE AS y FROM events),
c AS (SELECT event_type, count(*) AS n, max(count(*)) OVER () AS top FROM e GROUP BY 1),
m AS (SELECT e.*, n, top FROM e JOIN c USING (event_type) WHERE n < top),
near AS (SELECT event_id, unnest(list) AS nb, generate_subscripts(list, 1) AS place FROM (
  SELECT a.event_id, min({'dist': round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9), 'id': b.event_id, 'x': b.x, 'y': b.y}, 5) AS list
  FROM m a JOIN m b ON a.event_type = b.event_type AND a.event_id <> b.event_id GROUP BY 1)),
b AS (SELECT *, (top - n) // n + CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY md5('42:grow:' || event_id::VARCHAR)) <= (top - n) % n
        THEN 1 ELSE 0 END AS copies FROM m),
g AS (SELECT event_id, event_type, x, y, unnest(range(copies)) AS j FROM b WHERE copies > 0),
h AS (SELECT *, md5('42:point:' || event_id::VARCHAR || ':' || j::VARCHAR) AS key FROM g),
s AS (SELECT h.event_id::VARCHAR || '#' || h.j::VARCHAR AS id, event_type, true AS synthetic, h.event_id AS base_id, nb.id AS neighbor_id,
        h.x + ('0x' || substr(key, 9, 8))::UBIGINT / 4294967296.0::DOUBLE * (nb.x - h.x) AS x,
        h.y + ('0x' || substr(key, 9, 8))::UBIGINT / 4294967296.0::DOUBLE * (nb.y - h.y) AS y
      FROM h JOIN near n ON n.event_id = h.event_id AND n.place = ('0x' || substr(key, 1, 8))::UBIGINT % 5 + 1),
w AS (SELECT event_id::VARCHAR AS id, event_type, false AS synthetic, NULL::BIGINT AS base_id, NULL::BIGINT AS neighbor_id, x, y FROM e
      UNION ALL SELECT id, event_type, synthetic, base_id, neighbor_id, x, y FROM s),
t AS (SELECT a.id, any_value(a.event_type) AS own, min({'dist': round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9), 'id': b.id, 't': b.event_type}, 3) AS list
      FROM w a JOIN w b ON a.id <> b.id GROUP BY 1)
SELECT w.id AS event_id, event_type, round(x, 6) AS value, round(y, 6) AS k, synthetic, base_id, neighbor_id
FROM w JOIN t USING (id) WHERE len(list_filter(list, lambda n: n.t <> own)) = 0""")
def oversampled_and_edited(spark, folder):
    """Oversampling followed by editing on event value and payload."""
    events = table(spark, folder, "events").select(
        "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    edited = balance.oversample_and_edit(events, "event_id", "event_type", ["value", "k"])
    return edited.withColumns({c: F.round(c, 6) for c in ("value", "k")})


@query("class_centres", """
SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS x0, round(avg(embedding[64]::DOUBLE), 6) AS x63
FROM embeddings GROUP BY 1""")
def class_centres(spark, folder):
    centres = explain.class_centres(vectors(spark, folder), "label", FEATURES)
    return centres.select("label", "n", F.round("x0", 6).alias("x0"), F.round("x63", 6).alias("x63"))


CENTRE_SQL = """
v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS c FROM v GROUP BY 1, 2),
d AS (SELECT vec_id, v.label, round(sqrt(sum((x - c) ** 2)), 9) AS dist FROM v JOIN m ON v.label = m.label AND v.i = m.i GROUP BY 1, 2)"""


@query("nearest_to_centre", f"""
WITH {CENTRE_SQL}
SELECT label, vec_id, round(dist, 6) AS dist FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS place FROM d) WHERE place = 1""")
def nearest_to_centre(spark, folder):
    """The most typical row of every class."""
    typical = explain.representatives(vectors(spark, folder), "vec_id", "label", FEATURES)
    return typical.select("label", "vec_id", F.round("dist", 6).alias("dist"))


@query("absent_classes", """
WITH s AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('42:uniform:' || vec_id::VARCHAR)) AS rk FROM embeddings)
SELECT a.label, count(s.vec_id) AS n, count(s.vec_id) = 0 AS absent
FROM (SELECT DISTINCT label FROM embeddings) a LEFT JOIN s ON s.label = a.label AND s.rk <= 12 GROUP BY 1""")
def absent_classes(spark, folder):
    """Classes that a small sample lacks."""
    from flowsieve.operators.sample import uniform_sample
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    return explain.class_coverage(rows, uniform_sample(rows, ["vec_id"], 12), "label")
