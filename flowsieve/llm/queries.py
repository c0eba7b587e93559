"""The operators applied to whole tables, registered by `__spark_entry__.py`."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from flowsieve.llm import (
    bpe, decontaminate, manifest, neighbour_graphs, quality, repair, shards, simhash, suffixes, toxicity, url_filter, wordpiece, wrappers,
)
from flowsieve.llm.shared import table

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_simhash_near_duplicates(spark, folder):
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op9_byte_level_bpe(spark, folder):
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.round_trip(table(spark, folder, "documents"), memory=1_000_000, keep=True)


@query
def op4_token_counts(spark, folder):
    """Words, word pieces and unknown words of every document."""
    return wordpiece.token_counts(table(spark, folder, "documents"))


@query
def op10_uniform_shards(spark, folder):
    """All documents in 16 shards whose row counts are at most one apart."""
    placed = shards.uniform_shards(shards.sized_documents(table(spark, folder, "documents")), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def dated_lists(pages):
    """Dated list changes for the hosts, domains and first path segments that occur in ``pages``.

    Which of them are listed, and when, follows from checksums of their names.
    """
    def draw(name, salt=""):
        return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(name))), 1, 8), 16, 10).cast("bigint")

    def change(source, name, list_name, kind, action, first, days, where):
        day = F.date_add(F.lit("2024-01-01").cast("date"), (draw(name, f"{list_name}{action}{first}") % days + first).cast("int"))
        return source.where(where).select(F.lit(list_name).alias("list"), F.lit(kind).alias("kind"), F.col(name).alias("pattern"),
                                          F.lit(action).alias("action"), day.alias("changed_on"))

    url = F.col("url")
    seen = pages.select(url_filter.host_of(url).alias("host"), F.split(url_filter.path_of(url), "/")[0].alias("step")).where("host <> ''").distinct()
    hosts = seen.select("host").distinct()
    labels = F.split("host", r"\.")
    domains = hosts.where(F.size(labels) >= 3).select(F.array_join(F.slice(labels, -3, 3), ".").alias("domain")).distinct()
    sections = seen.where("step <> ''").select(F.concat_ws("/", "host", "step").alias("section")).distinct()
    parts = [
        change(hosts, "host", "hosts", "host", "block", 0, 150, draw("host") % 3 == 0),
        change(hosts, "host", "hosts", "host", "remove", 150, 100, draw("host") % 6 == 0),
        change(hosts, "host", "hosts", "host", "block", 260, 90, draw("host") % 12 == 0),
        change(domains, "domain", "domains", "domain", "block", 0, 366, draw("domain") % 4 == 1),
        change(sections, "section", "sections", "prefix", "block", 0, 300, draw("section") % 5 == 0),
        change(sections, "section", "exempt", "prefix", "allow", 100, 200, draw("section") % 3 == 1),
    ]
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.union(part)
    return entries


def captures(pages):
    """Pages with a fetch day of 2024 that follows from the page id."""
    draw = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (draw % 366).cast("int")).alias("fetched_on"))


@query
def op3_url_filters(spark, folder):
    """Every capture judged by the list entries active on the day it was fetched."""
    pages = table(spark, folder, "pages")
    return url_filter.judge(captures(pages), dated_lists(pages))


def _change_sql(source, name, list_name, kind, action, first, days, where):
    return f"""SELECT '{list_name}' AS list, '{kind}' AS kind, {name} AS pattern, '{action}' AS action,
      DATE '2024-01-01' + (draw('{list_name}{action}{first}' || {name}) % {days} + {first})::INTEGER AS day FROM {source} WHERE {where}"""


ORACLE_SQL["op3_url_filters"] = ("""
WITH raw AS (SELECT page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') AS host,
  trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') AS path,
  DATE '2024-01-01' + (draw(page_id::VARCHAR) % 366)::INTEGER AS fetched_on FROM pages),
hosts AS (SELECT DISTINCT host FROM raw WHERE host <> ''),
domains AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS domain FROM hosts WHERE len(string_split(host, '.')) >= 3),
sections AS (SELECT DISTINCT host || '/' || split_part(path, '/', 1) AS section FROM raw WHERE host <> '' AND path <> ''),
changes AS (""" + " UNION ALL ".join([
    _change_sql("hosts", "host", "hosts", "host", "block", 0, 150, "draw(host) % 3 = 0"),
    _change_sql("hosts", "host", "hosts", "host", "remove", 150, 100, "draw(host) % 6 = 0"),
    _change_sql("hosts", "host", "hosts", "host", "block", 260, 90, "draw(host) % 12 = 0"),
    _change_sql("domains", "domain", "domains", "domain", "block", 0, 366, "draw(domain) % 4 = 1"),
    _change_sql("sections", "section", "sections", "prefix", "block", 0, 300, "draw(section) % 5 = 0"),
    _change_sql("sections", "section", "exempt", "prefix", "allow", 100, 200, "draw(section) % 3 = 1"),
]) + """),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until
  FROM (SELECT list, kind, pattern, day, max(action) AS action FROM changes GROUP BY ALL)),
hits AS (SELECT r.page_id, r.url, r.fetched_on, s.*, row_number() OVER (PARTITION BY r.page_id, r.url, r.fetched_on ORDER BY
    CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(pattern) DESC, action = 'allow' DESC, list DESC, pattern DESC) AS place,
    count(*) OVER (PARTITION BY r.page_id, r.url, r.fetched_on) AS n
  FROM raw r JOIN spans s ON s.action <> 'remove' AND r.fetched_on >= s.day AND (s.until IS NULL OR r.fetched_on < s.until)
    AND CASE s.kind WHEN 'host' THEN r.host = s.pattern
                    WHEN 'domain' THEN r.host = s.pattern OR ends_with(r.host, '.' || s.pattern)
                    ELSE r.host || '/' || r.path = s.pattern OR starts_with(r.host || '/' || r.path, s.pattern || '/') END)
SELECT r.page_id, r.url, r.fetched_on, coalesce(h.n, 0)::BIGINT AS n_active, coalesce(h.action = 'block', false) AS blocked,
  h.list || ':' || h.kind || ':' || h.pattern AS reason
FROM raw r LEFT JOIN (SELECT * FROM hits WHERE place = 1) h ON h.page_id = r.page_id AND h.url = r.url""")
# draw(x) stands for the number that the first eight hex digits of x's checksum spell.
ORACLE_SQL["op3_url_filters"] = re.sub(r"draw\(([^()]*)\)", r"(('0x' || substr(md5(\1), 1, 8))::UBIGINT::BIGINT)",
                                       ORACLE_SQL["op3_url_filters"])


@query
def op6_toxic_segments(spark, folder):
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_site_quality(spark, folder):
    """Quality score of every document, by its text and its source and language."""
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op1_benchmark_matches(spark, folder):
    """Every benchmark item that stands in a document with few enough edits."""
    return decontaminate.matched_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_main_text(spark, folder):
    """Main text of every page, whole."""
    return wrappers.extract(table(spark, folder, "pages"))


@query
def op8_near_vectors(spark, folder):
    """Links and component of every embedding at a cosine of at least 0.9."""
    return neighbour_graphs.near_vectors(table(spark, folder, "embeddings"))


@query
def op11_conversation_repair(spark, folder):
    """Faults and the cheapest repair of every conversation after damage."""
    return repair.repair(repair.damaged(table(spark, folder, "conversations")))


@query
def op12_suffix_array_dedup(spark, folder):
    """What is left of every document without passages of 50 bytes that start in an earlier one."""
    return suffixes.digests(suffixes.without_repeats(table(spark, folder, "documents")))


@query
def op13_merkle_manifest(spark, folder):
    """Leaf, roots and proof of every document, and whether its tampered leaf still leads to the root."""
    return manifest.verified(manifest.manifest(table(spark, folder, "documents")))


_FIELD_SQL = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF_SQL = "sha256(" + " || ".join(_FIELD_SQL.format(c) for c in manifest.FIELDS) + ")"


# The checksum of a number's decimal digits, a byte at a time: each is mixed in, then eight bits are shifted out.
_CRC_SQL = ("xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}::VARCHAR, ''), lambda x: list_concat("
            "[ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))), lambda crc, op: CASE WHEN op >= 0 THEN xor(crc, op) "
            "ELSE xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)")


def _tree_sql(name, base, key):
    """Levels of the trees over ``base`` (key, r, h, n): every run of three nodes becomes the next level's node."""
    return f"""{name}({key}, lvl, r, h, n) AS (SELECT {key}, 0, r, h, n FROM {base}
  UNION ALL SELECT {key}, any_value(lvl) + 1, r // 3, sha256(string_agg(h, '' ORDER BY r)), (any_value(n) + 2) // 3 FROM {name}
  WHERE n > 1 GROUP BY {key}, r // 3)"""


def _steps_sql(name, base, tree, key):
    """(key, r, steps) of the nodes of ``base``: 'left|right' of their siblings, level by level."""
    return f"""{name} AS (SELECT {key}, r, list(step ORDER BY lvl) AS steps FROM (
  SELECT b.{key}, b.r, t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.r) FILTER (t.r < b.r // (3 ** t.lvl)::BIGINT), '') || '|' ||
    coalesce(string_agg(t.h, '' ORDER BY t.r) FILTER (t.r > b.r // (3 ** t.lvl)::BIGINT), '') AS step
  FROM {base} b JOIN {tree} t ON t.{key} IS NOT DISTINCT FROM b.{key} AND t.n > 1 AND t.r // 3 = b.r // (3 ** (t.lvl + 1))::BIGINT
  GROUP BY ALL) GROUP BY ALL)"""


ORACLE_SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (SELECT doc_id, source, {_LEAF_SQL} AS h, {_LEAF_SQL.replace("text", "changed")} AS t
  FROM (SELECT *, CASE WHEN {_CRC_SQL.format('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM hashed),
{_tree_sql("own", "leaves", "source")},
tops AS (SELECT 0 AS part, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM own WHERE n = 1),
{_tree_sql("upper", "tops", "part")},
{_steps_sql("low", "leaves", "own", "source")},
{_steps_sql("high", "tops", "upper", "part")},
proofs AS (SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, l.t,
    list_concat(coalesce(w.steps, []), coalesce(g.steps, [])) AS steps
  FROM leaves l JOIN tops s ON s.source IS NOT DISTINCT FROM l.source
  LEFT JOIN low w ON w.source IS NOT DISTINCT FROM l.source AND w.r = l.r LEFT JOIN high g ON g.r = s.r),
checked AS (SELECT *, list_reduce(list_concat([t], steps), lambda own, step: sha256(split_part(step, '|', 1) || own || split_part(step, '|', 2))) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM checked"""
