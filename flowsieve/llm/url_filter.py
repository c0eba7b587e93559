"""URL filters from dated lists: every capture is judged by the entries active when it was fetched.

List entries are dated changes: (list, kind, pattern, action, changed_on).  They
become validity intervals: an entry holds from its date until the next change
of the same pattern in the same list.  Kinds are ``domain`` (the host and all
below it), ``host`` (that host alone) and ``prefix`` (host and leading path
segments).  A capture's URL names all patterns that could match it, no deeper
than the deepest entry, so the as-of join is an equality on (kind, pattern) with
the date checked inside; captures that share URL and date are judged once, and
a host with very many captures is a hot key that adaptive execution splits.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsieve.llm.shared import quoted, small_or_shuffled

# How exact a kind is; the most exact active entry decides.
RANK = {"domain": 1, "host": 2, "prefix": 3}


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and last dot; empty if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.rtrim(F.lower(host), F.lit("."))


def path_of(url: Column) -> Column:
    """Path of an absolute URL without query and fragment, without slashes at its ends."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.trim(path, F.lit("/"))


def validity(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, action, valid_from, valid_to) of dated changes; valid_to is null while open.

    Of several changes of one pattern on one day the last in alphabetical order holds (allow, block, remove).
    Rows with a null in any of the five columns are no entries; repeated rows count once.
    """
    changes = entries.select(F.col("list"), F.col("kind"), F.lower("pattern").alias("pattern"), F.col("action"),
                             F.col("changed_on").cast("date").alias("valid_from")).na.drop()
    changes = changes.groupBy("list", "kind", "pattern", "valid_from").agg(F.max("action").alias("action"))
    following = Window.partitionBy("list", "kind", "pattern").orderBy("valid_from")
    return changes.withColumn("valid_to", F.lead("valid_from").over(following)).where(F.col("action") != "remove")


def candidate_patterns(url: Column, labels: int, segments: int) -> Column:
    """(kind, pattern) of all entries that can match a URL, up to so many labels and path segments."""
    host, path = host_of(url), path_of(url)
    parts, steps = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(parts, F.size(parts) - i + 1, i), ".").alias("pattern")))
    prefixes = F.when(path != "", F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(segments))), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("pattern"))))
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host != "", F.concat(domains if labels else F.slice(exact, 1, 0), exact,
                                       F.coalesce(prefixes, F.slice(exact, 1, 0)) if segments else F.slice(exact, 1, 0)))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """``captures`` with n_active, blocked and reason.

    n_active counts the entries active on the capture's day that match its URL; the most exact decides (prefix
    before host before domain, then the longer pattern, then allow before block, then the later list name), and
    reason is its list:kind:pattern.  A capture with a null or host-less URL or a null date matches nothing and
    is not blocked; repeated captures keep a row each; without entries nothing is blocked.  Columns of
    ``captures`` named like a result are replaced.
    """
    held = small_or_shuffled(validity(entries), "intervals")
    deepest = held.agg(F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))),
                       F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1))).first()
    keep = [c for c in captures.columns if c.lower() not in ("n_active", "blocked", "reason")]
    rows = captures.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"), F.col(quoted(url_col)).alias("url"),
                           F.col(quoted(day_col)).cast("date").alias("day"))
    asked = rows.select("url", "day").na.drop().distinct()
    named = asked.select("url", "day", F.explode(candidate_patterns(F.col("url"), deepest[0] or 0, deepest[1] or 0)).alias("k"))
    matched = (named.select("url", "day", F.col("k.kind").alias("kind"), F.col("k.pattern").alias("pattern"))
               .join(held, ["kind", "pattern"])
               .where((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))))
    rank = F.coalesce(*[F.when(F.col("kind") == k, r) for k, r in RANK.items()], F.lit(0))
    decisive = F.struct(rank.alias("rank"), F.length("pattern").alias("length"), (F.col("action") == "allow").cast("int").alias("allow"),
                        "list", "kind", "pattern")
    verdicts = matched.groupBy("url", "day").agg(F.count("*").alias("n"), F.max(decisive).alias("d"))
    met = rows.join(verdicts, ["url", "day"], "left")
    return met.select("row.*", F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
                      F.coalesce(F.col("d.allow") == 0, F.lit(False)).alias("blocked"),
                      F.when(F.col("n").isNotNull(), F.concat_ws(":", "d.list", "d.kind", "d.pattern")).alias("reason"))
