"""Merkle manifest of a dataset: a digest, an inclusion proof and a check of every row.

Leaves.  H of a row is the SHA-256 of its fields, each ``-`` if null, else its
UTF-8 byte count, a colon and its value.  Texts are read once, for their two
digests (as they are, and as tampering would leave them); only digests move.

Ranks.  Leaves are dealt to sorted ranges; a row's rank inside its source is its
position in the range plus what earlier ranges hold of that source, so no source
is sorted by one task.

Rollup.  A rank in base ARITY is split into digit columns.  The last DIGITS of
them name a place inside a block of ARITY ** DIGITS nodes and are grouped away
one after the other, each grouping nesting the structs of its children; the
blocks are the nodes of the next tier, until every source is one node.  The same
rollup over the sources gives the root.

Proofs.  A block's nested struct is unfolded by one transform per digit, which
see all nodes on the way down, and exploded.  What stands above a block comes
from the unfolded tier above by a grouping on (source, block), so a leaf meets
its proof without a join.  No row holds more than one block and one proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.bounded import materialise
from flowsieve.llm.shared import quoted, ranked

ARITY = 3
DIGITS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"
UP = f"struct<last:string,steps:{STEPS}>"


def field(value: Column) -> Column:
    """One field of a leaf's input."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """``text`` without line feeds where 2 divides the checksum of the id, else as it is."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def block_of(rank: Column, digits: int = DIGITS) -> Column:
    return F.floor(rank / F.lit(ARITY ** digits)).cast("long")


def rollup(nodes: DataFrame, tier: int, digits: int = DIGITS) -> DataFrame:
    """(grp, n, block, node) of nodes (grp, n, rank, hash[, more]): one nested struct per block, stored.

    A level is hashed only while its group has several nodes, so a short block passes its node on as it is.
    """
    inside = F.pmod(F.col("rank"), F.lit(ARITY ** digits))
    places = [F.floor(inside / F.lit(ARITY ** i)).cast("int") % ARITY for i in range(digits)]
    more = [c for c in nodes.columns if c not in ("grp", "n", "rank")]
    table = nodes.select("grp", "n", block_of(F.col("rank"), digits).alias("block"),
                         *[p.alias(f"d{i}") for i, p in enumerate(places)], F.struct(*more).alias("node"))
    # All digits of a block are in one partition already, so the groupings below need no further exchange.
    table = table.repartition("grp", "block")
    for i in range(digits):
        left = [f"d{j}" for j in range(i + 1, digits)]
        listed = F.sort_array(F.collect_list(F.struct(F.col(f"d{i}").alias("at"), F.col("node"))))
        grouped = table.groupBy("grp", "n", "block", *left).agg(listed.alias("_kids"))
        kids = F.transform("_kids", lambda k: k["node"])
        own = F.array_join(F.transform("_kids", lambda k: k["node"]["hash"]), "")
        # Level tier * digits + i still has several nodes if its group's count exceeds ARITY to that power.
        several = F.col("n") > F.lit(ARITY ** min(tier * digits + i, 39))
        node = F.struct(F.when(several, F.sha2(own, 256)).otherwise(F.col("_kids")[0]["node"]["hash"]).alias("hash"),
                        several.alias("several"), kids.alias("kids"))
        table = grouped.select("grp", "n", "block", *left, node.alias("node"))
    return materialise(table, f"tier{tier}")


def unfolded(blocks: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(grp, rank, node, up) of every node below the blocks (grp, block, node, up).

    ``up`` holds the group's last hash and the steps that lead there.  A step is what stands left and right of a
    node among its siblings.
    """
    def walk(node: Column, level: int, above: Column) -> Column:
        if level == 0:
            return F.array(F.struct(node.alias("node"), above.alias("steps")))

        def below(kid: Column, at: Column) -> Column:
            def joined(test):
                return F.array_join(F.transform(F.filter(node["kids"], lambda k, j: test(j, at)), lambda k: k["hash"]), "")
            step = F.array(F.struct(joined(lambda j, i: j < i).alias("left"), joined(lambda j, i: j > i).alias("right")))
            return walk(kid, level - 1, F.concat(F.when(node["several"], step).otherwise(F.array().cast(STEPS)), above))

        return F.flatten(F.transform(node["kids"], below))

    found = blocks.select("grp", "block", F.col("up")["last"].alias("last"),
                          F.posexplode(walk(F.col("node"), digits, F.col("up")["steps"])).alias("_at", "_one"))
    rank = F.col("block") * F.lit(ARITY ** digits) + F.col("_at")
    return found.select("grp", rank.alias("rank"), F.col("_one")["node"].alias("node"),
                        F.struct("last", F.col("_one")["steps"].alias("steps")).alias("up"))


def trees(nodes: DataFrame, digits: int = DIGITS) -> list[DataFrame]:
    """The stored tiers of blocks above nodes (grp, n, rank, hash[, more]); the last has one block per group."""
    largest = nodes.agg(F.max("n")).first()[0] or 1
    tiers = [rollup(nodes, 0, digits)]
    while largest > ARITY ** (digits * len(tiers)):
        below = tiers[-1].select("grp", "n", F.col("block").alias("rank"), F.col("node")["hash"].alias("hash"))
        tiers.append(rollup(below, len(tiers), digits))
    return tiers


def tops(tiers: list[DataFrame]) -> DataFrame:
    """(grp, hash) of every group's last node."""
    return tiers[-1].select("grp", F.col("node")["hash"].alias("hash"))


def descended(tiers: list[DataFrame], above: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(grp, rank, node, up) of the lowest tier's nodes; ``above`` (grp, rank 0, up) stands over the groups.

    Each tier's blocks meet the steps found for them in the tier above by a union and a grouping on their key.
    """
    found = above
    for tier in reversed(tiers):
        kind = tier.schema["node"].dataType
        both = tier.select("grp", "block", "node", F.lit(None).cast(UP).alias("up")).unionByName(
            found.select("grp", F.col("rank").alias("block"), F.lit(None).cast(kind).alias("node"), "up"))
        met = both.groupBy("grp", "block").agg(F.collect_list("node").alias("_node"), F.collect_list("up").alias("_up"))
        found = unfolded(met.select("grp", "block", F.col("_node")[0].alias("node"), F.col("_up")[0].alias("up")), digits)
    return found


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, start, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, tampered): digests and proof of every row, and its leaf after tampering.

    Reads the columns named in FIELDS; others, whatever their names, are left alone.  Null ids come first and are
    never tampered with; rows that repeat an id are ordered by their digests, equal rows take each other's place.
    A null source is a group of its own, before all others.  Empty and very long texts are hashed whole.  An
    empty table gives no rows.
    """
    columns = [F.col(quoted(c)) for c in FIELDS]
    own = dict(zip(FIELDS, columns))
    changed = [tampered_text(own["doc_id"], c) if name == "text" else c for name, c in own.items()]
    leaves = materialise(df.select(own["source"].cast("string").alias("grp"), own["doc_id"].alias("doc_id"),
                                   leaf(columns).alias("hash"), leaf(changed).alias("tampered")), "leaves")
    nodes = ranked(leaves, ["grp"], ["doc_id", "hash"])
    tiers = trees(nodes.select("grp", "n", "rank", "hash", "tampered", "doc_id"), digits)
    subroots = materialise(tops(tiers).select(F.col("grp").alias("source"), "hash", F.lit("").alias("grp")), "subroots")
    sources = ranked(subroots, ["grp"], ["source"])
    upper = trees(sources.select("grp", "n", "rank", "hash", "source"), digits)
    start = F.lit(0).cast("long").alias("rank")
    over = descended(upper, tops(upper).select("grp", start, F.struct(F.col("hash").alias("last"), F.array().cast(STEPS).alias("steps")).alias("up")),
                     digits)
    # The last hash over a source is the root; from here on it is the source's own, and the steps go on to the root.
    above = materialise(over.select(F.col("node")["source"].alias("grp"), start, F.struct(
        F.concat(F.col("node")["hash"], F.col("up")["last"]).alias("last"), F.col("up")["steps"].alias("steps")).alias("up")), "above")
    found = descended(tiers, above, digits)
    node, last = F.col("node"), F.col("up")["last"]
    return found.select(node["doc_id"].alias("doc_id"), node["hash"].alias("leaf"), F.substring(last, 1, 64).alias("subroot"),
                        F.substring(last, 65, 64).alias("root"), F.col("up")["steps"].alias("steps"), node["tampered"].alias("tampered"))


def verified(proofs: DataFrame) -> DataFrame:
    """Digests of what ``manifest`` returns, and whether the tampered leaf still leads to the root."""
    root = folded(F.col("tampered"), F.col("steps"))
    return (proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), root.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
