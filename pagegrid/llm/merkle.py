"""Merkle manifest of a table: leaves of its rows, a tree per group, a tree over the groups.

Every level is a table of nodes (group, index, size of the level, digest). It is joined with
itself on the computed index of a sibling: the index with its last bit flipped where runs are
pairs, otherwise the slot some places on in the same run. Then the rows of slot zero, which
know all their siblings, emit the parents. Way back down, children are joined to their
parent's path by index, so that every leaf gets its siblings up to the root.

Defined cases: rows of equal group and order are ordered by their digests, so repeated rows
give one tree whatever their order. A null group or order comes first. A run of one node is
hashed as well; a group of one leaf is its own subroot. An empty table gives no rows. Texts of
any length are hashed whole by their task. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrid.llm.common import shuffle_partitions, spread_lookup, written

ARITY = 2
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Documents whose id's CRC-32 this divides are tampered with.
TAMPERED = 7
#: Joins on the way down between two written tables.
STRETCH = 6
NODE = ["group", "at"]


def digest(*parts: Column) -> Column:
    """SHA-256 as 32 bytes; inputs that are digests count as their lowercase hex text."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def empty() -> Column:
    return F.unhex(F.lit(""))


def no_path() -> Column:
    return F.array().cast("array<struct<before:binary,after:binary>>")


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def field_text(value: Column) -> Column:
    """``-`` for null, otherwise the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place in the group from 0, and ``size`` of the group.

    A group may hold any share of the rows: they are dealt out by ranges of the order, counted
    per range, and each range starts where those before it end.
    """
    parts = shuffle_partitions(rows.sparkSession)
    keys = ["group", *order]
    # The last key only parts rows that are equal in all others.
    tagged = rows.withColumn("tag", F.monotonically_increasing_id())
    placed = tagged.repartitionByRange(parts, *keys, "tag").sortWithinPartitions(*keys).drop("tag")
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftrightunsigned("place", 33))
    ranges = placed.groupBy("group", "part").agg(
        F.count("*").alias("rows"), F.min("place").alias("first")
    )
    # A row per range of each group, however many rows the group has.
    group = Window.partitionBy("group")
    ahead = F.sum("rows").over(group.orderBy("part")) - F.col("rows")
    starts = ranges.select(
        "group",
        "part",
        (ahead - F.col("first")).alias("shift"),
        F.sum("rows").over(group).alias("size"),
    )
    joined = spread_lookup(placed, starts, ["group", "part"], F.col("place"))
    return joined.withColumn("at", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with ``before`` and ``after``: the digests of their run's others, in order."""
    slot = F.col("at") % arity
    others = []
    for step in range(1, arity):
        # Of the sibling's row: the index of the node that is ``step`` places behind it.
        if arity == 2:
            asked = F.col("at").bitwiseXOR(F.lit(1))
        else:
            asked = F.col("at") - slot + (slot + (arity - step)) % arity
        sibling = nodes.select("group", asked.alias("at"), F.col("digest").alias(f"other{step}"))
        others.append(sibling)
    joined = nodes
    for sibling in others:
        # Merged, since a broadcast of each level would pass through the driver.
        joined = joined.join(sibling.hint("merge"), NODE, "left")
    # The sibling ``step`` places on has a larger slot, or has gone round to a smaller one.
    after = [
        F.when(slot + step < arity, F.coalesce(F.col(f"other{step}"), empty())).otherwise(empty())
        for step in range(1, arity)
    ]
    before = [
        F.when(slot + step >= arity, F.coalesce(F.col(f"other{step}"), empty())).otherwise(empty())
        for step in range(1, arity)
    ]
    return joined.select(
        *NODE, "size", "digest", F.concat(*before).alias("before"), F.concat(*after).alias("after")
    )


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """The nodes above; a group whose tree has ended keeps its root as it is."""
    own = digest(hex_text(F.concat("digest", "after")))
    return level.where(F.col("at") % arity == 0).select(
        "group",
        F.expr(f"at div {arity}").alias("at"),
        F.expr(f"(size + {arity - 1}) div {arity}").alias("size"),
        F.when(F.col("size") > 1, own).otherwise(F.col("digest")).alias("digest"),
    )


def tree_levels(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The levels of all groups' trees from the leaves (group, at, size, digest) to their roots.

    Each is written, which computes it once; a checkpoint would do so twice. A group whose
    tree has ended keeps its root through later levels.
    """
    nodes, levels = leaves.select(*NODE, "size", "digest"), []
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        levels.append(written(_with_siblings(nodes, arity), "level"))
        nodes = _parents(levels[-1], arity)
        largest = -(-largest // arity)
    if largest:
        levels.append(nodes.withColumns({"before": empty(), "after": empty()}))
    return levels


def leaf_paths(levels: list[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """Leaves (group, at, ..) with ``path``: their siblings level by level, then their top's.

    ``tops`` has a row per group: group, what belongs to the group, and ``path`` above it.
    """
    carried = [c for c in tops.columns if c not in ("group", "path")]
    above = tops.withColumn("at", F.lit(0).cast("bigint"))
    for number, level in enumerate(reversed(levels[:-1]), 1):
        down = level.withColumn("up", F.expr(f"at div {arity}"))
        above = above.select("group", F.col("at").alias("up"), *carried, F.col("path").alias("rest"))
        entry = F.array(F.struct("before", "after"))
        own = F.when(F.col("size") > 1, F.concat(entry, "rest")).otherwise(F.col("rest"))
        above = down.join(above.hint("merge"), ["group", "up"]).select(*NODE, *carried, own.alias("path"))
        if number % STRETCH == 0 and number < len(levels) - 1:
            above = written(above, "paths")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path give."""
    return F.aggregate(
        path, leaf, lambda own, x: digest(hex_text(F.concat(x["before"], own, x["after"])))
    )


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root and tampered for every row of ``docs``.

    A tree per ``lang`` and one over their roots. Digests are 32 bytes; ``path`` lists the
    siblings before and after the node at every level up to the root.
    """
    fields = [field_text(F.col(c)) for c in FIELDS]
    changed = [field_text(F.col(c) + 1) if c == "n_chars" else field_text(F.col(c)) for c in FIELDS]
    touched = (F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    lang = F.col("lang").cast("string")
    leaves = numbered(
        docs.select(
            F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("group"),
            F.col("doc_id").cast("bigint").alias("doc_id"),
            digest(*fields).alias("digest"),
            F.when(touched, digest(*changed)).alias("tampered"),
        ),
        ["doc_id", "digest"],
    )
    leaves = written(leaves, "leaves")
    levels = tree_levels(leaves, arity)
    if not levels:
        return _shaped(leaves.withColumns({"subroot": empty(), "root": empty(), "path": no_path()}))
    subroots = levels[-1].select(F.col("group").alias("name"), F.col("digest"))
    tops = numbered(subroots.withColumn("group", F.lit("")), ["name"])
    upper = tree_levels(tops, arity)
    root = bytes(upper[-1].first()["digest"])
    start = tops.select("group").distinct().withColumn("path", no_path())
    paths = leaf_paths(upper, start, arity).select(*NODE, "path")
    named = tops.join(paths, NODE).select(
        F.col("name").alias("group"), F.col("digest").alias("subroot"), "path"
    )
    found = leaf_paths(levels, written(named, "tops"), arity)
    rows = leaves.join(found.hint("merge"), NODE).withColumn("root", F.lit(root))
    return _shaped(rows)


def _shaped(rows: DataFrame) -> DataFrame:
    given = F.coalesce("tampered", "digest")
    return rows.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "path",
        fold(given, F.col("path")).alias("folded_root"),
        F.col("tampered").isNotNull().alias("tampered"),
    )


def verified_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as hex text."""
    rows = manifest(docs)
    siblings = F.flatten(F.transform("path", lambda x: F.array(x["before"], x["after"])))
    proof = F.sha2(F.array_join(F.transform(siblings, hex_text), ""), 256)
    return rows.select(
        "doc_id",
        hex_text(F.col("leaf")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"),
        proof.alias("proof_sha256"),
        hex_text(F.col("folded_root")).alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
