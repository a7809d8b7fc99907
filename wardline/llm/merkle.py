"""Merkle manifest of a table: one tree per group, one tree over the group roots, and for each row the way to the root.

Leaves are numbered within their group by a range sort whose partitions are then offset by the sizes of those before, so no
group is ever in one task. A level is built by sibling shifts: nodes are keyed by their own index, the slot-zero node of
every run meets each of its siblings in an equijoin on the computed sibling index (XOR with one for binary trees, slot
offsets otherwise) and emits the parent. Every node is shuffled once per level and levels shrink by the fan-out. Ways to the
root are handed down from parents to the runs below them, so leaves take part in one such join only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.shared import written

FANOUT = 8
PATH = "array<struct<before:string,after:string>>"
#: Order of the subroots: no group first, then groups by their bytes.
_NO_GROUP, _SOME_GROUP = "0", "1"


def encoded(value: Column) -> Column:
    """A value as hashed: `-` if null, else the number of its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the encoded values one after another."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place of a row in its tree from 0 on by ``order``, and ``n``, the rows of the tree.

    Rows that are equal in all of ``order`` take any places. A number of the row closes the sort key, so that even rows
    that repeat one another are spread over tasks.
    """
    sort = [tree, *order, "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = written(ranged.drop("_row").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "placed")
    sizes = placed.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    # One row for each task that holds rows of a tree; the sums run inside a tree.
    before = sizes.selectExpr(
        tree, "_part", "_first", f"sum(_size) over (partition by {tree}) as n",
        f"coalesce(sum(_size) over (partition by {tree} order by _part rows between unbounded preceding and 1 preceding), 0) as _before",
    )
    numbered = placed.join(before, [tree, "_part"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first"))
    return numbered.drop("_part", "_at", "_first", "_before")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """tree, idx, digest, n of the parents and ``kids``, the digests of their runs in order; nodes have tree, idx, digest, n."""
    slot = F.pmod("idx", F.lit(fanout))
    runs, kids = nodes.filter(slot == 0).withColumnRenamed("digest", "_0"), ["_0"]
    for shift in range(1, fanout):
        # The index of the slot-zero sibling of a node in slot ``shift``.
        zero = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if fanout == 2 else F.col("idx") - shift
        sibling = nodes.filter(slot == shift).select("tree", zero.alias("idx"), F.col("digest").alias(f"_{shift}"))
        runs = runs.join(sibling, ["tree", "idx"], "left")
        kids.append(f"_{shift}")
    return runs.select(
        "tree", F.expr(f"idx div {fanout}").alias("idx"), F.sha2(F.concat_ws("", *kids), 256).alias("digest"),
        F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.array_compact(F.array(*kids)).alias("kids"),
    )


def _levels(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level from the lowest on, and tree, digest of what remains of every tree."""
    levels, tops = [], nodes.filter("n = 1").select("tree", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(written(_parents(nodes.filter("n > 1"), fanout), "runs"))
        nodes = levels[-1].select("tree", "idx", "digest", "n")
        tops = tops.unionByName(nodes.filter("n = 1").select("tree", "digest"))
        most = -(-most // fanout)
    return levels, written(tops, "tops")


def _step(kids: Column, slot: Column) -> Column:
    """The siblings before and after a slot, each run of digests as one text."""
    return F.struct(
        F.array_join(F.slice(kids, F.lit(1), slot), "").alias("before"),
        F.array_join(F.slice(kids, slot + 2, F.greatest(F.size(kids) - slot - 1, F.lit(0))), "").alias("after"),
    )


def _ways(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """tree, idx, path of the nodes above the lowest runs: the steps from a node up to the end of ``tops``.

    ``tops`` has tree, path and any further columns, which go down with it.
    """
    extra = [c for c in tops.columns if c not in ("tree", "path")]
    ways = tops.select("tree", F.lit(0).cast("long").alias("idx"), "path", *extra)
    for runs in reversed(levels[1:]):
        # A lower tree has no run at this height and keeps its way.
        reached = ways.join(runs.select("tree", "idx", "kids"), ["tree", "idx"], "left")
        below = F.transform("kids", lambda _, slot: F.struct(
            (F.col("idx") * fanout + slot).alias("idx"), F.concat(F.array(_step(F.col("kids"), slot)).cast(PATH), "path").alias("path")
        ))
        own = F.array(F.struct("idx", "path"))
        nodes = F.explode(F.when(F.col("kids").isNull(), own).otherwise(below)).alias("_node")
        ways = written(reached.select("tree", nodes, *extra).select("tree", "_node.idx", "_node.path", *extra), "ways")
    return ways


def manifest(leaves: DataFrame, group: str, order: list[str], fanout: int = FANOUT) -> DataFrame:
    """All rows and columns of ``leaves`` and idx, path, subroot, root.

    ``leaves`` has ``leaf`` (hex digest), ``group`` and ``order``, the columns that place a leaf in its group (nulls
    first; leaves equal in them are placed by their digest). ``path`` holds a step for each level, the digests before and
    after the own one; a node alone in its run has an empty step, a group of one leaf has none of its own and the leaf is
    its subroot. Subroots in order of their groups (null first, then by bytes) form the upper tree. Repeated rows are
    leaves of their own. An empty table gives no rows. Columns named tree, idx, n, kids,
    path, subroot, root or with a leading underscore are reserved: hand in the leaf and what identifies it, not whole rows.
    """
    columns = leaves.columns
    tree = F.when(F.col(group).isNull(), F.lit(_NO_GROUP)).otherwise(F.concat(F.lit(_SOME_GROUP), F.col(group).cast("string")))
    placed = written(_numbered(leaves.withColumn("tree", tree), "tree", [*order, "leaf"]), "leaves")
    levels, subroots = _levels(placed.select("tree", "idx", F.col("leaf").alias("digest"), "n"), fanout)
    upper = _numbered(subroots.select("tree", "digest", F.lit("").alias("_all")), "_all", ["tree"])
    upper = written(upper.withColumnRenamed("tree", "_group").withColumnRenamed("_all", "tree"), "subroots")
    above, top = _levels(upper.select("tree", "idx", "digest", "n"), fanout)
    high = top.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    groups = _leaf_ways(upper, above, high, fanout, ["_group", "digest"])
    tops = written(groups.select(F.col("_group").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "groups")
    return _leaf_ways(placed, levels, tops, fanout, columns).select(*columns, "idx", "path", "subroot", "root")


def _leaf_ways(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int, columns: list[str]) -> DataFrame:
    """Joins the way to each leaf: once from the run above it; a leaf alone in its tree has that of the tree's end."""
    extra = [c for c in tops.columns if c not in ("tree", "path")]
    if not levels:
        return leaves.select("tree", "idx", *columns).join(tops, "tree")
    runs = levels[0].select("tree", F.col("idx").alias("_run"), "kids")
    ways = _ways(levels, tops, fanout).withColumnRenamed("idx", "_run").withColumnRenamed("path", "_way")
    met = leaves.select("tree", "idx", *columns).withColumn("_run", F.expr(f"idx div {fanout}"))
    met = met.join(ways.join(runs, ["tree", "_run"], "left"), ["tree", "_run"])
    step = F.array(_step(F.col("kids"), F.pmod("idx", F.lit(fanout)).cast("int"))).cast(PATH)
    path = F.when(F.col("kids").isNull(), F.col("_way")).otherwise(F.concat(step, "_way"))
    return met.select("tree", "idx", *columns, path.alias("path"), *extra)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step.before, digest, step.after), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.before, s.after)), ""), 256)


def document_leaf(text: Column) -> Column:
    """Leaf of a row of documents with this text."""
    return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
