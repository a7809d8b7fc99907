"""Connected components of a table of links, as DataFrame joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b: longs): root is the smallest node that can be reached.

    Union-find by contraction: every node points to its first neighbour in some order if that comes before itself,
    pointers are followed, links are redrawn between the nodes pointed to, and the rest goes into the next round. The
    order alternates between that of the nodes, which ends stars, and a hashed one, which cuts chains. Each round writes
    its pointers and its links to the shared folder, so lineage stays short and a lost executor costs one round at most.
    Repeated links and loops do no harm; no links give no rows. A node with very many links is combined before the
    shuffle when pointers are formed; the joins on it can be split by adaptive execution.
    """
    edges = links.select("a", "b")
    count = edges.count()
    labels, turn = None, 0
    while True:

        def rank(node: Column, turn: int = turn) -> Column:
            return F.xxhash64(node, F.lit(turn)) if turn % 2 else node

        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        b, near = F.col("b"), F.col("near")
        first = both.groupBy("a").agg(F.min_by(b, rank(b)).alias("near"))
        up = F.when(rank(near) < rank(F.col("a")), near).otherwise(F.col("a"))
        point = written(first.select(F.col("a").alias("node"), up.alias("up")), "pointers", 2 * count)
        for _ in range(2):
            above = point.select(F.col("node").alias("up"), F.col("up").alias("top"))
            point = point.join(above, "up").select("node", F.col("top").alias("up"))
        point = written(point, "pointers", 2 * count)
        labels = (
            point.withColumnRenamed("up", "root")
            if labels is None
            else labels.join(point.withColumnRenamed("node", "root"), "root", "left").select(
                "node", F.coalesce("up", "root").alias("root")
            )
        )
        left, right = (point.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in ("a", "b"))
        edges = written(
            edges.join(left, "a").join(right, "b").filter("a_up <> b_up")
            .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(),
            "links",
            count,
        )
        turn, count = turn + 1, edges.count()
        if not count:
            break
    labels = written(labels, "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return written(labels.join(least, "root").select("node", F.col("least").alias("root")), "components")


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components once more links are known: only the links between different components are worked on."""
    if labels is None:
        return None if links.isEmpty() else components(links)
    for x in ("a", "b"):
        roots = labels.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
        links = links.join(roots, x, "left").withColumn(f"{x}_root", F.coalesce(f"{x}_root", x))
    across = written(links.filter("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "across")
    if across.isEmpty():
        return labels
    above = components(across).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = labels.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = above.join(labels.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return written(moved.unionByName(fresh), "components")
