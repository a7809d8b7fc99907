"""Merkle manifests against trees built in memory, for several fan-outs, group sizes and tampered rows."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests, fanout):
    """Root of some digests and for each of them the (before, after) steps."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, way in enumerate(ways):
            first = at[k] // fanout * fanout
            way.append(("".join(level[first : at[k]]), "".join(level[at[k] + 1 : first + fanout])))
            at[k] //= fanout
        level = [sha("".join(level[j : j + fanout])) for j in range(0, len(level), fanout)]
    return level[0], ways


def by_hand(leaves, fanout):
    """(doc_id, leaf, subroot, root, path) of (doc_id, lang, leaf) rows."""
    groups = defaultdict(list)
    for doc_id, lang, leaf in leaves:
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = [(sorted(groups[g]), *tree([x[2] for x in sorted(groups[g])], fanout)) for g in names]
    root, high = tree([b[1] for b in built], fanout)
    return [(x[3], x[2], b[1], root, tuple(w + up)) for b, up in zip(built, high) for x, w in zip(b[0], b[2])]


LANGS = ["en", None, "", "de", "é", "Z", "日本"]


@pytest.mark.parametrize("fanout, sizes", [(8, [70, 1, 8, 9, 3, 64, 2]), (2, [5, 1, 8, 9]), (3, [28]), (8, [1]), (8, [0, 0, 9]), (2, [1] * 7)])
def test_against_trees_in_memory(spark, fanout, sizes):
    ids = iter(range(1, 10_000))
    rows = [(next(ids) * 7919 % 10_007, LANGS[g]) for g, size in enumerate(sizes) for _ in range(size)]
    rows = [(i, g, sha(f"{i}{g}")) for i, g in rows]
    leaves = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(3)
    found = merkle.manifest(leaves, "lang", ["doc_id"], fanout)
    got = sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"])) for r in found.collect())
    assert got == sorted(by_hand(rows, fanout))
    folds = found.select(merkle.folded(F.col("leaf"), F.col("path")).alias("f"), "root", merkle.proof_digest(F.col("path")).alias("p"), "doc_id")
    wanted = {i: sha("".join(a + b for a, b in path)) for i, _, _, _, path in by_hand(rows, fanout)}
    assert all(r["f"] == r["root"] and r["p"] == wanted[r["doc_id"]] for r in folds.collect())


def test_awkward_rows(awkward, awkward_rows):
    """Nulls, empty and long texts, repeated rows and ids: every row is a leaf; one changed letter shows, an equal text does not."""
    leaves = awkward.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    leaves = leaves.select("doc_id", "lang", "text", merkle.document_leaf(F.col("text")).alias("leaf"), merkle.document_leaf(F.lower("text")).alias("claimed"))
    rows = [(r["doc_id"], r["lang"], r["leaf"]) for r in leaves.collect()]
    found = merkle.manifest(leaves.drop("text"), "lang", ["doc_id"]).withColumn("f", merkle.folded(F.col("claimed"), F.col("path"))).collect()
    assert sorted(map(repr, ((r["doc_id"], r["leaf"], r["subroot"], r["root"]) for r in found))) == sorted(repr(x[:4]) for x in by_hand(rows, 8))
    assert len(found) == len(awkward_rows) and all((r["f"] == r["root"]) == (r["claimed"] == r["leaf"]) for r in found)
    assert {r["claimed"] == r["leaf"] for r in found} == {True, False}


def test_leaf_digest(spark):
    df = spark.createDataFrame([(1, None, "é:", 3), (-2, "", None, None)], "doc_id long, source string, lang string, n_chars long")
    got = [r[0] for r in df.orderBy("n_chars").select(merkle.leaf_digest(*map(F.col, df.columns))).collect()]
    assert got == [sha("2:-20:--"), sha("1:1-3:é:1:3")]
    assert encoded("é:") == "3:é:"


def test_one_group_many_equal_rows(spark):
    """Rows equal in every column are still single leaves."""
    leaves = spark.range(600).select(F.lit(5).alias("doc_id"), F.lit("en").alias("lang"), F.lit(sha("x")).alias("leaf"))
    found = merkle.manifest(leaves, "lang", ["doc_id"], 2)
    assert {(r["root"], len(r["path"])) for r in found.collect()} == {(tree([sha("x")] * 600, 2)[0], 10)} and found.count() == 600


def test_empty_table(nothing):
    leaves = nothing.select("doc_id", "lang", merkle.document_leaf(F.col("text")).alias("leaf"))
    assert merkle.manifest(leaves, "lang", ["doc_id"]).collect() == []
