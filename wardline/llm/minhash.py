"""Near duplicates by circulant MinHash, banding and exact Jaccard on full shingle sets.

Two fixed permutations of 32-bit numbers make all coordinates of a signature: the first scatters the shingles, the second
is applied after a circular shift by k, and coordinate k is its minimum. ``ROWS`` coordinates form a band; documents that
share a band are candidates (a pair of similarity 0.75 shares none of 32 bands of 4 with probability 5e-6).

Exact copies of a set form a class first and only one of each class goes on. In every bucket all members meet two hubs,
the smallest and the largest under a scrambled order of that bucket, so a bucket of n members makes 2n pairs. Pairs are
screened by their signatures and confirmed on full sets, the most similar partner of each document first; pairs within a
component that is already known are left out. A bucket that still holds several components is compared wholly, in blocks
of bounded size: signatures of members of different components are compared inside a task, each pair in the first bucket
it shares; members that may reach the threshold come back with their full sets, which are compared inside a task as well,
and only links leave it. So no bucket is capped, no pairs are listed, and no link that a shared band could show is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from wardline.llm.graph import extended
from wardline.llm.shared import byte_texts, identified, map_batches, mixed, window_hashes, word_hashes, written

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: A signature agrees in this share of coordinates or more, if the sets reach the threshold (five deviations below it).
LEAST_AGREEMENT = 0.56
BLOCK = 512
SMALL_KEYS = 2_000_000  # keys up to which a semi-join may be broadcast (16 bytes each); beyond, a plain join

_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None]
_BAND_SALT = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; fewer words are one run; none give an empty set."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(size, len(words))))


def signature(found: np.ndarray) -> np.ndarray:
    """Minima of the shifted second permutation over the scattered shingles, in slices so that long texts fit."""
    low = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    scattered = (mixed(found) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(scattered), 4096):
        x = scattered[None, at : at + 4096] + _SHIFTS
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND_SALT.copy()
    for k in range(ROWS):
        key = mixed(key ^ parts[:, k])
    return key.view(np.int64)


def _signed(documents: DataFrame) -> DataFrame:
    """doc_id, _row, text_key, n_shingles, print (of the set), bands, sketch for each row."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        sizes, prints, keys, sketches = [], [], [], []
        for text in byte_texts(batch.column("text")):
            found = shingles(text)
            sizes.append(len(found))
            if len(found):
                low = signature(found)
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(bands(low))
                sketches.append(low.astype(np.uint8).tobytes())
            else:
                prints.append(None)
                keys.append(None)
                sketches.append(None)
        return {
            "doc_id": batch.column("doc_id"), "_row": batch.column("_row"), "text_key": batch.column("text_key"), "n_shingles": sizes,
            "print": prints, "bands": keys, "sketch": sketches,
        }

    rows = documents.select("doc_id", "_row", F.xxhash64("text").alias("text_key"), "text")
    return map_batches(rows, work, "doc_id long, _row long, text_key long, n_shingles long, print binary, bands array<long>, sketch binary")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept for every row; text_key is xxhash64 of the text.

    Texts without words and null texts are linked with nothing: component_id is their own id. Null ids are passed over
    when the smallest id is sought; a component of null ids only has a null component_id. One document of each component is
    kept: of the smallest id, and if texts share it or it is null, the one of smallest text_key (and, without id, one row of
    it). Rows that repeat an id (not null) and a text are one document and judged alike. Other columns are not read.
    """
    return _judged(identified(documents, "_row")).drop("_row")


def _judged(documents: DataFrame) -> DataFrame:
    """What near_duplicates returns, and _row, for identified rows."""
    signed = written(_signed(documents).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    unnamed = F.lit(str(1 << 63)).cast("decimal(20,0)") + F.col("_row").cast("decimal(20,0)")
    whole = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), unnamed.cast("decimal(20,0)"))
    place = whole.cast("decimal(20,0)") * F.lit(str(1 << 60)).cast("decimal(19,0)") + F.shiftrightunsigned("text_key", 4).cast("decimal(19,0)")
    with_set = signed.filter("print is not null").withColumn("place", place.cast("decimal(38,0)"))
    classes = written(
        with_set.groupBy("print").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_id"), F.min("place").alias("first")), "classes"
    )
    ones = written(with_set.join(classes.select("rid"), "rid", "left_semi").drop("print", "place", "_row"), "representatives")
    members = _members(ones)
    tested = joined = None
    for stage in ("best hub", "other hubs", "rest"):
        if stage == "rest":
            found = written(_rest_links(members, ones, joined, documents), "links")
        else:
            pairs = _hub_pairs(members, ones, joined)
            if stage == "best hub":
                best = W.partitionBy("member").orderBy(F.col("agreement").desc(), "a", "b")
                pairs = pairs.withColumn("place", F.row_number().over(best)).filter("place = 1")
            else:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = tested = written(pairs.select("a", "b").distinct(), "pairs")
            found = written(_confirmed(pairs, ones, documents), "links")
        joined = extended(joined, found)
    if joined is None:
        named = classes.select("print", F.col("first_id").alias("component_id"), "first")
    else:
        rooted = classes.join(joined.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first").alias("first"))
        named = rooted.drop("first").join(smallest, "root").select("print", "component_id", "first")
    columns = ["doc_id", "_row", "text_key", "n_shingles"]
    every = with_set.join(named, "print").select(*columns, "component_id", (F.col("place") == F.col("first")).alias("kept"))
    return every.unionByName(
        signed.filter("print is null").select(*columns, F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    )


def _members(ones: DataFrame) -> DataFrame:
    """bucket, rid, low_hub, high_hub for the buckets that hold two or more representatives."""
    banded = ones.select("rid", F.explode("bands").alias("bucket"))
    veil = F.xxhash64("bucket")  # exclusive-or with it orders the members of each bucket anew
    veiled = F.col("rid").bitwiseXOR(veil)
    shared = (
        banded.groupBy("bucket").agg(F.min(veiled).alias("low"), F.max(veiled).alias("high")).filter("low <> high")
        .select("bucket", F.col("low").bitwiseXOR(veil).alias("low_hub"), F.col("high").bitwiseXOR(veil).alias("high_hub"))
    )
    return written(banded.join(shared, "bucket").select("bucket", "rid", "low_hub", "high_hub"), "members")


def _rooted(rows: DataFrame, joined: DataFrame | None, rid: str, root: str) -> DataFrame:
    """Adds the component of a node so far; a node without links is its own."""
    if joined is None:
        return rows.withColumn(root, F.col(rid))
    roots = joined.select(F.col("node").alias(rid), F.col("root").alias(root))
    return rows.join(roots, rid, "left").withColumn(root, F.coalesce(root, rid))


def _hub_pairs(members: DataFrame, ones: DataFrame, joined: DataFrame | None) -> DataFrame:
    """member, a < b, agreement of the member with a hub of another component, where signatures allow the threshold."""
    pairs = (
        members.select(F.col("rid").alias("member"), F.explode(F.array("low_hub", "high_hub")).alias("hub"))
        .filter("member <> hub").distinct()
    )
    pairs = _rooted(_rooted(pairs, joined, "member", "member_root"), joined, "hub", "hub_root").filter("member_root <> hub_root")
    left = ones.select(F.col("rid").alias("member"), F.col("sketch").alias("x"))
    right = ones.select(F.col("rid").alias("hub"), F.col("sketch").alias("y"))

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES) for c in "xy")
        return {"member": batch.column("member"), "hub": batch.column("hub"), "agreement": (x == y).mean(axis=1)}

    met = pairs.select("member", "hub").join(left, "member").join(right, "hub")
    return map_batches(met, work, "member long, hub long, agreement double").filter(F.col("agreement") >= LEAST_AGREEMENT).select(
        "member", F.least("member", "hub").alias("a"), F.greatest("member", "hub").alias("b"), "agreement"
    )


def _rest_links(members: DataFrame, ones: DataFrame, joined: DataFrame | None, documents: DataFrame) -> DataFrame:
    """Links a < b between different components that share a bucket of four or more, enough of them to join all that are linked."""
    rooted = _rooted(members.select("bucket", "rid"), joined, "rid", "root")
    open_buckets = (
        rooted.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
        .filter("n > 3 and low <> high").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("rid", "bucket"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        rooted.join(open_buckets, "bucket").withColumn("own", block).withColumn("other", other)
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        .join(ones.select("rid", "sketch", "bands"), "rid").select("bucket", "i", "j", "own", "rid", "root", "sketch", "bands")
    )

    def hopeful(group: pd.DataFrame) -> pd.DataFrame:
        near = {k for pair in _near_pairs(group) for k in pair}
        return group.iloc[sorted(near)][["bucket", "i", "j", "own", "rid", "root", "sketch", "bands"]]

    schema = "bucket long, i int, j int, own int, rid long, root long, sketch binary, bands array<long>"
    left = written(dealt.groupBy("bucket", "i", "j").applyInPandas(hopeful, schema), "hopeful")
    sets = _sets(left.select("rid").distinct(), ones, documents).withColumnRenamed("own", "set")

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        rid, root, sets = group["rid"].to_numpy(), group["root"].to_numpy(), group["set"].to_list()
        above: dict[int, int] = {}

        def find(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        links = []
        for k, m in _near_pairs(group):
            p, q = find(root[k]), find(root[m])
            if p != q:
                small, large = sorted((len(sets[k]), len(sets[m])))
                if 100 * small >= PERCENT * large:
                    shared = len(np.intersect1d(sets[k], sets[m], assume_unique=True))
                    if 100 * shared >= PERCENT * (small + large - shared):
                        above[p] = q
                        links.append((min(rid[k], rid[m]), max(rid[k], rid[m])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return left.join(sets, "rid").groupBy("bucket", "i", "j").applyInPandas(confirm, "a long, b long").distinct()


def _near_pairs(group: pd.DataFrame):
    """Places of members of different components whose signatures allow the threshold and that share no earlier band."""
    x = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint8).reshape(-1, COORDINATES)
    keys, bucket = np.stack(group["bands"].to_list()), group["bucket"].iloc[0]
    at = int(np.flatnonzero((keys == bucket).any(axis=0))[0])  # the band that this bucket belongs to
    root, own = group["root"].to_numpy(), group["own"].to_numpy()
    across = group["i"].iloc[0] != group["j"].iloc[0]
    least = int(np.ceil(LEAST_AGREEMENT * COORDINATES))
    for k in range(len(x) - 1):
        rest = np.flatnonzero((root[k + 1 :] != root[k]) & ((own[k + 1 :] != own[k]) | (not across))) + k + 1
        rest = rest[(x[rest] == x[k]).sum(axis=1) >= least]
        if at and len(rest):
            rest = rest[~(keys[rest, :at] == keys[k, :at]).any(axis=1)]
        for m in rest.tolist():
            yield k, m


def _sets(rids: DataFrame, ones: DataFrame, documents: DataFrame) -> DataFrame:
    """rid, own: the full shingle sets, made again from the texts of the documents concerned."""
    wanted = written(
        rids.join(ones.select("rid", "doc_id", "text_key"), "rid")
        .select("rid", F.coalesce("doc_id", F.lit(0)).alias("id_key"), F.col("doc_id").isNull().alias("id_null"), "text_key"),
        "wanted",
    )
    keyed = documents.select(
        "text", F.coalesce("doc_id", F.lit(0)).alias("id_key"), F.col("doc_id").isNull().alias("id_null"),
        F.xxhash64("text").alias("text_key"),
    )
    side = F.broadcast(wanted) if wanted.count() <= SMALL_KEYS else wanted
    texts = keyed.join(side, ["id_key", "id_null", "text_key"]).select("rid", "text")

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        return {"rid": batch.column("rid"), "own": [shingles(t).view(np.int64) for t in byte_texts(batch.column("text"))]}

    return written(map_batches(texts, work, "rid long, own array<long>"), "sets")


def _confirmed(pairs: DataFrame, ones: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    rids = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    sets = _sets(rids, ones, documents)
    left = sets.select(F.col("rid").alias("a"), F.col("own").alias("x"))
    right = sets.select(F.col("rid").alias("b"), F.col("own").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")).cast("long"))
    union = F.size("x") + F.size("y") - F.col("shared")
    return both.filter(100 * F.col("shared") >= PERCENT * union).select("a", "b").distinct()


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """One document of each component, all columns: the one of smallest id; rows that repeat its id and text are one.

    Of several texts of the smallest id one stays; of rows without id each is a document. The column `_row` is reserved.
    """
    rows = identified(documents, "_row")
    judged = _judged(rows).filter("not kept").select(
        F.col("doc_id").alias("_id"), F.col("_row").alias("_number"), F.col("text_key").alias("_other")
    ).distinct()
    keyed = rows.withColumn("_key", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(judged["_id"]) & keyed["_row"].eqNullSafe(judged["_number"]) & (keyed["_key"] == judged["_other"])
    return keyed.join(judged, same, "left_anti").drop("_key", "_row")
