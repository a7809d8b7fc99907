"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due target / source size copies, between 0 and 2. The whole part is certain; the fraction
is rounded by the pivotal method: two documents meet, one of them gets all it can of their joint fraction and becomes
integral, the other goes on with the rest. Documents meet in order of size, so the words taken stay near the target.

The work is a reduction tree: documents of a source and size class are dealt by hash into blocks of about ``BLOCK`` rows;
each block is run through in one streaming pass that keeps one open document; the open documents of up to ``BLOCK``
blocks meet in the next level, then those of all size classes of a source; the last one is drawn. All draws are hashes,
so reruns agree. A hot source is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardline.llm.shared import SPACE_WORDS, written

BLOCK = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SMALL_TABLE = 100_000  # rows of a per-source table up to which it is broadcast; beyond, a plain join


def text_size(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target: ``share`` of all words by weight, no source above ``cap`` times its size.

    Expects columns source and size. Sources in order of code points, null last, take the weights in turn. The level at
    which uncapped sources stand is found by running sums over sources ordered by cap per weight. Null sizes count as
    none, repeated rows count each, an empty table gives no rows. The windows run over one row a source in one task: fine
    for the tens or thousands of sources of a mix, not for a source per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    each = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("_w", F.get(each, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    most = F.lit(cap) * F.col("source_size")
    before = W.orderBy(most / F.col("_w"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    return levelled.select("source", "source_size", F.least(most, F.col("_level") * F.col("_w")).alias("target"))


def mix(sized: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = 1) -> DataFrame:
    """The rows of ``sized`` (doc_id, source, size and any other columns) with source_size, target and copies.

    copies is 0, 1 or 2 (at most ``cap``, rounded up). Rows without words and sources without words take no copies.
    Repeated rows are rounded one by one; null ids and null sources are values like others. Columns named like one of
    the three results are replaced; names that start with `_mix` are reserved.
    """
    sized = sized.drop("source_size", "target", "copies")
    payload = sized.columns
    keyed = sized.withColumns(
        {
            "_mix_s": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
            "_mix_c": F.floor(2 * F.log2(F.col("size") + 1.0)).cast("int"),
            "_mix_tie": F.xxhash64(*[F.col(f"`{c}`") for c in payload if not c.startswith("_mix")], F.lit(seed)),
        }
    )
    targets = source_targets(sized.select("source", "size"), share, weights, cap)
    classes = keyed.groupBy("_mix_s", "_mix_c").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("_mix_n"))
    table = written(
        targets.withColumn("_mix_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
        .join(classes, "_mix_s")
        .withColumn("_mix_f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)),
        "classes",
    )
    facts = table.agg(F.count("*"), F.max("_mix_n")).first()
    small = F.broadcast(table) if facts[0] <= SMALL_TABLE else table
    dealt = keyed.join(small, ["_mix_s", "_mix_c"])
    dealt = dealt.withColumns(
        {
            "_mix_b": F.pmod(F.xxhash64("_mix_tie", F.lit("block")), F.col("_mix_n")),
            "_mix_f": F.when(F.col("size") > 0, F.col("_mix_f")).otherwise(0.0),
        }
    ).drop("_mix_n")
    dealt = dealt.withColumns(
        {"copies": F.floor("_mix_f").cast("int"), "_mix_p": F.col("_mix_f") - F.floor("_mix_f")}
    ).drop("_mix_f")
    leaves = ["_mix_s", "_mix_c", "_mix_b"]
    first = written(_level(dealt, leaves, [*leaves, "size", "_mix_tie"], seed, 0), "level-0")
    open_rows = first.filter("_mix_bit < 0").select(*leaves, "_mix_tie", "_mix_p", "_mix_bit")
    settled, groups, level = None, int(facts[1] or 1), 0
    while True:
        level += 1
        last = groups <= 1
        groups = -(-groups // BLOCK)
        above = open_rows.withColumn("_mix_up", F.lit(0).cast("long") if last else F.expr(f"_mix_b div {BLOCK**level}"))
        keys = ["_mix_s"] if last else ["_mix_s", "_mix_c", "_mix_up"]
        above = written(_level(above, keys, [*keys, "_mix_c", "_mix_b", "_mix_tie"], seed, level, last).drop("_mix_up"), f"level-{level}")
        done = above.filter("_mix_bit >= 0").select(*leaves, F.col("_mix_bit").alias("_mix_late"))
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        open_rows = above.filter("_mix_bit < 0").select(*leaves, "_mix_tie", "_mix_p", "_mix_bit")
    late = first.filter("_mix_bit < 0").join(settled, leaves).withColumn("_mix_bit", F.col("_mix_late")).drop("_mix_late")
    every = first.filter("_mix_bit >= 0").unionByName(late)
    return every.withColumn("copies", F.col("copies") + F.col("_mix_bit")).select(*payload, "source_size", "target", "copies")


def _level(rows: DataFrame, keys: list[str], order: list[str], seed: int, level: int, last: bool = False) -> DataFrame:
    """One level of the tree: within each key, in the given order, all but at most one row get _mix_bit 0 or 1.

    The open row keeps _mix_bit -1 and its fraction in _mix_p; at the last level it is drawn instead.
    """
    rows = rows.drop("_mix_bit").repartition(*keys).sortWithinPartitions(*order)
    schema = rows.withColumn("_mix_bit", F.lit(0)).schema
    names = rows.columns
    key_at, tie_at, p_at = [names.index(k) for k in keys], names.index("_mix_tie"), names.index("_mix_p")

    def draw(*what: object) -> float:
        return (xxhash.xxh3_64_intdigest(repr((*what, seed, level)).encode()) >> 11) / float(1 << 53)

    def meet(p: float, q: float, u: float) -> tuple[float, float]:
        """New fractions of the two; at least one is integral."""
        both = p + q
        if both < 1:
            return (0.0, both) if u * both < q else (both, 0.0)
        return (1.0, both - 1) if u * (2 - both) < 1 - q else (both - 1, 1.0)

    def exact(p: float) -> float:
        return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, held_p, held_tie = None, None, 0.0, 0  # the open row: a batch of one row once its batch is gone

        def out(batch: pa.RecordBatch, bits: list[int], rests: list[float]) -> pa.RecordBatch:
            columns = list(batch.columns)
            columns[p_at] = pa.array(rests, pa.float64())
            return pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.int32())], names=[*batch.schema.names, "_mix_bit"])

        def close(p: float, tie: int) -> int:
            return int(draw("last", tie) < p) if last else -1

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ps, ties = batch.column(p_at).to_pylist(), batch.column(tie_at).to_pylist()
            keyed = list(zip(*(batch.column(k).to_pylist() for k in key_at), strict=True))
            bits, rests = [0] * n, [0.0] * n
            at = -1  # place of the open row in this batch; -1 while it is in an earlier one
            for i in range(n):
                if keyed[i] != key:
                    if held is not None:
                        bit = close(held_p, held_tie)
                        if at < 0:
                            yield out(held, [bit], [held_p])
                        else:
                            bits[at], rests[at] = bit, held_p
                    key, held = keyed[i], None
                p = exact(ps[i])
                if p in (0.0, 1.0):
                    bits[i] = int(p)
                    continue
                if held is None:
                    held, held_p, held_tie, at = batch, p, ties[i], i
                    continue
                a, b = (exact(x) for x in meet(held_p, p, draw(held_tie, ties[i])))
                if a in (0.0, 1.0):
                    if at < 0:
                        yield out(held, [int(a)], [0.0])
                    else:
                        bits[at] = int(a)
                    held = None
                    if b in (0.0, 1.0):
                        bits[i] = int(b)
                    else:
                        held, held_p, held_tie, at = batch, b, ties[i], i
                else:
                    bits[i], held_p = int(b), a
            if held is not None and at >= 0:
                one = batch.slice(at, 1)
                rest = [k for k in range(n) if k != at]
                if rest:
                    left = batch.take(pa.array(rest))
                    yield out(left, [bits[k] for k in rest], [rests[k] for k in rest])
                held, at = one, -1
            else:
                yield out(batch, bits, rests)
        if held is not None:
            yield out(held, [close(held_p, held_tie)], [held_p])

    return rows.mapInArrow(run, schema)
