"""Helpers shared by the operators."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F

from wardline.functions.text import constant  # noqa: F401 - shared by the operators

INLINE_LIMIT = 4000
SALTS = 16


def bounded_rows(df: DataFrame, limit: int = INLINE_LIMIT) -> list[Row] | None:
    """The rows of a reference table when there are at most ``limit`` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def pages(df: DataFrame, order: list[str], size: int = INLINE_LIMIT):
    """A reference table in pages of ``size`` rows, one page on the driver at a time."""
    page: list[Row] = []
    for row in df.orderBy(*order).toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


@dataclass(frozen=True)
class StoredLookup:
    """The small side of salted joins, written once as a bucketed table with its rows repeated per salt.

    Joins that follow shuffle their big side only.
    """

    table: DataFrame
    on: tuple[str, ...]
    salts: int


def store_lookup(small: DataFrame, name: str, on: list[str], buckets: int = 64, salts: int = SALTS) -> StoredLookup:
    """Writes a lookup side (few rows a key) as a table bucketed by its key and the salt, replacing one of that name."""
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keys = [*on, "_salt"]
    repeated.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return StoredLookup(small.sparkSession.table(name), tuple(on), salts)


def salted_join(
    big: DataFrame,
    small: DataFrame | StoredLookup,
    on: list[str],
    how: str,
    spread: Column,
    salts: int = SALTS,
    large: bool = False,
) -> DataFrame:
    """Equi-join whose hot keys on the big side are spread over ``salts`` tasks.

    ``small`` holds few rows per key and is repeated once per salt. ``spread`` is any column that
    varies within a hot key. When Spark finds ``small`` below its broadcast threshold it broadcasts
    it and the salt costs nothing. Spark's finding goes by compressed bytes and does not count the repetition, so a side
    that is known to be ``large`` is kept off the driver. A stored lookup is bucketed by key and salt and is not shuffled again.
    """
    if isinstance(small, StoredLookup):
        if set(on) != set(small.on):
            raise ValueError(f"the lookup is stored by {small.on}, not by {tuple(on)}")
        salt = F.pmod(F.xxhash64(spread), F.lit(small.salts)).cast("int")
        return big.withColumn("_salt", salt).join(small.table, [*small.on, "_salt"], how).drop("_salt")
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(repeated.hint("merge") if large else repeated, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str, spread: Column, limit: int = INLINE_LIMIT
) -> DataFrame:
    """Equi-join with a lookup side: broadcast when it has at most ``limit`` rows, else salted. Same rows either way.

    The side is counted as far as the limit when the plan is made; one that is dear to compute should be ``stored`` before.
    Beyond a limit above ``INLINE_LIMIT`` Spark is not left to broadcast the side after all.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, spread, large=limit > INLINE_LIMIT)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: no later filter or column copies its expression below the outer explode."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def content_key(*values: Column) -> Column:
    """128 bits that stand for some column values, null included: rows of equal content share a key."""
    return F.md5(F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]), {"ignoreNullFields": "false"}))


def rate(numerator: Column, denominator: Column, digits: int | None = 4) -> Column:
    """numerator / denominator, zero for an empty denominator, rounded unless digits is None."""
    value = F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / denominator.cast("double")
    )
    return value if digits is None else F.round(value, digits)


def in_window(ts: Column, since: str | None = None, until: str | None = None) -> Column:
    """Half-open UTC window [since, until)."""
    inside = F.lit(True)
    if since is not None:
        inside = inside & (ts >= F.lit(since).cast("timestamp"))
    if until is not None:
        inside = inside & (ts < F.lit(until).cast("timestamp"))
    return inside


def first_failure(checks: dict[str, Column]) -> Column:
    """Name of the first check that does not hold (a null check does not hold), or null."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    return reason


def split_valid(df: DataFrame, checks: dict[str, Column], path: str | None = None, helpers: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Rows that pass every check, and the others with the ``reason`` of the first failure; ``helpers`` are left out.

    Two plans over the input, or with a ``path`` one pass that writes both sides there, see :func:`routed`.
    """
    return split_by_reason(df, first_failure(checks), path, helpers)


def split_by_reason(df: DataFrame, reason: Column, path: str | None = None, helpers: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The same with the reason as a column expression that is null for valid rows."""
    if path is not None:
        parts = routed(df, reason, path, helpers)
        return {side: parts[side] for side in ("valid", "quarantine")}
    judged = df.withColumn("reason", reason).drop(*helpers)
    return {
        "valid": judged.filter(F.col("reason").isNull()).drop("reason"),
        "quarantine": judged.filter(F.col("reason").isNotNull()),
    }


def routed(
    df: DataFrame,
    reason: Column,
    path: str,
    helpers: tuple[str, ...] = (),
    folders: tuple[str, ...] = (),
    mode: str = "errorifexists",
    spread: tuple[str | Column, ...] = (),
) -> dict[str, DataFrame | dict[str, int]]:
    """Judges every row once (``reason`` is null for a valid one) and writes all of them in one job, under ``verdict=valid`` and ``verdict=quarantine``.

    ``valid``, ``quarantine`` (with ``reason``) read back what this call wrote, and ``counts`` are the rows of either side
    as the job observed them. ``folders`` are further partition columns, ``spread`` what rows are dealt over tasks by.
    Several calls may append to one path; a column ``batch`` tells them apart.
    """
    batch, seen = uuid.uuid4().hex, Observation()
    ok = F.col("reason").isNull()
    judged = df.withColumn("reason", reason).drop(*helpers)
    judged = judged.withColumns({"verdict": F.when(ok, "valid").otherwise("quarantine"), "batch": F.lit(batch)})
    judged = judged.observe(seen, F.count_if(ok).alias("valid"), F.count_if(~ok).alias("quarantine"))
    if spread:
        judged = judged.repartition("verdict", *folders, *spread)
    judged.write.mode(mode).partitionBy("verdict", *folders).parquet(path)
    written = df.sparkSession.read.schema(judged.schema).parquet(path).filter(F.col("batch") == batch)
    columns = [c for c in judged.columns if c not in ("verdict", "batch", "reason")]
    return {
        "valid": written.filter("verdict = 'valid'").select(*columns),
        "quarantine": written.filter("verdict = 'quarantine'").select(*columns, "reason"),
        "counts": seen.get,
    }


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read from there: computed once, and lineage ends here."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Without that setting a local session gets one of its own, others fail."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="wardline-")
    return f"{root.rstrip('/')}/wardline-{uuid.uuid4().hex}"
