"""Helpers of the operators in this folder: shared storage and batches of byte strings."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS_PER_FILE = 100_000
#: Separators of `[^\x20\x09-\x0D]+` words; bytes.split() without arguments splits at the same six bytes.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"


#: Folder of the step that is running, see ``passing``.
_step: ContextVar[str | None] = ContextVar("step", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, only a local session gets one of its own."""
    if (step := _step.get()) is not None:
        return f"{step}/{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="wardline-llm-")
    return f"{root.rstrip('/')}/wardline-llm/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None, codec: str | None = None) -> DataFrame:
    """The same rows, written once to the shared folder and read from there: lineage ends here.

    ``rows``, a bound known beforehand, keeps small tables from being strewn over many files.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}"
    writer = (df if rows is None else df.coalesce(rows // ROWS_PER_FILE + 1)).write
    (writer if codec is None else writer.option("compression", codec)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished plans now; else they stay until the driver happens to collect garbage."""
    gc.collect()  # data frames that Python still holds keep their plans alive
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A step whose written tables are dropped when it ends; what it yields writes the step's result to stay.

    Nothing that a caller goes on with may read the step's tables but through that result.
    """
    folder, outer = shared_folder(spark), _step.get()

    def put(df: DataFrame, name: str) -> DataFrame:
        mark = _step.set(outer)
        try:
            return written(df, name)
        finally:
            _step.reset(mark)

    mark = _step.set(folder)
    try:
        yield put
    finally:
        _step.reset(mark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        free_shuffles(spark)


def identified(documents: DataFrame, column: str) -> DataFrame:
    """All rows and columns, and ``column``: null for rows with an id, else a number of the row, written so that it is stable."""
    unnamed = documents.filter("doc_id is null").withColumn(column, F.monotonically_increasing_id())
    named = documents.filter("doc_id is not null").withColumn(column, F.lit(None).cast("long"))
    return named.unionByName(written(unnamed, "unnamed"))


def training_row(doc_id: Column) -> Column:
    """Rows to learn from: crc32 of the id as text is no multiple of 5. A null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """The other rows with an id; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hash_share(order: Column, limit: int, total: int) -> Column:
    """Whether a 64-bit hash is among the smallest of ``total``: passes about four times ``limit`` of them.

    Put before a search for the ``limit`` smallest, it keeps what each task hands on in proportion to the sample.
    """
    if total <= 4 * limit:
        return F.lit(True)
    return order < F.lit(-(1 << 63) + (4 * limit << 64) // total)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str) -> DataFrame:
    """Applies ``work`` to Arrow batches; it returns the output columns, or None for no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    probe = df.sparkSession.createDataFrame([], schema).schema
    target = to_arrow_schema(probe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, probe)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


#: Odd multipliers of the window hash, from the golden ratio.
_STEPS = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF) for j in range(64)]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes; order counts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        part = hashes[j : j + n] * _STEPS[j % 64]
        total += part ^ (part >> np.uint64(29))
        if j >= 63:
            total *= _STEPS[1]
    return mixed(total)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
