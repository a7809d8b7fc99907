"""Lempel-Ziv phrase fingerprints: compression-like similarity of documents from minimum-hash signatures of phrase sets.

A text's UTF-8 bytes are parsed from left to right into the shortest phrases not seen before (LZ78); what a compressor would
put into its dictionary is the document's phrase set. Each phrase gets a 32-bit hash, the ``size`` smallest distinct hashes
are the fingerprint, and the likeness of two fingerprints estimates the Jaccard similarity of the phrase sets. Sets below
``size`` are kept whole and compared exactly. Parsing is sequential and per document, so it runs in Arrow batches.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from wardline.llm.shared import written

SIZE = 128


def parsed(seen: set[bytes], fresh: list[bytes], data: bytes, start: int, stop: int) -> int:
    """Goes on parsing ``data`` behind ``stop`` with a phrase open at ``start``; new phrases go into ``seen`` and ``fresh``.

    Returns the start of the phrase that is open at the end; it is a known one and adds nothing.
    """
    add, append = seen.add, fresh.append
    for end in range(stop + 1, len(data) + 1):
        if (phrase := data[start:end]) not in seen:
            add(phrase)
            append(phrase)
            start = end
    return start


def hashes(phrases: list[bytes]) -> np.ndarray:
    """Sorted 32-bit hashes of phrases: checksums, spread by a bijection."""
    x = np.fromiter(map(zlib.crc32, phrases), dtype=np.uint32, count=len(phrases))
    for shift in (16, 15):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(0x9E3779B1)  # odd, from the golden ratio
    x ^= x >> np.uint32(16)
    x.sort()
    return x


def smallest(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest distinct numbers of a sorted array."""
    return x[np.concatenate([[True], x[1:] != x[:-1]])][:size] if len(x) else x


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the smallest hashes of both sets together that are in both; two empty sets are alike.

    When both signatures are below ``size`` they are the whole sets and so all of their hashes count.
    """
    both = np.concatenate([a, b])
    both.sort()
    again = np.concatenate([[False], both[1:] == both[:-1]]) if len(both) else np.empty(0, dtype=bool)
    distinct = len(both) - int(again.sum())
    if not distinct:
        return 1.0
    if max(len(a), len(b)) >= size and distinct > size:
        # The first ``size`` distinct numbers end where the count of first occurrences says.
        end = int(np.searchsorted(np.cumsum(~again), size + 1))
        return int(again[:end].sum()) / size
    return int(again.sum()) / distinct


def text_signature(text: str | None, size: int = SIZE) -> np.ndarray:
    fresh: list[bytes] = []
    parsed(set(), fresh, (text or "").encode(), 0, 0)
    return smallest(hashes(fresh), size)


def _hex(sig: np.ndarray) -> str:
    return _stored(sig).hex()


def _from_hex(digits: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(digits), dtype=">u4").astype(np.uint32)


def _stored(sig: np.ndarray) -> bytes:
    return sig.astype(">u4").tobytes()


def fingerprint_documents(documents: DataFrame, column: str = "text", size: int = SIZE) -> DataFrame:
    """All rows and columns with ``fingerprint`` (hex text, eight digits a hash) of a text column; any such column is replaced.

    Null counts as empty, an empty text has the empty fingerprint, equal texts have equal ones. Whole texts are parsed.
    """
    rows = documents.drop("fingerprint")
    schema = StructType([*rows.schema.fields, StructField("fingerprint", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_hex(text_signature(t.as_py(), size)) for t in batch[column]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return rows.mapInArrow(work, schema)


def likeness_of(left: Column, right: Column, size: int = SIZE) -> Column:
    """Likeness of two fingerprint columns (0 to 1)."""

    @F.pandas_udf("double")
    def compare(a, b):
        import pandas as pd

        return pd.Series([likeness(_from_hex(x), _from_hex(y), size) for x, y in zip(a, b)], dtype="float64")

    return compare(left, right)


def _with_follower(text: str, follower: str, size: int) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of it with its last third replaced by the follower's start, and the edited text's digest.

    Both share the parse and the hashes of the first two thirds.
    """
    third = len(text) // 3
    head = text[: len(text) - third].encode()
    edited = head + follower[:third].encode()
    seen: set[bytes] = set()
    fresh: list[bytes] = []
    start = parsed(seen, fresh, head, 0, 0)
    shared, signatures = smallest(hashes(fresh), size), []
    for phrases, data in ((seen.copy(), text.encode()), (seen, edited)):
        fresh = []
        parsed(phrases, fresh, data, start, len(head))
        every = np.concatenate([shared, hashes(fresh)])
        every.sort()
        signatures.append(smallest(every, size))
    return *signatures, hashlib.sha256(edited).hexdigest()


_FIELDS = [
    ("n_chars", LongType()), ("edited_sha256", StringType()), ("fingerprint", BinaryType()), ("edited_fingerprint", BinaryType()),
    ("near_edited", DoubleType()), ("near_next", DoubleType()), ("text", StringType()), ("first_text", StringType()),
]


def _judged(place: tuple, n_chars: int, sigs: tuple[np.ndarray, np.ndarray, str], following: np.ndarray, size: int) -> tuple:
    """A row of the walk: ``place`` is the task and the id, ``following`` the signature of the next document."""
    own, other, digest = sigs
    return (*place, n_chars, digest, _stored(own), _stored(other), likeness(own, other, size), likeness(own, following, size), None, None)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(target)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target)], schema=target)


def edited_neighbours(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has the last third of the code points (rounded down) replaced by the first as many, or all, of the next
    document in descending order of doc_id; the last one takes the first, a lone document itself. Null ids come last; rows
    of one id follow one another by a hash of their text; repeated rows stay rows of their own. A null text counts as empty.
    An empty table gives no rows.

    Texts are shuffled once, by ranges of that order (a row number closes the sort key, so that many rows of one id are
    still spread). Every task walks its range with two documents in hand; its last document is written with its text and
    the first one's, and these pairs, one for each task, are worked on afterwards.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    order = [F.col("doc_id").desc_nulls_last(), F.col("_hash"), F.col("_row")]
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = StructType([StructField("part", LongType()), ranged.schema["doc_id"], *[StructField(n, k) for n, k in _FIELDS]])
    target = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``held`` waits for the text that follows it, ``waiting`` for the signature of the document that follows it.
        held, waiting, first = None, None, None
        for batch in batches:
            out = []
            for part, doc_id, text in zip(*(batch[c] for c in ("part", "doc_id", "text"))):
                text = text.as_py()
                if held is None:
                    first = text
                else:
                    sigs = _with_follower(held[1], text, size)
                    if waiting is not None:
                        out.append(_judged(*waiting, sigs[0], size))
                    waiting = held[0], len(held[1]), sigs
                held = (part.as_py(), doc_id.as_py()), text
            yield _batch(out, target)
        if held is not None:
            out = [] if waiting is None else [_judged(*waiting, text_signature(held[1], size), size)]
            yield _batch([*out, (*held[0], len(held[1]), *[None] * 5, held[1], first)], target)

    walked = written(ranged.mapInArrow(walk, schema), "walked", codec="zstd")
    # The last document of each task meets the first text of the next task that has any, the very last one the very first.
    ends = walked.filter("first_text is not null")
    parts = ends.select("part")  # one number a task
    by_part = W.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("next_part"))
    firsts = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("follower"))
    closing = ends.select("part", "doc_id", "text").join(after, "part").join(firsts, "next_part").select("part", "doc_id", "text", "follower")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, doc_id, text, follower in zip(*(batch[c] for c in closing_columns)):
                text, follower = text.as_py(), follower.as_py()
                sigs = _with_follower(text, follower, size)
                yield _batch([_judged((part.as_py(), doc_id.as_py()), len(text), sigs, text_signature(follower, size), size)], target)

    closing_columns = closing.columns
    whole = walked.filter("first_text is null").unionByName(closing.mapInArrow(close, schema))
    prints = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return whole.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next")
