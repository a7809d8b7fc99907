"""Benchmark decontamination: windows of benchmark words are looked for in whole documents.

The benchmark's windows are laid out on the driver in blocks of at most ``block_bytes`` of their words, window by window, so
the bound holds whatever the items are like. Up to ``MOST_BLOCKS`` blocks are broadcast as hash sets and each document passes
them all in the task that reads it: the hash of each run of words is tested against a set, hits are verified word by word.
A larger benchmark stays distributed: a bitmap of bounded size, built by Spark, is broadcast to sort out nearly all document
windows, and what passes meets the table of benchmark windows in a join on hash and words. Same rows either way.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from wardline.llm.shared import byte_texts, map_batches, window_hashes, word_hashes, written
from wardline.operators.common import salted_join

WINDOW = 10
BLOCK_BYTES = 16_000_000
MOST_BLOCKS = 4
#: Bits of the bitmap of a benchmark that is joined.
FILTER_BITS = 28
#: A-Z become a-z; the other separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` become blanks.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; null has none."""
    return text.translate(_TABLE).split() if text else []


def windows_of(text: bytes | None, window: int) -> Iterator[tuple[int, bytes]]:
    """Size and words of each window of an item."""
    words = words_of(text)
    size = min(window, len(words))
    for i in range(len(words) - size + 1 if size else 0):
        yield size, b" ".join(words[i : i + size])


@dataclass
class Block:
    """Some benchmark windows: exact words -> item ids, and a bit table of their hashes for each length."""

    windows: dict[int, dict[bytes, set[str]]] = field(default_factory=dict)
    tables: dict[int, tuple[np.ndarray, np.uint64]] = field(default_factory=dict)
    bytes: int = 0

    def add(self, item_id: object, size: int, words: bytes) -> None:
        found = self.windows.setdefault(size, {})
        if words not in found:
            found[words] = set()
            self.bytes += len(words)
        if item_id is not None:
            found[words].add(str(item_id))

    def seal(self) -> Block:
        for size, found in self.windows.items():
            bits = min(26, max(16, math.ceil(math.log2(len(found))) + 8))
            shift = np.uint64(64 - bits)
            table = np.zeros(1 << bits, dtype=bool)
            for words in found:
                table[window_hashes(word_hashes(words.split()), size) >> shift] = True
            self.tables[size] = (table, shift)
        return self

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """First word, word after the last, and item ids of every verified window in a document."""
        if not words:
            return
        hashes = word_hashes(words)
        for size, (table, shift) in self.tables.items():
            exact = self.windows[size]
            for i in np.flatnonzero(table[window_hashes(hashes, size) >> shift]).tolist():
                items = exact.get(b" ".join(words[i : i + size]))
                if items is not None:
                    yield i, i + size, items


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most: int = MOST_BLOCKS) -> list | None:
    """Broadcast blocks that together hold every window of every item; None when there would be more than ``most``.

    The words of an item are at most ten times in its windows, so a benchmark of more than ``most * block_bytes`` of text
    is not even looked at; one item's text is on the driver at a time besides the blocks.
    """
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most * block_bytes:
        return None
    blocks = [Block()]
    for item_id, text in items.toLocalIterator():
        for size, words in windows_of(text.encode(), window):
            if blocks[-1].bytes + len(words) > block_bytes and blocks[-1].bytes:
                if len(blocks) == most:
                    return None
                blocks.append(Block())
            blocks[-1].add(item_id, size, words)
    return [benchmark.sparkSession.sparkContext.broadcast(block.seal()) for block in blocks]


def _spans_in(blocks: list, text: bytes | None) -> tuple[list[int], set[str]]:
    """Hit spans of a text as start, end, start, ... in words, and the ids of the items with a window in it."""
    words, flat, items = words_of(text), [], set()
    for block in blocks:
        for start, end, ids in block.value.occurrences(words):
            flat += (start, end)
            items |= ids
    return _merged(flat), items


_KEYS = ["_text_a", "_text_b"]


def _keyed(documents: DataFrame) -> DataFrame:
    """Adds 128 bits that stand for the text: what is hit depends on nothing else."""
    return documents.withColumns({"_text_a": F.xxhash64("text"), "_text_b": F.xxhash64(F.lit(1), "text")})


def _joined_hits(documents: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """_text_a, _text_b, hit (start, end, ...), items (sorted) of the different texts with a window of a benchmark of any size."""

    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        rows = [
            (item, size, int(window_hashes(word_hashes(words.split()), size)[0].astype(np.int64)), words)
            for item, text in zip(batch.column("item_id").to_pylist(), byte_texts(batch.column("text"))) for size, words in windows_of(text, window)
        ]
        return dict(zip(("item", "size", "h", "words"), map(list, zip(*rows)) if rows else ([], [], [], [])))

    named = _items(benchmark).select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = written(map_batches(named, cut, "item string, size int, h long, words binary").distinct(), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``window`` numbers
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1  # Spark numbers bits and buckets from 1
    bitmaps = windows.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for r in bitmaps.toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        bits[(r["at"] - 1) * len(part) :][: len(part)] |= part
    table = documents.sparkSession.sparkContext.broadcast(bits)

    def sift(batch: pa.RecordBatch) -> dict[str, object]:
        rows, bits = [], table.value
        for a, b, text in zip(batch.column("_text_a").to_pylist(), batch.column("_text_b").to_pylist(), byte_texts(batch.column("text"))):
            words = words_of(text)
            hashes = word_hashes(words)
            for size in sizes:
                found = window_hashes(hashes, size)
                at = _bit_of(found)
                for i in np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                    rows.append((a, b, i, size, int(found[i].astype(np.int64)), b" ".join(words[i : i + size])))
        return dict(zip((*_KEYS, "start", "size", "h", "words"), map(list, zip(*rows)) if rows else ([],) * 6))

    texts = _keyed(documents.select("text")).dropDuplicates(_KEYS)
    passed = map_batches(texts, sift, "_text_a long, _text_b long, start int, size int, h long, words binary")
    # A passage may be in a third of all texts; of a window there are few rows.
    met = salted_join(passed, windows, ["size", "h", "words"], "inner", F.col("_text_a"))
    # One text's own hits are one group.
    spans = met.groupBy(*_KEYS).agg(
        F.flatten(F.sort_array(F.collect_set(F.array(F.col("start"), F.col("start") + F.col("size"))))).alias("hit"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    return written(spans, "hits")


def _bit_of(hashes: np.ndarray) -> np.ndarray:
    """Bit of the bitmap for each hash."""
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _with_hits(documents: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """All rows and columns with ``_hit`` (merged spans) and ``_items``."""
    blocks, at = benchmark_blocks(benchmark, window, block_bytes), documents.columns.index("text")
    added = "_hit array<int>, _items array<string>"
    if blocks is None:
        hits = _joined_hits(documents, benchmark, window).withColumnsRenamed({"hit": "_hit", "items": "_items"})
        met = salted_join(_keyed(documents), hits, _KEYS, "left", F.monotonically_increasing_id()).drop(*_KEYS)
        return met.select(*[F.col(f"`{c}`") for c in documents.columns], "_hit", "_items")
    schema = documents.schema.jsonValue()
    schema["fields"] += documents.sparkSession.createDataFrame([], added).schema.jsonValue()["fields"]
    target = StructType.fromJson(schema)

    def mark(batches):
        for batch in batches:
            if batch.num_rows:
                found = [_spans_in(blocks, t) for t in byte_texts(batch.column(at))]
                columns = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([sorted(f[1]) for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_hit", "_items"])

    return documents.mapInArrow(mark, target)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hit. Repeated rows are judged alike. Items that share an id count once, an
    item without id only marks words. An empty benchmark leaves every document clean. Other columns are not read.
    """
    found = _with_hits(documents.select("doc_id", "text"), benchmark, window, block_bytes)

    def finish(batch: pa.RecordBatch) -> dict[str, object]:
        n_hit = [_covered(_merged(h or [])) for h in batch.column("_hit").to_pylist()]
        items = [x or [] for x in batch.column("_items").to_pylist()]
        return {
            "doc_id": batch.column("doc_id"),
            "n_words": [len(words_of(t)) for t in byte_texts(batch.column("text"))],
            "n_hit": n_hit,
            "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
            "contaminated": [n > 0 for n in n_hit],
        }

    return map_batches(
        found, finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def _merged(flat: list[int]) -> list[int]:
    """Start and end positions, one after the other, with overlapping and touching spans joined."""
    out: list[int] = []
    for start, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _covered(flat: list[int]) -> int:
    return sum(flat[1::2]) - sum(flat[::2])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows without any benchmark window, with all their columns, whatever these are named.

    Null and empty texts stay. Repeated rows are judged alike. An empty benchmark leaves all rows. `_text_a` and `_text_b`
    are reserved names.
    """
    at, schema, blocks = documents.columns.index("text"), documents.schema, benchmark_blocks(benchmark, window, block_bytes)
    if blocks is None:
        hits = _joined_hits(documents, benchmark, window).select(*_KEYS)
        clean = salted_join(_keyed(documents), hits, _KEYS, "left_anti", F.monotonically_increasing_id())
        return clean.select(*[F.col(f"`{c}`") for c in documents.columns])

    def clean(batches):
        for batch in batches:
            if batch.num_rows:
                found = (words_of(t) for t in byte_texts(batch.column(at)))
                yield batch.filter(pa.array([not any(next(b.value.occurrences(words), None) for b in blocks) for words in found]))

    return documents.mapInArrow(clean, schema)


def cut_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns; hit words and what lies between them are taken out of the text, a newline stays instead.

    All hits are marked before the first word goes, so overlapping windows go whole; windows that the joined rest forms are
    cut in the next round, until there are none. Null and empty texts stay. Columns named `_hit`, `_items`, `_text_a` and
    `_text_b` are reserved.
    """
    blocks, at, schema = benchmark_blocks(benchmark, window, block_bytes), documents.columns.index("text"), documents.schema

    def rewritten(batch, texts):
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.binary()).cast(batch.column(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    def without(text):
        while text and (spans := _spans_in(blocks, text)[0]):
            text = _cut(text, spans)
        return text

    def cut_known(batches):
        for batch in batches:
            if batch.num_rows:
                yield rewritten(batch, [without(t) for t in byte_texts(batch.column(at))])

    def cut_marked(batches):
        for batch in batches:
            if batch.num_rows:
                hits = batch.column(batch.num_columns - 2).to_pylist()
                yield rewritten(batch, [_cut(t, _merged(h)) if h else t for t, h in zip(byte_texts(batch.column(at)), hits)])

    if blocks is not None:
        return documents.mapInArrow(cut_known, schema)
    while True:
        marked = written(_with_hits(documents, benchmark, window, block_bytes), "marked")
        if marked.filter("_hit is not null").isEmpty():
            return documents
        documents = written(marked.mapInArrow(cut_marked, marked.schema).select(*[F.col(f"`{c}`") for c in documents.columns]), "cut")


def _cut(text: bytes, spans: list[int]) -> bytes:
    """The text without the words from each start to each end."""
    plain = np.frombuffer(text.translate(_TABLE), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], plain, [False])).astype(np.int8)))
    kept, done = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        kept.append(text[done : edges[2 * start]])
        done = edges[2 * end - 1]
    return b"\n".join([*kept, text[done:]])
