"""Fill-in-the-middle transformation of documents as one pyarrow.compute pipeline per batch.

A text is cut into lines (a line keeps its break), two cuts drawn from a hash of the document id part the lines into prefix,
middle and suffix, and the pieces are put together again behind markers, suffix first (spm) or prefix first (psm). A text
that is empty, holds a marker, or is not drawn for the transformation stays plain. Nothing is shuffled, a row depends on
nothing but itself, and a batch is worked on in slices of at most ``SLICE_BYTES`` of text (a longer text is a slice alone).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

SLICE_BYTES = 64 << 20


@dataclass(frozen=True)
class Infill:
    """``percent`` of the documents are transformed, ``spm_percent`` of those suffix first; ``seed`` changes all draws."""

    seed: int = 7
    percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        """Markers must never arise from a marker and a neighbouring piece of text, or texts could not be rebuilt."""
        markers = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(markers):
            for j, b in enumerate(markers):
                if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"markers must not be empty, contain or overlap one another: {markers}")


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the first digits of a SHA-256 digest; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch that hold at most SLICE_BYTES of text each, or one row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch["_fim_text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _lists(parents: np.ndarray, units: pa.Array, rows: int) -> pa.Array:
    """Each row's units joined to one text; a row without units gives the empty text."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=rows))])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), units)
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def _rearranged(batch: pa.RecordBatch, how: Infill) -> dict[str, pa.Array]:
    rows = batch.num_rows
    text = pc.fill_null(batch["_fim_text"].cast(pa.large_string()), "")
    # Pieces between line breaks, flattened with the row each belongs to; all but a row's last piece end in a break.
    split = pc.split_pattern(text, "\n")
    parents = pc.list_parent_indices(split).to_numpy()
    pieces = pc.list_flatten(split)
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
    ordinals = np.arange(len(parents)) - starts[parents]
    last = ordinals == (starts[1:] - starts[:-1] - 1)[parents]
    ends = pc.if_else(pa.array(last), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    units = pc.binary_join_element_wise(pieces, ends, pa.scalar("", pa.large_string()))
    # The piece behind a closing break is no unit.
    real = pc.greater(pc.binary_length(units), 0)
    units, keep = units.filter(real), real.to_numpy(zero_copy_only=False)
    parents, ordinals = parents[keep], ordinals[keep]
    n = np.bincount(parents, minlength=rows)
    h1, h2, h3, h4 = (batch[f"_fim_h{k}"].to_numpy() for k in range(1, 5))
    first, second = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    role = (ordinals >= first[parents]).astype(np.int8) + (ordinals >= second[parents])
    prefix, middle, suffix = (_lists(parents[role == k], units.filter(pa.array(role == k)), rows) for k in range(3))
    marked = pc.or_(pc.or_(pc.match_substring(text, how.prefix), pc.match_substring(text, how.suffix)), pc.match_substring(text, how.middle))
    plain = pc.or_(marked, pa.array((n == 0) | (h3 % 100 >= how.percent)))
    spm = pa.array(h4 % 100 < how.spm_percent)
    p, s, m, none = (pa.scalar(x, pa.large_string()) for x in (how.prefix, how.suffix, how.middle, ""))
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    output = pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text))
    null = pa.scalar(None, pa.int64())
    return {
        "n_units": pa.array(n, pa.int64()),
        "form": pc.if_else(plain, pa.scalar("plain"), pc.if_else(spm, pa.scalar("spm"), pa.scalar("psm"))),
        "prefix_chars": pc.if_else(plain, null, pc.utf8_length(prefix).cast(pa.int64())),
        "middle_chars": pc.if_else(plain, null, pc.utf8_length(middle).cast(pa.int64())),
        "output": output,
    }


_ADDED = [("n_units", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType())]


def fill_in_middle(documents: DataFrame, how: Infill = Infill()) -> DataFrame:
    """doc_id, n_units (lines), form (plain, psm, spm), prefix_chars, middle_chars (code points, null if plain), output.

    One row per row, repeated rows alike. A null text counts as empty, an empty text stays plain, a null id is drawn like
    an id of no digits. The text itself and any further columns are not needed and not returned.
    """
    drawn = {f"_fim_h{k + 1}": h for k, h in enumerate(_draws(F.col("doc_id"), how.seed))}
    rows = documents.select("doc_id", F.col("text").alias("_fim_text")).withColumns(drawn)
    schema = StructType([rows.schema["doc_id"], *[StructField(name, kind) for name, kind in _ADDED]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                columns = _rearranged(part, how)
                columns["output"] = columns["output"].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns.values()], names=["doc_id", *columns])

    return rows.mapInArrow(work, schema)


def restored_text(output: Column, form: Column, how: Infill = Infill()) -> Column:
    """The exact text from an output and its form. Each marker occurs once in an output that is not plain."""
    one = "|".join("".join(c if c.isalnum() else "\\" + c for c in marker) for marker in (how.prefix, how.suffix, how.middle))
    part = F.split(output, one, 4)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part[1], part[3], part[2]))
        .otherwise(F.concat(part[2], part[3], part[1]))
    )
