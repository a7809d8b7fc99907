"""Fill-in-the-middle against a row-by-row version, round trips and markers that could not be rebuilt."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from wardline.llm import infill
from wardline.llm.infill import Infill, fill_in_middle, restored_text


def by_hand(doc_id, text, how):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in (how.prefix, how.suffix, how.middle)) or h[2] % 100 >= how.percent:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < how.spm_percent:
        return (doc_id, len(units), "spm", len(p), len(m), how.suffix + s + how.prefix + p + how.middle + m)
    return (doc_id, len(units), "psm", len(p), len(m), how.prefix + p + how.suffix + s + how.middle + m)


LINES = [
    (900, "\n"), (901, "\n\n\n"), (902, "a\n"), (903, "\na"), (904, "a\r\nb c\x0bd\n"), (905, "q <P> z\nr"), (906, "<\nP\n>\nS>\n"),
    (907, "<P\n<S\n<M\n"), (908, "é\n名前\n𝒳\n"), (909, "<M>"), (910, "l\n" * 5000),
]


@pytest.mark.parametrize("how", [Infill(), Infill(seed=3, percent=60, spm_percent=0, prefix="[[PRE]]", suffix="[[SUF]]", middle="[[MID]]")])
def test_against_rows_by_hand(frame, awkward_rows, how):
    rows = awkward_rows + LINES
    made = fill_in_middle(frame(rows), how)
    assert made.columns == ["doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    wanted = [by_hand(i, t, how) for i, t in rows]
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, wanted))
    back = made.select("doc_id", restored_text(F.col("output"), F.col("form"), how).alias("text"))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((i, t or "")) for i, t in rows)
    assert {r["form"] for r in made.collect()} == ({"plain", "psm", "spm"} if how.spm_percent else {"plain", "psm"})


def test_small_slices_change_nothing(frame, awkward_rows):
    """A batch in slices of one row each, as texts above the bound would be."""
    import pyarrow as pa

    rows = [(i, t) for i, t in awkward_rows + LINES if i is not None]
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "_fim_text": [t for _, t in rows]})
    whole, before = list(infill._slices(batch)), infill.SLICE_BYTES
    try:
        infill.SLICE_BYTES = 1
        parts = list(infill._slices(batch))
    finally:
        infill.SLICE_BYTES = before
    assert len(whole) == 1 and sum(p.num_rows for p in parts) == len(rows)
    assert [x for p in parts for x in p["doc_id"].to_pylist()] == [i for i, _ in rows]
    # Rows without text add nothing to a slice, all others stand alone.
    assert all(sum(1 for t in p["_fim_text"].to_pylist() if t) <= 1 for p in parts)


def test_empty_table(nothing):
    assert fill_in_middle(nothing).collect() == []


@pytest.mark.parametrize("markers", [("", "b", "c"), ("aa", "aab", "c"), ("<a>", "><", "c"), ("x", "x", "y"), ("aba", "c", "d")])
def test_markers_that_cannot_be_rebuilt(markers):
    with pytest.raises(ValueError, match="markers"):
        Infill(prefix=markers[0], suffix=markers[1], middle=markers[2])
