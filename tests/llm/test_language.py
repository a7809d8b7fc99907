"""Language identification on held-out rows."""

import pytest

from wardline.llm import language


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify_languages(documents, language.learn_languages(documents)).join(documents, "doc_id")
    rows = [r for r in found.collect() if r["held_out"] and r["lang"] is not None]
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    sure = [r for r in rows if not r["rejected"]]
    assert len(sure) > 0.7 * len(rows) and sum(r["lang_pred"] == r["lang"] for r in sure) >= 0.99 * len(sure)


@pytest.mark.parametrize("lang", [lambda i: "en", lambda i: None])
def test_awkward_rows(frame, awkward_rows, lang):
    df = frame(awkward_rows, lang=lang)
    got = language.identify_languages(df, language.learn_languages(df)).collect()
    assert len(got) == len(awkward_rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert {by_id[k]["lang_pred"] for k in (500, 501, 502, 506)} == {"und"}
    assert by_id[505]["lang_pred"] == (lang(505) or "und")


def test_empty_table(nothing):
    assert language.learn_languages(nothing) == {} and language.identify_languages(nothing, {}).collect() == []
