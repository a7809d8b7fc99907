"""Licence scan on planted notices."""

from wardline.llm import licenses


def test_planted_notices(frame, awkward, awkward_rows):
    model = licenses.train(licenses.prose_sample(awkward))
    plain = licenses.scan_licenses(awkward, model).collect()
    assert len(plain) == len(awkward_rows) and not any(r["families"] for r in plain) and sum(r["n_unknown"] for r in plain) <= 1
    rows, want = [], {}
    for k, (family, templates) in enumerate(licenses.TEMPLATES.items()):
        for j, template in enumerate(templates):
            i = 100 * k + j
            rows.append((i, f"{awkward_rows[k][1]}\n  {template.upper()}  \nthe end"))
            want[i] = family
    got = {r["doc_id"]: r["families"] for r in licenses.scan_licenses(frame(rows), model).collect()}
    assert sum(want[i] == got[i] for i in want) >= 0.9 * len(want)
    assert all(got[i] in ("", want[i]) for i in want)


def test_a_licence_without_template_is_unknown_or_prose(frame, awkward):
    model = licenses.train(licenses.prose_sample(awkward))
    row = licenses.scan_licenses(frame([(1, "Licensed under the Frobnitz License, Version 9.")]), model).collect()[0]
    assert row["families"] == ""


def test_known_lines_of_the_tables(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.train(licenses.prose_sample(documents))
    found = licenses.scan_licenses(documents, model).join(documents, "doc_id").collect()
    signs = {"cc": "Licensed under CC BY-NC 4.0.", "gpl": "GNU General Public License, version 3.", "apache": "Apache License, Version 2.0.", "mit": "Released under the MIT License.", "reserved": "All rights reserved."}
    for r in found:
        assert set(filter(None, r["families"].split(","))) == {f for f, sign in signs.items() if sign in r["text"]}


def test_empty_table(nothing):
    model = licenses.train(licenses.prose_sample(nothing))
    assert licenses.scan_licenses(nothing, model).collect() == []
