"""Licence notices wrapped as in source files."""

import textwrap

import pytest

from wardline.llm import licenses

GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
MIT = """// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction"""


@pytest.fixture(scope="module")
def model(awkward):
    return licenses.train(licenses.prose_sample(awkward))


def test_usual_headers(frame, awkward_rows, model):
    rows = [(k, f"{awkward_rows[k][1]}\n{h}\n{awkward_rows[k + 9][1]}") for k, h in enumerate([GPL, BSD, MIT])]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(rows), model).collect()}
    assert [got[k]["families"] for k in range(3)] == ["gpl", "bsd", "mit"]
    assert not got[0]["n_unknown"] and not got[1]["n_unknown"]  # the last line of the third is in no template
    for k in range(3):
        first = len(awkward_rows[k][1].split("\n"))
        assert f"{first}:{got[k]['families']}" in got[k]["paragraphs"].split(",")


@pytest.mark.parametrize("width", [24, 40, 72])
def test_every_template_at_any_width(frame, model, width):
    rows, want = [], {}
    for family, templates in licenses.TEMPLATES.items():
        for template in templates:
            lines = textwrap.wrap(template, width, break_long_words=False, break_on_hyphens=False)
            if len(lines) > 1:
                want[len(rows)] = family
                rows.append((len(rows), "\n".join(lines)))
    got = {r["doc_id"]: r["families"] for r in licenses.scan_licenses(frame(rows), model).collect()}
    assert {i: f for i, f in got.items() if f != want[i]} == {}


def test_blank_lines_end_a_notice(frame, model):
    text = "Redistribution and use in source and\n\nbinary forms, with or without modification,\n\nare permitted provided that"
    assert licenses.scan_licenses(frame([(1, text)]), model).collect()[0]["families"] == ""
