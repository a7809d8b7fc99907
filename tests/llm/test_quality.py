"""Statistics against plain counting; trees on held-out rows; monotonic scores."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import boosting, quality
from wardline.llm.shared import held_out
from wardline.llm.statistics import FEATURES


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often, inside = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            inside |= {k, k + 1, k + 2}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


@pytest.fixture(scope="module")
def real(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_counts(awkward, awkward_rows):
    got = quality.judge_quality(awkward, boosting.constant_forest(0.9)).collect()
    rows = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got]
    assert sorted(map(repr, rows)) == sorted(repr((i, *brute(t))) for i, t in awkward_rows)
    assert all(r["kept"] != r["base_failed"] for r in got)


def test_held_out_accuracy(real):
    documents, labels = real
    truth = labels.join(documents.filter(held_out(F.col("doc_id"))).select("doc_id"), "doc_id")
    scored = quality.score_quality(documents, quality.classifier_model(documents, labels)).join(truth, "doc_id").collect()
    assert len(scored) > 30
    assert sum(r["predicted"] == r["quality"] for r in scored) >= 0.95 * len(scored)
    judged = quality.judge_quality(documents, quality.rule_model(documents, labels)).join(truth, "doc_id").filter("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in judged) >= 0.95 * len(judged)


def test_monotonic(real):
    documents, labels = real
    model = quality.rule_model(documents, labels)
    x, _ = quality.training_matrix(documents, labels)
    for name, sign in quality.MONOTONIC.items():
        at = FEATURES.index(name)
        previous = None
        for value in np.linspace(0, max(1.0, x[:, at].max()), 30):
            moved = x.copy()
            moved[:, at] = value
            score = model.probability(moved)
            assert previous is None or (sign * (score - previous) >= -1e-12).all()
            previous = score


def test_trees_learn_and_walk():
    chance = np.random.default_rng(1)
    x = chance.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97

    def walk(row, node):
        while model.feature[node] >= 0:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        return model.value[node]

    raw = model.base + sum(walk(x[7], r) for r in model.roots)
    assert abs(model.probability(x[7:8])[0] - 1 / (1 + np.exp(-raw))) < 1e-12


def test_no_labels_and_empty_tables(spark, nothing, awkward, awkward_rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.classifier_model(awkward, labels)
    scored = quality.score_quality(awkward, model).collect()
    assert len(scored) == len(awkward_rows) and {r["score"] for r in scored} == {0.5}
    assert quality.score_quality(nothing, model).collect() == [] and quality.judge_quality(nothing, model).collect() == []
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.score_quality(awkward, quality.classifier_model(awkward, labels)).collect()) == len(awkward_rows)


def test_kept_rows_have_all_columns(awkward):
    kept = quality.keep_quality(awkward, boosting.constant_forest(0.9))
    assert kept.columns == awkward.columns and {r["kept"] for r in kept.collect()} == {"no"}
