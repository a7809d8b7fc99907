"""Quality rules and quality classifier: boosted trees over document statistics.

Both learn ``labels.quality`` from at most ``sample`` labelled rows (a documented bound: those of smallest id hash among
the rows whose crc32(doc_id) mod 5 is not 0) and score every whole text in the task that reads it; only ids and labels
are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm import boosting
from wardline.llm.shared import byte_texts, hash_share, held_out, map_batches, training_row, written
from wardline.llm.statistics import COUNTS, FEATURES, batch_statistics

SAMPLE = 20_000
#: More symbols, repeated lines, repeated windows or runs of one word never raise the score.
MONOTONIC = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "same_as_last_share": -1}
LEAST_SCORE = 0.5


def training_matrix(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and quality of at most ``sample`` labelled training documents; no text reaches the driver.

    A document with contradicting labels is left out. Of rows with the same id the statistics of each count. Label rows
    that are held out, have no quality or name no document do not count, however many they are.
    """
    usable = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality"))
        .filter(training_row(F.col("_id")) & F.col("_quality").isin(0, 1))
        .groupBy("_id")
        .agg(F.min("_quality").alias("_quality"), F.max("_quality").alias("_other"))
        .filter(F.col("_quality") == F.col("_other"))
        .join(documents.select(F.col("doc_id").alias("_id")).filter(training_row(F.col("_id"))), "_id", "left_semi")
    )
    usable = written(usable.select("_id", "_quality"), "labels")
    known = usable.filter(hash_share(F.xxhash64("_id"), sample, usable.count())).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = documents.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(known), "_id")  # at most sample rows

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        _, features = batch_statistics(byte_texts(batch.column("text")))
        return {"_id": batch.column("_id"), "_quality": batch.column("_quality"), "x": features.tolist()}

    found = map_batches(rows, work, "_id long, _quality int, x array<double>")
    bounded = found.orderBy(F.xxhash64("_id"), "_id", "x").limit(sample).collect()
    x = np.array([r["x"] for r in bounded], dtype=np.float64).reshape(-1, len(FEATURES))
    return x, np.array([r["_quality"] for r in bounded], dtype=np.float64)


def rule_model(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Forest:
    """Shallow trees that are monotonic in the features of MONOTONIC."""
    x, y = training_matrix(documents, labels, sample)
    return boosting.fit(x, y, trees=50, depth=3, monotonic={FEATURES.index(k): v for k, v in MONOTONIC.items()})


def classifier_model(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Forest:
    """Deeper trees without constraints."""
    x, y = training_matrix(documents, labels, sample)
    return boosting.fit(x, y, trees=80, depth=5, rate=0.1)


def _judged(texts: list[bytes | None], model: boosting.Forest, least: float):
    counts, features = batch_statistics(texts)
    words, repeats = counts[:, 0], counts[:, 4]
    failed = (words < 50) | (100 * repeats > 50 * words)
    score = model.probability(features)
    return counts, failed, score, ~failed & (score >= least)


def judge_quality(documents: DataFrame, model: boosting.Forest, least: float = LEAST_SCORE) -> DataFrame:
    """One row per row: doc_id, base counts, base_failed, kept and score.

    Null and empty texts have no words and fail. Repeated rows are judged alike. Other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        counts, failed, score, kept = _judged(byte_texts(batch.column("text")), model, least)
        columns = {name: counts[:, k] for k, name in enumerate(COUNTS)}
        return {"doc_id": batch.column("doc_id"), **columns, "base_failed": failed, "kept": kept, "score": score}

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return map_batches(documents.select("doc_id", "text"), work, schema)


def keep_quality(documents: DataFrame, model: boosting.Forest, least: float = LEAST_SCORE) -> DataFrame:
    """The rows that the rules keep, with all their columns, whatever these are named.

    Null and empty texts fail. Repeated rows are judged alike, null ids like others. An empty table gives no rows.
    """
    schema = documents.schema
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                kept = _judged(byte_texts(batch.column(at)), model, least)[3]
                yield batch.filter(pa.array(kept))

    return documents.mapInArrow(run, schema)


def score_quality(documents: DataFrame, model: boosting.Forest, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted for every row; empty texts get a score too."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        _, features = batch_statistics(byte_texts(batch.column("text")))
        score = model.probability(features)
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= least).astype(np.int32)}

    scored = map_batches(documents.select("doc_id", "text"), work, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
