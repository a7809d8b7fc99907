"""Samples that count usable rows only, blocks that hold their bound, contract digests, and SQL on tokens of every class."""

import random

import pytest
from pyspark.sql import functions as F

from wardline.llm import decontamination, language, quality, secrets
from wardline.llm.oracles import SECRETS
from wardline.llm.queries import QUERIES
from wardline.llm.shared import training_row

from samples import prose
from test_decontamination import brute


def test_sample_counts_usable_labels_only(spark):
    """100,000 label rows of which 1 % have a quality and a document: all of those are learned from."""
    documents = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"))
    labels = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when((F.col("id") < 1000) | (F.col("id") > 99_000), F.col("id") % 2).cast("int").alias("quality"))
    usable = documents.filter(training_row(F.col("doc_id"))).count()
    x, y = quality.training_matrix(documents, labels, sample=1000)
    assert len(x) == len(y) == usable
    assert len(quality.training_matrix(documents, labels, sample=50)[1]) == 50


def test_one_item_over_the_block_size(spark, frame):
    chance = random.Random(12)
    long, other = prose(chance, 400), prose(chance, 15)
    benchmark = spark.createDataFrame([(1, long), (2, other)], "item_id long, text string")
    rows = [(k, f"before {' '.join(long.split()[20 * k : 20 * k + 14])} after") for k in range(18)] + [(50, other), (51, "nothing of it"), (52, None)]
    wanted = sorted(repr((i, *brute(t, [(1, long), (2, other)]))) for i, t in rows)
    sizes = [len(b.value.windows.get(10, {})) for b in decontamination.benchmark_blocks(benchmark, block_bytes=10_000)]
    assert len(sizes) > 2 and sum(sizes) == 397
    assert all(b.value.bytes <= 10_000 for b in decontamination.benchmark_blocks(benchmark, block_bytes=10_000))
    assert decontamination.benchmark_blocks(benchmark, block_bytes=600) is None  # more than four blocks: joined
    for block_bytes in (decontamination.BLOCK_BYTES, 10_000, 600):
        found = decontamination.contamination(frame(rows), benchmark, block_bytes=block_bytes)
        assert sorted(repr(tuple(r)) for r in found.collect()) == wanted
        assert {r["doc_id"] for r in decontamination.drop_contaminated(frame(rows), benchmark, block_bytes=block_bytes).collect()} == {51, 52}


def test_kept_follows_the_contract_for_texts_of_one_id(spark, frame, tmp_path):
    chance = random.Random(3)
    a, b = prose(chance, 60), prose(chance, 60)
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, "words of its own, six or more")]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op6_minhash_dedup"](spark, str(tmp_path)).collect()
    assert len(found) == 6 and all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)


def test_too_many_languages(frame):
    rows = [(i, f"some text {i}") for i in range(60)]
    with pytest.raises(ValueError, match="lang"):
        language.learn_languages(frame(rows, lang=lambda i: f"l{i}"), most=20)


def test_sql_equals_operator_on_tokens_of_every_class(spark):
    import duckdb

    chance = random.Random(17)
    classes = {
        "letters": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "hex": "0123456789abcdef", "upper": "0123456789ABCDEF", "digits": "0123456789",
        "mixed": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", "few": "abcXYZ12",
    }
    texts = []
    for letters in classes.values():
        for _ in range(12):
            token = "".join(chance.choice(letters) for _ in range(chance.randrange(18, 60)))
            cut = chance.randrange(len(token))
            texts += [token, token[:cut] + "aaaaaaaa" + token[cut:], token[:cut] + "abcdefgh" + token[cut:], f"word {token}, {token[::-1]} end", f"token={token}"]
    texts += ["", None, "AKIA" + "Q7" * 10, "secret: " + "x1" * 10, "sha256-" + "aB3" * 12, "example" + "aB3dE6gH9" * 3, "no token here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    found = secrets.secret_digest(df)
    columns = sorted(found.columns)
    rows = sorted(map(repr, (tuple(r) for r in found.select(*columns).collect())))
    listed = ", ".join(columns)
    assert rows == sorted(map(repr, con.execute(f"SELECT {listed} FROM ({SECRETS})").fetchall()))
    assert any(r["n_added"] for r in found.filter("doc_id < 60").collect())  # letters-only tokens are among them
