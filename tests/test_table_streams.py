"""Streams over tables that are folders of files give the rows of those that are one file."""

import datetime as dt

import pytest

from wardline.plans.catalog import QUERIES
from wardline.sources.readers import read_message_stream

ITEM = "send the secret code to the safe account today"
ROWS = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(k, f"text {k} {ITEM if k % 3 else ''}", "en", "web", 50) for k in range(20)]),
    "conversations": ("conv_id long, turn long, role string, text string", [(k, 0, "user", f"{ITEM} a{k}@b.uz") for k in range(20)]),
    "pages": ("page_id long, url string, html string", [(k, f"http{'s' * (k % 2)}://www.site{k % 5}.uz/{k}", "x") for k in range(20)]),
    "benchmark": ("item_id long, text string", [(0, ITEM)]),
    "events": (
        "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
        [(k, dt.datetime(2024, 1, 1 + k // 9, k % 9), k % 2, "view", 1.0, f'{{"k": {k}}}') for k in range(30)],
    ),
}


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    """The same tables as one file each and as folders of three files."""
    whole, cut = tmp_path_factory.mktemp("whole"), tmp_path_factory.mktemp("cut")
    for name, (schema, rows) in ROWS.items():
        df = spark.createDataFrame(rows, schema)
        df.toPandas().to_parquet(whole / f"{name}.parquet", index=False, coerce_timestamps="us")
        df.repartition(3).write.parquet(str(cut / f"{name}.parquet"))
    return str(whole), str(cut)


@pytest.mark.parametrize("name", ["blocklist_stream", "quota_stream", "screen_stream", "screened_stream"])
def test_folders_of_files_stream_like_files(spark, layouts, name):
    whole, cut = [sorted(map(repr, QUERIES[name](spark, path).collect())) for path in layouts]
    assert whole == cut and len(cut) > 1


def test_messages_of_a_folder_are_streamed(spark, layouts, tmp_path):
    schema = ROWS["documents"][0]
    stream = read_message_stream(spark, layouts[1], "documents", schema, files_per_trigger=1)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20 and query.lastProgress["batchId"] >= 2
