"""Message corpora and feeds as tables of the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def as_timestamp(ts: Column) -> Column:
    """Parquet times without a zone are UTC; the session zone has to be UTC as well."""
    return ts.cast("timestamp")


def documents_as_messages(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.concat(F.lit("d"), "doc_id").alias("msg_id"),
        F.col("source").alias("user_key"),
        F.col("lang").alias("language"),
        F.lit("text").alias("input_type"),
        "text",
    )


def conversations_as_messages(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("msg_id"),
        F.col("role").alias("user_key"),
        F.lit(None).cast("string").alias("language"),
        F.lit("text").alias("input_type"),
        "text",
    )


def pages_as_messages(pages: DataFrame) -> DataFrame:
    """The address of a page as a message that holds just that link."""
    return pages.select(
        F.concat(F.lit("p"), "page_id").alias("msg_id"),
        F.lit("page").alias("user_key"),
        F.lit(None).cast("string").alias("language"),
        F.lit("text").alias("input_type"),
        F.col("url").alias("text"),
    )


_ADAPTERS = {
    "documents": documents_as_messages,
    "conversations": conversations_as_messages,
    "pages": pages_as_messages,
}


def read_messages(
    spark: SparkSession,
    path: str,
    tables: tuple[str, ...] = ("documents", "conversations"),
    partitions: int | None = None,
) -> DataFrame:
    """Message table from the corpus tables under ``path``; only the needed columns are read.

    Ids are text: a letter for the table, then its key. ``partitions`` deals the messages over that many tasks by a hash
    of their ids, for files that cannot be split; without it every file block is a task and nothing is shuffled.
    """
    merged = None
    for name in tables:
        table = spark.read.parquet(f"{path}/{name}.parquet")
        part = _ADAPTERS[name](table)
        merged = part if merged is None else merged.unionByName(part)
    return merged if partitions is None else merged.repartition(partitions, "msg_id")


def read_table_stream(
    spark: SparkSession, path: str, pattern: str, schema, files_per_trigger: int | None = None
) -> DataFrame:
    """The tables under ``path`` whose names fit a glob pattern as a stream, each a file or a folder of files.

    The pattern is part of the path: a filter of file names would see the names inside a table's folder only.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path}/{pattern}")


def read_message_stream(
    spark: SparkSession, path: str, table: str, schema, files_per_trigger: int | None = None
) -> DataFrame:
    """Streaming twin of :func:`read_messages` for one table: files or folders of files that start with its name."""
    return _ADAPTERS[table](read_table_stream(spark, path, f"{table}*", schema, files_per_trigger))


def read_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Feed lines (value, source) for :func:`wardline.operators.linkage.parse_threat_feed`."""
    return spark.read.text(path).select("value", F.lit(source).alias("source"))


def read_events(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Valid event rows of a table written by ``write_events``; a window prunes day folders."""
    events = spark.read.parquet(path).filter("verdict = 'valid'").drop("verdict", "reason", "batch")
    if since is not None:
        events = events.filter(
            (F.col("day") >= F.lit(since).cast("date")) & (F.col("ts") >= F.lit(since).cast("timestamp"))
        )
    if until is not None:
        events = events.filter(
            (F.col("day") <= F.lit(until).cast("date")) & (F.col("ts") < F.lit(until).cast("timestamp"))
        )
    return events
