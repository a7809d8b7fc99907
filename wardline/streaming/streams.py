"""Structured Streaming forms: screening, windows, debouncing, quota, blocklist, lifecycle.

Rows later than the watermark are dropped. Stateful steps keep one small value per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wardline import fixed_values as V
from wardline.operators.alerts import availability_windows, paged_errors, traffic_windows
from wardline.operators.linkage import upsert_blocklist
from wardline.plans.screening import screen

WATERMARK = "10 minutes"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb_state(spark: SparkSession) -> None:
    """Sets the state store that the debouncing and quota streams need; running queries keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


#: Trigger options of a job that ends when everything that is there now is processed.
AVAILABLE = {"availableNow": True}


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Starts writing a stream to Parquet; ``trigger`` as in DataStreamWriter, as fast as possible by default."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def start_batches(stream: DataFrame, one_batch, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream whose micro-batches go to a function."""
    writer = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there now into Parquet and waits for it."""
    query = start(stream, path, checkpoint, mode, AVAILABLE)
    query.awaitTermination()
    return query


def screened_stream(messages: DataFrame, patterns: DataFrame, **packs) -> DataFrame:
    """Arriving messages with what :func:`wardline.plans.screening.screen` adds, as an append plan without state.

    For :func:`start`, whose file sink commits every batch once. Packs, cards, catalog and blocklist have to be of the
    sizes that sit in a plan or are joined as static tables; beyond, :func:`screen_stream` screens batch by batch.
    """
    return screen(messages, patterns, **packs)


def screen_stream(
    messages: DataFrame, patterns: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **packs
) -> StreamingQuery:
    """Starts screening arriving messages batch by batch, with packs of any size.

    A replayed batch overwrites its own folder.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        screen(batch, patterns, **packs).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return start_batches(messages, one_batch, checkpoint, trigger)


def availability_stream(events: DataFrame, threshold: float, watermark: str = WATERMARK) -> DataFrame:
    """Sliding availability windows, emitted once a window can no longer change."""
    return availability_windows(events.withWatermark("ts", watermark), threshold)


def traffic_stream(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Daily traffic of events seen once each."""
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"])
    return traffic_windows(once)


def session_stream(events: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """(user_key, session_start, session_end, events) once a session is over."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy("user_key", F.session_window("ts", gap).alias("s"))
        .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("events"))
        .select("user_key", "session_start", "session_end", "events")
    )


class _Debounce(StatefulProcessor):
    """State of a key: the time of the last alert sent."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of each chunk only the distinct times are held, as plain numbers.
        times = np.unique(np.concatenate([np.unique(chunk["t"].to_numpy()) for chunk in rows]))
        stand = self.last.get()
        at = 0 if stand is None else int(np.searchsorted(times, stand[0] + self.gap))
        sent = []
        while at < len(times):
            sent.append(int(times[at]))
            at = int(np.searchsorted(times, times[at] + self.gap))
        if sent:
            self.last.update((sent[-1],))
        yield pd.DataFrame({"stage": key[0], "error_type": key[1], "t": sent})

    def close(self) -> None:
        pass


def debounce_stream(errors: DataFrame, debounce_seconds: int = V.ALERT_DEBOUNCE_SECONDS) -> DataFrame:
    """Alerts sent per (stage, error_type); the state is the time of the last one sent, kept in RocksDB.

    The session needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider, see ``rocksdb_state``.
    """
    times = paged_errors(errors).select("stage", "error_type", F.unix_micros("ts").alias("t"))
    sent = times.groupBy("stage", "error_type").transformWithStateInPandas(
        _Debounce(debounce_seconds * 1_000_000), "stage string, error_type string, t long", "append", "none"
    )
    return sent.select("stage", "error_type", F.timestamp_micros("t").alias("ts"))


class _Quota(StatefulProcessor):
    """State of a share of the users on a day: billable checks of each so far. A timer at the end of the day drops it."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "user_key string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Checks of each user in order of (t, id). The last place still free decides; the places only move forward as chunks come in.

        Rows behind the last free place are refused and leave at once; of those before it only ids and times are held.
        """
        fresh = not self.used.exists()
        number, used, billed, held = {}, [], np.zeros(0, dtype=np.int64), None
        for chunk in rows:
            codes, users = pd.factorize(chunk["user_key"], use_na_sentinel=False)
            users = [None if pd.isna(user) else user for user in users]
            for user in users:
                if user not in number:
                    number[user] = len(used)
                    stand = None if fresh else self.used.getValue((user,))
                    used.append(stand[0] if stand is not None else 0)
            chunk = chunk[["user_key", "t", "id", "billable"]].assign(user=np.array([number[user] for user in users])[codes])
            free = np.maximum(self.limit - np.array(used), 0)
            billed = np.bincount(chunk["user"], chunk["billable"], len(used)).astype(np.int64) + np.pad(billed, (0, len(used) - len(billed)))
            held = chunk if held is None else pd.concat([held, chunk])
            held = held.sort_values(["user", "t", "id"])
            before = (held.groupby("user")["billable"].cumsum() - held["billable"]).to_numpy()
            out = before >= free[held["user"]]
            refused, held = held[out], held[~out]
            if len(refused):
                yield pd.DataFrame({"id": refused["id"], "user_key": refused["user_key"], "admitted": False})
        for user, k in number.items():
            if billed[k]:
                self.used.updateValue((user,), (int(used[k] + billed[k]),))
        if fresh and billed.any():
            day_end = (pd.Timestamp(key[1]) + pd.Timedelta(days=1)).value // 1_000_000
            self.handle.registerTimer(max(day_end, timerValues.getCurrentWatermarkInMs() + 1))
        if held is not None and len(held):
            yield pd.DataFrame({"id": held["id"], "user_key": held["user_key"], "admitted": True})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        yield from ()

    def close(self) -> None:
        pass


def quota_stream(events: DataFrame, limit: int = V.DAILY_LIMIT, watermark: str = WATERMARK, shares: int = 256) -> DataFrame:
    """(id, user_key, admitted); the state counts the billable checks of each user and day, kept in RocksDB.

    Users are dealt over ``shares`` by a hash, so that one call of the state's Python code serves many of them; the number
    changes no row. A timer drops the state of a day once the watermark has passed its end; rows later than the watermark
    are dropped.
    """
    keyed = events.withWatermark("ts", watermark).select(
        "id", "user_key", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts",
        F.pmod(F.xxhash64("user_key"), F.lit(shares)).cast("int").alias("share"),
        F.unix_micros("ts").alias("t"),
        F.coalesce(F.col("status").isin(*V.BILLABLE_STATUSES), F.lit(False)).cast("int").alias("billable"),
    )
    return keyed.groupBy("share", "day").transformWithStateInPandas(
        _Quota(limit), f"id {events.schema['id'].dataType.simpleString()}, user_key string, admitted boolean", "append", "eventTime"
    )


def blocklist_stream(
    feed: DataFrame, base: DataFrame, path: str, checkpoint: str, now, trigger: dict | None = None, prefix: int = 2
) -> StreamingQuery:
    """Starts keeping a blocklist current from arriving hashes, in folders by the first letters of the hash.

    ``base`` is written once, when there is no list yet. A batch rewrites only the folders that its hashes fall into.
    The new rows are staged first, so no folder is read and written at once; the upsert keeps the earliest date and sets
    the latest, so a replayed batch repeats safely.
    """
    spark = base.sparkSession
    columns = base.columns

    def folders(df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.left("domain_hash", F.lit(prefix)))

    def put(df: DataFrame, target: str) -> None:
        writer = folders(df).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part").parquet(target)

    def listed() -> DataFrame:
        return spark.read.schema(folders(base).schema).parquet(f"{path}/list")

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            put(base, f"{path}/list")
        touched = folders(batch).select("part").distinct()
        current = listed().join(touched, "part", "left_semi").select(*columns)
        put(upsert_blocklist(current, batch, now), f"{path}/staged")
        staged = spark.read.schema(folders(base).schema).parquet(f"{path}/staged")
        put(staged.join(touched, "part", "left_semi").select(*columns), f"{path}/list")

    return start_batches(feed, one_batch, checkpoint, trigger)


def lifecycle_stream(events: DataFrame, gap: str = "10 minutes", watermark: str = WATERMARK) -> DataFrame:
    """The rows of :func:`wardline.operators.alerts.lifecycle`, each once its request has been silent for ``gap``.

    Requests without a start or without an end get a row too; records of a request that are further apart than ``gap``
    count as two.
    """
    start_ts = F.min(F.when(F.col("event") == "check_started", F.col("ts")))
    terminal = F.col("event").isin("check_completed", "check_failed")
    end_ts = F.min(F.when(terminal, F.col("ts")))
    return (
        events.withWatermark("ts", watermark)
        .groupBy("request_id", F.session_window("ts", gap).alias("s"))
        .agg(
            F.bool_or(F.col("event") == "check_started").alias("has_start"),
            F.min_by(F.when(terminal, F.col("event")), F.when(terminal, F.col("ts"))).alias("outcome"),
            F.sort_array(F.collect_set(F.when(F.col("event") == "app_error", F.col("error_type")))).alias("error_types"),
            ((F.unix_micros(end_ts) - F.unix_micros(start_ts)) / 1000).cast("long").alias("duration_ms"),
        )
        .drop("s")
    )
