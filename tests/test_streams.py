"""Streams with state: late rows, small limits, restarts; debouncing of one long key; contract checks in one pass."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import alerts, events as EV
from wardline.operators.common import routed
from wardline.streaming import streams as K

DAY = dt.datetime(2024, 1, 10)
EVENTS = "id string, user_key string, ts timestamp, status string"


def chunks(spark, tmp_path, schema, parts):
    """A stream that takes one of the parts in each micro-batch, in order."""
    import os
    import time

    folder = tmp_path / "in"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not name.startswith("seen"):
                os.rename(folder / name, folder / f"seen{k}-{name}")
                os.utime(folder / f"seen{k}-{name}", (time.time() - 100 + k, time.time() - 100 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_quota_keeps_the_first_checks_of_a_day(spark, tmp_path):
    chance = random.Random(2)
    minutes = [(f"{k:03}", chance.randrange(3), chance.randrange(600), chance.choice(["ok", "no_signal", "rate_limited", "ocr_error", None])) for k in range(200)]
    rows = [(i, f"u{u}", DAY + dt.timedelta(minutes=m, seconds=int(i)), s) for i, u, m, s in minutes]
    rows.sort(key=lambda r: r[2])
    K.rocksdb_state(spark)
    parts = [rows[k : k + 50] for k in range(0, 200, 50)]
    for part in parts:
        chance.shuffle(part)
    stream = K.quota_stream(chunks(spark, tmp_path, EVENTS, parts), limit=4, watermark="1 day")
    K.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r["id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame(rows, EVENTS)
    want = {r["id"]: r["admitted"] for r in EV.admit(batch, 4).select("id", "admitted").collect()}
    assert got == want and 0 < sum(got.values()) < 200


def test_quota_drops_late_rows_and_ended_days(spark, tmp_path):
    K.rocksdb_state(spark)
    late = ("late", "u", DAY + dt.timedelta(hours=1), "ok")
    parts = [
        [("a", "u", DAY + dt.timedelta(hours=2), "ok")], [("b", "u", DAY + dt.timedelta(days=2), "ok")], [("c", "u", DAY + dt.timedelta(days=2, hours=1), "ok")],
        [late, ("d", "u", DAY + dt.timedelta(days=2, hours=2), "ok")],
    ]
    stream = K.quota_stream(chunks(spark, tmp_path, EVENTS, parts), limit=2)
    K.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r["id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False}


def errors(times):
    return [("llm", "Timeout", DAY + dt.timedelta(seconds=s)) for s in times]


ERRORS = "stage string, error_type string, ts timestamp"


def test_debouncing_goes_on_after_a_restart(spark, tmp_path):
    K.rocksdb_state(spark)
    times = sorted(random.Random(5).sample(range(20_000), 300))
    folder = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(errors(times[100 * k : 100 * k + 100]), ERRORS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = K.debounce_stream(spark.readStream.schema(ERRORS).parquet(str(folder)))
        K.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r["ts"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = alerts.debounce_alerts(spark.createDataFrame(errors(times), ERRORS))
    assert got == {r["ts"] for r in whole.collect()} and len(got) > 5


def test_debouncing_one_key_over_ten_thousand_slices(spark):
    chance, at, times = random.Random(7), 0, []
    for _ in range(12_000):
        at += chance.choice([30, 400, 899, 900, 901, 3000, 9000])
        times.append(at)
    sent, last = [], None
    for t in times:
        if last is None or t - last >= 900:
            sent.append(t)
            last = t
    df = spark.createDataFrame(errors(times) + [("ocr", "Timeout", DAY)], ERRORS)
    found = alerts.debounce_alerts(df, slice_seconds=900)
    assert times[-1] // 900 > 10_000
    assert sorted((r["ts"] - DAY).total_seconds() for r in found.filter("stage = 'llm'").collect()) == sent
    assert "collect_list" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("rows", [[], errors([0]), errors([0, 900]), [("unknown", "Timeout", DAY)], [("llm", "", DAY), ("llm", None, DAY)]])
def test_debouncing_few_rows(spark, rows):
    df = spark.createDataFrame(rows, ERRORS)
    assert alerts.debounce_alerts(df).count() == sum(r[0] == "llm" and bool(r[1]) for r in rows)


def test_routing_is_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(100).mapInArrow(count, "id long")
    reason = F.when(F.col("id") % 7 == 0, "seventh").when(F.col("id") > 90, "large")
    for k in range(2):  # a second call appends and reads back its own rows only
        parts = routed(df, reason, str(tmp_path / "both"), mode="append")
        assert {r.id for r in parts["quarantine"].filter("reason = 'large'").collect()} == set(range(92, 100)) - {98}
        assert parts["valid"].columns == ["id"] and parts["valid"].count() == 78 and parts["quarantine"].count() == 22
        assert parts["counts"] == {"valid": 78, "quarantine": 22}
        assert seen.value == 100 * (k + 1)


def test_checks_with_and_without_a_path(spark, tmp_path):
    rows = [("a", "{\"status\": \"ok\"}", None), ("check_completed", "{\"text\": \"x\"}", None), ("check_completed", "{}", None)]
    df = spark.createDataFrame(rows, "name string, fields string, stage string")
    lazy, put = EV.validate_log_events(df), EV.validate_log_events(df, str(tmp_path / "log"))
    for side in ("valid", "quarantine"):
        assert lazy[side].columns == put[side].columns
        assert sorted(map(repr, lazy[side].collect())) == sorted(map(repr, put[side].collect()))
