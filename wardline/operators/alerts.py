"""Availability alerts, alert debouncing and the lifecycle of checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wardline import fixed_values as V
from wardline.operators.common import rate, stored


def availability_columns(threshold: float) -> dict[str, Column]:
    checks = F.count_if(F.col("retrieval_status").isNotNull())
    out = F.count_if(F.col("retrieval_status") == "unavailable")
    share = rate(out, checks, digits=None)
    return {
        "checks": checks,
        "unavailable": out,
        "rate": share,
        "alert": (out > 0) & (share >= threshold),
    }


def availability(events: DataFrame, since: str, threshold: float) -> DataFrame:
    """One row: retrieval checks since a moment, unavailable ones, their share, and the alert."""
    recent = events.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    return recent.agg(*[c.alias(n) for n, c in availability_columns(threshold).items()])


def availability_windows(
    events: DataFrame, threshold: float, window: str = "30 minutes", slide: str = "5 minutes"
) -> DataFrame:
    """The same over sliding windows."""
    return (
        events.groupBy(F.window("ts", window, slide).alias("w"))
        .agg(*[c.alias(n) for n, c in availability_columns(threshold).items()])
        .select(
            F.col("w.start").alias("window_start"), "checks", "unavailable", "rate", "alert"
        )
    )


def paged_errors(errors: DataFrame) -> DataFrame:
    """Errors an operator is paged for: known stages with an error type."""
    return errors.filter(F.col("stage").isin(*V.PAGED_STAGES) & (F.col("error_type") != ""))


def _last_reachable(following: np.ndarray) -> np.ndarray:
    """Where each index ends when ``following`` is applied until it leaves the array."""
    n = len(following)
    jump = np.append(following, n)
    end = np.arange(n + 1)
    while True:
        inside = jump < n
        if not inside.any():
            return end[:n]
        end = np.where(inside, end[np.minimum(jump, n)], end)
        jump = np.where(inside, jump[np.minimum(jump, n)], n)


#: Slices, and later blocks of slices, that are composed in one group of a round.
_FAN = 16
_ANY_TIME = -(1 << 62)


def _compose(first: tuple, then: tuple, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of two stretches of time, one after the other.

    A function (up_to, out) turns the earliest admissible time e on entering into the one on leaving: ``out`` of the first
    ``up_to`` that is not below e, and e itself beyond them all. No e above ``reach`` ever enters.
    """
    (u, v), (u2, v2) = first, then
    at = np.searchsorted(u2, v)
    moved = np.where(at < len(u2), np.append(v2, 0)[at], v)
    beyond = u2 > u[-1] if len(u) else np.ones(len(u2), dtype=bool)
    up_to, out = np.concatenate([u, u2[beyond]]), np.concatenate([moved, v2[beyond]])
    end = int(np.searchsorted(up_to, reach)) + 1
    up_to, out = up_to[:end], out[:end]
    keep = np.append(out[1:] != out[:-1], True) if len(out) else np.empty(0, dtype=bool)
    return up_to[keep], out[keep]


def _functions(pdf: pd.DataFrame) -> list[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """The step functions of a group in order of their numbers."""
    rows = pdf.sort_values(["number", "up_to"])
    numbers, up_to, out = (rows[c].to_numpy() for c in ("number", "up_to", "out"))
    starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
    return [(int(numbers[i]), (up_to[i:j], out[i:j])) for i, j in zip(starts, np.append(starts[1:], len(numbers)))]


def debounce_alerts(
    errors: DataFrame,
    debounce_seconds: int = V.ALERT_DEBOUNCE_SECONDS,
    slice_seconds: int = 3600,
) -> DataFrame:
    """(stage, error_type, ts) of the alerts sent: the first of a key, then only those at least
    ``debounce_seconds`` after the last one sent.

    A key is cut into time slices, so that one noisy key is many tasks. Each slice reports where the chain of alerts
    would leave it for every way of entering it, as rows of a step function. Rounds of composition turn the functions of
    neighbouring slices into those of blocks, of blocks of blocks, and so on; the way back hands each block, then each
    slice, the moment from which it may send. Then every slice replays its chain. No group holds more than one slice's
    errors or the functions of a few neighbours, however long a key's history is.
    """
    if slice_seconds < debounce_seconds:
        raise ValueError("slice_seconds must be at least debounce_seconds")
    gap, width = debounce_seconds * 1_000_000, slice_seconds * 1_000_000
    keys = ["stage", "error_type"]
    times = (
        paged_errors(errors)
        .select(*keys, F.unix_micros("ts").alias("t"))
        .distinct()
        .withColumn("number", F.floor(F.col("t") / F.lit(width)).cast("long"))
    )
    shape = "stage string, error_type string, number long"

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        end = _last_reachable(np.searchsorted(t, t + gap))
        entries = min(int(np.searchsorted(t, pdf["number"].iloc[0] * width + gap)) + 1, len(t))
        out = t[end[:entries]] + gap
        keep = np.append(out[1:] != out[:-1], True)
        return pdf[[*keys, "number"]].iloc[:1].merge(pd.DataFrame({"up_to": t[:entries][keep], "out": out[keep]}), how="cross")

    functions = stored(times.groupBy(*keys, "number").applyInPandas(report, f"{shape}, up_to long, out long"), "slices")
    low, high = functions.agg(F.min("number"), F.max("number")).first()
    if low is None:
        return times.select(*keys, F.timestamp_micros("t").alias("ts"))
    levels, size = [functions], 1
    while low // (size * _FAN) != high // (size * _FAN):
        levels.append(stored(_blocks_of(levels[-1], size, width, gap), "blocks"))
        size *= _FAN
    top = levels[-1].select(*keys, F.floor(F.col("number") / _FAN).cast("long").alias("block")).distinct()
    entered = top.withColumn("earliest", F.lit(_ANY_TIME))
    for level in reversed(levels):
        entered = stored(_entries_of(level, entered), "entries").withColumnRenamed("number", "block")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        at = int(np.searchsorted(t, pdf["earliest"].iloc[0]))
        sent = []
        while at < len(t):
            sent.append(int(t[at]))
            at = int(np.searchsorted(t, t[at] + gap))
        return pd.DataFrame(
            {"stage": pdf["stage"].iloc[0], "error_type": pdf["error_type"].iloc[0], "t": sent}
        )

    entered = entered.withColumnRenamed("block", "number")
    alerts = times.join(entered, [*keys, "number"]).groupBy(*keys, "number").applyInPandas(
        replay, "stage string, error_type string, t long"
    )
    return alerts.select(*keys, F.timestamp_micros("t").alias("ts"))


def _blocks_of(level: DataFrame, size: int, width: int, gap: int) -> DataFrame:
    """The functions of the next level: those of up to ``_FAN`` neighbours composed in order.

    A number of ``level`` stands for ``size`` slices.
    """
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        listed = _functions(pdf)
        reach, whole = listed[0][0] * size * width + gap, listed[0][1]
        for _, function in listed[1:]:
            whole = _compose(whole, function, reach)
        head = pdf[["stage", "error_type", "block"]].iloc[:1].rename(columns={"block": "number"})
        return head.merge(pd.DataFrame({"up_to": whole[0], "out": whole[1]}), how="cross")

    blocks = level.withColumn("block", F.floor(F.col("number") / _FAN).cast("long"))
    return blocks.groupBy("stage", "error_type", "block").applyInPandas(
        compose, "stage string, error_type string, number long, up_to long, out long"
    )


def _entries_of(level: DataFrame, entered: DataFrame) -> DataFrame:
    """(stage, error_type, number, earliest) of the functions of a level, from those of the blocks (``block``) they are in."""
    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        earliest, rows = int(pdf["earliest"].iloc[0]), []
        for number, (up_to, out) in _functions(pdf):
            rows.append((number, earliest))
            at = int(np.searchsorted(up_to, earliest))
            earliest = int(out[at]) if at < len(up_to) else earliest
        return pdf[["stage", "error_type"]].iloc[:1].merge(pd.DataFrame(rows, columns=["number", "earliest"]), how="cross")

    blocks = level.withColumn("block", F.floor(F.col("number") / _FAN).cast("long"))
    return blocks.join(entered, ["stage", "error_type", "block"]).groupBy("stage", "error_type", "block").applyInPandas(
        hand_down, "stage string, error_type string, number long, earliest long"
    )


def lifecycle(events: DataFrame) -> DataFrame:
    """One row per request: whether it started, how it ended, its error types and its duration.

    ``events``: request_id, event (check_started, check_completed, check_failed, app_error),
    error_type, ts.
    """
    start = F.min(F.when(F.col("event") == "check_started", F.col("ts")))
    terminal = F.col("event").isin("check_completed", "check_failed")
    end = F.min(F.when(terminal, F.col("ts")))
    outcome = F.min_by(F.when(terminal, F.col("event")), F.when(terminal, F.col("ts")))
    return events.groupBy("request_id").agg(
        F.bool_or(F.col("event") == "check_started").alias("has_start"),
        outcome.alias("outcome"),
        F.sort_array(
            F.collect_set(F.when(F.col("event") == "app_error", F.col("error_type")))
        ).alias("error_types"),
        ((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long").alias("duration_ms"),
    )


def user_sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_key, session_start, session_end, events): runs of a user's events without a longer gap.

    Events are first combined per user and minute, which can never split a session, so the window
    behind it sees minutes instead of events.
    """
    from pyspark.sql import Window as W

    minutes = events.groupBy("user_key", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")
    )
    by_user = W.partitionBy("user_key").orderBy("minute")
    gap = F.unix_micros("first") - F.unix_micros(F.lag("last").over(by_user))
    opens = F.when(gap.isNull() | (gap > gap_minutes * 60_000_000), 1).otherwise(0)
    numbered = minutes.withColumn("opens", opens).withColumn(
        "session", F.sum("opens").over(by_user.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    return numbered.groupBy("user_key", "session").agg(
        F.min("first").alias("session_start"),
        F.max("last").alias("session_end"),
        F.sum("n").alias("events"),
    ).drop("session")


def traffic_windows(events: DataFrame) -> DataFrame:
    """(day, checks, completed) per UTC day."""
    return (
        events.groupBy(F.window("ts", "1 day").alias("w"))
        .agg(
            F.count("*").alias("checks"),
            F.count_if(F.col("status").isin(*V.COMPLETED_STATUSES)).alias("completed"),
        )
        .select(F.to_date("w.start").alias("day"), "checks", "completed")
    )
