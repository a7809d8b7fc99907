"""Sinks: event rows by day, metrics as key and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.operators.common import first_failure, routed
from wardline.operators.events import event_checks

METRIC_KEYS = (
    "checks_total", "checks_completed", "completion_rate", "activated_users", "activation_rate",
    "cost_total_usd", "cost_avg_success_usd", "no_signal_rate", "safety_blocked",
    "knowledge_coverage_rate", "knowledge_unavailable_rate", "kb_version", "kb_approved_cards",
)


def write_events(events: DataFrame, path: str, mode: str = "append", parts_per_day: int = 8) -> DataFrame:
    """Writes events under ``verdict=`` and ``day=`` folders in one pass and returns those that break the contract.

    ``read_events`` reads the valid ones. Rows are spread by day and a hash of the id, so a busy day is several tasks and
    files.
    """
    dated = events.withColumn("day", F.to_date("ts"))
    part = F.pmod(F.xxhash64("id"), F.lit(parts_per_day))
    return routed(dated, first_failure(event_checks()), path, folders=("day",), mode=mode, spread=(part,))["quarantine"].drop("day")


def metrics_long(summary: DataFrame) -> DataFrame:
    """(key, value) rows of the exported metrics."""
    texts = summary.select(*[F.col(k).cast("string").alias(k) for k in METRIC_KEYS])
    filled = texts.withColumn("kb_version", F.coalesce("kb_version", F.lit("unavailable")))
    return filled.unpivot([], list(METRIC_KEYS), "key", "value")
