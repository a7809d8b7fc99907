"""Feedback labels per rule against the overall baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline import fixed_values as V
from wardline.operators.common import in_window, rate


def labelled_checks(events: DataFrame, feedback: DataFrame, since: str | None = None) -> DataFrame:
    """(check_id, rule_ids, usefulness, next_action) of every answered check."""
    answers = feedback if since is None else feedback.filter(in_window(F.col("ts"), since))
    return answers.select("check_id", "usefulness", "next_action").join(
        events.select(F.col("id").alias("check_id"), "rule_ids"), "check_id"
    )


def _useful() -> Column:
    return F.count_if(F.col("usefulness").isin(*V.USEFUL_VALUES))


def overall_usefulness(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count("*").alias("labeled_checks"), _useful().alias("useful_checks")
    ).withColumn("overall_useful_rate", rate(F.col("useful_checks"), F.col("labeled_checks")))


def _per_rule(labelled: DataFrame) -> DataFrame:
    ids = F.array_distinct(F.coalesce("rule_ids", F.array().cast("array<string>")))
    return labelled.select(F.explode(ids).alias("rule_id"), "usefulness", "next_action")


def rule_usefulness(
    events: DataFrame, feedback: DataFrame, rules: DataFrame, since: str | None = None
) -> DataFrame:
    """Per rule: responses, useful ones, rate, gap to the baseline and whether to review it."""
    labelled = labelled_checks(events, feedback, since)
    families = rules.groupBy("rule_id").agg(F.first("family").alias("family"))
    baseline = overall_usefulness(labelled).select("overall_useful_rate").scalar()
    counted = (
        _per_rule(labelled)
        .groupBy("rule_id")
        .agg(F.count("*").alias("responses"), _useful().alias("useful"))
        .withColumn("useful_rate", rate(F.col("useful"), F.col("responses")))
        .withColumn("gap_from_baseline", F.round(baseline - F.col("useful_rate"), 4))
    )
    candidate = (F.col("responses") >= V.CANDIDATE_MIN_SAMPLES) & (
        F.col("gap_from_baseline") >= V.CANDIDATE_GAP
    )
    return (
        counted.withColumn("candidate", candidate)
        .join(families, "rule_id", "left")
        .withColumn("family", F.coalesce("family", F.lit("unmapped")))
    )


def next_action_counts(labelled: DataFrame) -> DataFrame:
    """(next_action, count) over all answered checks."""
    return (
        labelled.filter(F.col("next_action").isNotNull())
        .groupBy("next_action")
        .agg(F.count("*").alias("count"))
    )


def rule_next_actions(events: DataFrame, feedback: DataFrame, since: str | None = None) -> DataFrame:
    """(rule_id, next_action, count)."""
    return (
        _per_rule(labelled_checks(events, feedback, since))
        .filter(F.col("next_action").isNotNull())
        .groupBy("rule_id", "next_action")
        .agg(F.count("*").alias("count"))
    )


def rule_action_maps(events: DataFrame, feedback: DataFrame, since: str | None = None) -> DataFrame:
    """(rule_id, next_actions): the counts of a rule as a map."""
    return rule_next_actions(events, feedback, since).groupBy("rule_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("next_action", "count")))
        ).alias("next_actions")
    )


def action_deltas(events: DataFrame, feedback: DataFrame, since: str | None = None) -> DataFrame:
    """Rule rate minus overall rate for each rule and each action ever taken.

    There are only a few actions, so the overall counts travel as one map value and every rule
    looks them up; combinations that never happened count as zero.
    """
    labelled = labelled_checks(events, feedback, since)
    overall = next_action_counts(labelled).agg(
        F.map_from_entries(F.collect_list(F.struct("next_action", "count"))).alias("m")
    )
    # Rules without any next action still get their rows, with zero counts.
    rated = _per_rule(labelled).groupBy("rule_id", "next_action").agg(F.count("*").alias("n"))
    taken = F.filter(
        F.collect_list(F.struct(F.col("next_action").alias("k"), F.col("n").alias("v"))),
        lambda e: e.k.isNotNull(),
    )
    per_rule = (
        rated.groupBy("rule_id")
        .agg(F.map_from_entries(taken).alias("own"))
        .withColumn("everyone", overall.scalar())
    )

    def total(name: str) -> Column:
        return F.aggregate(F.map_values(name), F.lit(0).cast("long"), lambda acc, v: acc + v)

    rows = (
        per_rule.withColumn("own_total", total("own"))
        .withColumn("overall_total", total("everyone"))
        .select("*", F.explode("everyone").alias("next_action", "overall_count"))
        .withColumn("count", F.coalesce(F.try_element_at("own", F.col("next_action")), F.lit(0)))
        .withColumn("rule_rate", rate(F.col("count"), F.col("own_total")))
        .withColumn("overall_rate", rate(F.col("overall_count"), F.col("overall_total")))
    )
    return rows.select(
        "rule_id", "next_action", "count", "rule_rate", "overall_count", "overall_rate",
        F.round(F.col("rule_rate") - F.col("overall_rate"), 4).alias("delta"),
    )
