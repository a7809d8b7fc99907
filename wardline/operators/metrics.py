"""Operational metrics over event, consent and feedback tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline import fixed_values as V
from wardline.operators.common import in_window, rate

_MONEY = "decimal(28,6)"


def _completed() -> Column:
    return F.col("status").isin(*V.COMPLETED_STATUSES)


def _windowed(df: DataFrame, since: str | None, until: str | None) -> DataFrame:
    return df if since is None and until is None else df.filter(in_window(F.col("ts"), since, until))


def _total_columns() -> dict[str, Column]:
    total, done = F.count("*"), F.count_if(_completed())
    return {
        "checks_total": total,
        "checks_completed": done,
        "checks_failed": F.greatest(F.lit(0).cast("long"), total - done),
        "completion_rate": rate(done, total),
    }


def _cost_columns() -> dict[str, Column]:
    zero = F.lit(0).cast(_MONEY)
    spent = F.coalesce(F.sum("cost_usd").cast(_MONEY), zero)
    good = F.coalesce(F.sum(F.when(_completed(), F.col("cost_usd"))).cast(_MONEY), zero)
    done = F.count_if(_completed())
    average = F.when(done > 0, F.round(good / done.cast("decimal(20,0)"), 6)).otherwise(zero)
    return {"cost_total_usd": spent, "cost_avg_success_usd": average.cast(_MONEY)}


def _latency_columns() -> dict[str, Column]:
    return {"latency_avg_ms": F.round(F.avg("latency_ms"), 2)}


def _no_signal_columns() -> dict[str, Column]:
    quiet = F.count_if("no_signal")
    return {"no_signal_count": quiet, "no_signal_rate": rate(quiet, F.count_if(_completed()))}


def _safety_columns() -> dict[str, Column]:
    return {"safety_blocked": F.count_if("safety_blocked")}


def _knowledge_columns() -> dict[str, Column]:
    retrieved = F.col("retrieval_status").isNotNull()
    checks = F.count_if(retrieved)
    selected = F.count_if(retrieved & (F.size(F.coalesce("knowledge_card_ids", F.array())) > 0))
    out = F.count_if(F.col("retrieval_status") == "unavailable")
    return {
        "knowledge_checks": checks,
        "knowledge_selected": selected,
        "knowledge_unavailable": out,
        "knowledge_coverage_rate": rate(selected, checks),
        "knowledge_unavailable_rate": rate(out, checks),
    }


def _one_pass(df: DataFrame, *groups: dict[str, Column]) -> DataFrame:
    return df.agg(*[c.alias(name) for group in groups for name, c in group.items()])


def check_totals(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return _one_pass(_windowed(events, since, until), _total_columns())


def cost_summary(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return _one_pass(_windowed(events, since, until), _cost_columns())


def latency_summary(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return _one_pass(_windowed(events, since, until), _latency_columns())


def no_signal_rate(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return _one_pass(_windowed(events, since, until), _no_signal_columns())


def safety_blocked(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return _one_pass(_windowed(events, since, until), _safety_columns())


def knowledge_coverage(
    events: DataFrame, since: str | None = None, until: str | None = None
) -> DataFrame:
    return _one_pass(_windowed(events, since, until), _knowledge_columns())


def activation(
    events: DataFrame, consent: DataFrame, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Distinct consenting users, distinct users with a completed check, and their ratio."""
    consented = _windowed(consent, since, until).agg(F.countDistinct("user_key").alias("n"))
    return (
        _windowed(events, since, until)
        .agg(F.countDistinct(F.when(_completed(), F.col("user_key"))).alias("activated_users"))
        .withColumn("consented_users", consented.scalar())
        .withColumn("activation_rate", rate(F.col("activated_users"), F.col("consented_users")))
        .select("consented_users", "activated_users", "activation_rate")
    )


def breakdown(
    events: DataFrame, columns: list[str], since: str | None = None, until: str | None = None
) -> DataFrame:
    """(dimension, value, checks) for several columns of one type, in one pass by grouping sets."""
    shown = _windowed(events, since, until)
    counted = shown.groupingSets([[F.col(c)] for c in columns], *columns).agg(
        F.count("*").alias("checks"), *[F.grouping(c).alias(f"_without_{c}") for c in columns]
    )
    own = {c: F.col(f"_without_{c}") == 0 for c in columns}
    return counted.select(
        F.coalesce(*[F.when(mine, F.lit(c)) for c, mine in own.items()]).alias("dimension"),
        F.coalesce(*[F.when(mine, F.col(c)) for c, mine in own.items()]).alias("value"),
        "checks",
    )


def feedback_breakdown(
    feedback: DataFrame,
    events: DataFrame,
    column: str,
    since: str | None = None,
    until: str | None = None,
    exclude_null: bool = False,
) -> DataFrame:
    """(value, responses) over feedback of known checks, windowed on the feedback's time."""
    rows = _windowed(feedback, since, until)
    if exclude_null:
        rows = rows.filter(F.col(column).isNotNull())
    known = events.select(F.col("id").alias("check_id"))
    return (
        rows.join(known, "check_id", "left_semi")
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("responses"))
    )


def kb_inventory(cards: DataFrame, version: str | Column) -> DataFrame:
    code = version if isinstance(version, Column) else F.lit(version)
    return cards.agg(
        F.count_if(F.col("status") == "approved").alias("approved_cards")
    ).select(code.alias("version"), "approved_cards")


def _by(name: str, entries: str = "groups") -> Column:
    """(value -> rows) of one field over a short array of combined groups."""
    values = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e[name])))

    def total(value: Column) -> Column:
        same = F.filter(entries, lambda e: e[name].eqNullSafe(value))
        return F.aggregate(same, F.lit(0).cast("long"), lambda acc, e: acc + e.n)

    return F.map_from_entries(
        F.transform(values, lambda v: F.struct(F.coalesce(v, F.lit("None")), total(v)))
    )


def _combined(df: DataFrame, *keys: str) -> DataFrame:
    """One row with the rows of a table counted per combination of a few categorical columns."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.agg(F.collect_list(F.struct(*keys, "n")).alias("groups"))


def collect_metrics(
    events: DataFrame,
    consent: DataFrame,
    feedback: DataFrame,
    cards: DataFrame,
    version: str,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """The whole summary as one row.

    Events are first combined per status and language with everything that adds up, so the figures
    and both breakdowns come from one scan; distinct users take a second, narrow one. Feedback is
    joined to events once for both of its breakdowns.
    """
    shown = _windowed(events, since, until)
    retrieved = F.col("retrieval_status").isNotNull()
    chosen = retrieved & (F.size(F.coalesce("knowledge_card_ids", F.array())) > 0)
    groups = shown.groupBy("status", "language").agg(
        F.count("*").alias("n"),
        F.sum("cost_usd").cast(_MONEY).alias("cost"),
        F.sum(F.col("latency_ms").cast("bigint")).alias("latency"),
        F.count("latency_ms").alias("timed"),
        F.count_if("no_signal").alias("quiet"),
        F.count_if("safety_blocked").alias("blocked"),
        F.count_if(retrieved).alias("retrieved"),
        F.count_if(chosen).alias("chosen"),
        F.count_if(F.col("retrieval_status") == "unavailable").alias("out"),
    )

    def total(column: str, only_completed: bool = False) -> Column:
        value = F.when(_completed(), F.col(column)) if only_completed else F.col(column)
        return F.coalesce(F.sum(value), F.lit(0))

    money = {
        name: F.coalesce(F.sum(value).cast(_MONEY), F.lit(0).cast(_MONEY)).alias(name)
        for name, value in (
            ("cost_total_usd", F.col("cost")), ("_good", F.when(_completed(), F.col("cost")))
        )
    }
    summed = groups.agg(
        total("n").alias("checks_total"),
        total("n", only_completed=True).alias("checks_completed"),
        *money.values(),
        F.sum("latency").alias("_latency"),
        F.sum("timed").alias("_timed"),
        total("quiet").alias("no_signal_count"),
        total("blocked").alias("safety_blocked"),
        total("retrieved").alias("knowledge_checks"),
        total("chosen").alias("knowledge_selected"),
        total("out").alias("knowledge_unavailable"),
        F.collect_list(F.struct("status", "language", "n")).alias("groups"),
    )
    c = F.col
    average = F.round(c("_good") / c("checks_completed").cast("decimal(20,0)"), 6).cast(_MONEY)
    users = shown.agg(F.countDistinct(F.when(_completed(), F.col("user_key"))))
    consented = _windowed(consent, since, until).agg(F.countDistinct("user_key"))
    inventory = cards.agg(F.count_if(F.col("status") == "approved"))
    known = events.select(F.col("id").alias("check_id"))
    answers = _combined(
        _windowed(feedback, since, until).join(known, "check_id", "left_semi"),
        "usefulness", "next_action",
    )
    filled = (
        summed.withColumn("activated_users", users.scalar())
        .withColumn("consented_users", consented.scalar())
        .withColumn("answers", answers.scalar())
        .withColumn("acted", F.filter("answers", lambda a: a.next_action.isNotNull()))
    )
    return filled.select(
        "checks_total",
        "checks_completed",
        F.greatest(F.lit(0), c("checks_total") - c("checks_completed")).alias("checks_failed"),
        rate(c("checks_completed"), c("checks_total")).alias("completion_rate"),
        "consented_users",
        "activated_users",
        rate(c("activated_users"), c("consented_users")).alias("activation_rate"),
        "cost_total_usd",
        F.when(c("checks_completed") > 0, average).otherwise(F.lit(0).cast(_MONEY)).alias("cost_avg_success_usd"),
        F.when(c("_timed") > 0, F.round(c("_latency") / c("_timed"), 2)).alias("latency_avg_ms"),
        "no_signal_count",
        rate(c("no_signal_count"), c("checks_completed")).alias("no_signal_rate"),
        "safety_blocked",
        "knowledge_checks",
        "knowledge_selected",
        "knowledge_unavailable",
        rate(c("knowledge_selected"), c("knowledge_checks")).alias("knowledge_coverage_rate"),
        rate(c("knowledge_unavailable"), c("knowledge_checks")).alias("knowledge_unavailable_rate"),
        _by("status").alias("by_status"),
        _by("language").alias("by_language"),
        _by("usefulness", "answers").alias("usefulness"),
        _by("next_action", "acted").alias("next_action"),
        F.lit(version).alias("kb_version"),
        inventory.scalar().alias("kb_approved_cards"),
    )
