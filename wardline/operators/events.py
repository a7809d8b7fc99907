"""Event-table operations: upserts, gates, quotas, contracts, erasure, retention, posts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from wardline import fixed_values as V
from wardline.functions.keys import deletion_audit_key
from wardline.functions.text import any_of, casefold, strip
from wardline.operators.common import StoredLookup, first_failure, salted_join, split_by_reason, split_valid
from wardline.operators.drafts import billable


def _latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The row with the greatest ``order`` per key, by an aggregate that combines map-side."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )


def upsert_consent(current: DataFrame, updates: DataFrame) -> DataFrame:
    """One row per user, the latest wins; an update beats a stored row of the same instant."""
    both = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    order = F.struct("ts", "_new", "notice_version", "language")
    return _latest(both, "user_key", order).drop("_new")


def current_consent(consent: DataFrame, notice_version: str) -> DataFrame:
    """(user_key, _ok): users whose stored version is the given one; for ``store_lookup``, when the gate runs often."""
    return consent.filter(F.col("notice_version") == notice_version).select("user_key").distinct().withColumn("_ok", F.lit(True))


def consent_gate(messages: DataFrame, consent: DataFrame | StoredLookup, notice_version: str) -> dict[str, DataFrame]:
    """Messages of users whose consent is current, and those that need consent first.

    ``consent`` may be :func:`current_consent` of that version, stored by user_key.
    """
    current = consent if isinstance(consent, StoredLookup) else current_consent(consent, notice_version)
    judged = salted_join(messages, current, ["user_key"], "left", F.xxhash64(*messages.columns))
    return {
        "pass": judged.filter(F.col("_ok").isNotNull()).drop("_ok"),
        "needs_consent": judged.filter(F.col("_ok").isNull()).drop("_ok"),
    }


def upsert_feedback(current: DataFrame, taps: DataFrame) -> DataFrame:
    """Per check: last usefulness, last non-null next action, last ts. Unknown values are ignored."""
    sound = F.col("usefulness").isin(*V.USEFULNESS_VALUES) & (
        F.col("next_action").isNull() | F.col("next_action").isin(*V.NEXT_ACTION_VALUES)
    )
    columns = ["check_id", "usefulness", "next_action", "ts"]
    both = current.select(*columns).unionByName(taps.select(*columns).filter(sound))
    answered = F.when(F.col("next_action").isNotNull(), F.struct("ts", "next_action"))
    return both.groupBy("check_id").agg(
        F.max_by("usefulness", F.struct("ts", "usefulness")).alias("usefulness"),
        F.max(answered).getField("next_action").alias("next_action"),
        F.max("ts").alias("ts"),
    )


def authorize_feedback(taps: DataFrame, events: DataFrame) -> DataFrame:
    """Taps that count: a completed check of the same user, and a next-action tap only after a
    usefulness tap on that check. ``taps``: tap_id, check_id, user_key, kind, value, ts."""
    owned = events.filter(F.col("status").isin(*V.COMPLETED_STATUSES)).select(
        F.col("id").alias("check_id"), "user_key"
    )
    allowed = salted_join(taps, owned, ["check_id", "user_key"], "inner", F.col("tap_id"))
    first_usefulness = (
        allowed.filter(F.col("kind") == "usefulness")
        .groupBy("check_id")
        .agg(F.min("ts").alias("_rated_at"))
    )
    judged = salted_join(allowed, first_usefulness, ["check_id"], "left", F.col("tap_id"))
    return judged.filter(
        (F.col("kind") == "usefulness") | (F.col("_rated_at") < F.col("ts"))
    ).drop("_rated_at")


def usage_counters(events: DataFrame, scope: str = "user") -> DataFrame:
    """(user_key, scope, day, count): net slots used, which is the number of billable checks."""
    return (
        events.groupBy("user_key", F.to_date("ts").alias("day"))
        .agg(F.count_if(billable(F.col("status"))).alias("count"))
        .select("user_key", F.lit(scope).alias("scope"), "day", "count")
    )


def admit(events: DataFrame, limit: int = V.DAILY_LIMIT) -> DataFrame:
    """Adds ``admitted``: fewer than ``limit`` billable checks came before it on that user's day.

    Only the first ``limit`` billable checks of a user and day matter, and Spark trims each day to
    those before it shuffles. The one cut-off row per user and day then meets the events in a
    salted join, so a user with a third of all events is not one task.
    """
    if limit <= 0:
        return events.withColumn("admitted", F.lit(False))
    day = F.to_date("ts")
    order = W.partitionBy("user_key", "_day").orderBy("ts", "id")
    cut = (
        events.filter(billable(F.col("status")))
        .select("user_key", day.alias("_day"), "ts", "id")
        .withColumn("_nth", F.row_number().over(order))
        .filter(F.col("_nth") <= limit)
        .filter(F.col("_nth") == limit)
        .select("user_key", "_day", F.struct("ts", "id").alias("_last"))
    )
    judged = salted_join(
        events.withColumn("_day", day), cut, ["user_key", "_day"], "left", F.col("id")
    )
    inside = F.col("_last").isNull() | (F.struct("ts", "id") <= F.col("_last"))
    return judged.withColumn("admitted", inside).drop("_day", "_last")


def event_checks() -> dict[str, Column]:
    """Reason -> condition each event row has to meet, in the order they count."""

    def one_of(column: str, values: tuple[str, ...], optional: bool = False) -> Column:
        test = F.col(column).isin(*values)
        return F.col(column).isNull() | test if optional else test

    def shaped(column: str, shape: str) -> Column:
        return F.col(column).isNull() | F.col(column).rlike(shape)

    def all_ids(column: str) -> Column:
        return F.col(column).isNull() | F.forall(column, lambda i: i.rlike(V.ID_SHAPE))

    return {
        "input_type": one_of("input_type", V.INPUT_TYPES),
        "language": one_of("language", V.REPLY_LANGUAGES),
        "status": one_of("status", V.STATUSES),
        "rule_ids": all_ids("rule_ids"),
        "knowledge_card_ids": all_ids("knowledge_card_ids"),
        "reviewed_case_ids": all_ids("reviewed_case_ids"),
        "retrieval_mode": one_of("retrieval_mode", V.RETRIEVAL_MODES, optional=True),
        "retrieval_status": one_of("retrieval_status", V.RETRIEVAL_STATUSES, optional=True),
        "router_status": one_of("router_status", V.ROUTER_STATUSES, optional=True),
        "kb_version": shaped("kb_version", V.VERSION_SHAPE),
        "error_class": shaped("error_class", V.ERROR_CLASS_SHAPE),
    }


def validate_events(events: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Event rows that keep the write contract, and the others with the first broken field; one pass with a ``path``."""
    return split_valid(events, event_checks(), path)


def _like(pattern: str):
    return lambda v: v.rlike(pattern)


def _not_like(pattern: str):
    return lambda v: ~v.rlike(pattern)


def leak_scan(df: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(column, kind, values): how many values per string column look like submitted content.

    Columns with a strict shape are checked against it instead (kind ``shape``). One pass.
    """
    counts = {}
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind not in ("string", "array<string>") or field.name in exempt:
            continue
        values = F.col(field.name) if kind != "string" else F.array(field.name)
        values = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())
        shape = V.STRICT_SHAPES.get(field.name)
        for name, pattern in ({"shape": shape} if shape else V.LEAK_PATTERNS).items():
            bad = F.filter(values, _not_like(pattern) if shape else _like(pattern))
            counts[(field.name, name)] = F.sum(F.size(bad))
    if not counts:
        return df.sparkSession.createDataFrame([], "column string, kind string, `values` bigint")
    keys = list(counts)
    one = df.agg(*[counts[k].alias(f"c{i}") for i, k in enumerate(keys)])
    rows = F.array(
        *[
            F.struct(
                F.lit(column).alias("column"),
                F.lit(kind).alias("kind"),
                F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("values"),
            )
            for i, (column, kind) in enumerate(keys)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def erase_users(tables: dict[str, DataFrame], keys: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Tables without the rows of the erased users, and the audit rows added to deletion_log.

    ``tables``: check_event, feedback, consent, rate_limit, story_submission, deletion_log.
    """
    gone = keys.select("user_key").distinct()
    marked = gone.withColumn("_gone", F.lit(True))

    def keep(df: DataFrame) -> DataFrame:
        spread = F.xxhash64(*[c for c in df.columns if c != "user_key"])
        return salted_join(df, marked, ["user_key"], "left", spread).filter(
            F.col("_gone").isNull()
        ).drop("_gone")

    erased_checks = salted_join(
        tables["check_event"].select("id", "user_key"), marked, ["user_key"], "inner", F.col("id")
    ).select(F.col("id").alias("check_id"))
    audit = gone.select(
        F.md5(F.concat_ws("|", deletion_audit_key(F.col("user_key")), now.cast("string"))).alias("id"),
        deletion_audit_key(F.col("user_key")).alias("user_key"),
        now.alias("requested_ts"),
        now.alias("completed_ts"),
    )
    kept = {n: keep(tables[n]) for n in ("check_event", "consent", "rate_limit", "story_submission")}
    kept["feedback"] = tables["feedback"].join(erased_checks, "check_id", "left_anti")
    kept["deletion_log"] = tables["deletion_log"].unionByName(audit)
    return kept


@dataclass(frozen=True)
class RetentionPolicy:
    """How long each table keeps its rows."""

    check_event_days: int = 90
    feedback_days: int = 90
    consent_days: int = 365
    rate_limit_hours: int = 48
    deletion_log_days: int = 365
    story_rejected_days: int = 30


def expiry(now: Column, policy: RetentionPolicy = RetentionPolicy()) -> dict[str, Column]:
    """Table -> condition under which a row is past its time (feedback of expired checks aside)."""

    def before(column: str, days: int) -> Column:
        return F.col(column) < now - F.make_dt_interval(F.lit(days))

    last_day = F.to_date(now - F.make_dt_interval(hours=F.lit(policy.rate_limit_hours)))
    log, story = policy.deletion_log_days, policy.story_rejected_days
    return {
        "check_event": before("ts", policy.check_event_days),
        "feedback": before("ts", policy.feedback_days),
        "consent": before("ts", policy.consent_days),
        "rate_limit": F.col("day") < last_day,
        "deletion_log": before("completed_ts", log)
        | (F.col("completed_ts").isNull() & before("requested_ts", log)),
        "story_submission": (F.col("status") == "rejected")
        & (
            before("reviewed_ts", story)
            | (F.col("reviewed_ts").isNull() & before("created_ts", story))
        ),
    }


def apply_retention(
    tables: dict[str, DataFrame], now: Column, policy: RetentionPolicy = RetentionPolicy()
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Kept rows per table, and (table, removed) counts. Feedback goes with its expired check."""
    rules = expiry(now, policy)
    marked = {}
    for name, df in tables.items():
        gone = F.coalesce(rules[name], F.lit(False))
        if name == "feedback":
            old = (
                tables["check_event"]
                .filter(rules["check_event"])
                .select(F.col("id").alias("check_id"))
                .withColumn("_orphan", F.lit(True))
            )
            df = df.join(old, "check_id", "left")
            gone = gone | F.col("_orphan").isNotNull()
        marked[name] = df.withColumn("_expired", gone).drop("_orphan")
    kept = {n: df.filter(~F.col("_expired")).drop("_expired") for n, df in marked.items()}
    removed = None
    for name, df in marked.items():
        counted = df.agg(F.count_if("_expired").alias("removed")).select(
            F.lit(name).alias("table"), "removed"
        )
        removed = counted if removed is None else removed.unionByName(counted)
    return kept, removed


def collapse_consent(old: DataFrame, discriminator: str = "discriminator") -> DataFrame:
    """The newest (ts, discriminator) row per user, without the discriminator."""
    return _latest(old, "user_key", F.struct("ts", discriminator)).drop(discriminator)


def collapse_counters(old: DataFrame, discriminator: str = "discriminator") -> DataFrame:
    """Scope from the discriminator's prefix; the smallest discriminator per (user, day, scope)."""
    scope = F.when(F.startswith(discriminator, F.lit("web_ip:")), "web_ip").otherwise("user")
    return (
        old.withColumn("scope", scope)
        .groupBy("user_key", "scope", "day")
        .agg(F.min_by("count", discriminator).alias("count"))
    )


def backfill_next_action(feedback: DataFrame) -> DataFrame:
    return feedback.fillna({"next_action": "not_sure"})


def reading_minutes(article: Column) -> Column:
    words = F.size(F.filter(F.split(article, V.WHITESPACE), lambda w: w != ""))
    return F.greatest(F.lit(1), F.bround(words / F.lit(V.WORDS_PER_MINUTE), 0).cast("int"))


def published_posts(posts: DataFrame, language: str, limit: int | None = None) -> DataFrame:
    """Published posts, newest first, in one language with a reading-time hint."""
    code = language if language in V.REPLY_LANGUAGES else "ru"
    shown = posts.filter((F.col("state") == "published") & F.col("published_ts").isNotNull())
    ordered = shown.orderBy(F.col("published_ts").desc(), "id")
    if limit is not None:
        ordered = ordered.limit(limit)
    return ordered.select(
        "id", "slug", "category",
        F.col(f"title_{code}").alias("title"),
        F.col(f"summary_{code}").alias("summary"),
        F.col(f"article_{code}").alias("article"),
        "published_ts",
        reading_minutes(F.col(f"article_{code}")).alias("reading_minutes"),
    )


def validate_posts(posts: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Posts that keep the editorial contract (trimmed), and the others with the reason; one pass with a ``path``."""
    fields = [f"{part}_{lang}" for lang in V.REPLY_LANGUAGES for part in ("title", "summary", "article")]
    cleaned = posts.withColumn("slug", casefold(strip(F.col("slug"))))
    for name in (*fields, "category", "state"):
        cleaned = cleaned.withColumn(name, strip(F.col(name)))

    def sized(part: str, most: int) -> Column:
        tests = [F.length(f"{part}_{lang}").between(1, most) for lang in V.REPLY_LANGUAGES]
        return tests[0] & tests[1]

    return split_valid(
        cleaned,
        {
            "invalid_slug": F.length("slug").between(1, V.POST_SLUG_MAX)
            & F.col("slug").rlike(V.SLUG_SHAPE),
            "invalid_category": F.col("category").isin(*V.POST_CATEGORIES),
            "invalid_state": F.col("state").isin(*V.POST_STATES),
            "invalid_title": sized("title", V.POST_TITLE_MAX),
            "invalid_summary": sized("summary", V.POST_SUMMARY_MAX),
            "invalid_article": sized("article", V.POST_ARTICLE_MAX),
        },
        path,
    )


def log_event_reason() -> Column:
    """Why a log event breaks its contract, or null. Needs ``name``, ``stage`` and ``fields`` (JSON).

    A row with a stage is an error record, any other row a product event.
    """
    fields = F.from_json("fields", "map<string,string>")
    keys = F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))
    is_error = F.col("stage").isNotNull()
    allowed = F.when(is_error, F.array(*[F.lit(f) for f in V.ERROR_FIELDS])).otherwise(
        F.array(*[F.lit(f) for f in V.EVENT_FIELDS])
    )

    def content_like(key: Column) -> Column:
        return ~key.isin(*V.CONTENT_LIKE_EXEMPT) & any_of(
            [F.lower(key).contains(t) for t in V.CONTENT_LIKE_TOKENS]
        )

    values = F.coalesce(F.map_entries(fields), F.array().cast("array<struct<key:string,value:string>>"))

    def leaks(entry: Column) -> Column:
        strict = F.lit(None).cast("boolean")
        for name, shape in V.STRICT_SHAPES.items():
            strict = F.when(entry.key == name, entry.value.rlike(shape)).otherwise(strict)
        content = any_of([entry.value.rlike(p) for p in V.LEAK_PATTERNS.values()])
        return F.when(strict.isNotNull(), ~strict).otherwise(content)

    return first_failure(
        {
            "unknown_event": is_error | F.col("name").isin(*V.EVENT_NAMES),
            "unknown_stage": ~is_error | F.col("stage").isin(*V.ERROR_STAGES),
            "unknown_field": F.size(F.array_except(keys, allowed)) == 0,
            "content_like_field": ~F.exists(keys, content_like),
            "content_like_value": ~F.exists(values, lambda e: F.coalesce(leaks(e), F.lit(False))),
        }
    )


def validate_log_events(events: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Log events that hold metadata only, and the others with the reason; one pass with a ``path``."""
    return split_by_reason(events, log_event_reason(), path)
