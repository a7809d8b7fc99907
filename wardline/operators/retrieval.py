"""Reviewed guidance cards: loading, ranking, router proposals, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline import fixed_values as V
from wardline.functions.text import bind, casefold, normalize_text, strip
from wardline.operators.common import INLINE_LIMIT, bounded_rows, constant, content_key, lookup_join, salted_join, split_valid, stored, with_once
from wardline.operators.matching import contained, match_literals

_STRINGS = "array<string>"
_CUES = "array<struct<card_id:string,score:bigint>>"


def load_cards(cards: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Approved cards of a sound card table, and the rows that break its contract; one pass with a ``path``."""
    copies = cards.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("copies"))
    checks = {
        "invalid_id": F.col("id").rlike(V.ID_SHAPE),
        "duplicate_id": F.col("copies") == 1,
        "invalid_version": F.col("version").rlike(V.VERSION_SHAPE),
        "invalid_status": F.col("status").isin(*V.CARD_STATUSES),
        "no_reviewer": strip(F.col("reviewer")) != "",
        "incomplete": (strip(F.col("mechanism")) != "")
        & (F.size("verify_steps") > 0)
        & (F.size("questions") > 0),
        "invalid_linked_id": F.forall(
            F.concat("trigger_rule_ids", "reviewed_case_ids"), lambda i: i.rlike(V.ID_SHAPE)
        ),
    }
    parts = split_valid(cards.join(copies, "id", "left"), checks, path, ("copies",))
    return {"approved": parts["valid"].filter(F.col("status") == "approved"), "quarantine": parts["quarantine"]}


def mandatory_cards(
    hits: DataFrame, signals: DataFrame, cards: DataFrame, id_col: str = "msg_id"
) -> DataFrame:
    """(id, card_id, by_rule): cards triggered by a rule id or by a signal kind."""
    by_rule = cards.select(F.col("id").alias("card_id"), F.explode("trigger_rule_ids").alias("rule_id"))
    by_kind = cards.select(F.col("id").alias("card_id"), F.explode("trigger_signal_kinds").alias("kind"))
    # A card may share its trigger with many others, a trigger may come from a third of all messages.
    ruled = lookup_join(hits.select(id_col, "rule_id").distinct(), by_rule, ["rule_id"], "inner", F.col(id_col))
    signalled = lookup_join(signals.select(id_col, "kind").distinct(), by_kind, ["kind"], "inner", F.col(id_col))
    both = ruled.select(id_col, "card_id", F.lit(True).alias("by_rule")).unionByName(
        signalled.select(id_col, "card_id", F.lit(False).alias("by_rule"))
    )
    return both.groupBy(id_col, "card_id").agg(F.bool_or("by_rule").alias("by_rule"))


def card_aliases(cards: DataFrame) -> DataFrame:
    """(card_id, alias): distinct normalised aliases of each card."""
    return (
        cards.select(F.col("id").alias("card_id"), F.explode(F.flatten(F.map_values("retrieval_aliases"))).alias("a"))
        .select("card_id", normalize_text(F.col("a")).alias("alias"))
        .filter(F.col("alias") != "")
        .distinct()
    )


def cue_scores(
    messages: DataFrame, aliases: DataFrame, id_col: str = "msg_id", inline_limit: int = INLINE_LIMIT
) -> DataFrame:
    """(id, card_id, score): number of aliases of a card found in the ``minimized`` text.

    One row for each message row and card, whether ids repeat or not; the limit decides the plan only.
    """
    texts = messages.select(id_col, normalize_text(F.col("minimized")).alias("normalized"))
    rows = bounded_rows(aliases, inline_limit)
    if rows is None:
        keyed = aliases.withColumn("lit_id", F.xxhash64("alias"))
        needles = keyed.select("lit_id", F.col("alias").alias("needle")).distinct()
        rows = texts.withColumn("_cue_key", content_key(F.col("normalized")))
        distinct = rows.select("_cue_key", "normalized").dropDuplicates(["_cue_key"])
        found = match_literals(distinct, "_cue_key", "normalized", needles, inline_limit)
        scores = (
            found.join(keyed.select("lit_id", "card_id"), "lit_id")
            .groupBy("_cue_key", "card_id")
            .agg(F.count("*").alias("score"))
        )
        return salted_join(rows, scores, ["_cue_key"], "inner", F.col(id_col)).select(id_col, "card_id", "score")
    scored = F.explode_outer(_cue_array(F.col("normalized"), rows)).alias("cue")
    return texts.select(id_col, scored).filter("cue is not null").select(id_col, "cue.*")


def _cue_array(normalized: Column, rows: list) -> Column:
    """(card_id, score) of the cards with an alias in the text, from one look at the posting index of all aliases."""
    if not rows:
        return F.array().cast(_CUES)
    cards: dict[str, set[str]] = {}
    for row in rows:
        cards.setdefault(row.alias, set()).add(row.card_id)
    table = constant([sorted(c) for c in cards.values()], "array<array<string>>")
    named = F.flatten(F.transform(contained(normalized, [(a, False) for a in cards]), lambda a: F.get(table, a)))

    def scored(named: Column) -> Column:
        score = lambda c: F.size(F.filter(named, lambda x: x == c)).cast("bigint")
        return F.transform(F.array_sort(F.array_distinct(named)), lambda c: F.struct(c.alias("card_id"), score(c).alias("score")))

    return bind(named, scored)


def rank_cards(
    mandatory: DataFrame, cues: DataFrame, id_col: str = "msg_id", k: int = V.MAX_CARDS
) -> DataFrame:
    """(id, card_ids, has_mandatory, rule_triggered): triggered cards first, then score, then id."""
    pooled = mandatory.select(
        id_col, "card_id", F.lit(1).alias("is_mandatory"), "by_rule", F.lit(0).cast("long").alias("score")
    ).unionByName(
        cues.select(
            id_col, "card_id", F.lit(0).alias("is_mandatory"), F.lit(False).alias("by_rule"), "score"
        )
    )
    # One entry per card, and cards are a reviewed list, so a message's list stays short.
    per_card = pooled.groupBy(id_col, "card_id").agg(
        F.max("is_mandatory").alias("is_mandatory"),
        F.bool_or("by_rule").alias("by_rule"),
        F.max("score").alias("score"),
    )
    order = F.struct((-F.col("is_mandatory")).alias("m"), (-F.col("score")).alias("s"), "card_id")
    return per_card.groupBy(id_col).agg(
        F.transform(
            F.slice(F.array_sort(F.collect_list(order)), 1, k), lambda c: c.card_id
        ).alias("card_ids"),
        (F.max("is_mandatory") == 1).alias("has_mandatory"),
        F.bool_or("by_rule").alias("rule_triggered"),
    )


def retrieval_mode(has_mandatory: Column, rule_triggered: Column, has_cue: Column) -> Column:
    return (
        F.when(has_mandatory & rule_triggered, "rule")
        .when(has_mandatory, "signal")
        .when(has_cue, "cue")
        .otherwise("none")
    )


def with_mode_status(messages: DataFrame, ranked: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Messages with card_ids, retrieval_mode and retrieval_status; unmatched ones are ``empty``."""
    joined = messages.join(ranked, id_col, "left")
    has_cards = F.col("card_ids").isNotNull()
    mode = retrieval_mode(
        F.coalesce("has_mandatory", F.lit(False)), F.coalesce("rule_triggered", F.lit(False)), has_cards
    )
    return (
        joined.withColumn("retrieval_mode", mode)
        .withColumn("retrieval_status", F.when(has_cards, "ok").otherwise("empty"))
        .withColumn("card_ids", F.coalesce("card_ids", F.array().cast(_STRINGS)))
        .drop("has_mandatory", "rule_triggered")
    )


def unavailable_retrieval(messages: DataFrame) -> DataFrame:
    """What every message gets when the card table could not be read."""
    return messages.select(
        "*",
        F.array().cast(_STRINGS).alias("card_ids"),
        F.lit("none").alias("retrieval_mode"),
        F.lit("unavailable").alias("retrieval_status"),
        F.lit("not_used").alias("router_status"),
    )


def retrieve(
    messages: DataFrame,
    cards: DataFrame,
    id_col: str = "msg_id",
    k: int = V.MAX_CARDS,
    inline_limit: int = INLINE_LIMIT,
) -> DataFrame:
    """Adds card_ids, retrieval_mode, retrieval_status and reviewed_case_ids.

    Needs ``hits``, ``signals`` and ``minimized``. A card table whose triggers and aliases number at most ``inline_limit``
    becomes one expression and the step shuffles nothing. Beyond, each distinct content (rule ids, signal kinds, text) is
    ranked once through joins and every row gets the cards of its content; rows and contents are stored first, as hits and
    signals may be dear and several joins read them. The limit decides the plan only.
    """
    aliases = card_aliases(cards)
    alias_rows = bounded_rows(aliases, inline_limit)
    card_rows = bounded_rows(
        cards.select("id", "trigger_rule_ids", "trigger_signal_kinds", "reviewed_case_ids"), inline_limit
    )
    if alias_rows is None or card_rows is None:
        rule_ids = F.array_distinct(F.transform("hits", lambda h: h.rule_id))
        kinds = F.array_distinct(F.transform("signals", lambda s: s.kind))
        keyed = stored(messages.withColumn("_content", content_key(rule_ids, kinds, F.col("minimized"))), "keyed")
        contents = keyed.select("_content", rule_ids.alias("rules"), kinds.alias("kinds"), "minimized").dropDuplicates(["_content"])
        contents = stored(contents, "contents")
        ranked = rank_cards(
            mandatory_cards(
                contents.select("_content", F.explode("rules").alias("rule_id")),
                contents.select("_content", F.explode("kinds").alias("kind")),
                cards,
                "_content",
            ),
            cue_scores(contents, aliases, "_content", inline_limit),
            "_content",
            k,
        )
        chosen = _with_cases(with_mode_status(contents.select("_content"), ranked, "_content"), cards, "_content")
        return salted_join(keyed, chosen, ["_content"], "left", F.col(id_col)).drop("_content")
    if not card_rows:
        empty = F.array().cast(_STRINGS)
        return (
            messages.withColumn("card_ids", empty)
            .withColumn("retrieval_mode", F.lit("none"))
            .withColumn("retrieval_status", F.lit("empty"))
            .withColumn("reviewed_case_ids", empty)
        )
    by_rule, by_kind, cases = {}, {}, {}
    for row in card_rows:
        cases[row.id] = list(row.reviewed_case_ids or [])
        for rule_id in row.trigger_rule_ids or []:
            by_rule.setdefault(rule_id, []).append(row.id)
        for kind in row.trigger_signal_kinds or []:
            by_kind.setdefault(kind, []).append(row.id)

    def lookup(keys: Column, table: dict[str, list[str]]) -> Column:
        """All values of the keys: work follows a message's few hits, not the number of cards."""
        if not table:
            return F.array().cast(_STRINGS)
        mapping = constant(table, "map<string,array<string>>")
        none = F.array().cast(_STRINGS)
        return F.flatten(
            F.transform(keys, lambda k: F.coalesce(F.try_element_at(mapping, k), none))
        )

    triggered = (
        messages.withColumn("_ruled", lookup(F.transform("hits", lambda h: h.rule_id), by_rule))
        .withColumn("_kinds", lookup(F.transform("signals", lambda s: s.kind), by_kind))
        .withColumn("_cue_text", normalize_text(F.col("minimized")))
    )
    # Once a row: a filter on the cards would otherwise look all aliases up again for every card of a message.
    triggered = with_once(triggered, "_cues", _cue_array(F.col("_cue_text"), alias_rows))
    forced = F.concat("_ruled", "_kinds")
    from_triggers = F.transform(
        forced, lambda c: F.struct(F.lit(0).alias("rank"), c.alias("id"), F.lit(0).cast("long").alias("score"))
    )
    from_cues = F.transform(
        "_cues", lambda c: F.struct(F.lit(1).alias("rank"), c.card_id.alias("id"), c.score.alias("score"))
    )
    pooled = with_once(triggered, "_pool", F.concat(from_triggers, from_cues))

    def entry(card: Column) -> Column:
        own = F.filter("_pool", lambda p: p.id == card)
        return F.struct(
            F.array_min(F.transform(own, lambda p: p.rank)).alias("rank"),
            (-F.array_max(F.transform(own, lambda p: p.score))).alias("neg"),
            card.alias("id"),
        )

    entries = F.transform(F.array_distinct(F.transform("_pool", lambda p: p.id)), entry)
    ranked = pooled.withColumn("_top", F.slice(F.array_sort(entries), 1, k))
    mode = retrieval_mode(F.size(forced) > 0, F.size("_ruled") > 0, F.size("_cues") > 0)
    return (
        ranked.withColumn("card_ids", F.transform("_top", lambda c: c.id))
        .withColumn("retrieval_mode", mode)
        .withColumn("retrieval_status", F.when(F.size("_pool") > 0, "ok").otherwise("empty"))
        .withColumn("reviewed_case_ids", F.array_distinct(lookup(F.col("card_ids"), cases)))
        .drop("_ruled", "_kinds", "_cue_text", "_cues", "_pool", "_top")
    )


def _with_cases(selected: DataFrame, cards: DataFrame, id_col: str) -> DataFrame:
    chosen = selected.select(id_col, F.posexplode("card_ids").alias("pos", "id"))
    cases = (
        lookup_join(chosen, cards.select("id", "reviewed_case_ids"), ["id"], "inner", F.col(id_col))
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "reviewed_case_ids"))).alias("all"))
        .select(
            id_col,
            F.array_distinct(F.flatten(F.transform("all", lambda c: c.reviewed_case_ids))).alias(
                "reviewed_case_ids"
            ),
        )
    )
    return selected.join(cases, id_col, "left").withColumn(
        "reviewed_case_ids", F.coalesce("reviewed_case_ids", F.array().cast(_STRINGS))
    )


def apply_router(
    selected: DataFrame, proposals: DataFrame, cards: DataFrame, id_col: str = "msg_id", k: int = V.MAX_CARDS
) -> DataFrame:
    """Fills empty selections from router proposals (id, card_ids, input_tokens, output_tokens, failed).

    Only known cards are kept, unique, the first k; unknown ids are reported. Messages without a
    proposal keep ``router_status`` not_used.
    """
    needed = selected.filter(F.col("retrieval_status") == "empty").select(id_col)
    asked = proposals.join(needed, id_col, "left_semi")
    known = cards.select(F.col("id").alias("card_id")).distinct().withColumn("known", F.lit(True))
    proposed = asked.filter("not failed").select(id_col, F.posexplode("card_ids").alias("pos", "card_id"))
    listed = (
        lookup_join(proposed, known, ["card_id"], "left", F.col(id_col))
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "card_id", "known"))).alias("all"))
    )

    def pick(keep) -> Column:
        return F.array_distinct(F.transform(F.filter("all", keep), lambda p: p.card_id))

    judged = (
        asked.select(id_col, "failed", "input_tokens", "output_tokens")
        .join(listed, id_col, "left")
        .select(
            id_col,
            F.when(F.col("failed"), 0).otherwise(F.col("input_tokens")).alias("router_input_tokens"),
            F.when(F.col("failed"), 0).otherwise(F.col("output_tokens")).alias("router_output_tokens"),
            "failed",
            F.slice(pick(lambda p: p.known.isNotNull()), 1, k).alias("routed"),
            pick(lambda p: p.known.isNull()).alias("invalid_router_ids"),
        )
    )
    joined = selected.join(judged, id_col, "left")
    routed = F.size(F.coalesce("routed", F.array())) > 0
    status = (
        F.when(F.col("failed").isNull(), "not_used")
        .when(F.col("failed"), "unavailable")
        .when(F.size(F.coalesce("invalid_router_ids", F.array())) > 0, "invalid_ids")
        .otherwise("ok")
    )
    return (
        joined.withColumn("router_status", status)
        .withColumn("card_ids", F.when(routed, F.col("routed")).otherwise(F.col("card_ids")))
        .withColumn("retrieval_mode", F.when(routed, "router").otherwise(F.col("retrieval_mode")))
        .withColumn("retrieval_status", F.when(routed, "ok").otherwise(F.col("retrieval_status")))
        .withColumn("invalid_router_ids", F.coalesce("invalid_router_ids", F.array().cast(_STRINGS)))
        .withColumn("router_input_tokens", F.coalesce("router_input_tokens", F.lit(0)))
        .withColumn("router_output_tokens", F.coalesce("router_output_tokens", F.lit(0)))
        .drop("failed", "routed")
    )


def merge_cards(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overlay by card id: approved replaces or adds, draft and retired suppress."""
    columns = [c for c in base.columns if c != "id"]
    fresh = (
        overrides.filter(F.col("status") == "approved")
        .groupBy("id")
        .agg(F.min_by(F.struct(*columns), "updated_ts").alias("new"))
    )
    suppressed = overrides.filter(F.col("status") != "approved").select("id").distinct()
    merged = base.select("id", F.struct(*columns).alias("old")).join(fresh, "id", "full")
    return (
        merged.join(suppressed, "id", "left_anti")
        .withColumn("card", F.coalesce("new", "old"))
        .select("id", *[F.col(f"card.{c}") for c in columns])
    )


def validate_card_overrides(overrides: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Valid overrides (cleaned) and quarantined ones with the reason."""
    ids = ("trigger_rule_ids", "trigger_signal_kinds", "reviewed_case_ids")
    entries = ("red_flags", "verify_steps", "questions")

    def cleaned(column: Column, lower: bool) -> Column:
        one = (lambda v: casefold(strip(v))) if lower else strip
        return F.filter(F.transform(column, lambda v: one(v)), lambda v: v != "")

    raw = overrides
    for c in (*ids, *entries):
        raw = raw.withColumn(f"_n_{c}", F.size(c)).withColumn(c, cleaned(F.col(c), c in ids))
    raw = (
        raw.withColumn("id", casefold(strip(F.col("id"))))
        .withColumn("version", strip(F.col("version")))
        .withColumn("reviewer", strip(F.col("reviewer")))
        .withColumn("mechanism", strip(F.col("mechanism")))
        .withColumn("_most_aliases", F.array_max(F.transform(F.map_values("retrieval_aliases"), lambda v: F.size(v))))
        .withColumn("retrieval_aliases", F.transform_values("retrieval_aliases", lambda _, v: cleaned(v, False)))
    )

    def listed(c: str, test) -> Column:
        return (F.col(f"_n_{c}") <= V.CARD_ENTRIES) & F.forall(c, test)

    def short(v: Column) -> Column:
        return F.length(v) <= V.CARD_ENTRY_MAX

    aliases = F.flatten(F.map_values("retrieval_aliases"))
    checks = {
        "invalid_card_id": F.col("id").rlike(V.CARD_ID_SHAPE),
        "invalid_card_version": F.col("version").rlike(V.CARD_VERSION_SHAPE),
        "invalid_status": F.col("status").isin(*V.CARD_STATUSES),
        "invalid_reviewer": F.length("reviewer").between(1, V.CARD_REVIEWER_MAX),
        "invalid_mechanism": F.length("mechanism").between(1, V.CARD_MECHANISM_MAX),
        "invalid_trigger_rule": listed("trigger_rule_ids", lambda v: v.rlike(V.RULE_ID_SHAPE)),
        "invalid_trigger_signal": listed("trigger_signal_kinds", lambda v: v.rlike(V.SNAKE_SHAPE)),
        "invalid_reviewed_case": listed("reviewed_case_ids", lambda v: v.rlike(V.CARD_ID_SHAPE)),
        "invalid_alias_language": F.forall(
            F.map_keys("retrieval_aliases"), lambda k: k.isin(*V.PATTERN_LANGUAGES)
        ),
        "invalid_aliases": (F.coalesce("_most_aliases", F.lit(0)) <= V.CARD_ALIASES_PER_LANGUAGE)
        & F.forall(aliases, lambda v: F.length(v) <= V.CARD_ALIAS_MAX),
        "invalid_red_flags": listed("red_flags", short),
        "invalid_verify_steps": listed("verify_steps", short),
        "invalid_questions": listed("questions", short),
    }
    helpers = [f"_n_{c}" for c in (*ids, *entries)] + ["_most_aliases"]
    return split_valid(raw, checks, path, tuple(helpers))


def kb_version(base_version: str, overrides: DataFrame) -> DataFrame:
    """One row: the base version stamped with the latest override, unless that gets too long."""
    stamp = F.date_format(F.max("updated_ts"), "yyyyMMddHHmmss")
    stamped = F.concat(F.lit(f"{base_version}.db"), stamp)
    return overrides.agg(
        F.when(F.length(stamped) <= V.KB_VERSION_MAX_CHARS, stamped)
        .otherwise(F.lit(base_version))
        .alias("kb_version")
    )


def card_impact(
    messages: DataFrame, base: DataFrame, candidate: DataFrame, id_col: str = "msg_id"
) -> DataFrame:
    """Messages in which an unsaved card would be selected: mode and the other cards chosen.

    ``candidate`` is a one-row card table; an unapproved card is never selected.
    """
    rest = base.join(candidate.select("id"), "id", "left_anti")
    trial = rest.unionByName(candidate.filter(F.col("status") == "approved").select(*base.columns))
    picked = retrieve(messages, trial, id_col)
    new_id = candidate.select("id").scalar()
    flagged = picked.withColumn("_new", new_id)
    return flagged.filter(F.expr("array_contains(card_ids, _new)")).select(
        id_col,
        "retrieval_mode",
        F.expr("array_remove(card_ids, _new)").alias("other_card_ids"),
    )
