"""Parsing and scoring of raw model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline import draft_values as D, fixed_values as V
from wardline.functions.text import any_of, bind, casefold
from wardline.operators.common import salted_join, with_once

DRAFT_SCHEMA = (
    "situation_type string, red_flags array<string>, pattern string, verify array<string>, "
    "ask array<string>, addressed_rule_ids array<string>"
)


def json_payload(raw: Column) -> Column:
    """The JSON object text of a model output: fence removed, else the outermost braces, else null."""
    trimmed = F.trim(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))

    def bare(text: Column) -> Column:
        opened = F.regexp_replace(text, D.FENCE_OPEN, "")
        return F.when(
            text.startswith("```"), F.trim(F.regexp_replace(opened, D.FENCE_CLOSE, ""))
        ).otherwise(text)

    def single_object(listed: Column) -> Column:
        single = F.size(listed.cast("array<variant>")) == 1
        return single & F.schema_of_variant(listed).startswith("ARRAY<OBJECT")

    def usable(candidate: Column) -> Column:
        # Inside brackets, anything after the first value is an error or a second element.
        listed = F.try_parse_json(F.concat(F.lit("["), candidate, F.lit("]")))
        return F.when(bind(listed, single_object), candidate)

    inner = lambda t: bind(F.regexp_extract(t, D.OUTER_BRACES, 0), usable)
    return bind(bind(trimmed, bare), lambda t: F.coalesce(usable(t), inner(t)))


def parse_drafts(outputs: DataFrame) -> DataFrame:
    """Adds ``json_ok`` and the draft fields; missing rule ids become an empty list."""
    parsed = with_once(outputs, "_json", json_payload(F.col("raw")))
    parsed = with_once(parsed, "_draft", F.from_json("_json", DRAFT_SCHEMA))
    none = F.array().cast("array<string>")
    return parsed.select(
        *outputs.columns,
        F.col("_json").isNotNull().alias("json_ok"),
        F.coalesce("_draft.situation_type", F.lit("checkable")).alias("situation_type"),
        F.coalesce("_draft.red_flags", none).alias("red_flags"),
        F.col("_draft.pattern").alias("pattern"),
        F.coalesce("_draft.verify", none).alias("verify"),
        F.coalesce("_draft.ask", none).alias("ask"),
        F.coalesce("_draft.addressed_rule_ids", none).alias("addressed_rule_ids"),
    )


def answer_script(text: Column) -> Column:
    """Script-based language of an answer."""
    cyrillic = F.regexp_count(text, F.lit(D.RUBRIC_CYRILLIC))
    latin = F.regexp_count(text, F.lit(D.RUBRIC_LATIN))
    return (
        F.when(text.rlike(D.RUBRIC_UZ_LETTER), "uz_latn")
        .when(cyrillic > latin, "ru")
        .otherwise("uz_latn")
    )


def eval_rubric(drafts: DataFrame) -> DataFrame:
    """Adds the seven rubric booleans and ``total``.

    Needs json_ok, language, expects_no_signal and the draft fields of :func:`parse_drafts`.
    """
    entries = F.concat("red_flags", "verify", "ask")
    pattern = F.when(F.coalesce("pattern", F.lit("")) != "", F.array("pattern"))
    text = F.array_join(F.concat(entries, F.coalesce(pattern, F.array().cast("array<string>"))), " ")
    low = F.lower("_text")
    for negation in D.RUBRIC_NEGATIONS:
        low = F.replace(low, F.lit(negation), F.lit(" "))
    scored = with_once(with_once(drafts, "_text", text), "_low", low)
    ok = F.col("json_ok")
    value = F.col("_text")
    raw_contact = (
        value.rlike(D.RUBRIC_PHONE) | value.rlike(D.RUBRIC_URL) | value.rlike(D.RUBRIC_CARD)
    )
    short = [F.size(c) <= V.MAX_BULLETS for c in ("red_flags", "verify", "ask")]
    judged = {
        "lang_ok": ok & (answer_script(value) == F.col("language")),
        "no_verdict": ok & ~any_of([F.col("_low").contains(w) for w in D.RUBRIC_VERDICT_WORDS]),
        "no_raw_contact": ok & ~raw_contact,
        "has_red_flags": ok & ((F.size("red_flags") > 0) | F.col("expects_no_signal")),
        "has_verify_ask": ok & (F.size("verify") > 0) & (F.size("ask") > 0),
        "length_ok": ok & short[0] & short[1] & short[2],
    }
    tests = F.struct(*[test.alias(name) for name, test in judged.items()])
    scored = with_once(scored, "_judged", tests).withColumns({name: F.col(f"_judged.{name}") for name in judged})
    points = [F.col(k).cast("int") for k in D.RUBRIC_KEYS]
    return scored.withColumn("total", sum(points[1:], points[0])).drop("_text", "_low", "_judged")


def failing_keys() -> Column:
    return F.array_compact(
        F.array(*[F.when(~F.col(k), F.lit(k)) for k in D.RUBRIC_KEYS])
    )


def failing_fixtures(scores: DataFrame, id_cols: tuple[str, ...] = ("answer_id",)) -> DataFrame:
    """(provider, ids, failing): the rubric keys that each scored output fails, of those that fail any."""
    listed = scores.withColumn("failing", failing_keys())
    return listed.filter(F.size("failing") > 0).select("provider", *id_cols, "failing")


def eval_leaderboard(scores: DataFrame) -> DataFrame:
    """Points, maximum and share per provider."""
    most = F.count("*") * len(D.RUBRIC_KEYS)
    return scores.groupBy("provider").agg(
        F.sum("total").alias("points"),
        most.alias("max_points"),
        F.count_if(F.size(failing_keys()) > 0).alias("failing_outputs"),
    )


def forbidden_leaks(
    answers: DataFrame, fixtures: DataFrame, id_col: str = "fixture_id"
) -> DataFrame:
    """(id, phrase): forbidden phrases that occur in an ``ok`` answer to their fixture, in any letter case.

    ``fixtures``: fixture_id, must_not_contain. Both sides are case-folded, so that letters whose upper-case form is
    longer (ß, SS) meet in every spelling; the phrase is returned as it was given.
    """
    phrases = fixtures.select(id_col, F.explode("must_not_contain").alias("phrase")).withColumn("_folded", casefold(F.col("phrase")))
    folded = answers.filter(F.col("status") == "ok").select(id_col, "answer_id", casefold(F.col("answer")).alias("_answer"))
    joined = salted_join(folded, phrases, [id_col], "inner", F.col("answer_id"))
    return joined.filter(F.contains("_answer", "_folded")).select(id_col, "answer_id", "phrase")
