"""Rule packs: flattening, matching, summaries, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline import fixed_values as V
from wardline.functions.text import casefold, normalize_text, strip
from wardline.operators.common import (
    INLINE_LIMIT, bounded_rows, constant, content_key, lookup_join, pages, salted_join, split_valid, stored,
)
from wardline.operators.matching import KEY_LIMIT, contained, match_literals, match_regexes

HIT_TYPE = (
    "array<struct<rule_id:string,family:string,message_key:string,severity:int,emits_signal:string>>"
)
_AFTER_BASE = 2**62
_COMPILE_PAGE = 500
_HIT_FIELDS = ("rule_id", "family", "message_key", "severity", "emits_signal")


def rule_pack_problems(rules: DataFrame) -> DataFrame:
    """(rule_id, problem) for duplicate ids and for rules left without a pattern."""
    patterns = F.flatten(F.map_values("match"))
    kept = F.size(F.filter(patterns, lambda p: strip(p) != ""))
    return (
        rules.select("rule_id", kept.alias("kept"))
        .groupBy("rule_id")
        .agg(F.count("*").alias("copies"), F.max("kept").alias("kept"))
        .select(
            "rule_id",
            F.when(F.col("copies") > 1, "duplicate_rule_id")
            .when(F.col("kept") == 0, "no_patterns")
            .alias("problem"),
        )
        .filter(F.col("problem").isNotNull())
    )


def flatten_rules(rules: DataFrame) -> DataFrame:
    """One row per (rule, language, pattern); blank patterns are dropped.

    ``needle`` is what is compared: the normalised literal, or the expression after ``regex:``.
    """
    flat = (
        rules.select("*", F.explode("match").alias("language", "patterns"))
        .select("*", F.posexplode("patterns").alias("position", "pattern"))
        .filter(strip(F.col("pattern")) != "")
        .withColumn("normalized", normalize_text(F.col("pattern")))
    )
    is_regex = F.startswith("normalized", F.lit(V.REGEX_PREFIX))
    return flat.select(
        "rule_order", *_HIT_FIELDS, "language", "position", "pattern",
        is_regex.alias("is_regex"),
        F.when(is_regex, F.substr("normalized", F.lit(len(V.REGEX_PREFIX) + 1)))
        .otherwise(F.col("normalized"))
        .alias("needle"),
    )


def broken_regexes(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns Spark does not accept. Constant folding compiles them, so no job runs."""
    if not patterns:
        return []
    tests = ", ".join(f"'' RLIKE :p{i}" for i in range(len(patterns)))
    try:
        spark.sql(f"SELECT {tests}", args={f"p{i}": p for i, p in enumerate(patterns)}).collect()
    except Exception as error:  # noqa: BLE001 - Spark reports a bad pattern in several classes
        if "PATTERN" not in str(error).upper():
            raise
        if len(patterns) == 1:
            return patterns
        half = len(patterns) // 2
        return broken_regexes(spark, patterns[:half]) + broken_regexes(spark, patterns[half:])
    return []


def usable_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns without the expressions that do not compile: those simply never match."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("needle"))
    return patterns.filter(~F.col("is_regex") | compiled.isNotNull())


def _usable_rows(patterns: DataFrame, limit: int) -> list | None:
    """The usable rows of a pack of at most ``limit`` patterns, from one collect; else None."""
    rows = bounded_rows(patterns, limit)
    if rows is None:
        return None
    regexes = sorted({r.needle for r in rows if r.is_regex})
    bad = set(broken_regexes(patterns.sparkSession, regexes))
    return [r for r in rows if not (r.is_regex and r.needle in bad)]


def with_normalized(messages: DataFrame, text_col: str = "text") -> DataFrame:
    return messages.withColumn("normalized", normalize_text(F.col(text_col)))


def with_rule_hits(
    messages: DataFrame,
    patterns: DataFrame,
    id_col: str = "msg_id",
    inline_limit: int = INLINE_LIMIT,
) -> DataFrame:
    """Adds ``hits``, one entry per rule that fires, in pack order. Needs ``normalized``.

    A pack of at most ``inline_limit`` patterns becomes one posting index in the plan, so nothing is shuffled. A larger one goes through
    equi-joins on pieces of the patterns: distinct texts are screened once and every row gets the hits of its text. The
    limit decides the plan only; ids may repeat or be null.
    """
    rows = _usable_rows(patterns, inline_limit)
    if rows is None:
        keyed, texts = _distinct_texts(messages)
        hits = _joined_hits(texts, usable_patterns(patterns), "_content", inline_limit)
        empty = F.array().cast(HIT_TYPE)
        joined = salted_join(keyed, hits, ["_content"], "left", F.col(id_col)).drop("_content")
        return joined.select(*messages.columns, F.coalesce("hits", empty).alias("hits"))
    by_rule: dict[tuple, list] = {}
    for row in sorted(rows, key=lambda r: (r.rule_order, r.rule_id)):
        by_rule.setdefault((row.rule_order, row.rule_id), []).append(row)
    patterns_of = [[(r.needle, r.is_regex) for r in group] for group in by_rule.values()]
    fields = constant([{f: group[0][f] for f in _HIT_FIELDS} for group in by_rule.values()], HIT_TYPE)
    fired = _owners(F.col("normalized"), patterns_of)
    return messages.withColumn("hits", F.transform(fired, lambda r: F.get(fields, r)).cast(HIT_TYPE))


def _owners(text: Column, patterns_of: list[list[tuple[str, bool]]]) -> Column:
    """Sorted numbers of the owners (rules) that have a pattern in the text; a pattern may have several owners."""
    owners: dict[tuple[str, bool], list[int]] = {}
    for number, patterns in enumerate(patterns_of):
        for pattern in dict.fromkeys(patterns):
            owners.setdefault(pattern, []).append(number)
    table = constant(list(owners.values()), "array<array<int>>")
    numbers = F.flatten(F.transform(contained(text, list(owners)), lambda p: F.get(table, p)))
    return F.array_sort(F.array_distinct(numbers))


def _distinct_texts(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with the key of their normalised text, and each such text once, stored as several joins read it."""
    keyed = messages.withColumn("_content", content_key(F.col("normalized")))
    return keyed, stored(keyed.select("_content", "normalized").dropDuplicates(["_content"]), "texts")


def _joined_hits(
    messages: DataFrame, patterns: DataFrame, id_col: str, page_size: int
) -> DataFrame:
    texts = messages.select(id_col, "normalized")
    keyed = patterns.withColumn("lit_id", F.xxhash64("needle", "is_regex")).select(
        "lit_id", "needle", "is_regex"
    ).distinct()
    long = patterns.limit(KEY_LIMIT + 1).count() > KEY_LIMIT
    if long:
        keyed = stored(keyed, "needles")
    found = match_literals(texts, id_col, "normalized", keyed.filter("not is_regex"), page_size)
    regex_found = match_regexes(texts, id_col, "normalized", keyed.filter("is_regex"), page_size)
    if regex_found is not None:
        found = found.unionByName(regex_found)
    rules = patterns.select(
        F.xxhash64("needle", "is_regex").alias("lit_id"), "rule_order", *_HIT_FIELDS
    )
    if long:  # only the rules that some text trips are taken from a long pack
        found = stored(found, "found")
        rules = lookup_join(rules, found.select("lit_id").distinct(), ["lit_id"], "left_semi", F.col("lit_id"), KEY_LIMIT)
    rules = rules.distinct()
    per_rule = found.join(rules, "lit_id").groupBy(id_col, "rule_order", "rule_id").agg(
        *[F.first(f).alias(f) for f in _HIT_FIELDS if f != "rule_id"]
    )
    ordered = F.array_sort(F.collect_list(F.struct("rule_order", *_HIT_FIELDS)))
    return per_rule.groupBy(id_col).agg(
        F.transform(ordered, lambda h: F.struct(*[h[f].alias(f) for f in _HIT_FIELDS])).alias("hits")
    )


def rule_hits(
    messages: DataFrame,
    patterns: DataFrame,
    id_col: str = "msg_id",
    inline_limit: int = INLINE_LIMIT,
) -> DataFrame:
    """Long form: one row per (message, rule)."""
    matched = with_rule_hits(with_normalized(messages), patterns, id_col, inline_limit)
    # An outer explode: for a plain one the pack would be evaluated in a filter on the array's size as well.
    return matched.select(id_col, F.explode_outer("hits").alias("hit")).filter("hit is not null").select(id_col, "hit.*")


def matching_patterns(
    messages: DataFrame, patterns: DataFrame, id_col: str = "msg_id", inline_limit: int = INLINE_LIMIT
) -> DataFrame:
    """(id, rule_id, pattern): every pattern that fired, for dry runs of a pack; the limit decides the plan only."""
    texts = with_normalized(messages).select(id_col, "normalized")
    rows = _usable_rows(patterns, inline_limit)
    if rows is not None:
        if not rows:
            return texts.select(id_col, F.lit("").alias("rule_id"), F.lit("").alias("pattern")).filter(F.lit(False))
        shown = constant([{"rule_id": r.rule_id, "pattern": r.pattern} for r in rows], "array<struct<rule_id:string,pattern:string>>")
        fired = _owners(F.col("normalized"), [[(r.needle, r.is_regex)] for r in rows])
        found = F.explode_outer(F.transform(fired, lambda p: F.get(shown, p))).alias("found")
        return texts.select(id_col, found).filter("found is not null").select(id_col, "found.*")
    keyed = usable_patterns(patterns).withColumn("lit_id", F.xxhash64("needle", "is_regex"))
    needles = keyed.select("lit_id", "needle", "is_regex").distinct()
    rows, distinct = _distinct_texts(texts)
    found = match_literals(distinct, "_content", "normalized", needles.filter("not is_regex"))
    regex_found = match_regexes(distinct, "_content", "normalized", needles.filter("is_regex"))
    if regex_found is not None:
        found = found.unionByName(regex_found)
    named = found.join(keyed.select("lit_id", "rule_id", "pattern"), "lit_id").drop("lit_id")
    return salted_join(rows, named, ["_content"], "inner", F.col(id_col)).select(id_col, "rule_id", "pattern")


def rule_signals(hits: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Signal rows (kind, note=family) of the rules that emit one."""
    return (
        hits.filter(F.col("emits_signal").isNotNull())
        .select(id_col, F.col("emits_signal").alias("kind"), F.col("family").alias("note"))
        .distinct()
    )


def summarize_hits(hits: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Per message: sorted rule ids and families, top severity, whether a red flag is due."""
    return hits.groupBy(id_col).agg(
        F.sort_array(F.collect_set("rule_id")).alias("rule_ids"),
        F.sort_array(F.collect_set("family")).alias("families"),
        F.max("severity").alias("max_severity"),
        F.bool_or(F.col("severity") >= V.RED_FLAG_MIN_SEVERITY).alias("needs_red_flag"),
    )


def top_families(
    checks: DataFrame, rules: DataFrame, id_col: str = "check_id", k: int = V.MAX_SHARE_FAMILIES
) -> DataFrame:
    """(id, families): up to k families by severity, then first position, then name."""
    exploded = checks.select(id_col, F.posexplode("rule_ids").alias("pos", "rule_id"))
    known = lookup_join(exploded, rules.select("rule_id", "family", "severity"), ["rule_id"], "inner", F.col(id_col))
    ranked = known.groupBy(id_col, "family").agg(
        F.min(F.struct((-F.col("severity")).alias("neg"), "pos")).alias("best")
    )
    listed = ranked.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("best.neg", "best.pos", "family"))).alias("all")
    )
    return listed.select(
        id_col, F.transform(F.slice("all", 1, k), lambda f: f.family).alias("families")
    )


def share_summary(
    top: DataFrame, labels: DataFrame, copy: DataFrame, id_col: str = "check_id"
) -> DataFrame:
    """Content-free share text. ``copy`` has language, lead, families, generic, caution, cta."""
    by_language = labels.groupBy("language").agg(
        F.map_from_entries(F.collect_list(F.struct("family", "label"))).alias("label_of")
    )
    wording = copy.join(by_language, "language", "left")
    language = F.when(F.col("language").isin(*V.REPLY_LANGUAGES), F.col("language")).otherwise(
        "uz_latn"
    )
    named = F.transform(
        "families",
        lambda f: F.coalesce(
            F.element_at("label_of", f), F.replace(f, F.lit("_"), F.lit(" "))
        ),
    )
    line = F.replace("families_line", F.lit("{families}"), F.array_join(named, ", "))
    full = F.concat_ws("\n", "lead", line, "caution", "cta")
    wording = wording.withColumnRenamed("families", "families_line")
    return (
        lookup_join(top.withColumn("language", language), wording, ["language"], "inner", F.col(id_col))
        .select(
            id_col,
            F.when(F.size(F.coalesce("families", F.array())) == 0, F.concat_ws("\n", "generic", "cta"))
            .otherwise(full)
            .alias("summary"),
        )
    )


def golden_recall(expected: DataFrame, hits: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """(id, missing, passed): expected families that did not fire."""
    fired = hits.groupBy(id_col).agg(F.collect_set("family").alias("fired"))
    missing = F.sort_array(
        F.array_except("expected", F.coalesce("fired", F.array().cast("array<string>")))
    )
    return (
        expected.join(fired, id_col, "left")
        .select(id_col, missing.alias("missing"))
        .withColumn("passed", F.size("missing") == 0)
    )


def merge_rules(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overlay by rule id: replace in place, add after the base, drop what is disabled.

    Additions follow in order of latest update, newest first. A rule id repeated among the
    overrides counts once: its oldest update wins, as the last one written over the others.
    """
    columns = [c for c in base.columns if c != "rule_order"]
    disabled = overrides.filter("disabled").select("rule_id").distinct()
    active = overrides.filter("not disabled").filter(has_patterns(F.col("match")))
    latest = active.groupBy("rule_id").agg(
        F.min_by(F.struct(*columns), "updated_ts").alias("new"),
        F.max("updated_ts").alias("seen"),
    )
    merged = base.select("rule_id", "rule_order", F.struct(*columns).alias("old")).join(
        latest, "rule_id", "full"
    )
    # Additions sort after the base by a key of their own, so no global numbering pass is needed.
    after_base = F.lit(_AFTER_BASE) - F.unix_micros(F.col("seen"))
    chosen = merged.join(disabled, "rule_id", "left_anti").withColumn(
        "rule", F.coalesce("new", "old")
    )
    return chosen.select(
        F.coalesce("rule_order", after_base).alias("rule_order"),
        *[F.col(f"rule.{c}") for c in columns],
    )


def has_patterns(match: Column) -> Column:
    return F.size(F.filter(F.flatten(F.map_values(match)), lambda p: strip(p) != "")) > 0


def validate_rule_overrides(
    overrides: DataFrame, bad_regexes: tuple[str, ...] | None = None, path: str | None = None
) -> dict[str, DataFrame]:
    """Valid overrides (cleaned) and quarantined ones with the reason.

    ``bad_regexes`` are expressions known not to compile; when None they are found by compiling the
    distinct expressions of the table.
    """
    trimmed = lambda c: casefold(strip(F.coalesce(F.col(c), F.lit(""))))
    entries = F.transform_values(
        "match",
        lambda _, ps: F.filter(F.transform(ps, lambda p: strip(p)), lambda p: p != ""),
    )
    cleaned = (
        overrides.withColumn("rule_id", trimmed("rule_id"))
        .withColumn("family", trimmed("family"))
        .withColumn("message_key", trimmed("message_key"))
        .withColumn("desc", strip(F.coalesce("desc", F.lit(""))))
        .withColumn("emits_signal", F.nullif(trimmed("emits_signal"), F.lit("")))
        .withColumn("too_many", F.exists(F.map_values("match"), lambda ps: F.size(ps) > V.RULE_PATTERNS_PER_LANGUAGE))
        .withColumn("match", entries)
        .withColumn("all", F.flatten(F.map_values("match")))
    )
    is_regex = lambda p: casefold(p).startswith(V.REGEX_PREFIX)
    body = lambda p: strip(F.substr(p, F.lit(len(V.REGEX_PREFIX) + 1)))
    if bad_regexes is None:
        spark = overrides.sparkSession
        listed = cleaned.select(F.explode("all").alias("p")).filter(is_regex(F.col("p")))
        distinct = listed.select(body(F.col("p")).alias("p")).filter(F.col("p") != "").distinct()
        bad_regexes = ()
        for page in pages(distinct, ["p"], _COMPILE_PAGE):
            bad_regexes += tuple(broken_regexes(spark, [r.p for r in page]))
    checks = {
        "invalid_rule_id": F.col("rule_id").rlike(V.RULE_ID_SHAPE),
        "invalid_family": F.col("family").rlike(V.SNAKE_SHAPE),
        "invalid_message_key": F.col("message_key").rlike(V.SNAKE_SHAPE),
        "invalid_description": F.length("desc").between(1, V.RULE_DESCRIPTION_MAX),
        "invalid_severity": F.col("severity").between(1, 3),
        "invalid_emits_signal": F.col("emits_signal").isNull()
        | F.col("emits_signal").rlike(V.SNAKE_SHAPE),
        "invalid_patterns": (F.size("match") > 0) & ~F.col("too_many"),
        "invalid_pattern_language": F.forall(
            F.map_keys("match"), lambda k: k.isin(*V.PATTERN_LANGUAGES)
        ),
        "pattern_too_long": F.forall("all", lambda p: F.length(p) <= V.RULE_PATTERN_MAX),
        "empty_regex": F.forall("all", lambda p: ~is_regex(p) | (body(p) != "")),
        "invalid_regex": F.forall("all", lambda p: ~is_regex(p) | ~body(p).isin(*bad_regexes))
        if bad_regexes
        else F.lit(True),
        "pattern_too_short": F.forall(
            "all", lambda p: is_regex(p) | (F.length(p) >= V.RULE_LITERAL_MIN)
        ),
        "no_patterns": F.col("disabled") | (F.size("all") > 0),
    }
    return split_valid(cleaned, checks, path, ("too_many", "all"))
