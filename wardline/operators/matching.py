"""Which literals and expressions occur in which texts, for lists of any size.

Short lists sit in the plan as a posting index: every literal is filed under one piece of itself that a text must hold as a
piece of its own (a whole word between two spaces, else the start of its longest word), and a text is looked up piece by
piece, so only the few literals whose piece it holds are compared with it. An expression enters the same index through the
longest literal that all its matches hold. Long lists go through joins on such pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.text import bind
from wardline.operators.common import INLINE_LIMIT, constant, lookup_join, pages, salted_join, stored

_GRAM = 3
#: Lengths of the word starts that literals without an inner word are filed under.
_STARTS = (8, 5, 3)
#: Lengths of the starts that literals of a long list are filed under; the last is ``_GRAM``.
_LONG_STARTS = (16, 8, 5, 3)
_ENTRY = "struct<i:int,also:string,must:array<string>,regex:string>"
_ENTRIES = f"array<{_ENTRY}>"
#: Rows (distinct keys, or literals with the key they are looked for by) up to which a side is broadcast; beyond, the joins are salted.
KEY_LIMIT = 200_000


def one_of_literals(needles: list[str]) -> str:
    """A pattern that finds any of the literals in one scan of a text.

    Shared beginnings are written once and many branches are split by a class of first letters, so
    that only a few characters are compared at each position however many literals there are. A
    literal that starts with a shorter one adds nothing.
    """

    def escape(text: str) -> str:
        return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)

    def alternatives(branches: list[tuple[str, str]]) -> str:
        if len(branches) <= 3:
            return "|".join(pattern for _, pattern in branches)
        middle = len(branches) // 2
        halves = [branches[:middle], branches[middle:]]
        return "|".join(
            f"(?=[{''.join(escape(first) for first, _ in half)}])(?:{alternatives(half)})"
            for half in halves
        )

    def build(sorted_texts: list[str]) -> str:
        if not sorted_texts[0]:
            return ""
        branches, start = [], 0
        while start < len(sorted_texts):
            stop = start
            while stop < len(sorted_texts) and sorted_texts[stop][0] == sorted_texts[start][0]:
                stop += 1
            shared = commonprefix([sorted_texts[start], sorted_texts[stop - 1]])
            rest = build([t[len(shared):] for t in sorted_texts[start:stop]])
            branches.append((shared[0], escape(shared) + rest))
            start = stop
        return branches[0][1] if len(branches) == 1 else f"(?:{alternatives(branches)})"

    return build(sorted(set(needles)))


def required_literals(regex: str) -> list[str]:
    """Literals that every match of an expression holds, the longest first; none when no literal is certain.

    Only plain characters outside groups, classes and alternatives count; what a quantifier may leave out does not.
    """
    runs, run, at = [], "", 0
    while at < len(regex):
        c = regex[at]
        if c == "|" or regex.startswith(("(?", "\\Q"), at) and not regex.startswith(("(?:", "(?=", "(?!", "(?<"), at):
            return []  # alternatives, flags and quotes change what the other characters mean
        width, literal = 1, None
        if c == "\\":
            width = 2
            follower = regex[at + 1 : at + 2]
            if follower.isalnum():
                if follower not in "dDsSwWbBAzZ":
                    return []  # numbers and classes in braces
            else:
                literal = follower
        elif c == "(":
            width = _group_width(regex, at)
        elif c == "[":
            width = _class_width(regex, at)
        elif c not in ".^$)]{}*+?":
            literal = c
        if not width:
            return []
        quantifier = _quantifier(regex, at + width)
        if literal is not None and not quantifier:
            run += literal
        else:
            if literal is not None and (quantifier[0] == "+" or quantifier[0] == "{" and quantifier[1:2] in "123456789"):
                run += literal  # at least once, but what follows need not touch the first of them
            runs.append(run)
            run = ""
        at += width + len(quantifier)
    return sorted({r for r in (*runs, run) if r}, key=lambda r: (-len(r), r))


def _quantifier(regex: str, at: int) -> str:
    """The quantifier that starts at a place, with its lazy or possessive mark."""
    if regex[at : at + 1] not in ("*", "+", "?", "{"):
        return ""
    end = at + 1 if regex[at] != "{" else regex.find("}", at) + 1
    return regex[at : end + 1] if regex[end : end + 1] in ("?", "+") else regex[at:end]


def _class_width(regex: str, at: int) -> int:
    """Length of a character class, 0 if it holds classes of its own or does not end."""
    end = at + 1
    while end < len(regex):
        if regex[end] == "\\":
            end += 1
        elif regex[end] == "[":
            return 0
        elif regex[end] == "]" and end > at + 1 and regex[at + 1 : end] != "^":
            return end - at + 1
        end += 1
    return 0


def _group_width(regex: str, at: int) -> int:
    """Length of a group, 0 if it does not end or sets flags."""
    depth, end = 0, at
    while end < len(regex):
        c = regex[end]
        if regex.startswith("\\Q", end):
            return 0
        if c == "\\":
            end += 1
        elif c == "[":
            width = _class_width(regex, end)
            if not width:
                return 0
            end += width - 1
        elif c == "(":
            if regex.startswith("(?", end) and not regex.startswith(("(?:", "(?=", "(?!", "(?<"), end):
                return 0
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return end - at + 1
        end += 1
    return 0


def _inner_words(literal: str) -> list[str]:
    """Words between two spaces: a text that holds the literal has them as whole words."""
    return [w for w in literal.split(" ")[1:-1] if w]


def lookup_table(values: dict[str, list], kind: str):
    """A function from a text column to the list (an array type ``kind``) that a constant table holds under it, or an empty one.

    Keys are dealt over buckets by their checksum, so a lookup looks at one or two of them however many there are.
    """
    size = 2 * len(values) + 1
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for key, value in values.items():
        buckets[zlib.crc32(key.encode()) % size].append({"key": key, "value": value})
    table = constant(buckets, f"array<array<struct<key:string,value:{kind}>>>")

    def look_up(key: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(key.cast("binary")), F.lit(size)).cast("int"))
        return F.flatten(F.transform(F.filter(bucket, lambda b: b.key == key), lambda b: b.value))

    return look_up


def _postings(text: Column, pieces: Column, index: dict[str, list[dict]]) -> Column:
    """Numbers of the indexed entries whose piece is among ``pieces`` and that the text holds."""
    entries_of = lookup_table(index, _ENTRIES)

    def confirmed(held: Column) -> Column:
        candidates = F.flatten(F.transform(held, entries_of))
        sure = F.filter(
            candidates,
            lambda e: ((e.also == "") | F.array_contains(pieces, e.also))
            & F.forall(e.must, lambda m: F.contains(text, m))
            & (e.regex.isNull() | F.rlike(text, e.regex)),
        )
        return F.transform(sure, lambda e: e.i)

    return bind(F.array_distinct(F.filter(pieces, lambda w: w.isin(list(index)))), confirmed)


def contained(text: Column, patterns: list[tuple[str, bool]]) -> Column:
    """Array with the numbers of the (needle, is_regex) patterns that occur in ``text``, each once; null text holds none.

    Literals of one or two letters and expressions without a required literal of three are compared directly.
    """
    sought = [(i, required_literals(n) if is_regex else [n], n if is_regex else None) for i, (n, is_regex) in enumerate(patterns)]
    uses = Counter(w for _, must, _ in sought if must for w in set(_inner_words(must[0])))
    by_word: dict[str, list[dict]] = {}
    by_start: dict[int, dict[str, list[dict]]] = {size: {} for size in _STARTS}
    direct = []
    for i, must, regex in sought:
        literal = must[0] if must else ""
        words = sorted(set(_inner_words(literal)), key=lambda w: (uses[w], -len(w), w))
        longest = max(literal.split(" "), key=len)
        entry = {"i": i, "also": "", "must": must, "regex": regex}
        if words:
            by_word.setdefault(words[0], []).append(entry | {"also": words[1] if len(words) > 1 else ""})
        elif len(longest) >= _STARTS[-1]:
            size = next(k for k in _STARTS if k <= len(longest))
            by_start[size].setdefault(longest[:size], []).append(entry)
        else:
            direct.append((i, literal, regex))

    def looked_up(words: Column) -> Column:
        parts = [_postings(text, words, by_word)] if by_word else []
        for size, index in by_start.items():
            if index:
                long = F.filter(words, lambda w: F.length(w) >= size)
                starts = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (size - 1)), lambda k: F.substr(w, k, F.lit(size)))  # noqa: E731, B023
                parts.append(_postings(text, F.flatten(F.transform(long, starts)), index))
        return F.concat(*parts)

    parts = []
    if by_word or any(by_start.values()):
        parts.append(bind(F.array_distinct(F.split(text, " ")), looked_up))
    short = [(i, n) for i, n, regex in direct if regex is None]
    if short:
        rows = constant([{"i": i, "n": n} for i, n in short], "array<struct<i:int,n:string>>")
        found = F.transform(F.filter(rows, lambda r: F.contains(text, r.n)), lambda r: r.i)
        parts.append(F.when(text.rlike(one_of_literals([n for _, n in short])), found).otherwise(F.array().cast("array<int>")))
    for block in _blocks([(i, regex) for i, _, regex in direct if regex is not None], 64):
        tested = F.array_compact(F.array(*[F.when(text.rlike(regex), F.lit(i)) for i, regex in block]))
        parts.append(tested)
    none = F.array().cast("array<int>")
    return F.coalesce(F.concat(*parts), none) if parts else none


def _blocks(rows: list, size: int) -> list[list]:
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def matching_ids(text: Column, rows: list) -> Column:
    """Array of ``lit_id`` for the rows whose literal occurs in ``text``; no join involved."""
    pack = constant([{"i": r.lit_id, "n": r.needle} for r in rows], "array<struct<i:bigint,n:string>>")
    found = F.transform(F.filter(pack, lambda r: F.contains(text, r.n)), lambda r: r.i)
    return F.when(text.rlike(one_of_literals([r.needle for r in rows])), found)


def match_literals(
    texts: DataFrame,
    id_col: str,
    text_col: str,
    literals: DataFrame,
    page_size: int = INLINE_LIMIT,
) -> DataFrame:
    """(id_col, lit_id) for each literal contained in each text.

    ``literals`` has ``lit_id`` (a number) and ``needle``; ids of texts must be unique. A literal that holds a whole word
    between two spaces meets the texts on such a word, any other one on three of its letters, each time the one that
    fewest texts hold; what meets is then verified. Pieces of texts that no literal has are dropped before any shuffle as
    long as the literals are few enough to broadcast their keys. A literal with a piece that no text holds is in none; of a
    long list the others are stored first, and how they meet the texts follows from their number. A long list of literals without
    such words goes by their starts, see :func:`_by_starts`. Literals of one or two letters go into expressions page
    by page. Every way is exact and none compares all texts with all literals.
    """
    texts = texts.select(id_col, F.col(text_col).alias("_text"))
    length = F.length("needle")
    parts = []
    for page in pages(literals.filter(length < _GRAM), ["lit_id"], page_size):
        ids = F.explode_outer(matching_ids(F.col("_text"), page)).alias("lit_id")
        parts.append(texts.select(id_col, ids).filter("lit_id is not null"))

    def words(text: str) -> Column:
        return F.split(text, " ")

    def grams(text: str) -> Column:
        return F.regexp_extract_all(F.col(text), F.lit(rf"(?s)(?=({'.' * _GRAM}))"), F.lit(1))

    inner = F.filter(
        F.slice(words("needle"), F.lit(2), F.greatest(F.size(words("needle")) - 2, F.lit(0))),
        lambda w: w != "",
    )
    keyed = literals.filter(length >= _GRAM).withColumn("_inner", inner)
    with_word = keyed.filter(F.size("_inner") > 0)
    without = keyed.filter(F.size("_inner") == 0)
    for some, keys, pieces in ((with_word, F.col("_inner"), words), (without, grams("needle"), grams)):
        if some.isEmpty():
            continue
        if some is without and some.limit(KEY_LIMIT + 1).count() > KEY_LIMIT:
            parts.append(_by_starts(texts, id_col, some.select("lit_id", "needle")))
            continue
        key = F.explode(F.array_distinct(pieces("_text"))).alias("key")
        own = some.select("lit_id", "needle", F.explode(F.array_distinct(keys)).alias("key"))
        few = own.select("key").distinct().limit(KEY_LIMIT + 1).count() <= KEY_LIMIT

        def meet(big: DataFrame, small: DataFrame, how: str, light: bool = few) -> DataFrame:
            if light:
                return big.join(F.broadcast(small), "key", how)
            return salted_join(big, small, ["key"], how, F.col(id_col))

        held = meet(texts.select(id_col, key), own.select("key").distinct(), "left_semi")
        uses = held.groupBy("key").agg(F.count("*").alias("uses"))
        anchors, light, pieces_held = _rarest(own, F.broadcast(uses) if few else uses), few, texts.select(id_col, key)
        if some.limit(KEY_LIMIT + 1).count() > KEY_LIMIT:
            anchors = stored(anchors, "anchors")
            light = anchors.limit(KEY_LIMIT + 1).count() <= KEY_LIMIT
            if not light:
                pieces_held = meet(pieces_held, anchors.select("key").distinct(), "left_semi")
        # Only ids travel with the pieces; the text itself is shuffled once, to verify candidates.
        candidates = meet(pieces_held, anchors, "inner", light).drop("key")
        verified = candidates.join(texts, id_col).filter(F.contains("_text", "needle"))
        parts.append(verified.select(id_col, "lit_id"))
    if not parts:
        return texts.select(id_col, F.lit(None).cast("bigint").alias("lit_id")).filter(F.lit(False))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _by_starts(texts: DataFrame, id_col: str, literals: DataFrame) -> DataFrame:
    """(id_col, lit_id) for a list of literals, of three letters or more, that is too long for a broadcast.

    A literal is filed under its start, the longest of ``_LONG_STARTS`` that it has. Places of texts where no literal starts
    are found by three letters and dropped in the task that reads them. Literals whose start no text holds are dropped
    where they are read, so neither sorts, shuffles nor copies of the list grow with it, but with what texts hold of it.
    """
    filed = literals.withColumn("key", F.coalesce(*[F.when(F.length("needle") >= size, F.left("needle", F.lit(size))) for size in _LONG_STARTS]))
    heads = stored(filed.select(F.left("key", F.lit(_GRAM)).alias("head")).distinct(), "heads")
    spot = F.explode(F.regexp_extract_all("_text", F.lit(rf"(?s)(?=(.{{{_GRAM},{_LONG_STARTS[0]}}}))."), F.lit(1))).alias("spot")
    spots = texts.select(id_col, spot).withColumn("head", F.left("spot", F.lit(_GRAM)))
    spots = lookup_join(spots, heads, ["head"], "left_semi", F.col(id_col), KEY_LIMIT)
    starts = F.array_compact(F.array(*[F.when(F.length("spot") >= size, F.left("spot", F.lit(size))) for size in _LONG_STARTS]))
    pieces = spots.select(id_col, F.explode(starts).alias("key"))
    keys = stored(pieces.select("key").distinct(), "keys")
    anchors = stored(lookup_join(filed, keys, ["key"], "left_semi", F.col("lit_id"), KEY_LIMIT), "anchors")
    held = lookup_join(pieces, stored(anchors.select("key").distinct(), "held"), ["key"], "left_semi", F.col(id_col), KEY_LIMIT).distinct()
    candidates = lookup_join(held, anchors, ["key"], "inner", F.col(id_col), KEY_LIMIT).drop("key")
    return candidates.join(texts, id_col).filter(F.contains("_text", "needle")).select(id_col, "lit_id")


def _rarest(pieces: DataFrame, uses: DataFrame) -> DataFrame:
    """(lit_id, needle, key): of each literal whose keys are all held by texts the one that fewest hold."""
    return (
        pieces.join(uses, "key", "left")
        .groupBy("lit_id", "needle")
        .agg(F.min(F.when(F.col("uses").isNotNull(), F.struct("uses", "key"))).alias("rarest"), F.bool_and(F.col("uses").isNotNull()).alias("held"))
        .filter("held")
        .select("lit_id", "needle", F.col("rarest.key").alias("key"))
    )


def match_regexes(
    texts: DataFrame,
    id_col: str,
    text_col: str,
    regexes: DataFrame,
    page_size: int = INLINE_LIMIT,
) -> DataFrame | None:
    """(id_col, lit_id) for each pattern found in each text, or None when there is no pattern.

    Expressions with a required literal of three letters or more meet the texts through :func:`match_literals`, in one
    pass however many they are, and only what meets is tested; the others are tested on every text, page by page.
    """
    found = []
    literals_of = F.udf(required_literals, "array<string>")
    sought = regexes.select("lit_id", literals_of("needle").alias("must"), F.col("needle").alias("regex"))
    if regexes.limit(INLINE_LIMIT + 1).count() > INLINE_LIMIT:
        sought = stored(sought, "regexes")
    is_filed = F.coalesce(F.length(F.get("must", F.lit(0))) >= _GRAM, F.lit(False))
    for page in pages(sought.filter(~is_filed).select("lit_id", "regex"), ["lit_id"], page_size or INLINE_LIMIT):
        tests = F.array_compact(F.array(*[F.when(F.col(text_col).rlike(r.regex), F.lit(r.lit_id)) for r in page]))
        found.append(texts.select(id_col, F.explode_outer(tests).alias("lit_id")).filter("lit_id is not null"))
    filed = sought.filter(is_filed)
    if not filed.isEmpty():
        met = match_literals(texts, id_col, text_col, filed.select("lit_id", F.get("must", F.lit(0)).alias("needle")), page_size)
        if filed.limit(KEY_LIMIT + 1).count() > KEY_LIMIT:  # only what meets a text is taken from a long list
            met = stored(met, "met")
            filed = lookup_join(filed, met.select("lit_id").distinct(), ["lit_id"], "left_semi", F.col("lit_id"), KEY_LIMIT)
        tested = met.join(filed, "lit_id").join(texts.select(id_col, F.col(text_col).alias("_tested")), id_col)
        holds = F.forall("must", lambda m: F.contains(F.col("_tested"), m)) & F.rlike("_tested", F.col("regex"))
        found.append(tested.filter(holds).select(id_col, "lit_id"))
    merged = found[0] if found else None
    for part in found[1:]:
        merged = merged.unionByName(part)
    return merged
