"""Text normalisation and triage as column expressions that stay in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from wardline import fixed_values as V

_NON_ASCII = r"[^\x00-\x7F]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def constant(value, schema: str) -> Column:
    """A nested Python value as one literal: the plan stays small however long the value is."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), F.lit(schema))


def any_of(conditions: list[Column]) -> Column:
    """OR of conditions as a balanced tree, so that long lists stay shallow."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        pairs = [conditions[i : i + 2] for i in range(0, len(conditions), 2)]
        conditions = [p[0] | p[1] if len(p) == 2 else p[0] for p in pairs]
    return conditions[0]


def may_hold_phone(text: Column) -> Column:
    """Cheap test that has to be true for any phone number: nine digits close together, or a plus before a digit."""
    return text.rlike(r"(?U)\d(?:\D{0,2}\d){8}") | (text.contains("+") & text.rlike(r"(?U)\+\d"))


def may_hold_card(text: Column) -> Column:
    """The same for thirteen digits of a card."""
    return text.rlike(r"(?U)\d(?:[ -]?\d){12}")


def nfkc(text: Column) -> Column:
    """NFKC through the ICU library Spark ships; pure-ASCII values skip the call."""
    return bind(text, lambda t: F.when(t.rlike(_NON_ASCII), _compose(t)).otherwise(t))


def _compose(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def casefold(text: Column) -> Column:
    """Full Unicode case folding; pure-ASCII values take the cheap route."""
    def fold(t: Column) -> Column:
        folded = F.reflect(
            F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), t, F.lit(True)
        )
        return F.when(t.rlike(_NON_ASCII), folded).otherwise(F.lower(t))

    return bind(text, fold)


def strip(text: Column) -> Column:
    """Trim every kind of whitespace on both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_text(text: Column) -> Column:
    """Matching form: NFKC, one apostrophe, yo as ye, casefold, single spaces, trimmed."""
    # One character map for apostrophes, yo and odd whitespace; a pattern would cost several times more.
    plain = F.translate(
        nfkc(text),
        V.APOSTROPHE_VARIANTS + "ёЁ" + V.ODD_SPACES,
        "'" * len(V.APOSTROPHE_VARIANTS) + "ее" + " " * len(V.ODD_SPACES),
    )
    return F.trim(F.regexp_replace(casefold(plain), " {2,}", " "))


def normalize_output(text: Column) -> Column:
    """Scan form of an answer: NFKC without format controls and emphasis marks."""
    visible = F.regexp_replace(nfkc(text), r"\p{Cf}", "")
    return F.translate(visible, "*~`", "")


def assemble_content(*parts: Column) -> Column:
    """Join trimmed, non-empty, distinct fragments by newline, in order."""
    trimmed = F.array(*[strip(F.coalesce(p, F.lit(""))) for p in parts])
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda p: p != "")), "\n")


def script_word_counts(text: Column) -> Column:
    """struct(cyrillic, latin): number of words in each script."""
    return F.struct(
        F.regexp_count(text, F.lit(V.CYRILLIC_WORD)).alias("cyrillic"),
        F.regexp_count(text, F.lit(V.LATIN_WORD)).alias("latin"),
    )


def resolve_language(
    text: Column,
    fallback: Column,
    detected: Column | None = None,
    probability: Column | None = None,
) -> Column:
    """Reply language by script majority, Uzbek markers, an optional detector, then fallback."""
    sure = F.lit(None).cast("string")
    if detected is not None:
        prob = F.lit(1.0) if probability is None else probability
        sure = F.when(prob >= V.DETECTOR_MIN_PROBABILITY, detected)

    def decide(padded: Column) -> Column:
        uzbek_cyrillic = padded.rlike(V.UZ_CYRILLIC_LETTER) | any_of(
            [padded.contains(w) for w in V.UZ_CYRILLIC_WORDS]
        )
        uzbek_latin = any_of([padded.contains(m) for m in V.UZ_LATIN_MARKERS])
        cyrillic = (
            F.when(uzbek_cyrillic, "uz_latn")
            .when(sure == "ru", "ru")
            .when(sure == "uz", "uz_latn")
            .when(fallback == "uz_latn", "ru")
            .otherwise(fallback)
        )
        latin = F.when(uzbek_latin, "uz_latn").when(sure == "uz", "uz_latn").otherwise(fallback)
        return bind(
            script_word_counts(padded),
            lambda n: F.when(n.cyrillic > n.latin, cyrillic)
            .when(n.latin > n.cyrillic, latin)
            .otherwise(fallback),
        )

    return bind(F.concat(F.lit(" "), casefold(text), F.lit(" ")), decide)


def chatter_key(text: Column, address_words: tuple[str, ...] = ()) -> Column:
    """Form compared with the chatter phrase list; ``address_words`` may open a message."""
    key = casefold(strip(text))
    if address_words:
        key = F.regexp_replace(key, rf"(?U)^(?:{'|'.join(address_words)})[,:\s]+", "")
    key = F.regexp_replace(key, r"(?U)[?!.,;:…\s]+$", "")
    return F.trim(F.regexp_replace(key, V.WHITESPACE, " "))


def length_status(text: Column, input_type: Column, limit: int = V.MAX_TEXT_CHARS) -> Column:
    """Null when the length is fine, otherwise the terminal status."""
    too_long = F.when(input_type == "image", "low_ocr").otherwise("unsupported_media")
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, "empty_input").when(
        F.length(text) > limit, too_long
    )
