"""Secret scan in DataFrame operations only: fixed patterns, and Shannon entropy in windows that slide over candidates.

Positions come from the pieces between the matches, so they are exact code points. A candidate is a run of at least
``WINDOW`` token characters with a letter and a digit, or of letters only; its class decides the threshold. The entropy of the window is kept
up to date by the counts of the one character that leaves and the one that enters. Windows that hold a run of one
character or an alphabet do not count; candidates that the rest of the allow-list names as a whole and those that touch a pattern's span are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.text import bind

#: Kinds in order with their patterns. Letters of the words in either case.
KINDS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: Group and its least length of a match that counts.
LEAST = {"assign": (2, 12), "access": (0, 18), "hex": (0, 16)}
#: Runs shorter than the least length never count for this kind, so they need not be found one by one.
QUICK = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Least entropy in bits for a window, by class; no value that a window can take lies near them.
THRESHOLDS = {"hex": 2.93, "decimal": 2.61, "letters": 3.73, "mixed": 3.73}
#: Candidates that are no secrets: identifiers in the canonical form, integrity hashes, placeholders, running alphabets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^sha(256|384|512)-", r"(?i)example|sample|placeholder|changeme|dummy",
    r"([A-Za-z0-9])\1{5,}", r"(?i)abcdefgh|0123456789|qwertyui",
)
#: The first of them judge a whole candidate. The others only judge windows: each match is cut so that no piece holds all of it
#: and each window without a match lies in a piece.
_WHOLE = ALLOWED[:3]
_CUTS = (
    (r"([A-Za-z0-9])\1{5,}", "$1$1$1$1$1 $1$1$1$1$1"), (r"(?i)(a)(bcdefg)(h)", "$1$2 $2$3"),
    (r"(0)(12345678)(9)", "$1$2 $2$3"), (r"(?i)(q)(wertyu)(i)", "$1$2 $2$3"),
)
_CHUNK = 512
#: Characters of a candidate; counts of ten of them share one number.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_PACK = 10


def _running(parts: Column) -> Column:
    """Spans (first, rank, last, kind) from parts (gap, size, ok, rank, kind): positions add up, failing ones are dropped.

    Two levels, a chunk and the row of chunks, keep the copying of the growing arrays far from quadratic.
    """
    none = "array<struct<first:bigint,rank:int,last:bigint,kind:string>>"

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + p["gap"]
        last = first + p["size"]
        span = F.struct(first.alias("first"), p["rank"].alias("rank"), last.alias("last"), p["kind"].alias("kind"))
        return F.struct(last.alias("at"), F.when(p["ok"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def chunk(acc: Column, k: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(none).alias("spans"))
        done = F.aggregate(F.slice(parts, k * _CHUNK + 1, F.lit(_CHUNK)), start, step)
        return F.transform(
            F.array(done), lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["chunks"], d["spans"]).alias("chunks"))
        )[0]

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{none}>").alias("chunks"))
    whole = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _CHUNK).cast("int")), zero, chunk)
    return F.when(F.size(parts) > 0, F.flatten(whole["chunks"])).otherwise(F.array().cast(none))


def _parts(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """gap, size, ok, rank, kind of each match, leftmost first; nothing is cut apart in texts without a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), counted.alias("group"))
    made = F.transform(
        F.filter(zipped, lambda z: z["match"].isNotNull()),
        lambda z: F.struct(
            F.length(z["gap"]).cast("long").alias("gap"), F.length(z["match"]).cast("long").alias("size"),
            (F.length(z["group"]) >= least).alias("ok"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
        ),
    )
    empty = F.array().cast("array<struct<gap:bigint,size:bigint,ok:boolean,rank:int,kind:string>>")
    return F.when(text.rlike(pattern), made).otherwise(empty)


def window_entropy(token: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy in bits of any ``window`` (at most 31) consecutive characters.

    The counts of the window are kept up to date as it slides: one number holds those of ten characters of the alphabet,
    five bits each. Characters outside the alphabet share one count.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    unit = F.array(*[F.lit(1 << (5 * k)).cast("long") for k in range(_PACK)])
    places = F.transform(
        F.split(token, ""), lambda c: F.when(F.instr(F.lit(_ALPHABET), c) > 0, F.instr(F.lit(_ALPHABET), c) - 1).otherwise(len(_ALPHABET))
    )

    def count(counts: Column, place: Column) -> Column:
        # Division by a power of two is exact below 2 ** 53.
        return F.pmod(F.floor(F.get(counts, F.floor(place / _PACK).cast("int")) / F.get(unit, place % _PACK)), F.lit(32)).cast("int")

    def changed(counts: Column, place: Column, sign: int) -> Column:
        pack, by = F.floor(place / _PACK).cast("int"), F.get(unit, place % _PACK) * sign
        return F.transform(counts, lambda n, k: F.when(k == pack, n + by).otherwise(n))

    def enter(acc: Column, place: Column) -> Column:
        """acc: counts, sum of c log c over them, and the highest entropy."""
        entering = count(acc["counts"], place)
        total = acc["sum"] + F.get(weight, entering + 1) - F.get(weight, entering)
        return F.struct(changed(acc["counts"], place, 1).alias("counts"), total.alias("sum"), acc["high"].alias("high"))

    def leave(acc: Column, place: Column) -> Column:
        leaving = count(acc["counts"], place)
        total = acc["sum"] + F.get(weight, leaving - 1) - F.get(weight, leaving)
        return F.struct(changed(acc["counts"], place, -1).alias("counts"), total.alias("sum"), acc["high"].alias("high"))

    def highest(acc: Column) -> Column:
        high = F.greatest(acc["high"], F.lit(math.log2(window)) - acc["sum"] / window)
        return F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum"), high.alias("high"))

    def slide(acc: Column, i: Column) -> Column:
        gone = bind(acc, lambda a: leave(a, F.get(places, i - window)))
        return bind(bind(gone, lambda a: enter(a, F.get(places, i))), highest)

    packs = len(_ALPHABET) // _PACK + 1
    none = F.struct(F.array(*[F.lit(0).cast("long")] * packs).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("high"))

    def over(places_once: Column) -> Column:
        nonlocal places
        places = places_once
        first = F.aggregate(F.slice(places, 1, window), none, enter)
        rest = F.sequence(F.lit(window), F.size(places) - 1)
        slid = F.when(F.size(places) > window, F.aggregate(rest, bind(first, highest), slide)["high"])
        return F.when(F.size(places) < window, 0.0).otherwise(F.coalesce(slid, bind(first, highest)["high"]))

    return bind(places, over)


def _suspicious(token: Column) -> Column:
    """Whether the entropy of a window of a candidate reaches the threshold of its class and nothing allows it."""
    allowed = F.lit(False)
    for pattern in _WHOLE:
        allowed = allowed | token.rlike(pattern)
    least = (
        F.when(token.rlike("^[0-9]+$"), F.lit(THRESHOLDS["decimal"]))
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(THRESHOLDS["hex"]))
        .when(token.rlike("^[A-Za-z]+$"), F.lit(THRESHOLDS["letters"]))
        .otherwise(F.lit(THRESHOLDS["mixed"]))
    )
    plausible = ((token.rlike("[0-9]") & token.rlike("[A-Za-z]")) | token.rlike("^[A-Za-z]+$")) & ~allowed
    pieces = token
    for pattern, cut in _CUTS:
        pieces = F.regexp_replace(pieces, F.lit(pattern), F.lit(cut))
    long = F.filter(F.split(pieces, " "), lambda p: F.length(p) >= WINDOW)
    return F.when(plausible, F.exists(long, lambda p: window_entropy(p) >= least)).otherwise(F.lit(False))


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, base and added (arrays of first, rank, last, kind; code points, end exclusive) for every row.

    A null text counts as empty; empty texts have no spans; repeated rows get equal results. Other columns are not read.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        group, least = LEAST[kind]
        rows = rows.withColumn(f"p_{kind}", _parts(text, kind, rank, QUICK.get(kind, pattern), group, least))
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    zipped = F.arrays_zip(F.split(text, CANDIDATE, -1).alias("gap"), found.alias("match"))
    candidates = F.transform(
        F.filter(zipped, lambda z: z["match"].isNotNull()),
        lambda z: F.struct(
            F.length(z["gap"]).cast("long").alias("gap"), F.length(z["match"]).cast("long").alias("size"),
            _suspicious(z["match"]).alias("ok"), F.lit(len(KINDS)).alias("rank"), F.lit("entropy").alias("kind"),
        ),
    )
    empty = F.array().cast("array<struct<gap:bigint,size:bigint,ok:boolean,rank:int,kind:string>>")
    rows = rows.withColumn("p_entropy", F.when(text.rlike(CANDIDATE), candidates).otherwise(empty))
    rows = rows.select("doc_id", *[_running(F.col(f"p_{k}")).alias(k) for k in (*KINDS, "entropy")])
    rows = rows.select("doc_id", "entropy", F.sort_array(F.concat(*KINDS)).alias("base"))
    free = F.filter("entropy", lambda e: ~F.exists("base", lambda b: (b["first"] < e["last"]) & (e["first"] < b["last"])))
    return rows.select("doc_id", "base", free.alias("added"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ","
    )


def secret_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and added ones by start, then kind), n_added."""
    found = find_secrets(documents)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(kind) for kind in KINDS], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
