"""The posting index against plain search, required literals of expressions, and labels of large catalogs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wardline import schemas
from wardline.functions import links as L
from wardline.functions.redact import minimize_answer, minimize_strict
from wardline.functions.signals import link_signals
from wardline.operators import linkage, rules as RU
from wardline.operators.matching import contained, lookup_table, match_regexes, required_literals
from wardline.sources import refdata


@pytest.mark.parametrize(
    "regex, literals",
    [
        ("abc", ["abc"]), ("ab+c", ["ab", "c"]), (r"\d+ сум", [" сум"]), ("(?i)abc", []), ("a|b", []), ("(ab|cd) hello?world", [" hell", "world"]),
        ("x{2,3}yz", ["yz", "x"]), ("ab{0,3}xyz", ["xyz", "a"]), ("a[^b]cde", ["cde", "a"]), (r"foo\.bar", ["foo.bar"]), ("([bad", []),
        ("foo (a|b) longer", [" longer", "foo "]), (r"\p{L}abc", []), (r"q\Qa.b\E", []), ("(?<n>ab)cd", ["cd"]), ("(x(?i)y)z", []),
        ("lazy+?tail", ["lazy", "tail"]), ("[]a]bc", ["bc"]), ("[a&&[b]]cd", []), ("ab$", ["ab"]), (r"a\b\-b", ["-b", "a"]), ("", []), ("(?:a)?", []),
    ],
)
def test_required_literals(regex, literals):
    assert required_literals(regex) == literals


def test_required_literals_are_in_every_match():
    """Random expressions and texts: where an expression matches, all its required literals are there."""
    chance, matched = random.Random(4), 0
    pieces = ["ab", "c", "d+", "e?", "[fg]", "(hi|jk)", r"\s", "l{2}", "m{0,1}", r"\.", "n*", ".", "(?:op)+"]
    for _ in range(3000):
        regex = "".join(chance.choice(pieces) for _ in range(chance.randrange(1, 5)))
        text = "".join(chance.choice("abcdefghijklmnop .") for _ in range(60))
        if re.search(regex, text):
            matched += 1
            assert all(x in text for x in required_literals(regex))
    assert matched > 300


def test_contained_equals_search(spark):
    chance = random.Random(9)
    words = ["".join(chance.choice("abcде") for _ in range(chance.randrange(1, 12))) for _ in range(60)]
    texts = [" ".join(chance.choice(words) for _ in range(chance.randrange(0, 40))) for _ in range(80)] + ["", None, " ", "a"]
    patterns = []
    for text in texts[:60]:
        if text and len(text) > 20:
            start = chance.randrange(len(text) - 15)
            patterns.append((text[start : start + chance.randrange(1, 40)], False))
    patterns += [(w, False) for w in words[:20]] + [(f"{a} {b}", False) for a, b in zip(words, words[1:])] + [("not there", False), ("zzzz", False)]
    patterns += [(rf"{re.escape(a)}\s+{re.escape(b)}", True) for a, b in zip(words, words[2:])] + [("[ab]{3}c", True), ("d+e?д", True), ("a|e", True)]
    patterns = [(p, r) for p, r in dict.fromkeys(patterns) if p]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, found in df.select("i", contained(F.col("t"), patterns)).collect():
        text = texts[i]
        wanted = [] if text is None else [k for k, (p, r) in enumerate(patterns) if (re.search(p, text) if r else p in text)]
        assert sorted(found) == wanted
    assert df.select(F.max(F.size(contained(F.col("t"), [])))).first()[0] == 0


def test_lookup_table(spark):
    table = lookup_table({f"k{i}": [i, i + 1] for i in range(50)} | {"é": []}, "array<int>")
    rows = spark.createDataFrame([("k7",), ("k77",), ("é",), ("",), (None,)], "k string").select("k", table(F.col("k")).alias("v")).collect()
    assert {r["k"]: r["v"] for r in rows} == {"k7": [7, 8], "k77": [], "é": [], "": [], None: None}


def test_regexes_meet_texts_in_one_pass(spark):
    texts = spark.createDataFrame([(i, f"order {i} of shop{i % 7} paid") for i in range(40)], "i long, t string")
    regexes = spark.createDataFrame(
        [(k, rf"order\s+{k}\s+of") for k in range(30)] + [(100, "shop[12] "), (101, r"\d\d"), (102, "paid$"), (103, "nothing here")], "lit_id long, needle string"
    )
    found = {tuple(r) for r in match_regexes(texts, "i", "t", regexes).collect()}
    wanted = {(i, i) for i in range(30)} | {(i, 100) for i in range(40) if i % 7 in (1, 2)} | {(i, 101) for i in range(10, 40)} | {(i, 102) for i in range(40)}
    assert found == wanted


def test_pack_is_evaluated_once(spark):
    """No filter on the size of the hits is inferred, and nothing leaves the JVM."""
    rule = (0, "fs.pay", "fam", "desc", "key", 2, None, {"ru": ["предоплата за товар", "на карту", "regex:сумма\\s+\\d+"]})
    patterns = RU.flatten_rules(spark.createDataFrame([rule], schemas.RULES))
    messages = spark.createDataFrame([(1, "Предоплата за товар"), (2, "сумма 5"), (3, None)], "msg_id int, text string")
    hits = RU.rule_hits(messages, patterns)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan.split("Generate")[1].split("Project")[0] and "Python" not in plan
    assert {r.msg_id for r in hits.collect()} == {1, 2}


def test_labels_of_a_large_catalog(spark):
    """Links looked up in tables give what the catalog in the plan gives, whatever surrounds them."""
    base = refdata.base_catalog(spark)
    tables = {"brands": base["brands"], "shorteners": base["shorteners"], "suffixes": base["nested_suffixes"]}
    texts = [
        "see https://click.uz@evil.example/pay, or bit.ly/x1.", "mail a.b@payme-uz.example now", "hxxps://click[.]uz.evil.example/a) and http://192.0.2.7/",
        "t: https://t.me/some_name and www.payme.uz!", "click.uz", "", None, "nothing", "https://сlick.uz/x (bit.ly/y), https://paymee.example", "user@click.uz/path bit.ly/z",
    ]
    rows = [(k % 9 if k % 4 else None, t) for k, t in enumerate([*texts, *texts[:2]])]
    df = spark.createDataFrame(rows, "msg_id int, text string")
    labelled = linkage.with_link_labels(df, tables, limit=0)
    assert labelled.columns == ["msg_id", "text", "link_labels"] and labelled.count() == len(rows)
    for make in (minimize_strict, minimize_answer, link_signals):
        got = labelled.select("text", make(F.col("text"), L.LinkLabels(F.col("link_labels"))).alias("x")).distinct().collect()
        want = df.select("text", make(F.col("text")).alias("x")).distinct().collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_stored_lookups_are_not_shuffled_again(spark):
    """Flags per domain, listed hashes and consent as bucketed tables: same rows, and one shuffle, that of the big side."""
    from wardline.operators import events as EV
    from wardline.operators.common import store_lookup

    base = refdata.base_catalog(spark)
    tables = (base["brands"], base["shorteners"], base["nested_suffixes"])
    urls = ["click.uz.evil.example/a", "bit.ly/x", "payme-uz.example", "click.uz", "https://x@y.example", "other.example", "other.example/b"]
    links = spark.createDataFrame([(k, u) for k, u in enumerate(urls * 3)], "msg_id int, raw_url string")
    messages = spark.createDataFrame([(k, f"see {u}", f"u{k % 4}") for k, u in enumerate(urls * 2)], "msg_id int, text string, user_key string")
    listed = spark.createDataFrame([("other.example", "a"), ("other.example", "b"), ("bit.ly", "a")], "d string, source string").select(
        L.hash_domain(F.col("d")).alias("domain_hash"), "source", F.lit("2024-01-01").cast("timestamp").alias("first_seen")
    )
    consent = spark.createDataFrame([("u0", "v2"), ("u1", "v1"), ("u2", "v2")], "user_key string, notice_version string")
    flags = store_lookup(linkage.domain_flags(linkage.described_links(links), *tables), "wardline_flags", ["domain"], 4, 3)
    hashes = store_lookup(linkage.listed_hashes(listed), "wardline_listed", ["domain_hash"], 4, 3)
    agreed = store_lookup(EV.current_consent(consent, "v2"), "wardline_consent", ["user_key"], 4, 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = [
            (linkage.classify_links(links, *tables, flags=flags), linkage.classify_links(links, *tables), 1),
            (linkage.reputation_hits(messages, hashes), linkage.reputation_hits(messages, listed), 2),  # the second brings hits together by message
            (EV.consent_gate(messages, agreed, "v2")["pass"], EV.consent_gate(messages, consent, "v2")["pass"], 1),
        ]
        for stored, plain, shuffles in pairs:
            assert sorted(map(repr, stored.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
            assert stored._jdf.queryExecution().sparkPlan().toString() and stored._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == shuffles
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("wardline_flags", "wardline_listed", "wardline_consent"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
