"""Lists too long for a broadcast or for the driver: which of their rows go where."""

from itertools import product

from wardline.operators import common, linkage, matching, rules as RU


def test_a_literal_needs_all_its_pieces(spark):
    pieces = spark.createDataFrame([(1, "abcd", "abc"), (1, "abcd", "bcd"), (2, "abcx", "abc"), (2, "abcx", "bcx")], "lit_id long, needle string, key string")
    uses = spark.createDataFrame([("abc", 5), ("bcd", 2)], "key string, uses long")
    assert [tuple(r) for r in matching._rarest(pieces, uses).collect()] == [(1, "abcd", "bcd")]


def test_long_lists_of_literals_are_not_broadcast(spark, monkeypatch):
    words = ["".join(w) for w in product("ab", repeat=7)]
    literals = spark.createDataFrame(list(enumerate(words)), "lit_id long, needle string")
    texts = spark.createDataFrame([(k, w + words[-k - 1]) for k, w in enumerate(words)] + [(999, "abc"), (1000, None)], "id long, text string")
    want = sorted((r.id, i) for r in texts.collect() for i, w in enumerate(words) if w in (r.text or ""))
    monkeypatch.setattr(matching, "KEY_LIMIT", 20)  # 8 keys, 128 literals, all of them held
    found = matching.match_literals(texts, "id", "text", literals)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") <= 1
    assert sorted(map(tuple, found.collect())) == want


def test_expressions_with_a_literal_stay_off_the_driver(spark, monkeypatch):
    listed = []

    def seen(df, *rest):
        for page in pages(df, *rest):
            listed.extend(r.regex if "regex" in r else r.needle for r in page)
            yield page

    pages = matching.pages
    monkeypatch.setattr(matching, "pages", seen)
    monkeypatch.setattr(RU, "pages", seen)
    expressions = [r"regex:o\s+123", r"regex:safe\s+account", r"regex:\d{4}", "regex:([unclosed"]
    packs = [(k, f"r{k}", "f", "d", "m", 1, None, {"uz_latn": [e]}) for k, e in enumerate(expressions)]
    packed = spark.createDataFrame(packs, "rule_order long, rule_id string, family string, desc string, message_key string, severity int, emits_signal string, match map<string,array<string>>")
    messages = spark.createDataFrame([("a", "O  1234"), ("b", "your safe   account"), ("c", "([unclosed 12"), ("d", None)], "msg_id string, text string")
    found = RU.rule_hits(messages, RU.flatten_rules(packed), inline_limit=0)
    assert sorted((r.msg_id, r.rule_id) for r in found.collect()) == [("a", "r0"), ("a", "r2"), ("b", "r1")]
    assert listed == [r"\d{4}"]


def test_a_long_list_is_cut_down_to_what_texts_hold(spark, monkeypatch):
    """Texts hold all three-letter pieces of all literals, but few of the literals; only these are stored and joined."""
    words = ["".join(w) for w in product("abcde", repeat=5)]
    needles = words + ["abc", "abcd", "abcdeabcd", "abcdeabcdeabcdeabcde", "\U0001f600bcd", "a b"]
    literals = spark.createDataFrame(list(enumerate(needles)), "lit_id long, needle string")
    rows = [(1, " ".join("".join(w) for w in product("abcde", repeat=3))), (2, "x abcdeabcd " + words[700]), (3, "abcdeabcdeabcdeabcde"), (4, "zz\U0001f600bcd"), (5, None), (6, "")]
    texts = spark.createDataFrame(rows, "id long, text string")
    rows_stored, stored = {}, matching.stored

    def seen(df, name):
        table = stored(df, name)
        rows_stored[name] = table.count()
        return table

    monkeypatch.setattr(matching, "KEY_LIMIT", 1000)
    monkeypatch.setattr(matching, "stored", seen)
    found = matching.match_literals(texts, "id", "text", literals)
    assert sorted(map(tuple, found.collect())) == sorted((k, i) for k, t in rows for i, w in enumerate(needles) if w in (t or ""))
    assert rows_stored["anchors"] < 30  # of 3,131


def test_long_packs_of_expressions_give_the_same_hits(spark, monkeypatch):
    expressions = [rf"regex:o\s+{k}" for k in range(1000, 1200)]
    packs = [(k % 150, f"r{k % 150}", "f", "d", "m", 1, None, {"uz_latn": [e, f"literal {k} of many"]}) for k, e in enumerate(expressions)]
    packed = spark.createDataFrame(packs, "rule_order long, rule_id string, family string, desc string, message_key string, severity int, emits_signal string, match map<string,array<string>>")
    messages = spark.createDataFrame([("a", "O  1001 and o 1151"), ("b", "o1002 o 10030"), (None, "a literal 7 of many"), (None, "a literal 7 of many"), ("d", None)], "msg_id string, text string")
    few = sorted(RU.rule_hits(messages, RU.flatten_rules(packed)).collect(), key=str)
    for limit in (20, 5):
        monkeypatch.setattr(matching, "KEY_LIMIT", limit)
        monkeypatch.setattr(RU, "KEY_LIMIT", limit)
        assert sorted(RU.rule_hits(messages, RU.flatten_rules(packed), inline_limit=0).collect(), key=str) == few
    assert {(r.msg_id, r.rule_id) for r in few} == {("a", "r1"), ("b", "r3"), (None, "r7")}


def test_labels_of_many_links_stay_off_the_driver(spark, monkeypatch):
    """Spark would broadcast these lookup sides: their files are small however many rows they hold and repeat."""
    brands = spark.createDataFrame([(f"brand{k}", f"brand{k}.uz") for k in range(9)], "brand string, domain string")
    catalog = {
        "brands": brands, "shorteners": spark.createDataFrame([("bit.ly",)], "domain string"), "suffixes": spark.createDataFrame([("com",)], "label string"),
    }
    texts = [f"see https://brand{k}.example/a and https://bit.ly/{k} or https://brand{k}.uz." for k in range(9)] + ["no link", None, "see https://bit.ly/1"]
    messages = spark.createDataFrame([(None if k == 11 else k, t) for k, t in enumerate(texts)], "msg_id long, text string")
    plain = lambda df: sorted(str((r.msg_id, r.text, sorted(r.link_labels.items()))) for r in df.collect())
    few = plain(linkage.with_link_labels(messages, catalog, limit=0))
    monkeypatch.setattr(common, "INLINE_LIMIT", 1)
    monkeypatch.setattr(linkage, "KEY_LIMIT", 2)
    written, stored = [], linkage.stored

    def seen(df, name):
        written.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name)

    monkeypatch.setattr(linkage, "stored", seen)
    rows = linkage.with_link_labels(messages, catalog, limit=0)
    plans = [*written, ("rows", rows._jdf.queryExecution().executedPlan().toString())]
    assert [name for name, plan in plans if name in ("labels", "rows", "allowed") and "BroadcastHashJoin" in plan] == []
    assert plain(rows) == few
