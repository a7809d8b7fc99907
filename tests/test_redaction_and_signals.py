from pyspark.sql import functions as F

from wardline.functions import redact as R, signals as S, text as X

CASES = [
    ("write to ann.lee@mail.example now", "write to [EMAIL] now"),
    ("see https://t.me/some_user ok", "see [HANDLE] ok"),
    ("see https://bit.ly/abc, ok", "see [LINK: shortened], ok"),
    ("see payme.uz/pay.", "see [LINK]."),
    ("ping @some_user!", "ping [HANDLE]!"),
    ("call +998 90 123-45-67 today", "call [PHONE] today"),
    ("local 901234567 number", "local [PHONE] number"),
    ("password: hunter22", "password: [SECRET]"),
    ("пароль это qwerty", "пароль это [SECRET]"),
    ("sms kod 123456 keldi", "sms kod [CODE] keldi"),
    ("passport AB1234567 here", "passport [PASSPORT] here"),
    ("card 8600 1234 5678 9012 ok", "card [CARD]ok"),  # the separator after the last digit belongs to the run
    ("on Navoiy street 12 building", "on Navoiy [ADDRESS]"),
    ("from Anna Karimova yesterday", "from [NAME] yesterday"),
    ("paid 2024-01-15, total 150 000", "paid 2024-01-15, total 150 000"),
    ("я@user1 текст", "я@user1 текст"),
]


def test_minimize_strict(apply_column):
    assert apply_column(lambda t: R.minimize_strict(t), [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_minimize_is_idempotent_and_leaves_no_identifier(apply_column, spark):
    once = apply_column(lambda t: R.minimize_strict(t), [c[0] for c in CASES])
    assert apply_column(lambda t: R.minimize_strict(t), once) == once
    for test in (S.has_email, S.has_card, S.has_phone):
        assert not any(apply_column(test, once))


def test_minimize_answer_keeps_names_and_links(apply_column):
    text = "Anna Karimova: https://bit.ly/a?phone=+998901234567 mail a.b@c.example or +998901234567"
    expected = "Anna Karimova: https://bit.ly/a?phone=+998901234567 mail [EMAIL] or [PHONE]"
    assert apply_column(lambda t: R.minimize_answer(t), [text, "no link, password: abcd"]) == [
        expected,
        "no link, password: [SECRET]",
    ]


def test_redaction_counts(apply_column):
    (n,) = apply_column(R.redaction_counts, ["[LINK] [LINK: shortened] [CARD] [NAME]"])
    assert (n.link, n.card, n.name, n.email) == (2, 1, 1, 0)


def test_structural_signals(apply_column):
    def found(text):
        (signals,) = apply_column(lambda t: S.structural_signals(t, X.normalize_text(t)), [text])
        return [(s.kind, s.note) for s in signals]

    assert found("bit.ly/a and https://payme.uz and bit.ly/b") == [("link_shortened", "shortened"), ("link", None)]
    assert found("a@b.example") == [("email", None)]
    assert found("@durov +998901234567 kod 12345") == [("handle", None), ("phone", None), ("code", None)]
    assert found("karta 8600123456789012 ga") == [("card", None), ("card_personal", "transfer-to-card phrasing")]
    assert found("nothing at all") == []


def test_null_text_gives_null(spark):
    row = spark.range(1).select(R.minimize_strict(F.lit(None).cast("string")).alias("m")).first()
    assert row.m is None
