import unicodedata

import pytest
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import links as L, text as X
from wardline.operators import linkage
from wardline.sources import refdata


def test_normalize_text_matches_unicode_rules(apply_column):
    samples = ["ﬁne  Straße ½", "O’zbek Ё ёлка", "  a\t\nb  ", "İSTANBUL", "", "plain `quote`", "a b　c"]

    def expected(s):
        s = unicodedata.normalize("NFKC", s)
        for c in V.APOSTROPHE_VARIANTS:
            s = s.replace(c, "'")
        return " ".join(s.replace("ё", "е").replace("Ё", "е").casefold().split())

    assert apply_column(X.normalize_text, samples) == [expected(s) for s in samples]


def test_normalize_output_drops_hidden_characters(apply_column):
    assert apply_column(X.normalize_output, ["s​c*a*m", "~`x`"]) == ["scam", "x"]


@pytest.mark.parametrize(
    "text,fallback,expected",
    [
        ("Пришлите код прямо сейчас", "uz_latn", "ru"),
        ("Кодни юборинг, илтимос", "ru", "uz_latn"),
        ("Тўлов ўтмади", "ru", "uz_latn"),
        ("номер вашей карта", "ru", "uz_latn"),  # a word both languages share
        ("Salom, pulni yuboring", "ru", "uz_latn"),
        ("Hello there friend", "ru", "ru"),
        ("12345 !!!", "uz_latn", "uz_latn"),
    ],
)
def test_resolve_language(apply_column, text, fallback, expected):
    assert apply_column(lambda t: X.resolve_language(t, F.lit(fallback)), [text]) == [expected]


def test_detector_needs_probability(apply_column):
    sure = lambda p: lambda t: X.resolve_language(t, F.lit("ru"), F.lit("uz"), F.lit(p))
    assert apply_column(sure(0.75), ["hello world"]) == ["uz_latn"]
    assert apply_column(sure(0.74), ["hello world"]) == ["ru"]


def test_chatter_key(apply_column):
    samples = ["  Bot, Привет!!! ", "bot: salom ", "salom   do'st…", "botanik"]
    assert apply_column(lambda t: X.chatter_key(t, ("bot",)), samples) == ["привет", "salom", "salom do'st", "botanik"]


def test_assemble_content_keeps_first_of_equal_parts(spark):
    row = spark.range(1).select(
        X.assemble_content(F.lit(" a "), F.lit("b"), F.lit("a"), F.lit(None).cast("string"), F.lit(" ")).alias("c")
    ).first()
    assert row.c == "a\nb"


LINKS = [
    ("https://payme.uz/pay", "payme.uz", None),
    ("hxxps://payme[.]uz.", "payme.uz", None),
    ("https://click.uz@evil.example/x", "evil.example", "credentials-in-url"),
    ("https://:@evil.example", "evil.example", None),
    ("http://192.0.2.7:8080/a", "192.0.2.7", "ip-address"),
    ("http://[2001:db8::1]", "2001:db8::1", "ip-address"),
    ("http://[2001:db8::1]).", "2001:db8::1", "ip-address"),
    ("http://[nope]/", None, None),
    ("http://[::1", None, None),
    ("https://BIT.ly/abc", "bit.ly", "shortened"),
    ("paymee.example", "paymee.example", "lookalike-domain"),
    ("https://pay.click.uz", "pay.click.uz", None),
    ("https://login-telegram.example", "login-telegram.example", "lookalike-domain"),
    ("https://раyme.uz", "раyme.uz", "lookalike-domain"),
    ("https://%70ayme.example", "payme.example", "lookalike-domain"),
    ("https://a%2Fb.example", None, None),
    ("https://a%zz.example", None, None),
    ("https://a%ff.example", None, None),
    ("shop.uz.other-site.example", "shop.uz.other-site.example", "domain-in-subdomain"),
    ("https://tеst.example", "tеst.example", "mixed-script-domain"),
    ("www.olx.uz", "olx.uz", None),
    ("https://olxshop.example", "olxshop.example", "lookalike-domain"),
    ("https://xn--e1afmkfd.example", "пример.example", "mixed-script-domain"),
    ("HTTPS://WWW.Example.COM.", "example.com", None),
    ("foo/bar://x", None, None),
]


def test_describe_and_classify_links(apply_column):
    raw = [case[0] for case in LINKS]
    assert apply_column(L.normalize_domain, raw) == [case[1] for case in LINKS]
    assert apply_column(lambda u: L.classify_link(u), raw) == [case[2] for case in LINKS]


def test_catalog_sites_are_never_flagged(apply_column):
    own = [f"https://{d}/" for ds in V.BRAND_DOMAINS.values() for d in ds]
    assert set(apply_column(lambda u: L.classify_link(u), own)) == {None}


def test_large_catalog_path_agrees(spark):
    catalog = refdata.base_catalog(spark)
    links = spark.createDataFrame([(c[0],) for c in LINKS], "raw_url string")
    args = (catalog["brands"], catalog["shorteners"], catalog["nested_suffixes"])
    inline = {tuple(r) for r in linkage.classify_links(links, *args).select("raw_url", "label").collect()}
    joined = {tuple(r) for r in linkage.classify_links(links, *args, limit=0).select("raw_url", "label").collect()}
    assert inline == joined == {(c[0], c[2]) for c in LINKS}


def test_extract_urls_skips_mail_hosts(apply_column):
    text = "ask ann@mail.example or see payme[.]uz, http://a.example/x(1) and www.b.example/y)."
    assert apply_column(L.extract_urls, [text, "no link here"]) == [
        ["payme[.]uz", "http://a.example/x", "www.b.example/y"],
        [],
    ]


def test_message_domains_are_unique_in_order(apply_column):
    assert apply_column(L.message_domains, ["b.example https://www.a.example/1 B.example"]) == [["b.example", "a.example"]]


def test_feed_and_blocklist(spark):
    lines = spark.createDataFrame(
        [("# list", "f"), ("hxxp://Bad[.]example/x,2024", "f"), ("www.bad.example", "f"), ("worse.example", "g")],
        "value string, source string",
    )
    hashes = linkage.parse_threat_feed(lines)
    assert hashes.count() == 2
    t = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    first = linkage.upsert_blocklist(
        hashes.select("domain_hash", "source", t(1).alias("first_seen"), t(1).alias("last_seen")).limit(0), hashes, t(1)
    )
    second = linkage.upsert_blocklist(first, hashes.filter("source = 'g'"), t(3))
    seen = {r.source: (r.first_seen.day, r.last_seen.day) for r in second.collect()}
    assert seen == {"f": (1, 1), "g": (1, 3)}
    messages = spark.createDataFrame([(1, "go to WORSE.example or bad.example"), (2, "fine.example")], "msg_id int, text string")
    hit = linkage.reputation_hits(messages, second).collect()
    assert [(r.msg_id, r.sources, str(r.listed_since), r.severity) for r in hit] == [(1, ["f", "g"], "2024-01-01", 3)]
