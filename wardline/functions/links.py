"""Link shape analysis as column expressions; nothing is ever fetched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from wardline import fixed_values as V
from wardline.functions.text import bind, casefold, constant, nfkc

_BRACKETED = r"(?:[^/?#]*?://)?(?:[^/?#]*@)?\[[^\]@/?#]*\]"
_TAIL = rf"[{V.TRAILING_PUNCTUATION}]*"


@dataclass(frozen=True)
class Catalog:
    """Reviewed brand domains, shorteners and suffixes, small enough to sit in an expression."""

    brands: tuple[tuple[str, tuple[str, ...]], ...]
    shorteners: tuple[str, ...]
    nested_suffixes: tuple[str, ...]


@dataclass(frozen=True)
class LinkLabels:
    """Labels looked up beforehand, for catalogs of any size: a map column from a link without trailing punctuation to its label.

    A link without an entry has no label.
    """

    labels: Column


BASE_CATALOG = Catalog(
    tuple((b, d) for b, d in V.BRAND_DOMAINS.items()), V.SHORTENERS, V.NESTED_SUFFIXES
)


def may_hold_link(text: Column) -> Column:
    """Cheap test that has to be true for any link; spares the full pattern most messages."""
    return text.rlike(r"(?U)[^\s][.\])][^\s]|://")


def find_spans(text: Column) -> Column:
    """Every URL-shaped span, e-mail halves included."""
    return F.when(may_hold_link(text), F.regexp_extract_all(text, F.lit(V.URL), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def extract_urls(text: Column) -> Column:
    """URL-shaped spans in order, leaving out a span right after ``@``."""
    return F.when(text.contains("@"), _extract_after_at(text)).otherwise(find_spans(text))


def _extract_after_at(text: Column) -> Column:
    # A span is dropped after it matched, so the text between spans tells what precedes each one.
    spans = find_spans(text)
    gaps = F.split(text, V.URL, -1)
    return bind(
        F.struct(spans.alias("spans"), gaps.alias("gaps")),
        lambda s: F.filter(s.spans, lambda _, i: ~F.get(s.gaps, i).endswith("@")),
    )


def trim_trailing(value: Column) -> Column:
    """Drop prose punctuation after a link but keep the bracket of a bare IPv6 host."""
    text = F.trim(value)
    bracketed = F.regexp_extract(text, rf"^({_BRACKETED}){_TAIL}$", 1)
    return F.when(bracketed != "", bracketed).otherwise(F.regexp_replace(text, rf"{_TAIL}$", ""))


def is_ip(domain: Column) -> Column:
    """Literal IPv4 or IPv6 host."""
    return F.regexp_replace(domain, r"^[\[\]]+|[\[\]]+$", "").rlike(rf"^(?:{V.IPV4}|{V.IPV6})$")


def script_count(domain: Column) -> Column:
    """How many of latin, cyrillic, greek and other scripts a host uses."""
    return (
        domain.rlike("[a-z]").cast("int")
        + domain.rlike("[Ѐ-ӿ]").cast("int")
        + domain.rlike("[Ͱ-Ͽ]").cast("int")
        + domain.rlike(r"(?U)[^\x00-\x7fЀ-ӿͰ-Ͽ\d]").cast("int")
    )


def fold_confusables(domain: Column) -> Column:
    """Lookalike Cyrillic and Greek letters as ASCII."""
    return F.translate(domain, V.CONFUSABLE_LETTERS, V.CONFUSABLE_ASCII)


def describe_link(raw: Column) -> Column:
    """struct(domain, has_userinfo, is_ip, mixed_script); the domain is null when malformed."""

    def absolute(core: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(core, r"\[\.\]|\(\.\)", "."), r"(?i)^hxxp", "http")
        return F.when(plain.contains("://"), plain).otherwise(F.concat(F.lit("https://"), plain))

    def authority(url: Column) -> Column:
        return F.regexp_extract(
            F.regexp_replace(url, r"[\t\r\n]", ""), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1
        )

    def parts(netloc: Column) -> Column:
        host_port = F.regexp_extract(netloc, r"(?s)^(?:.*@)?([^@]*)$", 1)
        bracket = F.regexp_extract(host_port, r"^\[([^\[\]]*)\](?::.*)?$", 1)
        has_bracket = netloc.contains("[") | netloc.contains("]")
        bad = has_bracket & ~bracket.rlike(rf"^{V.IPV6}$")
        host = F.when(has_bracket, bracket).otherwise(F.regexp_extract(host_port, r"^([^:]*)", 1))
        user = F.regexp_extract(netloc, r"(?s)^(.*)@[^@]*$", 1)
        return F.struct(
            bad.alias("bad"),
            (~bad & (user != "") & (user != ":")).alias("has_userinfo"),
            F.lower(host).alias("host"),
        )

    def decoded(host: Column) -> Column:
        plain = F.when(
            host.contains("%"), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))
        ).otherwise(host)
        return bind(plain, lambda h: F.when(~h.rlike(r"(?U)[\s\x00-\x1f/?#@\\\[\]%�]"), h))

    def unicode_form(host: Column) -> Column:
        bare = F.regexp_replace(casefold(F.trim(host, F.lit("."))), r"^www\.", "")
        readable = bind(
            bare,
            lambda d: F.when(
                d.contains("xn--") & ~d.rlike(r"[^\x00-\x7F]"),
                F.reflect(F.lit("java.net.IDN"), F.lit("toUnicode"), d),
            ).otherwise(d),
        )
        return F.nullif(F.trim(casefold(nfkc(readable)), F.lit(".")), F.lit(""))

    def shape(p: Column) -> Column:
        domain = F.when(~p.bad, bind(decoded(p.host), unicode_form))
        return bind(
            domain,
            lambda d: F.struct(
                d.alias("domain"),
                p.has_userinfo.alias("has_userinfo"),
                F.coalesce(is_ip(d), F.lit(False)).alias("is_ip"),
                F.coalesce(script_count(d) > 1, F.lit(False)).alias("mixed_script"),
            ),
        )

    return bind(trim_trailing(raw), lambda c: bind(parts(authority(absolute(c))), shape))


def normalize_domain(raw: Column) -> Column:
    return describe_link(raw).getField("domain")


def has_nested_suffix(domain: Column, suffixes: tuple[str, ...]) -> Column:
    """A public suffix used as an interior label."""
    return bind(
        F.split(domain, r"\."),
        lambda labels: F.arrays_overlap(
            F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))),
            constant(list(suffixes), "array<string>"),
        ),
    )


def is_allowed(domain: Column, allowed: Column) -> Column:
    """Equal to, or a subdomain of, one of the allowed domains."""
    return F.exists(
        allowed, lambda a: (domain == a) | domain.endswith(F.concat(F.lit("."), a))
    )


def resembles_brand(folded: Column, labels: Column, brand: Column) -> Column:
    """Brand inside the folded host, or a label within one edit of a brand of four letters or more."""
    near = (F.length(brand) >= 4) & F.exists(
        labels, lambda label: F.levenshtein(label, brand, 1) >= 0
    )
    return F.contains(folded, brand) | near


def brand_labels(folded: Column) -> Column:
    return F.split(folded, r"[^a-z0-9]+")


def _lookalike(link: Column, catalog: Catalog) -> Column:
    if not catalog.brands:
        return F.lit(False)
    brands = constant(
        [{"brand": b, "domains": list(d)} for b, d in catalog.brands],
        "array<struct<brand:string,domains:array<string>>>",
    )
    folded = fold_confusables(link.domain)
    return bind(
        F.struct(folded.alias("folded"), brand_labels(folded).alias("labels")),
        lambda f: F.exists(
            brands,
            lambda b: ~(~link.mixed_script & is_allowed(link.domain, b.domains))
            & resembles_brand(f.folded, f.labels, b.brand),
        ),
    )


def label_link(link: Column, catalog: Catalog, lookalike: Column | None = None) -> Column:
    """One label per described link, most deceptive first, or null."""
    is_lookalike = _lookalike(link, catalog) if lookalike is None else lookalike
    return (
        F.when(link.domain.isNull(), F.lit(None).cast("string"))
        .when(link.has_userinfo, V.LABEL_CREDENTIALS)
        .when(link.is_ip, V.LABEL_IP)
        .when(
            F.array_contains(constant(list(catalog.shorteners), "array<string>"), link.domain),
            V.LABEL_SHORTENED,
        )
        .when(is_lookalike, V.LABEL_LOOKALIKE)
        .when(has_nested_suffix(link.domain, catalog.nested_suffixes), V.LABEL_DOMAIN_IN_SUBDOMAIN)
        .when(link.mixed_script, V.LABEL_MIXED_SCRIPT)
    )


def classify_link(raw: Column, catalog: Catalog = BASE_CATALOG) -> Column:
    return bind(describe_link(raw), lambda link: label_link(link, catalog))


def span_label(span: Column, catalog: Catalog | LinkLabels) -> Column:
    """Label of a URL-shaped span."""
    if isinstance(catalog, LinkLabels):
        return F.try_element_at(catalog.labels, trim_trailing(span))
    return classify_link(span, catalog)


def message_domains(text: Column) -> Column:
    """Distinct normalised domains of a message, in order of first appearance."""
    return F.array_distinct(F.array_compact(F.transform(extract_urls(text), normalize_domain)))


def hash_domain(domain: Column) -> Column:
    return F.sha2(domain, 256)
