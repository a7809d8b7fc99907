"""Link tables, brand lookalikes, catalogs and the domain blocklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline import fixed_values as V
from wardline.functions import links as L
from wardline.functions.redact import labelled_links
from wardline.operators.common import INLINE_LIMIT, StoredLookup, bounded_rows, content_key, lookup_join, salted_join, stored
from wardline.functions.text import bind
from wardline.operators.matching import KEY_LIMIT, lookup_table, match_literals


def message_links(messages: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """(id, position, raw_url) for each link of each message."""
    return messages.select(id_col, F.posexplode(L.extract_urls(F.col("text")))).toDF(
        id_col, "position", "raw_url"
    )


def described_links(links: DataFrame) -> DataFrame:
    """Adds domain, has_userinfo, is_ip and mixed_script to a table with ``raw_url``."""
    return links.withColumn("_shape", L.describe_link(F.col("raw_url"))).select("*", "_shape.*").drop("_shape")


def message_domains(messages: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """(id, position, domain): distinct domains of a message in order."""
    return messages.select(id_col, F.posexplode(L.message_domains(F.col("text")))).toDF(
        id_col, "position", "domain"
    )


def collect_catalog(
    brands: DataFrame, shorteners: DataFrame, suffixes: DataFrame, limit: int = INLINE_LIMIT
) -> L.Catalog | None:
    """The catalog as an expression constant, or None when one of its tables is too large."""
    tables = [bounded_rows(t, limit) for t in (brands, shorteners, suffixes)]
    if any(t is None for t in tables):
        return None
    by_brand: dict[str, list[str]] = {}
    for row in tables[0]:
        by_brand.setdefault(row.brand, []).append(row.domain)
    return L.Catalog(
        tuple(sorted((b, tuple(sorted(d))) for b, d in by_brand.items())),
        tuple(sorted(r.domain for r in tables[1])),
        tuple(sorted(r.label for r in tables[2])),
    )


def domain_ancestors(domain: Column) -> Column:
    """The domain and every parent of it: a.b.c, b.c, c."""
    labels = F.split(domain, r"\.")
    return F.transform(
        labels,
        lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."),
    )


def official_domains(domains: DataFrame, brands: DataFrame) -> DataFrame:
    """(domain, brand) where the domain equals or lies under an allowed domain of the brand.

    The domain's parents meet the catalog in an equi-join, so no pairwise comparison happens.
    """
    parents = domains.select("domain", F.explode(domain_ancestors(F.col("domain"))).alias("parent"))
    allowed = brands.select("brand", F.col("domain").alias("parent"))
    # Only the catalog's rows that some domain lies under are repeated per salt.
    allowed = stored(lookup_join(allowed, parents.select("parent").distinct(), ["parent"], "left_semi", F.col("brand"), KEY_LIMIT), "allowed")
    return lookup_join(parents, allowed, ["parent"], "inner", F.col("domain"), KEY_LIMIT).select("domain", "brand").distinct()


def shortened_domains(domains: DataFrame, shorteners: DataFrame) -> DataFrame:
    return domains.join(shorteners.select("domain").distinct(), "domain", "left_semi")


def _one_edit_keys(word: Column) -> Column:
    """The word and each form with one character removed: words within one edit share one."""
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))),
        lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1)),
    )
    return F.array_distinct(F.concat(F.array(word), cut))


def brand_lookalikes(domains: DataFrame, brands: DataFrame) -> DataFrame:
    """(domain, brand) for hosts that hold or nearly spell a brand they do not belong to.

    ``domains``: domain, mixed_script. Works for brand lists of any size: containment goes through
    the literal matcher and near spellings through an equi-join on one-deletion forms.
    """
    hosts = domains.select("domain", "mixed_script").distinct()
    folded = hosts.withColumn("folded", L.fold_confusables(F.col("domain")))
    names = stored(brands.select("brand").distinct(), "names")
    keyed = names.withColumn("lit_id", F.xxhash64("brand"))
    literals = keyed.select("lit_id", F.col("brand").alias("needle"))
    held = stored(match_literals(folded, "domain", "folded", literals), "held")
    keyed = lookup_join(keyed, held.select("lit_id").distinct(), ["lit_id"], "left_semi", F.col("brand"), KEY_LIMIT)
    inside = held.join(keyed, "lit_id").select("domain", "brand")
    labels = folded.select(
        "domain", F.explode(F.array_distinct(L.brand_labels(F.col("folded")))).alias("label")
    ).filter(F.length("label") >= 3)  # a brand of four letters or more is two edits from anything shorter
    long_names = names.filter(F.length("brand") >= 4)
    # Each label once, however many hosts have it; what it nearly spells goes back to the hosts.
    forms = labels.select("label").distinct().select("label", F.explode(_one_edit_keys(F.col("label"))).alias("form"))
    spellings = long_names.select("brand", F.explode(_one_edit_keys(F.col("brand"))).alias("form"))
    shared = lookup_join(spellings, forms, ["form"], "inner", F.col("brand"), KEY_LIMIT)
    spelled = stored(shared.filter(F.levenshtein("label", "brand", 1) >= 0).select("label", "brand").distinct(), "spelled")
    near = lookup_join(labels, spelled, ["label"], "inner", F.col("domain"), KEY_LIMIT).select("domain", "brand")
    found = inside.unionByName(near).distinct()
    owned = official_domains(hosts.filter("not mixed_script"), brands)
    return found.join(owned, ["domain", "brand"], "left_anti")


def classify_links(
    links: DataFrame,
    brands: DataFrame,
    shorteners: DataFrame,
    suffixes: DataFrame,
    limit: int = INLINE_LIMIT,
    flags: DataFrame | StoredLookup | None = None,
) -> DataFrame:
    """Adds the shape columns and ``label`` to a table with ``raw_url``.

    ``flags`` are those of :func:`domain_flags` for all domains of the links (or more), stored by domain when links of
    known domains come again and again; then the catalog is not looked at.
    """
    described = described_links(links)
    catalog = collect_catalog(brands, shorteners, suffixes, limit) if flags is None else None
    if catalog is not None:
        shape = F.struct("domain", "has_userinfo", "is_ip", "mixed_script")
        return described.withColumn("label", L.bind(shape, lambda s: L.label_link(s, catalog)))
    # Catalog too large for an expression: one flag table per distinct domain, joined back.
    known = flags is not None
    if not known:
        flags = stored(domain_flags(described, brands, shorteners, suffixes), "flags")
    label = (
        F.when(F.col("domain").isNull(), F.lit(None).cast("string"))
        .when(F.col("has_userinfo"), V.LABEL_CREDENTIALS)
        .when(F.col("is_ip"), V.LABEL_IP)
        .when(F.col("_short"), V.LABEL_SHORTENED)
        .when(F.col("_like"), V.LABEL_LOOKALIKE)
        .when(F.col("_nested"), V.LABEL_DOMAIN_IN_SUBDOMAIN)
        .when(F.col("mixed_script"), V.LABEL_MIXED_SCRIPT)
    )
    spread = F.col("raw_url")
    joined = salted_join(described, flags, ["domain"], "left", spread) if known else lookup_join(described, flags, ["domain"], "left", spread, KEY_LIMIT)
    return joined.withColumn("label", label).drop("_short", "_like", "_nested")


def domain_flags(described: DataFrame, brands: DataFrame, shorteners: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(domain, _short, _like, _nested) of the different domains of described links, against a catalog of any size."""
    hosts = described.filter(F.col("domain").isNotNull()).select("domain", "mixed_script").distinct()
    lookalike = brand_lookalikes(hosts, brands).select("domain").distinct().withColumn("_like", F.lit(True))
    short = shorteners.select("domain").distinct().withColumn("_short", F.lit(True))
    interior = F.explode(
        F.array_distinct(
            F.slice(
                F.split("domain", r"\."),
                F.lit(1),
                F.greatest(F.size(F.split("domain", r"\.")) - 2, F.lit(0)),
            )
        )
    )
    nested = (
        hosts.select("domain", interior.alias("label"))
        .join(suffixes.select("label").distinct(), "label", "left_semi")
        .select("domain")
        .distinct()
        .withColumn("_nested", F.lit(True))
    )
    return (
        hosts.select("domain").distinct()
        .join(short, "domain", "left")
        .join(lookalike, "domain", "left")
        .join(nested, "domain", "left")
    )


def with_link_labels(
    messages: DataFrame, catalog: dict[str, DataFrame], id_col: str = "msg_id", column: str = "link_labels", limit: int = INLINE_LIMIT
) -> DataFrame:
    """Adds a map from each link of ``text`` that has a label to that label, for :class:`wardline.functions.links.LinkLabels`.

    ``catalog``: brands, shorteners and suffixes as tables of any size. Every different text is cut into links once, every
    different link is labelled once by :func:`classify_links`, and labels come back by link, then by text. A null text
    has no links; ids may repeat or be null.
    """
    keyed = messages.withColumn("_content", content_key(F.col("text")))
    contents = keyed.filter(L.may_hold_link(F.col("text"))).select("_content", "text").dropDuplicates(["_content"])
    held = stored(contents.select("_content", F.explode(labelled_links(F.col("text"))).alias("raw_url")), "links")
    labels = classify_links(held.select("raw_url").distinct(), catalog["brands"], catalog["shorteners"], catalog["suffixes"], limit)
    labels = stored(labels.filter("label is not null").select("raw_url", "label"), "labels")
    # A text's own links are one group.
    found = lookup_join(held, labels, ["raw_url"], "inner", F.col("_content"), KEY_LIMIT).groupBy("_content").agg(
        F.map_from_entries(F.collect_list(F.struct("raw_url", "label"))).alias(column)
    )
    joined = salted_join(keyed, found, ["_content"], "left", F.col(id_col), large=True)
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return joined.withColumn(column, F.coalesce(column, none)).drop("_content")


def merge_brands(floor: DataFrame, extra: DataFrame) -> DataFrame:
    """(brand, domain): the extra list replaces a brand as a whole; unusable domains are dropped."""
    clean = (
        extra.select(
            F.lower(F.trim("brand")).alias("brand"), L.normalize_domain(F.col("domain")).alias("domain")
        )
        .filter((F.col("brand") != "") & F.col("domain").isNotNull())
        .distinct()
    )
    kept = floor.select("brand", "domain").join(clean.select("brand").distinct(), "brand", "left_anti")
    return kept.unionByName(clean)


def merge_strings(floor: DataFrame, extra: DataFrame, column: str) -> DataFrame:
    """Union of two one-column lists, trimmed and lower-cased."""
    clean = extra.select(F.lower(F.trim(column)).alias(column)).filter(F.col(column) != "")
    return floor.select(column).union(clean).distinct()


def merge_catalog(floor: dict[str, DataFrame], extra: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A whole catalog: brands replaced brand by brand, shorteners and suffixes united."""
    return {
        "brands": merge_brands(floor["brands"], extra["brands"]),
        "shorteners": merge_strings(floor["shorteners"], extra["shorteners"], "domain"),
        "suffixes": merge_strings(floor["suffixes"], extra["suffixes"], "label"),
    }


def parse_threat_feed(lines: DataFrame) -> DataFrame:
    """(domain_hash, source) from feed lines (``value``, ``source``); only hashes survive."""
    candidates = F.regexp_extract_all("value", F.lit(V.FEED_CANDIDATE), F.lit(0))
    domain = L.normalize_domain(F.col("candidate"))
    return (
        lines.select("source", F.explode(candidates).alias("candidate"))
        .distinct()
        .select("source", domain.alias("domain"))
        .filter(F.col("domain").isNotNull())
        .select(L.hash_domain(F.col("domain")).alias("domain_hash"), "source")
        .distinct()
    )


def upsert_blocklist(current: DataFrame, feed: DataFrame, now: Column) -> DataFrame:
    """Keeps first_seen, moves last_seen to now for listed hashes, leaves the rest untouched."""
    fresh = feed.select("domain_hash", "source").distinct().withColumn("_listed", F.lit(True))
    merged = current.join(fresh, ["domain_hash", "source"], "full")
    return merged.select(
        "domain_hash",
        "source",
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(F.col("_listed"), now).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def reputation_hits(
    messages: DataFrame, blocklist: DataFrame | StoredLookup, id_col: str = "msg_id"
) -> DataFrame:
    """One severity-3 hit per message whose domains are listed: sorted sources, earliest date.

    The blocklist is reduced to one row per hash first; a domain that fills a third of all
    messages is spread over several tasks. ``blocklist`` may be :func:`listed_hashes`, stored by domain_hash.
    """
    hashed = message_domains(messages, id_col).select(
        id_col, L.hash_domain(F.col("domain")).alias("domain_hash")
    )
    return reputation_of_hashes(hashed, blocklist, id_col)


def listed_hashes(blocklist: DataFrame) -> DataFrame:
    """(domain_hash, sources, first_seen): a blocklist with one row per hash, sources sorted."""
    return blocklist.groupBy("domain_hash").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.min("first_seen").alias("first_seen")
    )


def listed_constant(hashes: Column, rows: list) -> Column:
    """struct(sources, listed_since) of the listed ones of some domain hashes, or null; ``rows`` of :func:`listed_hashes`."""
    table = lookup_table(
        {r.domain_hash: [{"sources": list(r.sources), "day": r.first_seen.date().isoformat()}] for r in rows},
        "array<struct<sources:array<string>,day:string>>",
    )
    found = F.flatten(F.transform(hashes, table))
    listed = lambda f: F.struct(
        F.array_sort(F.array_distinct(F.flatten(F.transform(f, lambda x: x.sources)))).alias("sources"),
        F.array_min(F.transform(f, lambda x: x.day)).cast("date").alias("listed_since"),
    )
    return bind(found, lambda f: F.when(F.size(f) > 0, listed(f)))


def reputation_of_hashes(hashed: DataFrame, blocklist: DataFrame | StoredLookup, id_col: str) -> DataFrame:
    """The hits of rows (id, domain_hash)."""
    listed = blocklist if isinstance(blocklist, StoredLookup) else listed_hashes(blocklist)
    found = salted_join(hashed, listed, ["domain_hash"], "inner", F.col(id_col))
    return found.groupBy(id_col).agg(
        F.lit(V.BLOCKLIST_RULE_ID).alias("rule_id"),
        F.lit(V.BLOCKLIST_FAMILY).alias("family"),
        F.lit(V.BLOCKLIST_SEVERITY).alias("severity"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.to_date(F.min("first_seen")).alias("listed_since"),
    )
