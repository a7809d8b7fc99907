"""Rule packs, cards and catalogs from YAML files as DataFrames. These are small, hand-kept files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline import fixed_values as V, schemas


def _yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def read_rules(spark: SparkSession, *paths: str) -> DataFrame:
    """Rule table from files with ``families: [{family, rules: [{id, desc, ...}]}]``."""
    rows = []
    for path in sorted(paths):
        for family in _yaml(path)["families"]:
            for rule in family["rules"]:
                rows.append(
                    (
                        len(rows), rule["id"], family["family"], rule["desc"], rule["message_key"],
                        int(rule["severity"]), rule.get("emits_signal"), rule["match"],
                    )
                )
    return spark.createDataFrame(rows, schemas.RULES)


def read_cards(spark: SparkSession, *paths: str) -> DataFrame:
    """Card table from files with ``cards: [...]``."""
    lists = (
        "trigger_rule_ids", "trigger_signal_kinds", "red_flags", "verify_steps", "questions",
        "reviewed_case_ids",
    )
    rows = []
    for path in sorted(paths):
        for card in _yaml(path)["cards"]:
            row = {k: card.get(k) for k in ("id", "version", "status", "reviewer", "mechanism")}
            row["version"] = str(row["version"])
            row |= {k: list(card.get(k) or []) for k in lists}
            row["retrieval_aliases"] = {
                k: [str(a) for a in v] for k, v in (card.get("retrieval_aliases") or {}).items()
            }
            rows.append(row)
    return spark.createDataFrame(rows, schemas.CARDS)


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """brands, shorteners and nested_suffixes from one file."""
    data = _yaml(path)
    brands = [(b["brand"], d) for b in data.get("brands") or [] for d in b.get("domains") or []]
    return {
        "brands": spark.createDataFrame(brands, schemas.BRANDS),
        "shorteners": spark.createDataFrame([(s,) for s in data.get("shorteners") or []], schemas.SHORTENERS),
        "nested_suffixes": spark.createDataFrame(
            [(s,) for s in data.get("nested_suffixes") or []], schemas.NESTED_SUFFIXES
        ),
    }


def base_catalog(spark: SparkSession) -> dict[str, DataFrame]:
    """The floor catalog that always applies."""
    brands = [(b, d) for b, domains in V.BRAND_DOMAINS.items() for d in domains]
    return {
        "brands": spark.createDataFrame(brands, schemas.BRANDS),
        "shorteners": spark.createDataFrame([(s,) for s in V.SHORTENERS], schemas.SHORTENERS),
        "nested_suffixes": spark.createDataFrame([(s,) for s in V.NESTED_SUFFIXES], schemas.NESTED_SUFFIXES),
    }
