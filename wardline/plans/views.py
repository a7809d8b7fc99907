"""Model tables as views over the corpus tables; each grows with the table it comes from."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.functions import links as L
from wardline.operators.rules import flatten_rules
from wardline.plans.screening import with_signals
from wardline.sources.readers import as_timestamp, read_messages

STATUS_OF_EVENT = {
    "view": "ok", "purchase": "ok", "click": "no_signal", "error": "llm_error",
    "signup": "safety_fallback",
}
KB_VERSION = "2024-01-01-v1"
SIGNAL_KINDS = ("email", "phone", "card", "code", "card_personal")
ERROR_STAGES = ("ocr", "qr", "llm", "validate", "web", "bot", "knowledge", "url_reputation")


def pick(number: Column, values: tuple[str, ...]) -> Column:
    """values[number mod len(values)]."""
    return F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int")
    )


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[.\n]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def dealt(parts: Column, place: int, places: int = 4) -> Column:
    """Every ``places``-th entry, from ``place`` on: the places together hold all entries."""
    return F.filter(parts, lambda _, i: i % places == place)


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


class Views:
    """Lazily built views for one folder of corpus tables."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def messages(self) -> DataFrame:
        """The corpus; ``spark.wardline.partitions`` deals it over so many tasks where its files cannot be split."""
        partitions = self.spark.conf.get("spark.wardline.partitions", None)
        return read_messages(self.spark, self.path, partitions=int(partitions) if partitions else None)

    # --- rules and cards from the benchmark items ------------------------------------------------
    @cached_property
    def rules(self) -> DataFrame:
        """One rule per benchmark item; its lines are the patterns."""
        n = F.col("item_id")
        parts = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
        return (
            self.table("benchmark")
            .select(
                n.alias("rule_order"),
                F.concat(F.lit("bench.item_"), n).alias("rule_id"),
                F.concat(F.lit("family_"), F.pmod(n, F.lit(5))).alias("family"),
                F.concat(F.lit("Passage of item "), n).alias("desc"),
                F.concat(F.lit("key_"), n).alias("message_key"),
                (F.pmod(n, F.lit(3)) + 1).cast("int").alias("severity"),
                F.when(F.pmod(n, F.lit(2)) == 0, "bench_even").alias("emits_signal"),
                F.create_map(F.lit("uz_latn"), parts, F.lit("ru"), strings(" ")).alias("match"),
            )
            .filter(F.size(parts) > 0)
        )

    @cached_property
    def patterns(self) -> DataFrame:
        return flatten_rules(self.rules)

    @cached_property
    def cards(self) -> DataFrame:
        """One card per benchmark item, triggered by its rule, by one signal kind or by its words."""
        n = F.col("item_id")
        words = F.filter(F.split("text", r"[\s.,]+"), lambda w: F.length(w) >= 9)
        return self.table("benchmark").select(
            F.concat(F.lit("card.item_"), n).alias("id"),
            F.lit("1.0.0").alias("version"),
            F.when(F.pmod(n, F.lit(7)) == 6, "draft").otherwise("approved").alias("status"),
            F.lit("reviewer").alias("reviewer"),
            F.array(F.concat(F.lit("bench.item_"), n)).alias("trigger_rule_ids"),
            F.when(F.pmod(n, F.lit(4)) == 0, F.array(pick(n / 4, SIGNAL_KINDS)))
            .otherwise(strings())
            .alias("trigger_signal_kinds"),
            F.create_map(F.lit("uz_latn"), words).alias("retrieval_aliases"),
            F.concat(F.lit("Mechanism "), n).alias("mechanism"),
            sentences(F.col("text")).alias("red_flags"),
            F.array(F.concat(F.lit("Verify "), n)).alias("verify_steps"),
            F.array(F.concat(F.lit("Ask "), n)).alias("questions"),
            F.array(F.lit("case.shared"), F.concat(F.lit("case.item_"), n)).alias("reviewed_case_ids"),
        )

    @cached_property
    def approved_cards(self) -> DataFrame:
        return self.cards.filter(F.col("status") == "approved")

    # --- links from the page addresses -----------------------------------------------------------
    @cached_property
    def links(self) -> DataFrame:
        """One link per page in one of eight spellings."""
        n, url = F.col("page_id"), F.col("url")
        host = F.split_part(url, F.lit("/"), F.lit(3))
        spelled = (
            F.when(n % 8 == 0, url)
            .when(n % 8 == 1, F.concat(F.lit("hxxps://"), F.replace(host, F.lit("."), F.lit("[.]")), F.lit("/a")))
            .when(n % 8 == 2, F.concat(F.lit("https://click.uz@"), host, F.lit("/pay")))
            .when(n % 8 == 3, F.concat(F.lit("http://192.0.2."), n % 250, F.lit("/login")))
            .when(n % 8 == 4, F.concat(F.lit("bit.ly/p"), n))
            .when(n % 8 == 5, F.concat(F.lit("https://click.uz."), host))
            .when(n % 8 == 6, F.concat(F.lit("www.paymee-"), n, F.lit(".example")))
            .otherwise(F.concat(F.lit("https://th"), F.lit("е"), F.lit("st."), host, F.lit("/x")))
        )
        return self.table("pages").select(n.alias("msg_id"), spelled.alias("raw_url"))

    @cached_property
    def link_messages(self) -> DataFrame:
        """Messages that hold the link of a page, its plain address and an e-mail address."""
        pages = self.table("pages").select(F.col("page_id").alias("msg_id"), "url")
        text = F.concat(
            F.lit("See "), F.col("raw_url"), F.lit(", then "), F.col("url"),
            F.lit(" or write to help@"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."),
        )
        return (
            self.links.join(pages, "msg_id")
            .select("msg_id", F.lit("text").alias("input_type"), text.alias("text"))
        )

    @cached_property
    def blocklist(self) -> DataFrame:
        """Domains of plain-http pages, by three sources."""
        n = F.col("page_id")
        seen = F.timestamp_add("DAY", F.pmod(n, F.lit(28)).cast("int"), F.lit("2024-01-01").cast("timestamp"))
        return (
            self.table("pages")
            .filter(F.col("url").startswith("http://"))
            .select(
                L.hash_domain(L.normalize_domain(F.col("url"))).alias("domain_hash"),
                pick(n, ("urlhaus", "openphish", "local")).alias("source"),
                seen.alias("seen"),
            )
            .groupBy("domain_hash", "source")
            .agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
        )

    # --- event tables ----------------------------------------------------------------------------
    @cached_property
    def check_event(self) -> DataFrame:
        k, kind = F.col("k"), F.col("event_type")
        status = F.lit(None).cast("string")
        for event, value in STATUS_OF_EVENT.items():
            status = F.when(kind == event, value).otherwise(status)
        no_cards = (k % 3 == 0) | (k % 10 == 0)
        retrieved = F.when(kind != "signup", F.when(k % 10 == 0, "unavailable").when(k % 3 == 0, "empty").otherwise("ok"))
        return (
            self.table("events")
            .withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("bigint"))
            .select(
                F.col("event_id").alias("id"),
                F.col("user_id").cast("string").alias("user_key"),
                as_timestamp(F.col("ts")).alias("ts"),
                F.when(k % 6 == 0, "image").otherwise("text").alias("input_type"),
                F.when(F.col("user_id") % 2 == 0, "ru").otherwise("uz_latn").alias("language"),
                F.array_distinct(
                    F.array(F.concat(F.lit("r"), k % 13), F.concat(F.lit("r"), k % 7))
                ).alias("rule_ids"),
                F.when(no_cards, strings()).otherwise(F.array(F.concat(F.lit("c"), k % 10))).alias("knowledge_card_ids"),
                strings().alias("reviewed_case_ids"),
                F.when(kind == "signup", F.lit(None)).when(no_cards, "none").otherwise(
                    pick(k, ("rule", "signal", "cue", "router"))
                ).alias("retrieval_mode"),
                retrieved.alias("retrieval_status"),
                F.when(kind == "signup", F.lit(None)).otherwise(
                    pick(k, ("ok", "invalid_ids", "unavailable", "not_used", "not_used"))
                ).alias("router_status"),
                F.lit(KB_VERSION).alias("kb_version"),
                (status == "no_signal").alias("no_signal"),
                status.alias("status"),
                F.when(kind == "error", "TimeoutError").alias("error_class"),
                F.lit(None).cast("double").alias("ocr_confidence"),
                F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
                F.lit(None).cast("int").alias("ocr_ms"),
                F.lit(None).cast("int").alias("llm_ms"),
                (k * 7).cast("int").alias("input_tokens"),
                (k * 3).cast("int").alias("output_tokens"),
                (k / 100000).cast("decimal(10,6)").alias("cost_usd"),
                (status == "safety_fallback").alias("safety_blocked"),
                k.alias("k"),
            )
        )

    @cached_property
    def feedback(self) -> DataFrame:
        """An answer to every completed check, one hour later."""
        return self.check_event.filter(F.col("status").isin("ok", "no_signal")).select(
            F.col("id").alias("check_id"),
            pick(F.floor(F.col("k") / 3), ("yes", "partly", "no")).alias("usefulness"),
            F.when(F.col("k") % 5 != 4, pick(F.col("k"), ("verify", "delay_stop", "continue", "not_sure", "verify")))
            .alias("next_action"),
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"),
        )

    @cached_property
    def consent(self) -> DataFrame:
        """The first event of a user as consent; every fifth user accepted an old notice."""
        return self.check_event.groupBy("user_key").agg(F.min("ts").alias("ts")).select(
            "user_key",
            F.when(F.col("user_key").cast("bigint") % 5 == 0, "v1").otherwise("v2").alias("notice_version"),
            F.when(F.col("user_key").cast("bigint") % 2 == 0, "ru").otherwise("uz_latn").alias("language"),
            "ts",
        )

    @cached_property
    def model_rules(self) -> DataFrame:
        """Families of the rule ids used by events; r12 has none."""
        ids = self.check_event.select(F.explode("rule_ids").alias("rule_id")).distinct()
        number = F.substring("rule_id", 2, 9).cast("int")
        return ids.filter(F.col("rule_id") != "r12").select(
            "rule_id", F.concat(F.lit("family_"), number % 4).alias("family"),
            (number % 3 + 1).alias("severity"),
        )

    @cached_property
    def model_cards(self) -> DataFrame:
        """Cards c0 to c11 as used by events; the last two are never used, c9 is a draft."""
        used = self.check_event.select((F.col("k") % 12).alias("n")).distinct()
        return used.select(
            F.concat(F.lit("c"), "n").alias("id"),
            F.when(F.col("n") == 9, "draft").otherwise("approved").alias("status"),
        )

    @cached_property
    def errors(self) -> DataFrame:
        return self.check_event.select(
            pick(F.col("k"), ERROR_STAGES).alias("stage"),
            F.when(F.col("latency_ms") < 100, "Timeout").otherwise("ProviderError").alias("error_type"),
            "ts",
        )

    @cached_property
    def log_events(self) -> DataFrame:
        """Start, error and terminal records of each check, keyed by an anonymous request id."""
        ev = self.check_event
        ended = F.col("ts") + F.make_dt_interval(secs=F.col("latency_ms") / 1000)

        def record(event: Column | str, ts: Column, when: Column, error=None) -> Column:
            name = event if isinstance(event, Column) else F.lit(event)
            return F.when(
                when,
                F.struct(
                    name.alias("event"), F.lit(error).cast("string").alias("error_type"), ts.alias("ts")
                ),
            )

        status = F.col("status")
        terminal = F.when(status.isin("ok", "no_signal"), "check_completed").otherwise("check_failed")
        records = F.array_compact(
            F.array(
                record("check_started", F.col("ts"), F.col("k") % 9 != 0),
                record("app_error", ended, status == "llm_error", "TimeoutError"),
                record(terminal, ended, F.col("k") % 11 != 0),
            )
        )
        return ev.select(F.md5(F.col("id").cast("string")).alias("request_id"), F.explode(records).alias("r")).select(
            "request_id", "r.*"
        )

    # --- drafts ----------------------------------------------------------------------------------
    @cached_property
    def drafts(self) -> DataFrame:
        """All sentences of each assistant turn dealt over draft blocks, with one of several phrases that checks look for."""
        from wardline.plans.phrases import PHRASES

        n = F.col("conv_id") * 31 + F.col("turn")
        s = F.col("s")
        phrase = pick(n, PHRASES)
        hit = F.struct(
            F.concat(F.lit("fs.rule_"), n % 6).alias("rule_id"), (n % 3 + 1).cast("int").alias("severity")
        )
        listed = F.struct(F.lit("shared.link.blocklisted").alias("rule_id"), F.lit(3).alias("severity"))
        hits = (
            F.when(n % 4 == 0, F.array().cast("array<struct<rule_id:string,severity:int>>"))
            .when(n % 7 == 0, F.array(hit, listed))
            .otherwise(F.array(hit))
        )
        own = F.transform("hits", lambda h: h.rule_id)
        return (
            self.table("conversations")
            .filter(F.col("role") == "assistant")
            .select("conv_id", "turn", sentences(F.col("text")).alias("s"), n.alias("n"), hits.alias("hits"))
            .select(
                F.concat_ws(":", "conv_id", "turn").alias("check_id"),
                "conv_id",
                F.when(F.col("n") % 2 == 0, "ru").otherwise("uz_latn").alias("language"),
                dealt(s, 0).alias("red_flags"),
                F.concat(F.array_join(dealt(s, 1), ". "), F.lit(" "), phrase).alias("pattern"),
                dealt(s, 2).alias("verify"),
                dealt(s, 3).alias("ask"),
                F.when(F.col("n") % 13 == 0, F.concat(own, strings("fs.other")))
                .when(F.col("n") % 11 == 0, strings())
                .otherwise(own)
                .alias("addressed_rule_ids"),
                "hits",
                F.when(F.col("n") % 3 == 0, strings("card.alpha")).otherwise(strings()).alias("knowledge_card_ids"),
                "n",
            )
        )

    # --- screened messages -----------------------------------------------------------------------
    @cached_property
    def matched(self) -> DataFrame:
        from wardline.operators.rules import with_normalized, with_rule_hits

        return with_rule_hits(with_normalized(self.messages.select("msg_id", "text")), self.patterns)

    @cached_property
    def signalled(self) -> DataFrame:
        return with_signals(self.matched)
