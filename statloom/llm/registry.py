"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, importance, jaccard_join, language_id, license_scan, merkle, mixing, packing, quality_rules, repair, suffix_dedup, tokens, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose 5-word shingles are at least 80 % similar."""
    return jaccard_join.ngram_jaccard_join(table(spark, sf, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as token pieces, packed into sequences of 4096 tokens."""
    return packing.best_fit_pack(table(spark, sf, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of each document, learned from four of five folds."""
    return language_id.language_report(table(spark, sf, "documents"))


def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Log importance weights towards good documents, and a sample of three quarters of all rows."""
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return importance.importance_sample(table(spark, sf, "documents"), good, fraction=0.75)


def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each document when repeated strings of 400 bytes go; its text without passages of 50 words."""
    return suffix_dedup.repeat_report(table(spark, sf, "documents"), passage=suffix_dedup.PASSAGE)


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts of each document and whether the rules and the classifier keep it."""
    return quality_rules.quality_report(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the benchmark items that they hold, with equal or other slot values."""
    return decontaminate.benchmark_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


#: Rules of the URL filter: verdict, host, path prefix.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Domains that are listed as unwanted, with all below them.
LISTED_DOMAINS = tuple(f"{name}.example.{top}" for name in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets") for top in ("com", "net", "org"))


def op10_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict of each page's url: a rule's, or the cascade's over listed domains."""
    listed = spark.createDataFrame([(x,) for x in LISTED_DOMAINS], "host string")
    return url_filter.url_verdicts(table(spark, sf, "pages"), URL_RULES, listed)


def _url_sql() -> str:
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (_, h, p) in zip(fits, rules, strict=True))
    said = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True))
    listed = " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in LISTED_DOMAINS)
    return f"""WITH r AS (SELECT page_id, coalesce({rest}, '') AS rest FROM pages),
    u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
    SELECT page_id, host, path, CASE {rule} END AS rule,
      CASE {said} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM u"""


def op4_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation against itself with another's last answer: shared prompt, masked completions."""
    return chat_format.preference_records(table(spark, sf, "conversations"))


def op8_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    """The licence that each document is, and the licence notices among its lines."""
    return license_scan.scan(table(spark, sf, "documents"), license_scan.known_licenses(spark))


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of each conversation after planned damage, and its cheapest repair."""
    return repair.repair_report(table(spark, sf, "conversations"))


def op12_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of each document the mix takes, each source near its target."""
    return mixing.mix_sources(table(spark, sf, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, subroot, root and proof of each document, and whether its row as met again folds up to the root."""
    return merkle.document_manifest(table(spark, sf, "documents"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The whole corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_language_id": op3_language_id,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_quality_rules": op7_quality_rules,
        "op8_license_scans": op8_license_scans,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_url_filters": op10_url_filters,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_source_mixing": op12_source_mixing,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_formatting": chat_format.SQL,
        "op8_license_scans": license_scan.SQL,
        "op9_benchmark_decontamination": decontaminate.SQL,
        "op10_url_filters": _url_sql(),
        "op11_conversation_repair": repair.SQL,
        "op13_merkle_manifest": merkle.SQL,
    }
