"""The queries of this subpackage and their SQL, for the registry at the top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm import fingerprints, html, langid, mixing, packing, quality, rules, simhash, token_files, urls
from quillsieve.llm.common import in_held_out, table


def public(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op3_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "score", "verdict")


def op4_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs.select("doc_id", "text"), model)
    return scored.select("row.doc_id", in_held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= quality.KEEP_AT).cast("int").alias("predicted"))


def op6_grouping_ga(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), vocabulary or public("word_bpe_49k.json"), "dropped", 1)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("failed")


def op8_elias_fano(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.encode_and_read_back(docs, vocabulary or public("byte_bpe_50k.json"), "kept", 0, width=2)


def op9_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("row.doc_id", in_held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_bottom_k": op2_bottom_k,
    "op3_url_models": op3_url_models,
    "op4_simhash_anchors": op4_simhash_anchors,
    "op5_line_crf": op5_line_crf,
    "op6_grouping_ga": op6_grouping_ga,
    "op7_quality_rules": op7_quality_rules,
    "op8_elias_fano": op8_elias_fano,
    "op9_language_codes": op9_language_codes,
    "op10_html_wrappers": op10_html_wrappers,
}

ORACLES = {"op1_pareto_mix": mixing.ORACLE_SQL, "op7_quality_rules": rules.ORACLE_SQL}
