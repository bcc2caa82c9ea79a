"""The registered queries of these operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import chat_windows, decontaminate, hard_negatives, language_kernel, lexical_search, lm_bloom, packing, quality_rules, records, simhash
from changelens.llm import suffix_dedup, url_templates, weak_quality
from changelens.llm.common import prepared, table
from changelens.scratch import fresh_path


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    planted = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{text}' AS text")
    return chat_windows.digests(given.unionByName(planted))


def op3_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_kernel.identify(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """Place of the public byte-level BPE vocabulary; the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    contract = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*contract, "rule")


URL_RULES = [
    url_templates.UrlRule(True, "org", "/"),
    url_templates.UrlRule(False, "example.org", "/es/"),
    url_templates.UrlRule(False, "example.org", "/en/1"),
    url_templates.UrlRule(True, "com", "/fr/"),
    url_templates.UrlRule(False, "com", "/de/"),
]


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number stands in its path, so that document's label is the page's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = url_templates.with_parts(pages).select("page_id", F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS bigint)").alias("shown_id"))
    good = F.expr("coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0").alias("good")
    labels = shown.join(table(spark, sf_dir, "labels").select("doc_id", good), F.col("shown_id") == F.col("doc_id")).select("page_id", "good")
    return url_templates.judge(pages, labels, URL_RULES)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", F.coalesce(moved, "label")), F.col("vec_id") % 50 == 0)


def word_vocabulary() -> str:
    """Place of the public word-level BPE vocabulary; the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(prepared(spark), "records")
    records.write(table(spark, sf_dir, "documents"), folder, word_vocabulary(), end=2)
    return records.read(spark, folder)


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_chat_windows": op2_chat_windows,
    "op3_language_kernel": op3_language_kernel,
    "op4_weak_quality": op4_weak_quality,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_url_templates": op7_url_templates,
    "op8_decontamination": op8_decontamination,
    "op9_simhash": op9_simhash,
    "op10_lm_bloom": op10_lm_bloom,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_records": op13_token_records,
}
