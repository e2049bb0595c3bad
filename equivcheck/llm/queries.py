"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equivcheck.llm import (
    bpe,
    brown,
    chat,
    decontaminate,
    language,
    merkle,
    mixing,
    pseudonyms,
    quality,
    simhash,
    toxicity,
    urls,
    variants,
)
from equivcheck.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]

# The sites that are judged by name, and the globs for all other pages (host glob, path glob).
SITES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BLOCKED = [("*ads-track*", "*"), ("*spam-*", "*"), ("*adult-*", "*"), ("*casino*", "*"), ("*", "*/ads/*"), ("*", "*.exe")]

# Weights of the mixture, in thousandths of a node's share; other nodes have 1,000.
WEIGHTS = {"domain": {"short": 500, "long": 1_500}, "lang": {"en": 2_000}}


def levels() -> dict:
    """The tree of the mixture: length class of the text as the domain, language, source."""
    chars = F.length(F.coalesce(F.col("text"), F.lit("")))
    domain = F.when(chars < 500, "short").when(chars < 5_000, "middle").otherwise("long")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def rules() -> tuple[list[urls.Rule], list[urls.Rule]]:
    sites = [r for name, verdict in SITES for r in urls.site_rules(name, verdict)]
    globs = [urls.Rule(f"{h}{p}", "block", h, p, len(h) + len(p)) for h, p in BLOCKED]
    return sites, globs


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), text.alias("fingerprint"), "component_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.replies(table(spark, sf_dir, "conversations"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        digest.alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    drawn = mixing.mix(docs, levels(), weights=WEIGHTS)
    return drawn.select("doc_id", "lang", "source", F.col("epoch").cast("long").alias("epoch"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 3) == 1
    found = language.predict(docs.withColumn("held_out", held), ~held, keep=("held_out",))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 5) == 1
    found = brown.score(docs.withColumn("held_out", held), ~held, keep=("held_out",))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return found.withColumnRenamed("id", "doc_id").withColumn("perplexity", perplexity)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pseudonyms.replace(table(spark, sf_dir, "documents"))
    return replaced.select("doc_id", "text", "n_pii")


def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels")
    found = toxicity.score(docs.withColumn("held_out", held), labels, ~held, keep=("held_out",))
    return found.withColumnRenamed("id", "doc_id")


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, globs = rules()
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), sites, globs).drop("url")


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.tampered_text())
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified"
    )


def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spellings(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": quality_rules,
    "op2_simhash": near_duplicates,
    "op3_chat_quotes": conversations,
    "op4_decontamination": contamination,
    "op5_mixing": mixture,
    "op6_language": languages,
    "op7_brown_lm": lm_scores,
    "op8_pseudonyms": personal_data,
    "op9_toxicity": toxic_texts,
    "op10_url_filter": url_verdicts,
    "op11_merkle_manifest": dataset_manifest,
    "op12_byte_bpe": byte_pairs,
    "op13_spelling_variants": spelling_variants,
}
