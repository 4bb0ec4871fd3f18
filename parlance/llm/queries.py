"""The opN_ queries: each operator with production parameters over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import toxicity
from parlance.llm.bpe import round_trip
from parlance.llm.conversation_repair import damage, repair, repair_sql
from parlance.llm.decontaminate import CONTAINED_SQL, contained_items
from parlance.llm.embedding_dedup import near_duplicates
from parlance.llm.frames import table
from parlance.llm.language import held_out, identify, learn
from parlance.llm.licenses import known_licenses, license_scan, license_scan_sql
from parlance.llm.lm_scoring import score as lm_score
from parlance.llm.ngram_join import similar_links
from parlance.llm.quality_rules import quality, quality_sql
from parlance.llm.spelling_variants import group_variants, variants_sql
from parlance.llm.suffix_dedup import remove_repeats
from parlance.llm.token_counts import token_counts


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), known_licenses(spark))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_links(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out(5, 0)))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "n_windows")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs, held_out(4, 2)))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "languages")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_decontaminate": op2_decontaminate,
        "op3_licenses": op3_licenses,
        "op4_lm_scores": op4_lm_scores,
        "op5_ngram_join": op5_ngram_join,
        "op6_token_counts": op6_token_counts,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_language": op9_language,
        "op10_bpe": op10_bpe,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": CONTAINED_SQL,
        "op3_licenses": license_scan_sql(),
        "op11_spelling_variants": variants_sql(),
        "op12_conversation_repair": repair_sql(),
        "op13_quality_rules": quality_sql(),
    }
