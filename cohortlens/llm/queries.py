"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, html_text, jaccard, langid, licenses, mixing, repair, simhash, sketch, substr, toxicity,
               whitening)
from .common import read_table


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   words=3, radius=2)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (substr.remove_repeats(docs)
            .select("doc_id", "n_words", "n_removed",
                    F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                      F.col("vec_id") % 50 == 0, k=5)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "html"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sketch.fingerprint_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        sketch.fingerprint(F.col("sketch")).alias("fingerprint"),
        sketch.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketch.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_decode(docs, VOCABULARY, public_tokenizers.PATTERN)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    filters = langid.learn(docs.where("held_out is distinct from true").select("text", "lang"))
    return (langid.identify(docs.select("doc_id", "held_out", "text"), filters)
            .select("doc_id", "held_out", "lang_pred", "score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    model = toxicity.learn(docs, labels)
    return toxicity.score(docs.withColumn("held_out", fold("doc_id", 5) == 0), model).drop("text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_all(rows, change=repair.damage)


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   words=5, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_simhash_near_dedup,
        op2_mix_sources,
        op3_nearest_neighbours,
        op4_html_extraction,
        op5_document_fingerprints,
        op6_byte_bpe,
        op7_substring_dedup,
        op8_language_id,
        op9_toxicity,
        op10_license_scan,
        op11_embedding_whitening,
        op12_conversation_repair,
        op13_ngram_jaccard_join,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op10_license_scan": licenses.oracle()}
