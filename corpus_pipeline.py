"""Preparing a training corpus: five stages, each written as Parquet and read again by the next.

Toxic documents go, one document of each near-duplicate class stays, repeated passages are cut,
the sources are mixed to their target weights, and the mix is encoded and decoded again.

Defined cases are those of the operators called. Every stage but the last returns the columns
of its input; a document cut by a stage keeps its other columns and has ``n_chars`` counted anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, mixing, simhash, substr, toxicity
from cohortlens.llm.common import numbered, read_table, stage
from cohortlens.llm.queries import VOCABULARY, fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the labels of one id in five are left out of the learning."""
    labels = read_table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    model = toxicity.learn(docs, labels)
    plain, names = numbered(docs)
    judged = toxicity.score(plain, model, text_col=names["text"])
    return judged.where("predicted = 0").select(*(F.col(n).alias(c) for c, n in names.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each SimHash class stays (three words, two bits)."""
    return simhash.one_of_each(docs, words=3, radius=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated passages of 35 words are cut; documents with nothing removed stay as they are."""
    plain, names = numbered(docs)
    cut = substr.remove_repeats(plain, id_col=names["doc_id"], text_col=names["text"])
    changed = F.col("n_removed") > 0
    made = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col(names["text"])),
            "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col(names["n_chars"]))
            .cast(docs.schema["n_chars"].dataType)}
    return cut.select(*(made.get(c, F.col(n)).alias(c) for c, n in names.items()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each pass over a document gives a row with the words taken."""
    return mixing.mix_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    done = bpe.encode_decode(docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text")),
                             VOCABULARY, public_tokenizers.PATTERN)
    return done.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.encode("text", "UTF-8")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: learnt scores and hash draws: SQL can't express them (tests hold the rows against a brute-force version)
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
