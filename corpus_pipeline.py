"""A corpus pipeline over documents: language ID, exact dedup, near dedup, source mixing, BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm import bpe, exact_dedup, jaccard_join, lang_id, mixing
from barlab.llm.common import ascii_lower, discard, staged

VOCABULARY = "byte_bpe_50k.json"


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: a null text, or one without a letter."""
    return docs.where(lang_id.language(lang_id.train(docs), spark, F.col("text")) != "und")


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; rows repeated with one id and text stay together."""
    stay = exact_dedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    sha = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    return docs.join(stay, docs["doc_id"].eqNullSafe(F.col("__id")) & (sha == F.col("__sha")), "left_semi")


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity the one with the smallest id stays, and every row without an id."""
    stay = jaccard_join.linked_documents(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows repeated with one id share its copies evenly, rounded up."""
    copies = mixing.mixed(docs).groupBy(F.col("doc_id").alias("__id")).agg(F.ceil(F.sum("copies") / F.count(F.lit(1))).cast("int").alias("__n"))
    taken = docs.join(copies.where("__n > 0"), docs["doc_id"].eqNullSafe(F.col("__id")))
    return taken.select(*(docs[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(1), F.col("__n"))).alias("__copy")).drop("__copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row's ids and decoded text."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", keep_known_language),
    ("exact_dedup", keep_one_of_equal),
    ("near_dedup", keep_one_of_near),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: Neither the language models nor the encoder can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
