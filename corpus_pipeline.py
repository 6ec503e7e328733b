"""Five stages from documents to token ids; each keeps documents' columns but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.llm import mixing, pieces, pii, quality, simhash
from briarlake.llm.text import named, word_count
from briarlake.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose host is rejected go."""
    return quality.filter_documents(docs, Scratch(spark, "quality"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.filter_documents(docs, Scratch(spark, "simhash"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts give way to pseudonyms; n_chars follows the text."""
    moved = pii.replace(docs, pii.session_key(spark))
    return moved.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else moved


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    row = F.struct(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    packed = docs.select(row, "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = mixing.emit(mixing.mix_documents(packed, Scratch(spark, "mix")), ["row"])
    return taken.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("pii pseudonyms", pii_pseudonyms),
    ("mixing sources", mix_sources),
    ("sentencepiece", sentencepiece_ids),
]

#: SimHash and the model's merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
