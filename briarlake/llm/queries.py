"""The queries of the operators over the whole test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.llm import chat, codes, embeddings, html, mixing, negatives, pieces, pii, quality, sharding, simhash, urls, warc
from briarlake.llm.text import word_count
from briarlake.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(_table(spark, sf_dir, "documents"), Scratch(spark, "op1")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op3"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op4")
    sized = scratch.keep(_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mixing.mix_documents(sized, scratch)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard_documents(_table(spark, sf_dir, "documents"), Scratch(spark, "op6")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", urls.stand_in_fetch_time(F.col("page_id")).alias("fetch_ts"))
    return urls.match_lists(pages, urls.stand_in_events(pages), Scratch(spark, "op7")).withColumn("fetch_ts", F.col("fetch_ts").cast("timestamp_ntz"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"), Scratch(spark, "op8"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark, "op9")))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(_table(spark, sf_dir, "documents"), pii.session_key(spark))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), Scratch(spark, "op11"), F.col("vec_id") % 50 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op12")
    return codes.digest(*codes.compressed(_table(spark, sf_dir, "embeddings"), scratch), scratch)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"), Scratch(spark, "op13"))


def op1_quality_rules_of_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts by source and section: each source's stubs, texts under 400 characters, are a host of their own, which the rules reject."""
    docs = _table(spark, sf_dir, "documents")
    section = F.when(F.char_length("text") < 400, "/stubs").otherwise("/pages")
    return quality.digest(quality.judge(docs.withColumn("source", F.concat("source", section)), Scratch(spark, "op1s")))


_SECTIONS_SQL = quality.SQL.replace("FROM documents)", "FROM (SELECT * REPLACE (source || CASE WHEN length(text) < 400 THEN '/stubs' ELSE '/pages' END AS source) FROM documents))")
#: Number and turns of the snapshots that are logged of a conversation; the last is whole.
_SNAPSHOTS = ((0, 1), (1, 2), (2, 4), (3, 8), (4, 16), (5, 1 << 40))


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is logged after 1, 2, 4, 8 and 16 turns and at its end: snapshots that begin another collapse, equal ones count."""
    turns = _table(spark, sf_dir, "conversations")
    logged = F.filter(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(k).cast("long").alias("k")) for e, k in _SNAPSHOTS]), lambda s: F.col("turn") < s["k"])
    rows = turns.select(F.explode(logged).alias("s"), "conv_id", "turn", "role", "text")
    return chat.format_chats(rows.select((F.col("conv_id") * 8 + F.col("s.e")).alias("conv_id"), "turn", "role", "text"), Scratch(spark, "op8s"))


_SNAPSHOTS_SQL = chat.SQL.replace("FROM conversations WHERE", f"FROM (SELECT conv_id * 8 + e AS conv_id, turn, role, text FROM conversations JOIN (VALUES {', '.join(map(str, _SNAPSHOTS))}) s(e, k) ON turn < k) WHERE")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_html_extraction, op3_embedding_near_dedup, op4_mixing, op5_sentencepiece, op6_sharding, op7_url_filters, op8_chat_formatting, op9_simhash_near_dedup, op10_pii_pseudonyms, op11_hard_negatives, op12_vector_codes, op13_warc, op1_quality_rules_of_sections, op8_chat_snapshots)
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality.SQL, "op4_mixing": mixing.SQL, "op7_url_filters": urls.SQL, "op8_chat_formatting": chat.SQL, "op11_hard_negatives": negatives.SQL, "op12_vector_codes": codes.SQL, "op13_warc": warc.SQL, "op1_quality_rules_of_sections": _SECTIONS_SQL, "op8_chat_snapshots": _SNAPSHOTS_SQL}
