"""Queries of the training-data operators over the whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm import chat, decontaminate, html, linededup, media, pieces, quality, sharding, simhash, sql, toxicity
from tokenlake.llm.common import read

#: A public SentencePiece model; a parameter of the encoder, never copied here.
PIECE_MODEL = os.environ.get("TOKENLAKE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load(PIECE_MODEL)
    coded = pieces.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return coded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.translate("text", pieces.BLANK, " ")).alias("round_trip"),
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = media.from_media(media.to_media(read(spark, sf_dir, "documents")))
    return back.withColumn("feature", F.lower(F.hex("phash"))).drop("phash")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(read(spark, sf_dir, "conversations"))
    return chat.digest(chat.parse(chat.format_conversations(rows)))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_sharding, op4_quality, op5_sentencepiece, op6_media, op7_html_extraction, op8_line_dedup, op9_chat_formatting, op10_simhash_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": sql.DECONTAMINATION, "op8_line_dedup": sql.LINE_DEDUP, "op9_chat_formatting": sql.CHAT}
