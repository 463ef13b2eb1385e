"""Queries of the training-data operations: each applies one operator to a whole table and returns its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language, oracles, pu_quality, toxicity
from plumbline.llm.bpe import encode_documents
from plumbline.llm.chat_template import format_conversations, read_back
from plumbline.llm.conversation_repair import damaged, repair_conversations
from plumbline.llm.line_templates import drop_templates
from plumbline.llm.merkle import merkle_manifest, proof_digest
from plumbline.llm.minhash import near_duplicates
from plumbline.llm.mixing import mix_sources
from plumbline.llm.neighbours import nearest_neighbours
from plumbline.llm.quality_rules import quality_rules
from plumbline.llm.suffix_dedup import repeated_spans
from plumbline.llm.text import held_out, materialise, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """``path``: the vocabulary file, by default the one of the installed library."""
    import public_tokenizers

    coded = encode_documents(table(spark, sf_dir, "documents"), path or str(public_tokenizers.path("byte_bpe_50k.json")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    rows = materialise(pu_quality.featured(docs, keep=("doc_id", "held_out")))
    net = pu_quality.train(rows.where("not held_out").select("doc_id", "x"), labels.select("doc_id", "quality"))
    return pu_quality.score(rows, net, keep=("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    index = toxicity.train(docs.where("not held_out").select("doc_id", "text"), docs.select("text"), labels.select("doc_id", "toxic"))
    return toxicity.score(docs, index, keep=("doc_id", "held_out")).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = language.train(docs.where("not held_out").select("lang", "text"))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_templates(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 100 = 0"), k=10)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 5 divides the crc32 of the id, the text that is checked has its A-Z lower-cased."""
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claim = F.when(altered, F.translate("text", oracles.UPPER, oracles.LOWER)).otherwise(F.col("text"))
    proved = merkle_manifest(table(spark, sf_dir, "documents"), {"text": claim})
    return proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of number -1 whose texts look like control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_conversations(rows.unionByName(hard)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(rows), rows)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_mix_sources, op3_pu_quality, op4_bpe_encode_decode, op5_minhash_near_dedup, op6_toxicity, op7_language_id, op8_line_templates, op9_nearest_neighbours, op10_suffix_dedup, op11_merkle_manifest, op12_chat_format, op13_conversation_repair)}
ORACLE_SQL = {"op2_mix_sources": oracles.mix_sources(), "op5_minhash_near_dedup": oracles.near_duplicates(2, 80), "op8_line_templates": oracles.line_templates(), "op10_suffix_dedup": oracles.repeated_spans(), "op11_merkle_manifest": oracles.merkle_manifest(), "op12_chat_format": oracles.chat_format(), "op13_conversation_repair": oracles.conversation_repair()}
