"""A training-corpus pipeline over ``documents``: each stage reads what the stage before it kept.

Language identification rejects documents without letters and those whose language stays unclear; line deduplication
drops lines that recur, and documents of which no word is left; near-duplicate removal keeps one document of each group;
mixing reads documents by the targets of their sources, so a document may come twice, or in part; encoding turns texts
into token ids.

Defined results: a null, empty or blank text has no letters and goes in the first stage; rows with null ids pass language
identification and line deduplication like others, cannot be grouped, and stay; of rows that repeat an id near-duplicate
removal leaves the first by text and then by the other columns; ties go as the operators state; very long texts are read
whole; an empty table stays empty; further columns go along unchanged under their own names, whatever these are, up to
mixing, and ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import language
from plumbline.llm.bpe import encode_documents
from plumbline.llm.line_templates import drop_templates
from plumbline.llm.minhash import near_duplicates
from plumbline.llm.mixing import mixed_texts
from plumbline.llm.text import discard, held_out, scratch

LEAST_SCORE = 0.5


def _packed(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns and all further ones as one struct, ``rest``, so that none can clash with what an operator adds."""
    rest = [docs[f"`{c}`"] for c in docs.columns if c not in named]
    return docs.select(*named, F.struct(*rest or [F.lit(0).alias("none")]).alias("rest"))


def _unpacked(rows: DataFrame, like: DataFrame, *named: str) -> DataFrame:
    """The columns of ``like``: the named ones as they are, the others from ``rest``; n_chars follows the text."""
    pick = {c: F.col(c) if c in named else F.col("rest").getField(c) for c in like.columns}
    if "n_chars" in pick:
        pick["n_chars"] = F.length("text").cast(like.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in pick.items()])


def _free(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it."""
    while name in docs.columns:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.where(~held_out(F.col("doc_id"), 5, 0)).select("lang", "text"))
    known = language.identify(_packed(docs, "doc_id", "text"), model, keep=("doc_id", "text", "rest"))
    return _unpacked(known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs, "doc_id", "text")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = drop_templates(_packed(docs, "doc_id", "text"), keep=("rest",))
    return _unpacked(left.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs, "doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id").distinct()
    ones, place = docs.join(kept, "doc_id", "left_semi"), _free(docs, "place")
    first = Window.partitionBy("doc_id").orderBy("text", *[ones[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")])
    ones = ones.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)  # repeated rows
    return ones.unionByName(docs.where("doc_id is null"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = "doc_id", "text", "source"
    return _unpacked(mixed_texts(_packed(docs, *named), keep=("rest",)), docs, *named)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    coded = encode_documents(docs.select("doc_id", "text", "lang", "source"), path or str(public_tokenizers.path("byte_bpe_50k.json")), keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_recurring_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_to_targets),
    ("BPE encoding and decoding", encode),
]

#: Language models and encoders are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as kept:  # what a stage has written on its way goes with it
            docs = kept(stage(spark, before, sf_dir))
        if before is not docs and hasattr(before, "_written_to"):
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
