"""A pipeline over the table documents: five stages, each written as Parquet and read again by the next one.

Stages but the last return the columns of documents, whatever further columns there are. Null texts count as empty; an empty table stays
empty. A document is a row: rows that share a doc_id, or have none, are told apart by their texts. What a stage writes on its way goes when it is
done, and its own folder once the next stage is written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.llm import op1_decontaminate, op4_suffix_dedup, op7_sentencepiece, op8_toxicity, op9_jaccard_join
from cardlake.llm.shared import remove, scratch, shared_folder, table

SCORE = "__toxicity"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic. Empty texts stay; without labels all do."""
    model = op8_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op8_toxicity.score_documents(docs, model, name=SCORE).where(F.col(SCORE) < op8_toxicity.THRESHOLD).select(docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64(F.col("text").cast("string"))})


def _join(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Keyed docs that are, or aren't, among found (doc_id, text_hash), by how."""
    names = found.select(F.col("doc_id").alias("__of"), F.col("text_hash").alias("__as")).distinct()
    return docs.join(names, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__as")), how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of connected near duplicates the document of least doc_id stays (on ties that of the least hash of its text, and of equal rows one)."""
    near = table(op9_jaccard_join.near_duplicates(docs).select("doc_id", "text_hash", "first"), "near")
    left = _join(_keyed(docs), near.where(~F.col("first")), "left_anti")
    # rows that repeat both doc_id and text are few: only they are dealt again
    again = near.where("first").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    once = _join(left, again, "left_semi").dropDuplicates(["__id", "__hash"])
    return _join(left, again, "left_anti").unionByName(once).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document, or an earlier place, has too. No document goes, even if nothing of it is left."""
    cut = op4_suffix_dedup.remove_repeats(docs.withColumnsRenamed({c: f"__of_{c}" for c in docs.columns if c not in ("doc_id", "text")}))
    size = F.length("kept")
    left = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in docs.columns:
        left["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return cut.select(*(left.get(c, F.col(f"`__of_{c}`")).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a passage of the benchmark."""
    found = op1_decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _join(_keyed(docs), found, "left_anti").select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return op7_sentencepiece.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: The stages learn, align and tokenise: no SQL gives their rows. tests/llm holds the rows of each on a planted table against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
