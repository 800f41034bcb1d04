"""A corpus pipeline: language ID, exact dedup, near-duplicate dedup, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all rows
that the stage before kept and returns the next stage's docs, with the columns of documents;
the last returns the packed pieces. run() writes each stage's rows as Parquet in the shared
folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm._shared import crc_mod, drop_table, table
from tallyframe.llm.exact_dedup import exact_dedup
from tallyframe.llm.language_id import fit, identify
from tallyframe.llm.ngram_join import ngram_join
from tallyframe.llm.packing import pack_documents
from tallyframe.llm.suffix_dedup import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found: null texts and texts without a letter."""
    model = fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return identify(docs, model).where("lang_pred <> 'und'").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; rows that repeat id and text are one document and stay."""
    return exact_dedup(docs).where("dedup.kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (0.8 or more, over any number of links) the one with the least doc_id stays."""
    gone = ngram_join(docs).where("NOT doc_id <=> class_id").select(F.col("doc_id").alias("gone"), "text_hash")
    same = F.xxhash64(docs["text"]) == gone["text_hash"]
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]) & same, "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 200 bytes or more that occur more than once, at each place; every document stays."""
    cut = remove_repeats(docs, as_text=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("passages", passages), ("packing", packing)]

#: The stages are learned or go beyond SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
