"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark items, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it again for the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Scratch, row_key
from sparkloom.llm.decontaminate import decontaminate
from sparkloom.llm.minhash import near_duplicates
from sparkloom.llm.pieces import load_pieces
from sparkloom.llm.sampling import segment
from sparkloom.llm.suffixes import without_repeats
from sparkloom.llm.toxicity import rejected

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject.

    A rejected doc_id goes with all its rows; rows without an id are kept if they score below the threshold.
    """
    docs = docs.select(*COLUMNS)
    bad = Scratch(spark).table(rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(F.col("key").alias("_bad")))
    return docs.join(bad, row_key() == F.col("_bad"), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates (five words, similarity 0.8), once.

    Of rows equal in id and text the one with the least lang, source and n_chars stays. Rows without an id are no copies of
    others, and of equal ones among them one stays; texts without words are linked with nothing. Rows without an id are
    spread by their text. Long texts are shingled whole; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    gone = Scratch(spark).table(near_duplicates(docs).where("not kept").select(F.col("doc_id").cast("string").alias("_gone")).distinct())
    kept = docs.join(gone, row_key() == F.col("_gone"), "left_anti")
    first = kept.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("first"))
    return first.select("doc_id", "text", "first.lang", "first.source", "first.n_chars")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id holds too.

    Null texts stay null, and an empty text empty; rows without an id take no part and keep their text. Rows that repeat an id
    aren't each other's smaller document. Texts of any length are read in pieces; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    kept = without_repeats(docs.withColumn("null_text", F.col("text").isNull()), carry=("lang", "source", "n_chars", "null_text"))
    text = F.when(~F.col("null_text"), F.col("kept_text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("null_text"), F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long")).alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows without an id are judged by their own text, null and empty texts stay."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces, lossless of every row; null and empty texts have no pieces, long texts are cut whole."""
    return segment(docs, load_pieces())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_leaks),
    ("pieces", to_pieces),
]

#: A recurrent network, permutations and sampled pieces have no SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
