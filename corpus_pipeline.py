"""The corpus pipeline: quality rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floatq.llm.line_dedup import line_dedup
from floatq.llm.near_dedup import near_dedup
from floatq.llm.packing import pack, token_pieces
from floatq.llm.quality import quality_rules
from floatq.llm.shared import Scratch, pick, row_key, unused

MAX_TOKENS = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one of which no text is left goes."""
    out = line_dedup(docs)
    left = F.col("n_dropped") == 0
    out = out.where(left | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(left, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words."""
    verdicts = near_dedup(docs, width=5)
    (row,) = unused(docs.columns, "row")
    dropped = Scratch(spark, "near-dropped").save(verdicts.where(~F.col("kept")).select(F.col("row").alias(row)).distinct(), "rows")
    return pick(docs.withColumn(row, row_key("doc_id", "text")), dropped, row, "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence of at most MAX_TOKENS tokens."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), MAX_TOKENS)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), MAX_TOKENS)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near), ("best_fit_packing", packing)]

#: SQL has no tokenizer and no linear program; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
