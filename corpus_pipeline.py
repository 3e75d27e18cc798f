"""A corpus pipeline over `documents`: toxicity, line dedup, near-duplicates, decontamination, encoding.

Each stage takes what the one before it kept and returns the columns of
documents; the last returns token counts and digests. Rows with a null doc_id
go through every stage, null texts count as empty, empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm import bpe, decontam, lines, superminhash, toxicity
from rippleframe.llm.tables import alone, small_batches, stored, table, without_ids


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject."""
    small_batches(spark)
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document (or line) has; one of which no word is left goes."""
    small_batches(spark)
    others = {c: f"other_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # their names may be those of counts
    named = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(new) for c, new in others.items()])
    out = lines.dedup_lines(named, keep=tuple(others.values()))
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in others:
        out = out.withColumn(others["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    small_batches(spark)
    copies = alone(lambda: superminhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct())
    return without_ids(docs, copies, "doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    small_batches(spark)
    leaked = alone(lambda: decontam.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").filter("doc_id is not null").distinct())
    return without_ids(docs, leaked, "doc_id")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    small_batches(spark)
    return bpe.token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]
#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
