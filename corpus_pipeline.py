"""A corpus pipeline: quality filter, exact dedup, near-duplicate join, PII removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read as the next stage's documents. All stages but the last
return the columns of documents.

Awkward input, the same in every stage: a null text counts as empty, and stays null
where it is kept. Rows with a null id are scored and cleaned as others; exact dedup
keeps one of a text only if no row with an id has it, and the near-duplicate join keeps
them all. Repeated ids are separate rows; of rows with one id and one text exact dedup
keeps one. White space and empty texts are near copies of nothing. An empty table passes
through as an empty table, and without labels no document is dropped for quality. Other
columns, whatever their names, are carried along up to the last stage. Texts are read
whole however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.common import fold, small_batches, written
from docketlake.llm.exact_dedup import drop_exact_copies
from docketlake.llm.ngram_join import keep_one_of_each
from docketlake.llm.packing import pack_pieces, token_pieces
from docketlake.llm.pii import redact_pii
from docketlake.llm.quality import keep_quality, train_quality
from docketlake.llm.queries import WORD_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network, fitted on the labelled ones, scores under 0.5.

    Without a labelled document every score is 0.5, so all stay.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return keep_quality(docs, train_quality(docs, labels.filter(fold("doc_id", 3) != 1)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of each text; null ids give way to others."""
    return drop_exact_copies(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of similar ones.

    Rows with a null id or an empty set of words all stay.
    """
    small_batches(spark)
    return keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text, null for a null text."""
    small_batches(spark)
    return redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' pieces into sequences of at most 2048 ids.

    A null or empty text is its end id alone; a null id stays null in its pieces.
    The memo of chunks is smaller than by default: the workers are shared with the
    other stages, and a memo stays with its worker.
    """
    small_batches(spark)
    pieces = token_pieces(docs, WORD_BPE, memo=50_000).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_pieces(written(pieces, "pieces"))


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("ngram_join", near_copies), ("pii", personal_data), ("packing", packing)]

ORACLE_SQL = None  # no stage but exact dedup can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
