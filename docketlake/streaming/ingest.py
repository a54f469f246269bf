"""Ingestion of files: extract, chunk, embed, append; in batches or as they arrive.

The stream is an addition: each micro-batch of new files runs the same plan, and a
file that fails leaves a row in the report and stops nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.text import chunks, extension, is_blank
from docketlake.sources.embed import Embedder, embed
from docketlake.sources.extract import extract_text


def chunk_rows(docs: DataFrame, size: int = 1000, overlap: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` exploded into chunks: content, chunk_index (from 0), chunk_total."""
    held = docs.withColumn("_chunks", chunks(F.col(text_col), size, overlap))
    return held.select(*[c for c in docs.columns if c != text_col], F.size("_chunks").alias("chunk_total"), F.posexplode("_chunks").alias("chunk_index", "content"))


def split_blank(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with text, rows whose text is null or blank)."""
    blank = is_blank(F.col(text_col))
    return docs.filter(~blank), docs.filter(blank)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which characters beyond U+FFFF count twice."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def ingest_stats(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """key, characters_extracted, chunks_created of each text that is not blank."""
    kept, _ = split_blank(docs, text_col)
    return kept.select(key, utf16_length(F.col(text_col)).alias("characters_extracted"), F.size(chunks(F.col(text_col), size, overlap)).alias("chunks_created"))


def ingest(stored: DataFrame, embedder: Embedder, bucket: str, upload_date: str, matter_id: str | None = None, document_type_id: str | None = None, is_precedent: bool = False, size: int = 1000, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """(chunk rows, report) of files: what to append, and one row a file."""
    return ingest_text(extract_text(stored), embedder, bucket, upload_date, matter_id, document_type_id, is_precedent, size, overlap)


def pending(stored: DataFrame, report: DataFrame) -> DataFrame:
    """The files that no report calls ingested: what a retry has left to do."""
    return stored.join(report.filter("ingested").select("path"), "path", "left_anti")


def ingest_text(found: DataFrame, embedder: Embedder, bucket: str, upload_date: str, matter_id: str | None = None, document_type_id: str | None = None, is_precedent: bool = False, size: int = 1000, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """``ingest`` of files whose text is extracted; both results read ``found``."""
    rows = chunk_rows(found.filter("error IS NULL"), size, overlap)
    meta = F.to_json(F.struct("filename", "file_type", F.lit(upload_date).alias("upload_date"), F.col("path").alias("storage_path"), F.lit(bucket).alias("storage_bucket"), "file_size", "original_format", "page_count", "sheet_count", "chunk_index", "chunk_total"))
    out = rows.select("content", meta.alias("metadata"), F.lit(matter_id).cast("string").alias("matter_id"), F.lit(document_type_id).cast("string").alias("document_type_id"), F.lit(is_precedent).alias("is_precedent"))
    report = found.select("path", F.col("error").isNull().alias("ingested"), "error", utf16_length(F.col("text")).alias("characters_extracted"), F.size(chunks(F.col("text"), size, overlap)).alias("chunks_created"))
    return embed(out, embedder), report


def ingest_stream(spark: SparkSession, path: str, out: str, checkpoint: str, embedder: Embedder, bucket: str, **options):
    """Adds the chunks of files that appear under ``path`` to the tables under ``out``.

    Each batch writes a partition of its own, so a batch that is tried again replaces
    what it has left. Files are read and extracted once a batch.
    """
    arriving = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)

    def each(batch: DataFrame, number: int) -> None:
        found = extract_text(batch.withColumn("file_type", extension(F.col("path")))).persist()
        rows, report = ingest_text(found, embedder, bucket, **options)
        rows.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        report.write.mode("overwrite").parquet(f"{out}/report/batch={number}")
        found.unpersist()

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
