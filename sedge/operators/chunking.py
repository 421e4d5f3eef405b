"""Overlapping line chunks (WIN-1, SRC-3, SRC-4, FLT-5, MTH-2, ARR-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text, udfs

SIZE, OVERLAP = 100, 20


def chunk_lines(df: DataFrame, text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """df without its text and with chunk_index, start_line, end_line, content: a row for each step of size - overlap lines.

    The last chunk may lie within the one before it. Texts without lines, and null, give no rows.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("overlap must be at least 0 and less than size, which must be above 0")
    step = size - overlap
    others = [c for c in df.columns if c != text_col]
    x = df.select(*others, text.lines(F.col(text_col)).alias("_lines")).where(F.size("_lines") > 0)
    x = x.select(*others, "_lines", F.posexplode(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(step))).alias("chunk_index", "_at"))
    content = F.array_join(F.slice("_lines", F.col("_at") + 1, F.lit(size)), "\n")
    return x.select(*others, "chunk_index", (F.col("_at") + 1).alias("start_line"), F.least(F.col("_at") + size, F.size("_lines")).alias("end_line"), content.alias("content"))


def chunk_files(tree: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """repository_id, file_path, chunk_index, start_line, end_line, content of a tree's files that are chunked."""
    files = tree.where(F.col("kind") == "file").where(paths.for_chunks(F.col("name"), F.col("dir_parts"))).where(F.col("content").isNotNull())
    read = files.select("repository_id", F.col("path").alias("file_path"), udfs.decode_lossy("content").alias("text"))
    return chunk_lines(read, "text", size, overlap)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """repository_id, chunks (AGG-9)."""
    return chunks.groupBy("repository_id").agg(F.count(F.lit(1)).alias("chunks"))
