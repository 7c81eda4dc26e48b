"""What the operators of this package share: column helpers, and Arrow batches cut to bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.functions.storage import materialise

__all__ = ["WORD", "id_remainder", "materialise", "table", "text_slices", "utf8"]

#: A word, where a contract counts or shingles words: a run of bytes other than ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, rows: int = 2_048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has at most `rows` rows and the column `text` about `most` bytes (one longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").cast(pa.large_binary())
        ends = np.cumsum(np.nan_to_num(np.array(pa.compute.binary_length(text).to_numpy(zero_copy_only=False), dtype=float))).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the column `text` one after another, and where each row begins (with the end as last entry). Null is empty."""
    col = batch.column("text")
    col = col.cast(pa.large_binary()) if col.type != pa.large_binary() else col
    col = col.fill_null(b"") if col.null_count else col
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
