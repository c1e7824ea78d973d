"""Helpers shared by the training-data operators: durable tables in the shared folder, slices of Arrow batches, tokenizer files."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import durable, new_folder, prepare_workers, release, shared_dir

__all__ = ["durable", "id_crc", "new_folder", "prepare_workers", "read_table", "release", "shared_dir", "sliced", "text_or_empty", "tokenizer_path", "trimmed"]

#: Rows that a Python worker takes on at a time. Spark cuts Arrow batches by bytes, but a batch may still have thousands of texts.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives the memory it freed back to the system when it ends: Python workers live on between tasks, and what one stage has held would lack in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return run


def tokenizer_path(name: str) -> str:
    """A public vocabulary file's place on this machine."""
    try:
        import public_tokenizers
    except ImportError:
        if "/opt" not in sys.path:
            sys.path.append("/opt")
        for folder in (os.environ.get("TOKENIZER_DIR"), "/opt/tokenizers"):
            if folder and os.path.exists(os.path.join(folder, name)):
                return os.path.join(folder, name)
        raise
    return public_tokenizers.path(name)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text, as folds are drawn by it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
