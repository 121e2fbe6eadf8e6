"""What several of the operators share: tables, task-side state, words."""

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_in_worker(key, make):
    """``make()`` once for each Python worker; later tasks of that worker get the same object."""
    store = sys.modules.setdefault("_roomtrace_worker", types.ModuleType("_roomtrace_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def plain(column) -> pa.Array:
    """One Arrow array of text, nulls as empty texts."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.string()) if array.type != pa.string() else array
    return pc.fill_null(array, "") if array.null_count else array


def by_bytes(texts: pa.Array, limit: int):
    """Cut an array into runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start, total = np.cumsum(sizes), 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, total + limit, side="right")))
        yield start, texts.slice(start, stop - start)
        start, total = stop, int(ends[stop - 1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array one after another, and the offsets of its texts in them."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start .. start + length of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
