"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cleanup, materialize  # noqa: F401 (the operators' own name for them)

#: Largest object, in bytes, that an operator may broadcast.
BROADCAST_LIMIT = 64 * 1024 * 1024
#: Bits a value in :func:`hash_filter`, and its largest size in bytes.
FILTER_BITS_EACH = 16
FILTER_MAX_BYTES = 32 << 20


def broadcast_checked(spark: SparkSession, value, n_bytes: int, what: str):
    """Broadcast ``value`` after checking the stated size bound."""
    if n_bytes > BROADCAST_LIMIT:
        raise ValueError(f"{what} has {n_bytes} bytes; at most {BROADCAST_LIMIT} may be broadcast")
    return spark.sparkContext.broadcast(value)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size, from its plan alone."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _filter_places(hashes: np.ndarray, n_bits: int) -> list[np.ndarray]:
    h = hashes.view(np.uint64)
    return [(h >> np.uint64(shift)).astype(np.int64) & (n_bits - 1) for shift in (0, 21, 42)]


def in_filter(mask: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the mask of :func:`hash_filter` may hold; none that it holds is missed."""
    found = np.ones(len(hashes), bool)
    for at in _filter_places(hashes, len(mask) * 64):
        found &= (mask[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def hash_filter(values: DataFrame):
    """A Bloom filter over a column of 64-bit hashes, broadcast; bounded by ``FILTER_MAX_BYTES``.

    Beyond that bound it holds ever more values that were never put in, so it only
    spares work: what it lets through must be joined with ``values`` afterwards.
    """
    spark = values.sparkSession
    n = values.count()
    size = 1 << int(np.ceil(np.log2(max(64, min(FILTER_MAX_BYTES, FILTER_BITS_EACH * n // 8)))))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in _filter_places(b.column(0).to_numpy(zero_copy_only=False), size * 8):
                at = np.unique(at)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    found = values.mapInArrow(releasing(bits), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    mask = np.zeros(size // 8, np.int64)
    for part in found.toArrow().to_batches():  # at most FILTER_MAX_BYTES / 8 rows
        mask[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return broadcast_checked(spark, mask.view(np.uint64), mask.nbytes, "the filter")


def releasing(task: Callable) -> Callable:
    """``task`` over batches, after which the worker gives its free memory back.

    Workers outlive their tasks; without this each keeps its largest task's memory.
    """

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run
