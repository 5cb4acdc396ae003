"""Bit tables of a fixed size, for filters before a shuffle.

A table of 2**24 bits is 2 MB whatever it is built from. It lets through every
member and, as it fills, more and more others, which the join behind it drops.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

BITS = 24


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    return W.mix(values.view(np.uint64)) >> np.uint64(64 - bits)


def _cells(table: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in table:
        at = np.unique(_places(batch.column(0).to_numpy(), bits)) if batch.num_rows else np.zeros(0, np.uint64)
        cell, start = np.unique(at >> np.uint64(6), return_index=True)
        ones = np.left_shift(np.uint64(1), at & np.uint64(63))
        sums = np.bitwise_or.reduceat(ones, start) if len(at) else ones
        yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(sums.view(np.int64))], ["cell", "bits"])


def table_of(values: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bit table of a column of 64-bit numbers without nulls. At most 2**(bits - 6) rows reach the driver."""
    rows = values.mapInArrow(partial(_cells, bits=bits), "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    if rows.num_rows:
        out[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def inside(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of the 64-bit numbers may be in the table."""
    at = _places(values, len(table).bit_length() + 5)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
