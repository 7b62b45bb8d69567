"""A bitmap of hashed values, of fixed size: says which values are surely not in a set.

It spares a shuffle of whole texts when few rows can match: rows that miss the bitmap
are settled where they are read, the others take the exact join. It never
exceeds ``2 ** BITS`` bits, so it may be sent to every task; a set too large for it
only lets more rows through to the join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.hashing import mix64

BITS = 24


class Bitmap:
    def __init__(self, words: np.ndarray):
        self.words = words

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        slot = _slots(values)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _slots(values: np.ndarray) -> np.ndarray:
    return mix64(np.ascontiguousarray(values, np.int64).view(np.uint64)) >> np.uint64(64 - BITS)


def bitmap(df: DataFrame, column: str) -> Bitmap:
    """Of the values of a column of long; null is left out."""
    def run(batches):
        for batch in batches:
            slot = np.unique(_slots(batch.column(0).to_numpy(zero_copy_only=False)))
            word = (slot >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word
            mask = (np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first) if len(word)
                    else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(mask.view(np.int64))],
                                             names=["word", "mask"])

    values = df.select(F.col(column).cast("long").alias("v")).filter("v is not null")
    # at most 2 ** (BITS - 6) rows
    rows = values.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << (BITS - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return Bitmap(words)
