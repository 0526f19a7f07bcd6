"""A bitmap of fixed size over hashes, so that a scan can tell on the spot what may have a partner elsewhere.

A false hit costs its caller a row and must change no result. With many more hashes than bits the bitmap hits always and
spares nothing; callers stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits: 16 MB wherever the bitmap is sent, whatever the input.
BITS = 1 << 27
SEGMENT = 1 << 16


def built(hashes: DataFrame, column: str, shift: int = 0) -> np.ndarray:
    """The bits of a column of 64-bit hashes whose lowest `shift` bits say nothing.

    Segments are packed where they are; what reaches the driver has BITS bits."""
    slot = F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit(BITS - 1))
    places = hashes.select(F.shiftright(slot, 16).alias("segment"), slot.bitwiseAND(F.lit(SEGMENT - 1)).alias("bit"))
    words = places.groupBy("segment", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    held = words.groupBy("segment").agg(F.collect_list(F.struct("word", "mask")).alias("words"))

    def packed(batches):
        for batch in batches:
            rows = []
            for words in batch.column(1):
                own = np.zeros(SEGMENT // 64, np.int64)
                own[words.values.field(0).to_numpy(zero_copy_only=False)] = words.values.field(1).to_numpy(zero_copy_only=False)
                rows.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["segment", "bits"])

    out = np.zeros((BITS // SEGMENT, SEGMENT // 64), np.uint64)
    for row in held.mapInArrow(packed, "segment long, bits binary").collect():  # bounded: a row for each segment
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint64)
    return out.ravel()


def hits(bits: np.ndarray, hashes: np.ndarray, shift: int = 0) -> np.ndarray:
    """The places of the hashes (unsigned) that the bitmap has."""
    slot = (hashes >> np.uint64(shift)) & np.uint64(len(bits) * 64 - 1)
    return np.flatnonzero((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
