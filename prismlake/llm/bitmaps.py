"""Bit sets of 64-bit keys: a filter of bounded size that tasks apply before a shuffle.

A filter may pass a key that was never put in (the join after it is exact) but never drops one that was.
It has SPARE bits for each key and each key sets PROBES of them, so that about one foreign key in 400
passes, up to 2**MOST_BITS bits (32 MB): beyond that many keys it is as right as before, but holds back
less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, SPARE, PROBES = 16, 28, 16, 4
#: The step from a probe to the next comes from the bits of the key above these.
STEP_AT = 24


def build(keys: DataFrame, column: str, log_bits: int | None = None) -> np.ndarray:
    """Bytes of the filter of all values of a long column, gathered by grouped bit-or: no more rows reach
    the driver than PROBES for each key, or than 2**(log_bits - 6). The size comes from a count of the keys."""
    if log_bits is None:
        log_bits = min(MOST_BITS, max(LEAST_BITS, (SPARE * keys.count()).bit_length()))
    size = 1 << log_bits
    first, step = F.shiftrightunsigned(column, 64 - log_bits), F.shiftrightunsigned(column, STEP_AT) % size
    slots = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(*((first + i * step) % size for i in range(PROBES)))).alias("slot"))
    words = slots.select(F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()
    table = np.zeros(size >> 6, np.int64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return table.view(np.uint8)


def probe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys the filter passes."""
    size = len(table) * 8
    slot, step = keys >> np.uint64(64 - int(size - 1).bit_length()), (keys >> np.uint64(STEP_AT)) % np.uint64(size)
    out = np.ones(len(keys), bool)
    for _ in range(PROBES):
        out &= (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        slot = (slot + step) % np.uint64(size)
    return out


def build_ids(ids: DataFrame, column: str, log_bits: int | None = None) -> np.ndarray:
    """build() for plain ids, which textkernel.mix spreads first; probe with mix(ids)."""
    from collections.abc import Iterator

    import pyarrow as pa

    from prismlake.llm.textkernel import mix

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(mix(batch.column(0).to_numpy().astype(np.uint64)).view(np.int64))], ["key"])

    return build(ids.select(F.col(column).alias("key")).where("key is not null").mapInArrow(spread, "key long"), "key", log_bits)
