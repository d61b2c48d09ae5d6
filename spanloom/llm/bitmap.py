"""Bitmaps of fixed size that the driver gets in a few hundred chunks, however many bits are set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk.
_CHUNK = 1 << 16


def _packed(table: pa.Table) -> pa.Table:
    own = np.zeros(_CHUNK, np.uint8)
    own[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return pa.table([pa.array([table.column("chunk")[0].as_py()], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["chunk", "held"])


def bitmap(df: DataFrame, place: Column, bits: int) -> np.ndarray:
    """Bytes with the bits at all ``place`` (from 0, below ``bits``) set. Tasks make the chunks; the driver takes ``bits / 8`` bytes in all."""
    byte = F.floor(place / 8).cast("int")
    one = F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)).cast("int"))
    words = df.groupBy(F.floor(byte / _CHUNK).cast("int").alias("chunk"), F.pmod(byte, F.lit(_CHUNK)).alias("at")).agg(F.bit_or(one).cast("int").alias("bits"))
    chunks = words.groupBy("chunk").applyInArrow(_packed, "chunk int, held binary").toArrow()
    held = np.zeros(-(-bits // 8), np.uint8)
    for k, part in zip(chunks.column(0).to_pylist(), chunks.column(1), strict=True):
        own = np.frombuffer(part.as_buffer(), np.uint8)[: len(held) - k * _CHUNK]
        held[k * _CHUNK : k * _CHUNK + len(own)] = own
    return held
