"""Bit filters of 64-bit keys with two places for each: they let all keys pass that they were made of, and few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from entwine.llm import kernels as k
from entwine.llm.shared_files import put

SLICE = 20  # the logarithm of the places that are set at a time


def slots(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two of 2**size places for each key."""
    return ((keys >> np.uint64(7)) & np.uint64((1 << size) - 1)).astype(np.int64), ((keys * k.GOLD) >> np.uint64(64 - size)).astype(np.int64)


def size_for(n: int) -> int:
    """The logarithm of the places for n keys."""
    return max(8, (8 * n).bit_length())


def bits_of(keys: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(1 << size, bool)
    for at in slots(keys, size):
        out[at] = True
    return np.packbits(out, bitorder="little")


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key can be among those that bits was made of."""
    one, two = slots(keys, (len(bits) * 8).bit_length() - 1)
    read = lambda at: (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return read(one) & read(two)


def publish(keys: DataFrame, uri: str, size: int) -> str:
    """A file at uri with the filter of the one long column of keys, 2**size bits, made in slices of its places."""
    width = 1 << min(size, SLICE)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(slots(batch.column(0).to_numpy().view(np.uint64), size)))
            yield pa.RecordBatch.from_arrays([pa.array(at // width), pa.array(at % width)], ["slice", "at"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            s, at = (batch.column(c).to_numpy() for c in (0, 1))
            for one in np.unique(s):
                slices.setdefault(int(one), np.zeros(width, bool))[at[s == one]] = True
        for one, bits in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    dealt = keys.mapInArrow(place, "slice long, at long").repartition(min(256, max(1, (1 << size) // width)), "slice")
    out = np.zeros((1 << size) // 8, np.uint8)
    table = dealt.mapInArrow(fill, "slice long, bits binary").toArrow()
    for s, bits in zip(table["slice"].to_pylist(), table["bits"], strict=True):
        out[s * width // 8 : (s + 1) * width // 8] = np.frombuffer(bits.as_buffer(), np.uint8)
    return put(uri, {"bits": out})
