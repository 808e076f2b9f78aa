"""Array kernels over batches of texts: word bounds, word and n-gram hashes, code points.

Texts come as Arrow columns and are read as one array of UTF-8 bytes with offsets, in
pieces of a few hundred kilobytes (at least one text), so that memory follows the piece and the
longest text, not the batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: The bytes of [\x20\x09-\x0D], and the ASCII bytes that are neither letter nor digit.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(i).isalnum() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def unused(columns: Iterable[str], name: str) -> str:
    """name, with as many underscores after it as it takes to be none of columns in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@lru_cache(1)
def wordy() -> np.ndarray:
    """Whether each code point is a letter, a digit or a mark that combines with one."""
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] in "LNM"]] = True
    return out


def in_words(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 is of a code point that is wordy()."""
    out = ~MARKS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = [np.append(data, np.zeros(3, np.uint8))[lead + i].astype(np.int32) for i in range(4)]
        tail = [x & 63 for x in b]
        two, three = (b[0] & 31) << 6 | tail[1], (b[0] & 15) << 12 | tail[1] << 6 | tail[2]
        four = (b[0] & 7) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]
        point = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        other = ~wordy()[np.minimum(point, 0x10FFFF)]
        for i in range(4):
            out[lead[other & (size > i)] + i] = False
    return out


_powers: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix) of each element."""
    x = x + np.uint64((int(GOLD) * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        both = []
        for b in (BASE, BASE_INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def pieces(texts: pa.Array, lower: bool, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts; null is the empty text. lower: Unicode lower case."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + limit, "right")) - 1)
        part = texts.slice(i, j - i)
        if lower:
            part = pc.utf8_lower(part)
        start = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + j - i + 1]
        data = part.buffers()[2]
        data = np.frombuffer(data, np.uint8)[start[0] : start[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        yield i, j, data, start - start[0]
        i = j


class Words:
    """The words of a piece: start, end (bytes), doc (index in the piece), first and last word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray | None = None):
        """gaps: the bytes that part words; without it, runs of letters, digits and combining marks are words."""
        inside = in_words(data) if gaps is None else ~gaps[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        first = inside & (~before | edge[:-1])
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        last = inside & (~after | edge[1:])
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.start)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end): polynomial sums by prefix differences, then mixed with the length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    p, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * GOLD)


def runs(words: Words, k: int) -> np.ndarray:
    """Indices of the words that begin k words of one text."""
    at = np.arange(len(words))
    return at[at + k <= words.bounds[1:][words.doc]] if len(words) else at


def combine(hashes: np.ndarray, at: np.ndarray, offsets: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """The hash of the words at at + each offset, in order."""
    out = np.full(len(at), np.uint64(seed + 1), np.uint64)
    for i, o in enumerate(offsets):
        out += hashes[at + o] * np.uint64(pow(BASE, i + 1, 1 << 64))
    return mix(out)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the offsets in code points."""
    text = data.tobytes().decode("utf-8", "replace")
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), heads[offsets]


def group_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(values[order], at)


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds (0 for an empty stretch)."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
