"""Elias-Fano sequences and the levels of an n-gram trie laid over them, as arrays in one mapped file."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

STEP = 5  # every 2**STEP-th bit's place is kept


def _byte_select() -> np.ndarray:
    """[byte, k]: the place of the k-th set bit of a byte (8 if there is none)."""
    out = np.full((256, 8), 8, np.uint8)
    for b in range(256):
        at = [i for i in range(8) if b >> i & 1]
        out[b, : len(at)] = at
    return out


BYTE_SELECT = _byte_select()


def _in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit of each word."""
    place = np.zeros(len(k), np.int64)
    for half in (32, 16, 8):
        n = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        go = k >= n
        k = np.where(go, k - n, k)
        words = np.where(go, words >> np.uint64(half), words)
        place += half * go
    return place + BYTE_SELECT[(words & np.uint64(255)).astype(np.int64), np.minimum(k, 7)]


@dataclass
class EliasFano:
    """A non-decreasing sequence of n integers below universe, in about 3 + log2(universe / n) bits each.

    before: set bits before each word of high; ones, zeros: the word of every 2**STEP-th set and clear bit.
    """

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    before: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n) * bits
            _or_into(low, at // 64, part << (at % 64).astype(np.uint64))
            over = at % 64 + bits > 64
            _or_into(low, at[over] // 64 + 1, part[over] >> (64 - at[over] % 64).astype(np.uint64))
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((n + (int(universe) >> bits) + 2 + 63) // 64, np.uint64)
        _or_into(high, places // 64, np.uint64(1) << (places % 64).astype(np.uint64))
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        clear = np.arange(len(before), dtype=np.int64) * 64 - before
        mark = lambda c: np.append(np.searchsorted(c, np.arange(0, c[-1], 1 << STEP), "right") - 1, len(high) - 1)
        small = lambda a: a.astype(np.uint32) if high.size < 1 << 25 else a.astype(np.int64)
        return cls(n, bits, low, high, small(before), small(mark(before)), small(mark(clear)))

    def _select(self, k: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the k-th set bits of high (of the k-th clear bits, if flip)."""
        marks = self.zeros if flip else self.ones
        j = k >> STEP
        lo, hi = marks[j].astype(np.int64), marks[j + 1].astype(np.int64)
        count = (lambda w: 64 * w - self.before[w]) if flip else (lambda w: self.before[w].astype(np.int64))
        # the last word with no more than k before it
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_] + 1) // 2
            fits = count(middle) <= k[open_]
            lo[open_] = np.where(fits, middle, lo[open_])
            hi[open_] = np.where(fits, hi[open_], middle - 1)
        words = self.high[lo]
        return 64 * lo + _in_word(~words if flip else words, k - count(lo))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word, shift = at // 64, (at % 64).astype(np.uint64)
        over = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (((self.low[word] >> shift) | over) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _after(self, place: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """The places of the k-th bits as in _select, each the next of its kind after place."""
        words = self.high[place >> 6]
        rest = ((~words if flip else words) >> (place & 63).astype(np.uint64)) >> np.uint64(1)
        lowest = rest & (~rest + np.uint64(1))
        out = place + 1 + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        out[far] = self._select(k[far], flip)
        return out

    def _value(self, place: np.ndarray, i: np.ndarray) -> np.ndarray:
        return ((place - i) << self.bits) | self._low(i)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        return self._value(self._select(i, False), i)

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the places i and i + 1."""
        place = self._select(i, False)
        return self._value(place, i), self._value(self._after(place, i + 1, False), i + 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the first place whose value is x or more, n if none; whether it is x)."""
        top = x >> self.bits
        # the values with a high part below top lie before the clear bit that ends it
        before = self._select(np.maximum(top - 1, 0), True)
        end = np.where(top > 0, self._after(before, top, True), before) - top
        start = np.where(top > 0, before - (top - 1), 0)
        last, low = end.copy(), x & ((1 << self.bits) - 1)
        while (open_ := np.flatnonzero(start < end)).size:
            middle = (start[open_] + end[open_]) // 2
            less = self._low(middle) < low[open_]
            start[open_] = np.where(less, middle + 1, start[open_])
            end[open_] = np.where(less, end[open_], middle)
        return start, (start < last) & (self._low(np.minimum(start, max(0, self.n - 1))) == low)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.bits], np.int64), "low": self.low, "high": self.high, "before": self.before, "ones": self.ones, "zeros": self.zeros}

    @classmethod
    def read(cls, a: dict[str, np.ndarray]) -> EliasFano:
        return cls(int(a["meta"][0]), int(a["meta"][1]), a["low"], a["high"], a["before"], a["ones"], a["zeros"])


def _or_into(out: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """out[at] |= bits; at does not decrease."""
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] |= np.bitwise_or.reduceat(bits, first)


@dataclass
class Level:
    """The n-grams of one order. The children of context c are the places pointer(c) to pointer(c + 1) - 1.

    A child's value is its word + 1 plus the value of the last child of the contexts before,
    so that the whole level does not decrease; a word is found in its context by a search
    for the successor of that sum.
    """

    pointers: EliasFano
    words: EliasFano
    prob: np.ndarray
    prob_book: np.ndarray
    back: np.ndarray
    back_book: np.ndarray

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, contexts: int, prob: np.ndarray, back: np.ndarray) -> Level:
        """From (context, word) in order; back: of the n-grams of this level as contexts of the next."""
        pointers = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=contexts))])
        ends = np.flatnonzero(np.concatenate([context[1:] != context[:-1], [True]])) if len(context) else np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum(word[ends] + 1)])
        group = np.cumsum(np.concatenate([[0], (context[1:] != context[:-1]).astype(np.int64)])) if len(context) else np.zeros(0, np.int64)
        return cls(EliasFano.of(pointers, len(word) + 1), EliasFano.of(word + 1 + base[group], int(base[-1]) + 1), *quantised(prob), *quantised(back))

    def find(self, context: np.ndarray, word: np.ndarray, block: int = 1 << 14) -> np.ndarray:
        """The place of each word under its context, -1 where there is none."""
        out = np.full(len(context), -1, np.int64)
        if not self.words.n:
            return out
        last = int(self.words.access(np.array([self.words.n - 1]))[0])
        for a in range(0, len(context), block):  # as much as caches hold
            first, end = self.pointers.both(context[a : a + block])
            some = np.flatnonzero(end > first)
            first, end = first[some], end[some]
            target = np.where(first > 0, self.words.access(np.maximum(first - 1, 0)), 0) + word[a : a + block][some] + 1
            at, equal = self.words.successor(np.minimum(target, last))
            hit = equal & (at < end) & (target <= last)
            out[a + some[hit]] = at[hit]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        out = {"prob": self.prob, "prob_book": self.prob_book, "back": self.back, "back_book": self.back_book}
        for name, ef in (("pointers", self.pointers), ("words", self.words)):
            out |= {f"{name}.{x}": a for x, a in ef.arrays().items()}
        return out

    @classmethod
    def read(cls, a: dict[str, np.ndarray]) -> Level:
        ef = lambda name: EliasFano.read({x.split(".")[1]: v for x, v in a.items() if x.startswith(name + ".")})
        return cls(ef("pointers"), ef("words"), a["prob"], a["prob_book"], a["back"], a["back_book"])


def quantised(values: np.ndarray, steps: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """(code of each value, value of each code): the values themselves if they are few, else the means of equally full bins."""
    distinct = np.unique(values)
    if len(distinct) <= steps:
        return np.searchsorted(distinct, values).astype(np.uint16), distinct.astype(np.float64)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, steps + 1)))
    code = np.clip(np.searchsorted(edges, values, "right") - 1, 0, len(edges) - 2)
    full = np.bincount(code, minlength=len(edges) - 1)
    book = np.bincount(code, weights=values, minlength=len(edges) - 1) / np.maximum(full, 1)
    return code.astype(np.uint16), book


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """One blob: length of the header, header (name, type, start, count), arrays at multiples of 64 bytes."""
    header, at = [], 0
    for name, a in arrays.items():
        header.append([name, a.dtype.str, at, len(a)])
        at = -(-(at + a.nbytes) // 64) * 64
    text = json.dumps(header).encode()
    top = -(-(8 + len(text)) // 64) * 64
    out = bytearray(top + at)
    out[:8] = len(text).to_bytes(8, "little")
    out[8 : 8 + len(text)] = text
    for (_, _, start, _), a in zip(header, arrays.values(), strict=True):
        out[top + start : top + start + a.nbytes] = np.ascontiguousarray(a).tobytes()
    return bytes(out)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a blob, as views of the mapped file."""
    data = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(bytes(data[:8]), "little")
    top = -(-(8 + n) // 64) * 64
    out = {}
    for name, kind, start, count in json.loads(bytes(data[8 : 8 + n])):
        kind = np.dtype(kind)
        out[name] = np.frombuffer(data, kind, count, top + start) if count else np.zeros(0, kind)
    return out


@dataclass
class HashIndex:
    """Sorted 64-bit hashes, found by their leading bits."""

    hashes: np.ndarray
    starts: np.ndarray
    shift: int

    @classmethod
    def of(cls, hashes: np.ndarray) -> HashIndex:
        bits = max(1, len(hashes).bit_length())
        starts = np.searchsorted((hashes >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1)).astype(np.int32)
        return cls(hashes, starts, 64 - bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes):
            return out
        top = (h >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.starts[top].astype(np.int64), self.starts[top + 1].astype(np.int64)
        open_ = np.flatnonzero(at < end)
        at, end, h = at[open_], end[open_], h[open_]
        while len(open_):
            found = self.hashes[at]
            hit = found == h
            out[open_[hit]] = at[hit]
            at = at + 1
            more = np.flatnonzero((found < h) & (at < end))
            open_, at, end, h = open_[more], at[more], end[more], h[more]
        return out
