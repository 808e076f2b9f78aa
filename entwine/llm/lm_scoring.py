"""LM scoring: an Elias-Fano n-gram trie.

Tokens are runs of non-white bytes with A-Z in lower case, then one end token per text.

Unigrams are counted whole: c(w) for every distinct token of the texts learnt from, N
tokens in all, V distinct. base(w) = (c(w) + 1) / (N + V + 1).

N-grams of orders 2 and 3 are over all tokens, with the start of a text as a context, and
are kept if they occur LEAST times, however large the input. With discount D:
    p(w | context) = (c(context w) - D) / c(context) + back(context) * p(w | shorter context)
for kept n-grams, and the second part alone for others; back is the weight left over, so each
context's probabilities sum to 1.

Counting. Every text position gives a token with the one before and the one after; these
triples are summed in each task, dealt by a hash of their first two tokens, and summed again: a
part has all of the n-grams that begin with its pairs, so both orders come from one pass and one
shuffle. Common tokens are numbered by rank, so that what is shuffled is small.

The trie. Discounted probabilities and back-off weights, with logarithms quantised to 4096 values a level, lie
in levels of Elias-Fano sequences (see elias_fano), sharded by the same hash. Executors build a
shard each, write it into the shared folder, and all workers map it from there; a query finds a
word among its context's children by its successor, and adds the back-off's share. Mapped are
at most WORDS tokens and GRAMS n-grams of each order, the most usual ones: that is a bound on
what workers map, not on what is kept. Tokens and kept n-grams beyond it meet
their values in a join by hash, after a sum per text, as what they add to the score of a text:
a token its base and back-off, a kept n-gram what it changes against its back-off. A filter of at most
2**FILTER_BITS bits spares n-grams that surely are none of these the join.

Defined results. Null text is the empty text: one end token. A text without known tokens has the
end token. Nothing learnt: base(w) = 1 for every token, both scores 0, all tokens unknown.
An empty table gives an empty result; repeated rows get a row each; very long texts are
read whole. Extra columns are not read and can have any name.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.functions.session import forget, release, shared_folder, ship, stored
from entwine.llm import kernels as k
from entwine.llm.bit_filters import among, bits_of, publish, size_for
from entwine.llm.elias_fano import HashIndex, Level, quantised
from entwine.llm.language_id import remainder
from entwine.llm.shared_files import arrays_of, put

#: What workers map at most: tokens, n-grams of each order; and how many pairs a shard aims at.
WORDS, GRAMS, SHARD = 1 << 22, 1 << 26, 1 << 19
LEAST, FILTER_BITS = 2, 28
DISCOUNT = 0.75
END, START = np.uint64(0x5EED5EED5EED5EED), np.uint64(0x57A257A257A257A2)
#: Hashes of tokens are not below LOW, which leaves lesser codes for the numbers of common tokens.
LOW = 1 << 24
HELD, TRIPLES, PART = 300_000, 700_000, 1 << 20
#: Tasks that parts are dealt among at most; a task sums one part after the other.
TASKS = 1 << 16
PIECE = 1 << 20


def tokens(texts: pa.Array, limit: int = k.PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, token hashes with the end tokens, bounds of each text)."""
    for i, j, data, offsets in k.pieces(texts, False, limit):
        data = k.LOWER[data]
        words = k.Words(data, offsets, k.WHITE)
        bounds = words.bounds + np.arange(j - i + 1)
        out = np.full(int(bounds[-1]), END, np.uint64)
        hashes = k.span_hashes(data, words.start, words.end)
        out[np.arange(len(words)) + words.doc] = np.where(hashes < LOW, hashes + np.uint64(LOW), hashes)
        yield i, j, out, bounds


class Counter:
    """Sums per key, with what goes with it, given out whenever more than HELD keys are held."""

    def __init__(self, *names: str) -> None:
        self.names = names
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *sums: np.ndarray) -> None:
        self.parts.append(_summed(keys, *sums))
        self.size += len(self.parts[-1][0])
        if self.size > HELD and len(self.parts) > 1:
            self.merge()

    def merge(self) -> None:
        if self.parts:
            self.parts = [_summed(*[np.concatenate(c) for c in zip(*self.parts, strict=True)])]
            self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return self.size > HELD

    def take(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for keys, *sums in self.parts:
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].view(np.int64)), *[pa.array(s[a : a + 100_000]) for s in sums]], list(self.names))
        self.parts, self.size = [], 0


def _summed(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each."""
    if not len(keys):
        return keys, *sums
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], *[np.add.reduceat(s[order], at) for s in sums]


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter("key", "n")
    for batch in batches:
        for _, _, h, _ in tokens(batch.column(0)):
            counter.add(h, np.ones(len(h), np.int64))
            if counter.full():
                yield from counter.take()
    yield from counter.take()


def gram(first: np.ndarray, second: np.ndarray, order: int) -> np.ndarray:
    """The key of an n-gram: of the codes of two tokens, or of a pair's key and a code."""
    return k.mix(first * k.M1 + second * k.M2, 3 + order)


@dataclass
class Vocabulary:
    """The common tokens: their number is their place in falling order of counts; other tokens have their hash as code.

    number: of each hash; count: of each number; start: the code of the start of a text, none: of what comes after its end.
    """

    index: HashIndex
    number: np.ndarray
    count: np.ndarray
    sizes: np.ndarray

    def __post_init__(self) -> None:
        self.total, self.distinct, self.texts, self.least = (int(x) for x in self.sizes)
        self.start, self.none = len(self.number), len(self.number) + 1

    @classmethod
    def read(cls, uri: str) -> Vocabulary:
        a = arrays_of(uri)
        return cls(HashIndex(a["hashes"], a["starts"], int(a["shift"][0])), a["number"], a["count"], a["sizes"])

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each token, -1 for others than common ones."""
        at = self.index.find(h)
        return np.where(at >= 0, self.number[np.maximum(at, 0)], -1).astype(np.int64) if len(self.number) else at

    def codes(self, h: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers >= 0, numbers.astype(np.uint64), h)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """The token hash of each code (START for the start)."""
        by_number = np.empty(self.start + 1, np.uint64)
        by_number[self.number] = self.index.hashes
        by_number[self.start] = START
        return np.where(codes < LOW, by_number[np.minimum(codes, np.uint64(self.start)).astype(np.int64)], codes)

    def base(self, numbers: np.ndarray) -> np.ndarray:
        """The unigram probability of each number; 1 for others than common tokens."""
        if not self.start:
            return np.ones(len(numbers))
        return np.where(numbers >= 0, (self.count[np.maximum(numbers, 0)] + 1.0) / (self.total + self.distinct + 1.0), 1.0)

    def as_context(self, numbers: np.ndarray) -> np.ndarray:
        """How often each token, or the start of a text, is there as a context."""
        return np.where(numbers == self.start, float(self.texts), self.count[np.minimum(numbers, self.start - 1)]) if self.start else np.full(len(numbers), float(self.texts))


def shifted(codes: np.ndarray, bounds: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The code before and after each token of a text, first and last at its ends."""
    before, after = np.empty_like(codes), np.empty_like(codes)
    before[1:], after[:-1] = codes[:-1], codes[1:]
    before[bounds[:-1]], after[bounds[1:] - 1] = first, last
    return before, after


def _planes(a: np.ndarray) -> bytes:
    """The bytes of a, the lowest of all elements first: the high bytes are alike."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _bundle(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a) for a in arrays], np.int64).tobytes()
    return sizes + pa.compress(b"".join(_planes(a) for a in arrays), codec="zstd", asbytes=True)


def _unbundle(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(blob[: 8 * len(kinds)], np.int64)
    dtypes = [np.dtype(x) for x in kinds]
    data = pa.decompress(blob[8 * len(kinds) :], decompressed_size=int(sum(n * d.itemsize for n, d in zip(sizes, dtypes, strict=True))), codec="zstd", asbytes=True)
    out, at = [], 0
    for n, d in zip(sizes, dtypes, strict=True):
        planes = np.frombuffer(data, np.uint8, n * d.itemsize, at).reshape(d.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(d))
        at += int(n) * d.itemsize
    return out


TRIPLE_KINDS = ("u8", "u8", "u4", "u8", "u8")


def _sum_triples(pair: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, a, b, number of its triples) of distinct pairs in order of their keys; (c, n) of their distinct triples."""
    order = np.lexsort((c, pair))
    pair, c, n = pair[order], c[order], n[order]
    new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])
    at = np.flatnonzero(new_pair | np.concatenate([[True], c[1:] != c[:-1]]))
    first = np.flatnonzero(new_pair[at])
    of = order[at[first]]
    many = np.diff(np.append(first, len(at))).astype(np.uint32)
    return pair[at[first]], a[of], b[of], many, c[at], np.add.reduceat(n, at)


def _triples(vocabulary: str, bits: int):
    """(part, blob) of the summed triples of about TRIPLES positions at a time; a part is the first bits of a pair's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Vocabulary.read(vocabulary), [], 0
        for batch in batches:
            for _, _, h, bounds in tokens(batch.column(0)):
                codes = words.codes(h, words.numbers(h))
                before, after = shifted(codes, bounds, words.start, words.none)
                held.append((gram(before, codes, 2), before, codes, after))
                size += len(h)
                if size > TRIPLES:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        pair, a, b, c = (np.concatenate(x) for x in zip(*held, strict=True))
        pair, a, b, many, c, n = _sum_triples(pair, a, b, c, np.ones(len(pair), np.uint64))
        part = _part(pair, bits)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        ends = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        blobs = [_bundle(a[x:y], b[x:y], many[x:y], c[ends[x] : ends[y]], n[ends[x] : ends[y]]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array(blobs, pa.binary())], ["part", "blob"])

    return run


def _part(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _rows(batches: Iterator[pa.RecordBatch], group: str, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """The binaries of each run of equal values of group."""
    now, held = None, []
    for batch in batches:
        for g, blob in zip(batch.column(group).to_pylist(), batch.column(column), strict=True):
            if g != now and held:
                yield now, held
                held = []
            now = g
            held.append(blob.as_py())
    if held:
        yield now, held


#: Of kept n-grams: a, b, n of pairs, and how many triples follow; c, n of triples.
KEPT_KINDS = ("u8", "u8", "u8", "u4", "u8", "u8")


def _keep(none: int):
    """(part, blob, pairs, triples): the kept n-grams of a part; pairs, triples: their numbers by the whole logarithm of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _rows(batches, "part", "blob"):
            columns = [np.concatenate(x) for x in zip(*[_unbundle(x, *TRIPLE_KINDS) for x in blobs], strict=True)]
            a, b, many, c, n = columns
            of = np.repeat(np.arange(len(a)), many)
            pair, a, b, many, c, n = _sum_triples(gram(a, b, 2)[of], a[of], b[of], c, n)
            ends = np.cumsum(many, dtype=np.int64)
            n2 = np.add.reduceat(n, ends - many.astype(np.int64))
            good = n2 >= LEAST
            of = np.repeat(np.arange(len(pair)), many)
            good3 = (n >= LEAST) & (c != none)
            many = np.bincount(of[good3], minlength=len(pair))[good].astype(np.uint32)
            a, b, n2, c, n = a[good], b[good], n2[good], c[good3], n[good3]
            sizes = [pa.array([np.bincount(np.log2(x).astype(int), minlength=48).tolist()], pa.list_(pa.int64())) for x in (n2, n)]
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([_bundle(a, b, n2, many, c, n)], pa.binary()), *sizes], ["part", "blob", "pairs", "triples"])

    return run


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, seen, kinds): occurrences and number of the kept pairs of a first token."""
    counter = Counter("a", "seen", "kinds")
    for batch in batches:
        for blob in batch.column(0):
            a, _, n, *_ = _unbundle(blob.as_py(), *KEPT_KINDS)
            counter.add(a, n.astype(np.int64), np.ones(len(a), np.int64))
            if counter.full():
                yield from counter.take()
    yield from counter.take()


@dataclass
class Shard:
    """Two levels of the trie, for the pairs whose keys begin alike, and filters of the keys in them."""

    two: Level
    three: Level
    bits2: np.ndarray
    bits3: np.ndarray

    @classmethod
    def read(cls, uri: str) -> Shard:
        arrays = arrays_of(uri)
        level = lambda name: Level.read({x.split("/")[1]: a for x, a in arrays.items() if x.startswith(name + "/")})
        return cls(level("two"), level("three"), arrays["bits2"], arrays["bits3"])


#: Of mapped n-grams: as KEPT_KINDS, with the discounted occurrences of all kept triples of a pair after its n.
MAPPED_KINDS = ("u8", "u8", "u8", "f8", "u4", "u8", "u8")


def _of_shard(vocabulary: str, shift: int, least: int):
    """(shard, blob) of the kept n-grams that are mapped: of common tokens, and at least least occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = Vocabulary.read(vocabulary).start
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a, b, n2, many, c, n3 = _unbundle(blob.as_py(), *KEPT_KINDS)
                of = np.repeat(np.arange(len(a)), many)
                seen = np.bincount(of, n3 - DISCOUNT, len(a))
                good = (a <= start) & (b < start) & (n2 >= least)
                good3 = good[of] & (c < start) & (n3 >= least)
                many = np.bincount(of[good3], minlength=len(a))[good].astype(np.uint32)
                out = _bundle(a[good], b[good], n2[good], seen[good], many, c[good3], n3[good3])
                yield pa.RecordBatch.from_arrays([pa.array([part >> shift]), pa.array([out], pa.binary())], ["shard", "blob"])

    return run


def _build(vocabulary: str, folder: str):
    """Write the shards of the mapped n-grams."""

    def build(shard: int, blobs: list[bytes]) -> None:
        words = Vocabulary.read(vocabulary)
        a, b, n2, seen, many, c, n3 = (np.concatenate(x) for x in zip(*[_unbundle(x, *MAPPED_KINDS) for x in blobs], strict=True))
        of, order = np.repeat(np.arange(len(a)), many), np.lexsort((b, a))
        place = np.empty(len(a), np.int64)
        place[order] = np.arange(len(order))
        back = np.log10(np.maximum(1 - seen / n2, 1e-9))[order]
        first = a[order].astype(np.int64)
        two = Level.of(first, b[order].astype(np.int64), words.start + 1, np.log10((n2[order] - DISCOUNT) / words.as_context(first)), back)
        order3 = np.lexsort((c, place[of]))
        three = Level.of(place[of][order3], c[order3].astype(np.int64), len(order), np.log10((n3 - DISCOUNT) / n2[of])[order3], np.zeros(len(c)))
        keys = gram(a, b, 2)
        arrays = {"bits2": bits_of(keys, size_for(len(a))), "bits3": bits_of(gram(keys[of], c, 3), size_for(len(c)))}
        for name, level in (("two", two), ("three", three)):
            arrays |= {f"{name}/{x}": v for x, v in level.arrays().items()}
        put(f"{folder}/shard-{shard}.bin", arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blobs in _rows(batches, "shard", "blob"):
            build(shard, blobs)
            yield pa.RecordBatch.from_arrays([pa.array([shard])], ["shard"])

    return run


@dataclass
class Mapped:
    """What workers map: common tokens with counts and back-offs, the shards of the trie, the filter of n-grams outside it."""

    vocabulary: str
    backs: str
    folder: str
    shards: frozenset[int]
    shard_bits: int
    rest: str | None


class Model:
    def __init__(self, of: Mapped):
        self.words, backs = Vocabulary.read(of.vocabulary), arrays_of(of.backs)
        # by number, the start last
        self.back, self.weight = backs["code"], 10.0 ** backs["book"]
        self.shards = {s: Shard.read(f"{of.folder}/shard-{s}.bin") for s in of.shards}
        self.shard_bits = of.shard_bits
        self.rest = arrays_of(of.rest)["bits"] if of.rest else None

    def _each_shard(self, keys: np.ndarray, at: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        """The shards, with the places of at whose keys they can have."""
        shard = _part(keys[at], self.shard_bits)
        order = np.argsort(shard.astype(np.uint16 if self.shard_bits <= 16 else np.int64), kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]]) if len(order) else [0]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if (s := self.shards.get(int(shard[order[x]]))) is not None:
                yield s, at[order[x:y]]

    def log_probs(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each token: its number, log10 of its unigram probability, and of its probability, both without what is joined later;
        then the places and the keys of the n-grams that may have to be joined, of both orders."""
        words = self.words
        number = words.numbers(h)
        known = number >= 0
        codes = words.codes(h, number)
        before, _ = shifted(codes, bounds, words.start, words.none)
        context = shifted(number, bounds, words.start, 0)[0]
        base = words.base(number)
        low = base * np.where(context >= 0, self.weight[self.back[np.maximum(context, 0)]], 1.0)
        pair = gram(before, codes, 2)
        place, q, back = np.full(len(h), -1, np.int64), np.zeros(len(h)), np.ones(len(h))
        for shard, at in self._each_shard(pair, np.flatnonzero(known & (context >= 0))):
            at = at[among(shard.bits2, pair[at])]
            found = shard.two.find(context[at], number[at])
            at, found = at[found >= 0], found[found >= 0]
            place[at], q[at] = found, 10.0 ** shard.two.prob_book[shard.two.prob[found]]
            back[at] = 10.0 ** shard.two.back_book[shard.two.back[found]]
        inner = np.ones(len(h), bool)
        inner[bounds[:-1]] = False
        third = np.flatnonzero(inner)
        triple = np.zeros(len(h), np.uint64)
        triple[third] = gram(pair[third - 1], codes[third], 3)
        p = low + q
        low3 = np.ones(len(h))
        low3[third] = np.where(place[third - 1] >= 0, back[third - 1], 1.0)
        q3 = np.zeros(len(h))
        both = third[(place[third] >= 0) & (place[third - 1] >= 0)]
        for shard, at in self._each_shard(pair, both - 1):
            at = at[among(shard.bits3, triple[at + 1])]
            found = shard.three.find(place[at], number[at + 1])
            at, found = at[found >= 0], found[found >= 0]
            q3[at + 1] = 10.0 ** shard.three.prob_book[shard.three.prob[found]]
        logs = np.log10(low3 * p + q3)
        if self.rest is None:
            none = np.zeros(0, np.int64)
            return number, np.log10(base), logs, [none, none], [pair, triple]
        rest3 = third[q3[third] == 0]
        return number, np.log10(base), logs, [np.flatnonzero((place < 0) & among(self.rest, pair)), rest3[among(self.rest, triple[rest3])]], [pair, triple]


@lru_cache(2)
def _model(vocabulary: str, backs: str, folder: str, shards: frozenset[int], shard_bits: int, rest: str | None) -> Model:
    return Model(Mapped(vocabulary, backs, folder, shards, shard_bits, rest))


def model_of(of: Mapped) -> Model:
    return _model(of.vocabulary, of.backs, of.folder, of.shards, of.shard_bits, of.rest)


def _least(sizes: list[int], bound: int, from_: int) -> int:
    """The least power of two, at least from_, such that no more than bound of what sizes counts by whole logarithms reach it."""
    out = from_
    while sum(sizes[out.bit_length() - 1 :]) > bound:
        out *= 2
    return out


def _vocabulary(counts: DataFrame, texts: int, folder: str) -> tuple[str, Vocabulary]:
    sizes = [0] * 48
    for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("n")).collect():
        sizes[r["size"]], sizes[-1] = r["tokens"], sizes[-1] + r["n"]
    total, distinct, sizes[-1] = sizes[-1], sum(sizes[:-1]), 0
    least = _least(sizes, WORDS, 1)
    common = counts.where(F.col("n") >= least).toArrow()
    hashes, n = common["key"].to_numpy().view(np.uint64), common["n"].to_numpy()
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    number = np.empty(len(n), np.int32)
    by_count = np.lexsort((hashes, -n))
    number[by_count] = np.arange(len(n), dtype=np.int32)
    count = n[by_count]
    index = HashIndex.of(hashes)
    sizes = np.array([total, distinct, texts, least])
    uri = put(f"{folder}/vocabulary.bin", {"hashes": hashes, "starts": index.starts, "shift": np.array([index.shift]), "number": number, "count": count, "sizes": sizes})
    return uri, Vocabulary(index, number, count, sizes)


def _backs(words: Vocabulary, followers: DataFrame, folder: str) -> str:
    """The logarithms of what common tokens, and the start of a text, leave to their back-off."""
    common = followers.where(F.col("a").between(0, words.start)).toArrow()
    left = np.ones(words.start + 1)
    a = common["a"].to_numpy()
    left[a] = 1 - (common["seen"].to_numpy() - DISCOUNT * common["kinds"].to_numpy()) / words.as_context(a)
    code, book = quantised(np.log10(np.maximum(left, 1e-9)))
    return put(f"{folder}/backs.bin", {"code": code, "book": book})


def learn(docs: DataFrame) -> tuple[Mapped, DataFrame, int, int]:
    """From every text of docs: what workers map, (key, known, base, value) of other tokens and kept n-grams, N and V.

    base, value: what a token adds to a text's base score and score beyond an unknown one, an n-gram beyond its back-off.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex[:12]}"
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(texts.mapInArrow(_unigrams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-unigrams")
    release(spark)
    uri, words = _vocabulary(counts, texts.count(), folder)
    rare = counts.where(F.col("n") < words.least)
    if not words.total:
        followers = spark.createDataFrame([], "a long, seen long, kinds long")
        return Mapped(uri, _backs(words, followers, folder), folder, frozenset(), 0, None), _tokens(rare), 0, 0
    bits = max(0, (words.total // PART).bit_length())
    parts = texts.mapInArrow(_triples(uri, bits), "part long, blob binary").repartition(min(1 << bits, TASKS), "part").sortWithinPartitions("part")
    kept = stored(parts.mapInArrow(_keep(words.none), "part long, blob binary, pairs array<long>, triples array<long>"), "lm-kept")
    del parts
    release(spark)
    sizes = {c: [0] * 48 for c in ("pairs", "triples")}
    for c in sizes:
        for r in kept.select(F.posexplode(c).alias("size", "n")).groupBy("size").agg(F.sum("n").alias("n")).collect():
            sizes[c][r["size"]] = r["n"]
    least = max(_least(s, GRAMS, LEAST) for s in sizes.values())
    followers = stored(kept.select("blob").mapInArrow(_followers, "a long, seen long, kinds long").groupBy("a").agg(F.sum("seen").alias("seen"), F.sum("kinds").alias("kinds")), "lm-followers")
    backs = _backs(words, followers, folder)
    mapped_pairs = sum(sizes["pairs"][least.bit_length() - 1 :])
    shard_bits = min(bits, (mapped_pairs // SHARD).bit_length())
    mapped_grams = kept.select("part", "blob").mapInArrow(_of_shard(uri, bits - shard_bits, least), "shard long, blob binary")
    dealt = mapped_grams.repartition(1 << shard_bits, "shard").sortWithinPartitions("shard")
    shards = frozenset(r["shard"] for r in dealt.mapInArrow(_build(uri, folder), "shard long").collect())
    spent = [kept, followers]
    if words.least <= LEAST and least == LEAST:  # every kept n-gram is mapped; tokens that are not occur once
        forget(*spent)
        return Mapped(uri, backs, folder, shards, shard_bits, None), _tokens(rare), words.total, words.distinct
    rest, more = _rest(kept, counts, followers, words, uri, least)
    filter_ = publish(rest.select("key"), f"{folder}/rest.bin", min(FILTER_BITS, size_for(words.total)))
    forget(*spent)
    return Mapped(uri, backs, folder, shards, shard_bits, filter_), _tokens(rare.join(more, "key", "left")).unionByName(rest), words.total, words.distinct


def _tokens(rare: DataFrame) -> DataFrame:
    """Of tokens (key, n, and log_back if they can have one)."""
    base = F.log10(F.col("n") + 1.0)
    back = F.coalesce("log_back", F.lit(0.0)) if "log_back" in rare.columns else F.lit(0.0)
    return rare.select("key", F.lit(1).alias("known"), base.alias("base"), (base + back).alias("value"))


def _decoded(vocabulary: str, least: int):
    """(key, a, b, bc, n, context_n, log_back, mapped, order) of kept n-grams; a and b: token hashes of a pair; bc: the key of a triple's last pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.read(vocabulary)
        for batch in batches:
            for blob in batch.column(0):
                a, b, n2, many, c, n3 = _unbundle(blob.as_py(), *KEPT_KINDS)
                seen, of = np.zeros(len(a)), np.repeat(np.arange(len(a)), many)
                np.add.at(seen, of, n3 - DISCOUNT)
                pair, back = gram(a, b, 2), np.log10(np.maximum(1 - seen / n2, 1e-9))
                common = (a <= words.start) & (b < words.start) & (n2 >= least)
                common3 = common[of] & (c < words.start) & (n3 >= least)
                zero, one = np.zeros(len(a), np.uint64), np.zeros(len(c), np.uint64)
                for columns in (
                    (pair, words.hashes(a), words.hashes(b), zero, n2, zero, back, common, np.full(len(a), 2)),
                    (gram(pair[of], c, 3), one, one, gram(b[of], c, 2), n3, n2[of], back[of], common3, np.full(len(c), 3)),
                ):
                    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "a", "b", "bc", "n", "context_n", "log_back", "mapped", "order"])

    return run


def _rest(kept: DataFrame, counts: DataFrame, followers: DataFrame, words: Vocabulary, vocabulary: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(key, known, base, value) of the kept n-grams that are not mapped; (key, log_back) of the tokens that are not."""
    spark = kept.sparkSession
    schema = "key long, a long, b long, bc long, n long, context_n long, log_back double, mapped boolean, order long"
    grams = kept.select("blob").mapInArrow(_decoded(vocabulary, least), schema)
    log = lambda c: F.log10(F.greatest(c, F.lit(1e-9)))
    start = spark.range(1).select(F.lit(int(START.view(np.int64))).alias("key"), F.lit(words.texts).cast("long").alias("n"))
    # followers have codes; those of common tokens are in the mapped file, and come from there
    rare_backs = followers.where(~F.col("a").between(0, words.start)).select(F.col("a").alias("key"), "seen", "kinds")
    common = spark.range(1).mapInArrow(_common_backs(vocabulary), "code long, key long")
    common_backs = followers.where(F.col("a").between(0, words.start)).join(common, F.col("a") == F.col("code")).select("key", "seen", "kinds")
    left = log(1 - (F.col("seen") - DISCOUNT * F.col("kinds")) / F.col("n"))
    each = counts.unionByName(start).join(rare_backs.unionByName(common_backs), "key", "left")
    each = stored(each.select("key", "n", F.coalesce(left, F.lit(0.0)).alias("log_back")), "lm-words")
    base = (F.col("n_b") + 1.0) / F.lit(float(words.total + words.distinct + 1))
    side = lambda s: each.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("log_back").alias(f"back_{s}"))
    pairs = grams.where("order = 2").join(side("a"), "a").join(side("b"), "b")
    lower = F.pow(F.lit(10.0), F.col("back_a")) * base
    pairs = pairs.select("key", "log_back", "mapped", lower.alias("lower"), ((F.col("n") - DISCOUNT) / F.col("n_a") + lower).alias("p"))
    pairs = stored(pairs, "lm-pairs")
    triples = grams.where("order = 3 AND NOT mapped").join(pairs.select(F.col("key").alias("bc"), F.col("p").alias("p_bc")), "bc")
    lower3 = F.pow(F.lit(10.0), F.col("log_back")) * F.col("p_bc")
    out = lambda df, value: df.select("key", F.lit(0).alias("known"), F.lit(0.0).alias("base"), value.alias("value"))
    rest = out(pairs.where("NOT mapped"), F.log10("p") - F.log10("lower") + F.col("log_back"))
    rest = rest.unionByName(out(triples, F.log10((F.col("n") - DISCOUNT) / F.col("context_n") + lower3) - F.log10(lower3)))
    return stored(rest, "lm-rest"), each.select("key", "log_back")


def _common_backs(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary.read(vocabulary)
        for batch in batches:
            for _ in range(batch.num_rows):
                codes = np.arange(words.start + 1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(words.hashes(codes).view(np.int64))], ["code", "key"])

    return run


def _score(of: Mapped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(of)
        for batch in batches:
            for i, j, h, bounds in tokens(batch.column(0), PIECE):
                number, base, logs, places, keys = model.log_probs(h, bounds)
                known = number >= 0
                # the other tokens and n-grams, summed per text
                places, keys = [np.flatnonzero(~known), *places], [h, *keys]
                rare = np.concatenate([x[at] for x, at in zip(keys, places, strict=True)])
                doc = np.repeat(np.arange(j - i), np.diff(bounds))[np.concatenate(places)]
                order = np.lexsort((rare, doc))
                rare, doc = rare[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1])])) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rare))).astype(np.int32)
                ends = np.searchsorted(doc[new], np.arange(j - i + 1)).astype(np.int32)
                part = batch.slice(i, j - i)
                sums = [np.diff(bounds).astype(np.int64), k.per_doc(known.astype(np.int64), bounds), k.per_doc(base, bounds), k.per_doc(logs, bounds)]
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (rare[new].view(np.int64), times)]
                columns = [*[part.column(c) for c in range(1, batch.num_columns)], *[pa.array(s) for s in sums], *lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "mark", "n_tokens", "n_common", "base_common", "score_common", "rare", "times"])

    return run


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text, held_out).

    train: the texts to learn from.
    """
    of, others, total, distinct = learn(train)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    schema = f"doc_id {id_type}, held_out boolean, mark long, n_tokens long, n_common long, base_common double, score_common double, rare array<long>, times array<int>"
    sent = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", "held_out", mark.alias("mark"))
    rows = stored(sent.mapInArrow(_score(of), schema), "lm-rows")
    pairs = rows.select("doc_id", "mark", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("doc_id", "mark", F.col("t.rare").alias("key"), "t.times")
    added = lambda c: F.sum(F.col(c) * F.col("times")).alias(f"rare_{c}")
    sums = pairs.join(others, "key").groupBy("doc_id", "mark").agg(added("known"), added("base"), added("value"))
    # rows with the same id and text have summed alike
    twins = rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("twins"))
    sums = sums.join(twins, sums.doc_id.eqNullSafe(twins.doc_id) & (sums.mark == twins.mark)).select(
        sums.doc_id.alias("id_"), sums.mark.alias("mark_"), (F.col("rare_known") / F.col("twins")).cast("long").alias("rare_known"),
        (F.col("rare_base") / F.col("twins")).alias("rare_base"), (F.col("rare_value") / F.col("twins")).alias("rare_value"),
    )
    out = rows.drop("rare", "times").join(sums, rows.doc_id.eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")), "left")
    unknown = (F.col("n_tokens") - F.col("n_common")) * F.lit(-math.log10(total + distinct + 1))
    rare = lambda c: F.coalesce(c, F.lit(0.0)) + unknown
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_common") + rare("rare_base")).alias("base_score"),
        (F.col("score_common") + rare("rare_value")).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """score() over docs (doc_id, text), learning from the rows whose held_out is false."""
    held = remainder(7) == 2
    return score(docs.select("doc_id", "text", held.alias("held_out")), docs.where(~held))
