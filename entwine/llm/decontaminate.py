"""Benchmark decontamination: spaced-seed hashing.

Tokens are runs of letters, digits and combining marks in lower case. A mask keeps a few of
neighbouring tokens; the hash of the kept tokens, at every position of every benchmark item
and of every document, is what is joined. Items of LONG tokens have the masks MASKS, shorter ones
those of FEW, so that some mask hits wherever no more than a fifth of an item's
tokens are substituted. Each hit names an item, a document and their alignment; there the tokens
are compared. A document leaks an item if on one alignment SIMILARITY of the item's tokens are
equal; or, where words were put in or left out, if that many are over all
alignments, counting equal tokens that have SUPPORT of five aligned neighbours equal; or if in a
stretch of RUN consecutive item tokens, on one alignment, each window of five has SUPPORT that agree,
and the first and the last agree. Items of fewer than MIN_TOKENS tokens are leaked where all
their tokens are equal, in a row.

The benchmark is the stated query set. Up to BROADCAST_CHARS characters of it are broadcast as
seeds and tokens; a larger one is joined: a filter of at most 2**FILTER_BITS bits passes the documents' seeds that
items can have, these meet the items' in a shuffle join, and the alignments found are verified
on the texts that have any.

Defined results. Null or empty text leaks nothing. Items without
tokens are not looked for. Items with the same tokens are one, by their least item_id (null is
the greatest). An empty benchmark finds nothing; an empty table gives an empty result;
repeated rows get their own rows; very long texts are read whole. Ids can have any type that
has an order. Extra columns can have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StructField, StructType

from entwine.functions.session import bounded, shared_folder, ship, stored
from entwine.llm import kernels as k
from entwine.llm.bit_filters import among, publish, size_for
from entwine.llm.shared_files import arrays_of

MIN_TOKENS, LONG = 5, 16
MASKS = ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7))
FEW = ((0, 1, 2), (0, 1, 3))
#: The masks of items of fewer than MIN_TOKENS tokens: all their tokens.
SHORT = tuple(tuple(range(n)) for n in range(1, MIN_TOKENS))
ALL = MASKS + FEW + SHORT
SIMILARITY = 0.8
SUPPORT = 4
RUN = 20
BROADCAST_CHARS, FILTER_BITS = 6_000_000, 28
TABLE_BITS = 22
COMPARED = 4_000_000


def hits_type(item_id: DataType) -> ArrayType:
    return ArrayType(StructType([StructField("item_id", item_id), StructField("similarity", DoubleType()), StructField("start", LongType())]))


def _serves(mask: int, size: np.ndarray) -> np.ndarray:
    """Whether items of so many tokens have the mask of that number."""
    if mask < len(MASKS):
        return size >= LONG
    return (size >= MIN_TOKENS) & (size < LONG) if mask < len(MASKS) + len(FEW) else size == len(ALL[mask])


def seeds_at(hashes: np.ndarray, counts: np.ndarray, bounds: np.ndarray, mask: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices of tokens at which a mask fits into the text, seed hashes); at: only of these."""
    at = np.arange(int(bounds[-1])) if at is None else at
    at = at[at + ALL[mask][-1] + 1 <= np.repeat(bounds[1:], counts)[at]] if len(at) else at
    return at, k.combine(hashes, at, ALL[mask], mask)


@dataclass
class Seeds:
    """Items as token hashes (tokens[bounds[i] : bounds[i + 1]]), and the sorted seed hashes of each mask with item and position."""

    ids: list
    tokens: np.ndarray
    bounds: np.ndarray
    hashes: list[np.ndarray]
    item: list[np.ndarray]
    place: list[np.ndarray]

    def table(self) -> list[np.ndarray | None]:
        """For each mask, which values of the lowest bits occur; None if it has no seeds."""
        out: list[np.ndarray | None] = []
        for h in self.hashes:
            if not len(h):
                out.append(None)
                continue
            t = np.zeros(1 << TABLE_BITS, bool)
            t[(h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
            out.append(t)
        return out


def _items(ids: list, texts: pa.Array) -> Iterator[tuple]:
    """(id, token hashes) of the items that have tokens."""
    for i, j, data, offsets in k.pieces(texts, True):
        words = k.Words(data, offsets)
        hashes = k.span_hashes(data, words.start, words.end)
        for d in range(j - i):
            if words.counts[d]:
                yield ids[i + d], hashes[words.bounds[d] : words.bounds[d + 1]]


def seeds_of(ids: list, texts: pa.Array) -> Seeds:
    kept: dict[bytes, tuple] = {}
    rank = lambda x: (x[0] is None, x[0] if x[0] is not None else 0)
    for one in _items(ids, texts):
        kept[one[1].tobytes()] = min(kept.get(one[1].tobytes(), one), one, key=rank)
    items = sorted(kept.values(), key=rank)
    counts = np.array([len(x[1]) for x in items], np.int64)
    tokens = np.concatenate([np.zeros(0, np.uint64), *[x[1] for x in items]])
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    of = np.repeat(np.arange(len(items)), counts)
    out = Seeds([x[0] for x in items], tokens, bounds, [], [], [])
    for m in range(len(ALL)):
        at, h = seeds_at(tokens, counts, bounds, m, np.flatnonzero(_serves(m, counts[of])))
        order = np.argsort(h, kind="stable")
        out.hashes.append(h[order])
        out.item.append(of[at][order])
        out.place.append((at - bounds[of[at]])[order])
    return out


def _pairs(seeds: Seeds, table: list[np.ndarray | None], hashes: np.ndarray, words: k.Words) -> np.ndarray:
    """Distinct (document, item, alignment) of a piece's hits; alignment is document place minus item place."""
    found = [np.zeros((0, 3), np.int64)]
    for m in range(len(ALL)):
        if table[m] is None:
            continue
        at, h = seeds_at(hashes, words.counts, words.bounds, m)
        maybe = table[m][(h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        low, high = np.searchsorted(seeds.hashes[m], h), np.searchsorted(seeds.hashes[m], h, "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        doc = words.doc[at]
        hits = np.stack([doc, seeds.item[m][which], at - words.bounds[doc] - seeds.place[m][which]], 1)
        # of a short item the first place is enough
        found.append(hits[np.unique(hits[:, :2], axis=0, return_index=True)[1]] if m >= len(MASKS + FEW) and len(hits) else hits)
    return np.unique(np.concatenate(found), axis=0)


def _equal_counts(seeds: Seeds, hashes: np.ndarray, words: k.Words, pairs: np.ndarray) -> np.ndarray:
    """The number of equal tokens on each alignment."""
    doc, item, shift = pairs.T
    size, start, text = np.diff(seeds.bounds)[item], seeds.bounds[item], words.bounds[doc]
    low = np.maximum(0, -shift)
    n = np.minimum(size, words.counts[doc] - shift) - low
    out, ends = np.zeros(len(pairs), np.int64), np.cumsum(n)
    a = 0
    while a < len(pairs):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COMPARED, "right")))
        of = np.repeat(np.arange(a, b), n[a:b])
        first = np.cumsum(n[a:b]) - n[a:b]
        at = np.arange(len(of)) - first[of - a] + low[of]
        equal = seeds.tokens[start[of] + at] == hashes[text[of] + at + shift[of]]
        out[a:b] = np.add.reduceat(equal.astype(np.int64), first)
        a = b
    return out


def _stretch(equal: np.ndarray, full: np.ndarray) -> int:
    """The tokens of the longest stretch of full windows of five, from an equal token to an equal token; full: by first token."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], full.astype(np.int8), [0]])))
    if not len(edges):
        return 0
    first, last = edges[::2], edges[1::2] + 3
    # at most one token of a full window is unequal
    return int((last - (~equal[last]) * 1 - first - (~equal[first]) * 1).max()) + 1


def judge(tokens: np.ndarray, text: np.ndarray, shifts: np.ndarray) -> tuple[float, int] | None:
    """(share of the item's tokens, token of the text at which the best alignment begins) if the text leaks the item, else None."""
    counted, best, longest = np.zeros(len(tokens), bool), (0, 0), 0
    for shift in shifts:
        low, high = max(0, -int(shift)), min(len(tokens), len(text) - int(shift))
        equal = np.zeros(len(tokens), bool)
        equal[low:high] = tokens[low:high] == text[low + shift : high + shift]
        best = max(best, (int(equal.sum()), -int(low + shift)))
        full = np.convolve(equal, np.ones(5, int)) >= SUPPORT
        # a token has support if one of the windows of five around it has
        counted |= equal & np.logical_or.reduce([full[i : i + len(tokens)] for i in range(5)])
        longest = max(longest, _stretch(equal, full[4 : len(tokens)]))
    if len(tokens) < MIN_TOKENS:
        return (1.0, -best[1]) if best[0] == len(tokens) else None
    share = max(best[0], int(counted.sum())) / len(tokens)
    return (share, -best[1]) if share >= SIMILARITY or longest >= RUN else None


def _leaks(seeds: Seeds, hashes: np.ndarray, words: k.Words, pairs: np.ndarray) -> dict[int, list[dict]]:
    """Verified leaks by document of the piece."""
    out: dict[int, list[dict]] = {}
    if not len(pairs):
        return out
    edges = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(1)]))
    # no rule can hold with fewer equal tokens over all alignments
    equal = np.add.reduceat(_equal_counts(seeds, hashes, words, pairs), edges)
    size = np.diff(seeds.bounds)[pairs[edges, 1]]
    ends = np.append(edges[1:], len(pairs))
    for g in np.flatnonzero(equal >= np.minimum(SIMILARITY * size, RUN * SUPPORT // 5)):
        a, b = edges[g], ends[g]
        doc, item = int(pairs[a, 0]), int(pairs[a, 1])
        found = judge(seeds.tokens[seeds.bounds[item] : seeds.bounds[item + 1]], hashes[words.bounds[doc] : words.bounds[doc + 1]], pairs[a:b, 2])
        if found:
            out.setdefault(doc, []).append({"item_id": seeds.ids[item], "similarity": found[0], "start": found[1]})
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, into: str = "__leaks") -> DataFrame:
    """docs, with all its columns, and into: array<struct<item_id, similarity, start>> of the benchmark items that text leaks.

    start is the token of the text at which the best alignment begins.
    """
    ship(docs.sparkSession)
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return (_broadcast if size <= BROADCAST_CHARS else _joined)(docs, items, into, size)


def _broadcast(docs: DataFrame, items: DataFrame, into: str, size: int) -> DataFrame:
    kind, names = hits_type(items.schema["item_id"].dataType), docs.columns
    table = items.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(seeds_of(table["item_id"].to_pylist(), table["text"].combine_chunks()))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, table, hits = sent.value, None, None
        for batch in batches:
            table, hits = table or seeds.table(), hits or _arrow_hits(seeds.ids)
            for i, j, data, offsets in k.pieces(batch.column(at), True):
                words = k.Words(data, offsets)
                hashes = k.span_hashes(data, words.start, words.end)
                leaks = _leaks(seeds, hashes, words, _pairs(seeds, table, hashes, words))
                part = batch.slice(i, j - i)
                found = pa.array([leaks.get(d, []) for d in range(j - i)], hits)
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, kind)]))


def _arrow_hits(ids: list) -> pa.DataType:
    one = pa.array(ids).type if any(i is not None for i in ids) else pa.int64()
    return pa.list_(pa.struct([("item_id", one), ("similarity", pa.float64()), ("start", pa.int64())]))


def _joined(docs: DataFrame, items: DataFrame, into: str, size: int) -> DataFrame:
    """As _broadcast, by joins of seeds; texts are told apart by 128 bits."""
    spark = docs.sparkSession
    id_field = items.schema["item_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = list(_items(list(range(batch.num_rows)), batch.column(1)))
            ids = batch.column(0).take(pa.array([x[0] for x in every], pa.int64()))
            keys = [pa.array([int(k.mix(np.array([np.bitwise_xor.reduce(k.mix(x[1] + np.arange(len(x[1]), dtype=np.uint64) * k.GOLD, s))]))[0].view(np.int64)) for x in every], pa.int64()) for s in (31, 32)]
            yield pa.RecordBatch.from_arrays([*keys, ids, pa.array([x[1].view(np.int64) for x in every], pa.list_(pa.int64()))], ["i1", "i2", "item_id", "tokens"])

    found = items.mapInArrow(read, StructType([StructField("i1", LongType()), StructField("i2", LongType()), id_field, StructField("tokens", ArrayType(LongType()))]))
    known = stored(found.groupBy("i1", "i2").agg(F.min("item_id").alias("item_id"), F.first("tokens").alias("tokens")), "dc-items")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            counts = np.diff(lists.offsets.to_numpy())
            hashes, bounds = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(counts)])
            of = np.repeat(np.arange(len(counts)), counts)
            for m in range(len(ALL)):
                at, h = seeds_at(hashes, counts, bounds, m, np.flatnonzero(_serves(m, counts[of])))
                rows = pa.array(of[at])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - bounds[of[at]])], ["seed", "i1", "i2", "item_place"])

    seeded = stored(known.select("i1", "i2", "tokens").mapInArrow(seeds, "seed long, i1 long, i2 long, item_place long"), "dc-seeds")
    uri = publish(seeded.select("seed"), f"{shared_folder(spark)}/dc-{uuid.uuid4().hex[:12]}.bin", min(FILTER_BITS, size_for(size)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = arrays_of(uri)["bits"]
        for batch in batches:
            for i, _, data, offsets in k.pieces(batch.column(2), True):
                words = k.Words(data, offsets)
                hashes = k.span_hashes(data, words.start, words.end)
                for m in range(len(ALL)):
                    at, h = seeds_at(hashes, words.counts, words.bounds, m)
                    maybe = among(bits, h)
                    at, h = at[maybe], h[maybe]
                    rows = pa.array(i + words.doc[at])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h.view(np.int64)), pa.array(at - words.bounds[words.doc[at]])], ["t1", "t2", "seed", "place"])

    text = F.coalesce("text", F.lit(""))
    marks = [F.xxhash64(F.lit(label), text) for label in ("a", "b")]
    sent = docs.select(marks[0].alias("t1"), marks[1].alias("t2"), text.alias("text"))
    hits = sent.mapInArrow(look, "t1 long, t2 long, seed long, place long").join(seeded, "seed")
    hits = hits.select("t1", "t2", "i1", "i2", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    aligned = stored(hits.groupBy("t1", "t2", "i1", "i2").agg(F.collect_list("shift").alias("shifts")), "dc-hits")
    wanted = bounded(stored(aligned.select(F.col("t1").alias("w1"), F.col("t2").alias("w2")).distinct(), "dc-wanted"))
    texts = sent.join(wanted, (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")), "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, shares, starts = [], [], []
            for i, j, data, offsets in k.pieces(batch.column(2), True):
                words = k.Words(data, offsets)
                hashes = k.span_hashes(data, words.start, words.end)
                for d in range(j - i):
                    item, shifts = (np.array(batch.column(c)[i + d].as_py(), np.int64) for c in (4, 5))
                    one = judge(item.view(np.uint64), hashes[words.bounds[d] : words.bounds[d + 1]], np.sort(shifts))
                    if one:
                        good.append(i + d)
                        shares.append(one[0])
                        starts.append(one[1])
            rows = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in (0, 1, 3)], pa.array(shares, pa.float64()), pa.array(starts, pa.int64())], ["t1", "t2", "item_id", "similarity", "start"])

    pairs = aligned.join(known, ["i1", "i2"]).join(texts, ["t1", "t2"]).select("t1", "t2", "text", "item_id", "tokens", "shifts")
    schema = StructType([StructField("t1", LongType()), StructField("t2", LongType()), id_field, StructField("similarity", DoubleType()), StructField("start", LongType())])
    leaks = pairs.mapInArrow(verify, schema).groupBy(F.col("t1").alias("w1"), F.col("t2").alias("w2"))
    found_name = k.unused(docs.columns, "__found")
    leaks = leaks.agg(F.array_sort(F.collect_list(F.struct("item_id", "similarity", "start"))).alias(found_name))
    names = [k.unused(docs.columns, x) for x in ("w1", "w2")]
    leaks = bounded(stored(leaks.withColumnsRenamed(dict(zip(("w1", "w2"), names, strict=True))), "dc-leaks"))
    out = docs.join(leaks, (marks[0] == F.col(names[0])) & (marks[1] == F.col(names[1])), "left")
    return out.select(*docs.columns, F.coalesce(F.col(found_name), F.array().cast(hits_type(id_field.dataType))).alias(into))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start: one row for each document of docs (doc_id, text) and benchmark item that it leaks."""
    found = annotate(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("__leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.similarity", "leak.start")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all its columns, that leak no item."""
    into = k.unused(docs.columns, "__leaks")
    return annotate(docs, benchmark, into).where(F.size(into) == 0).drop(into)
