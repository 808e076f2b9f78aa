"""Pairs of two sides in tiles: a task gets a block of the left side and goes through all blocks of the right one, and returns only what is asked for.

Blocks of the right side are files in the shared folder, written once and in order, so that neither pairs nor rows are shuffled
again and again, and the best of a left row are known at the end of its task. The kernels are Arrow tables in and out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.functions.session import located, ship, stored

#: Keys of a block, at most; left blocks are cut finer until there are TILES of them, or LEAST keys in a block.
ENTRIES, TILES, LEAST = 600_000, 24, 20_000
#: Cells of a tile that are summed at once.
CELLS = 1_000_000
#: An n-gram is summed by a matrix product if one of so many cells of the tile has it, up to so many n-grams and so many numbers.
DENSE, DENSE_GRAMS, DENSE_NUMBERS = 100, 512, 4_000_000
#: What rounding to 9 places can lift a similarity by, and more.
ROUNDING = 2e-9
#: Rows of the batches that go back to the JVM.
BATCH = 50_000

Kernel = Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.Table]]


def _blocks(files: list[str]) -> Iterator[pa.Table]:
    for uri in files:
        system, path = located(uri)
        block = pq.ParquetFile(system.open_input_file(path)).read(use_threads=False)
        if block.num_rows:
            yield block


def tiled(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, sizes: tuple[int, int], tiles: int = 0, order: str = "id") -> DataFrame:
    """kernel of every block of left with the blocks of right, which come in the order of a column; sizes: keys of either side."""
    a, b = (max(1, -(-size // ENTRIES)) for size in sizes)
    while a < TILES and sizes[0] / a > LEAST:
        a += 1
    while a * b < tiles and max(sizes[0] / a, sizes[1] / b) > LEAST:
        a, b = (a + 1, b) if sizes[0] / a >= sizes[1] / b else (a, b + 1)
    ship(left.sparkSession)
    # part files are named by number, and the parts are ranges
    files = sorted(stored(right.repartitionByRange(b, order).sortWithinPartitions(order), "blocks").inputFiles(), key=lambda uri: uri.rsplit("/", 1)[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for x in batches if x.num_rows]
        if rows:
            for found in kernel(pa.Table.from_batches(rows), _blocks(files)):
                yield from found.to_batches(BATCH)

    return left.repartition(a).mapInArrow(run, schema)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each element, and the elements."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(whole), 0))
    return np.repeat(np.arange(len(sizes)), sizes), whole.flatten()


def _postings(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by code, where each of n codes starts in it, and how many rows it has."""
    order, counts = np.argsort(codes, kind="stable"), np.bincount(codes, minlength=n)
    return order, np.cumsum(counts) - counts, counts


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _first(rows: np.ndarray, limit: int) -> np.ndarray:
    """Which of the elements, in order by row, are among the first `limit` of their row."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
    return np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) < limit


def _best(row: np.ndarray, rows: int, grade: np.ndarray, grades: int, limit: int) -> np.ndarray:
    """Which of the elements, in order by row, are the `limit` of least grade in their row; of equal grades the first. Without a sort."""
    upto = np.bincount(row * grades + grade, minlength=rows * grades).reshape(rows, grades).cumsum(1)
    last = (upto < limit).sum(1)  # the grade at which a row is full; that of no element if it never is
    room = limit - np.where(last > 0, upto[np.arange(rows), last - 1], 0)
    ends = last[row]
    keep, ties = grade < ends, np.flatnonzero(grade == ends)
    at = row[ties]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    keep[ties[np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)])) < room[at]]] = True
    return keep


NEAREST = "q long, p long, similarity double"


def nearest(top: int, rows: int) -> Kernel:
    """(q, p, similarity): of each left row the `top` nearest right rows by the product of their vectors, to 9 places; ties go to the lesser id.

    Both have id and v, a list of (g, w) that names each g once. rows: left rows whose similarities are held at once, at most.
    """

    def kernel(left: pa.Table, blocks: Iterator[pa.Table]) -> Iterator[pa.Table]:
        m = left.num_rows
        q, v = _lists(left["v"])
        gq, w = np.asarray(v.field(0)), np.asarray(v.field(1))
        grams, gq = np.unique(gq, return_inverse=True)
        ids, found = np.full((m, top), -1), np.zeros((m, top))
        for right in blocks if len(grams) else ():
            p, v = _lists(right["v"])
            gp, v = np.asarray(v.field(0)), np.asarray(v.field(1))
            place = np.minimum(np.searchsorted(grams, gp), len(grams) - 1)
            ok = grams[place] == gp
            theirs, n = np.asarray(right["id"]), right.num_rows
            for i, j, s in _search(q, gq, w, p[ok], place[ok], v[ok], m, n, len(grams), top, min(rows, max(1, 2 * CELLS // n)), found[:, -1]):
                # those found before have lesser ids, and the sort is stable
                at = np.unique(i)
                row = np.concatenate([np.repeat(at, top), i])
                s, p_ids = np.concatenate([found[at].ravel(), s]), np.concatenate([ids[at].ravel(), theirs[j]])
                order = np.lexsort((-s, row))
                order = order[_first(row[order], top)]
                found[at], ids[at] = s[order].reshape(-1, top), p_ids[order].reshape(-1, top)
        i, j = np.nonzero(found > 0)
        yield pa.table({"q": left["id"].take(pa.array(i)), "p": ids[i, j], "similarity": found[i, j]})

    return kernel


def _search(q, gq, w, p, gp, v, m: int, n: int, grams: int, top: int, rows: int, floor: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:  # noqa: ANN001
    """(row, column, similarity) in that order, for `rows` rows at a time, of all that can be among the nearest `top` of a row and are not below its floor."""
    order, starts, counts = _postings(gp, p, grams)
    p, v = p[order], v[order]
    pairs = np.bincount(gq, minlength=grams).astype(float) * counts
    usual = np.argsort(-pairs, kind="stable")[: min(DENSE_GRAMS, DENSE_NUMBERS // n)]
    usual = usual[pairs[usual] * DENSE > float(m) * n]
    place = np.full(grams, -1)
    place[usual] = np.arange(len(usual))
    theirs = np.zeros((len(usual), n))
    for k, g in enumerate(usual):
        at = slice(starts[g], starts[g] + counts[g])
        theirs[k, p[at]] = v[at]
    dense = place[gq] >= 0
    rest = ~dense & (counts[gq] > 0)
    q1, k1, w1 = q[dense], place[gq[dense]], w[dense]
    q2, g2, w2 = q[rest], gq[rest], w[rest]
    for r in range(0, m, rows):
        size = min(rows, m - r)
        a, b = np.searchsorted(q1, (r, r + size))
        mine = np.zeros((size, len(usual)))
        mine[q1[a:b] - r, k1[a:b]] = w1[a:b]
        sums = mine @ theirs
        ends = np.searchsorted(q2, np.arange(r, r + size + 1))
        for x in range(size):
            a, b = ends[x], ends[x + 1]
            if a < b:
                n_of = counts[g2[a:b]]
                at = _ranges(starts[g2[a:b]], n_of)
                sums[x] += np.bincount(p[at], weights=v[at] * np.repeat(w2[a:b], n_of), minlength=n)
        least = floor[r : r + size] - ROUNDING
        if n > top and least.min() <= 0:  # rows without `top` yet
            least = np.maximum(least, np.partition(sums, n - top, axis=1)[:, n - top] - ROUNDING)
        i, j = np.nonzero(sums >= np.maximum(least, ROUNDING / 10)[:, None])
        s = np.floor(sums[i, j] * 1e9 + 0.5) / 1e9
        keep = s > 0
        if keep.any():
            yield i[keep] + r, j[keep], s[keep]


FOUND = "s1_id string, cand_id string, bits long, rank int"
COUNTED = "k int, pairs long, hits long"


def sharing(columns: list[str], weights: list[int], hot: list[list[str]], limit: int | None = None, truth: int | None = None) -> Kernel:
    """(s1_id, cand_id, bits, rank) of the pairs of rows that share keys: bit k says that they share one of columns[k]'s, without the keys in hot[k].

    limit: only the best of each left row by the sum of weights, ties to the lesser id, and their rank; else rank is 0. truth: instead of pairs,
    (k, pairs, hits), for each column their number and how many share a key of columns[truth] too.
    """
    cell = np.uint8 if len(columns) <= 8 else np.uint64

    def scored(bits: np.ndarray) -> np.ndarray:
        return sum(((bits >> cell(k)) & cell(1)).astype(np.int64) * weight for k, weight in enumerate(weights))

    small = scored(np.arange(256, dtype=np.uint8)) if cell is np.uint8 else None
    levels, by_bits = np.unique(-small, return_inverse=True) if small is not None else (None, None)

    def graded(bits: np.ndarray) -> tuple[np.ndarray, int]:
        """A number for each score, 0 for the greatest, and how many there are."""
        if levels is not None:
            return by_bits[bits], len(levels)
        scores, grade = np.unique(-scored(bits), return_inverse=True)
        return grade, len(scores)

    def tile(left: pa.Table, right: pa.Table, counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, column, bits) in order of row and column, for some rows at a time; or only counts."""
        m, n = left.num_rows, right.num_rows
        keys = []
        for column, often in zip(columns, hot, strict=True):
            (q, mine), (p, theirs) = _lists(left[column]), _lists(right[column])
            known = pc.unique(theirs).drop_null()
            if often:
                known = known.filter(pc.invert(pc.is_in(known, value_set=pa.array(often, known.type))))
            (q, mine), (p, theirs) = [(at[code >= 0], code[code >= 0]) for at, x in ((q, mine), (p, theirs)) for code in [np.asarray(pc.fill_null(pc.index_in(x, value_set=known), -1))]]
            order, starts, sizes = _postings(theirs, p, len(known))
            keys.append((q, mine, p[order], starts, sizes))
        rows = max(1, CELLS // n)
        for r in range(0, m, rows):
            bits = np.zeros(min(rows, m - r) * n, cell)
            for k, (q, mine, p, starts, sizes) in enumerate(keys):
                a, b = np.searchsorted(q, (r, r + rows))
                n_of = sizes[mine[a:b]]
                cells = np.repeat((q[a:b] - r) * n, n_of) + p[_ranges(starts[mine[a:b]], n_of)]
                bits[cells] |= cell(1 << k)
            at = np.flatnonzero(bits)
            bits = bits[at]
            if truth is not None:
                hit = (bits >> cell(truth)) & cell(1) > 0
                for k in range(len(columns)):
                    has = (bits >> cell(k)) & cell(1) > 0
                    counts[k] += has.sum(), (has & hit).sum()
                continue
            row = at // n
            if limit is not None and len(at):
                keep = _best(row, min(rows, m - r), *graded(bits), limit)
                at, row, bits = at[keep], row[keep], bits[keep]
            yield row + r, at - row * n, bits

    def shown(left: pa.Table, row: np.ndarray, ids: pa.Array, bits: np.ndarray, rank: np.ndarray) -> pa.Table:
        return pa.table({"s1_id": left["id"].take(pa.array(row)), "cand_id": ids, "bits": pa.array(bits.astype(np.int64)), "rank": pa.array(rank, pa.int32())})

    def kernel(left: pa.Table, blocks: Iterator[pa.Table]) -> Iterator[pa.Table]:
        m, counts = left.num_rows, np.zeros((len(columns), 2), np.int64)
        row, bits, ids = np.zeros(0, int), np.zeros(0, cell), pa.array([], left["id"].type)
        for right in blocks:
            out = list(tile(left, right, counts))
            if not out:
                continue
            i, j, new = (np.concatenate(x) for x in zip(*out, strict=True))
            theirs = right["id"].combine_chunks().take(pa.array(j))
            theirs = pa.concat_arrays(theirs.chunks) if isinstance(theirs, pa.ChunkedArray) else theirs
            if limit is None:
                yield shown(left, i, theirs, new, np.zeros(len(i), np.int32))
                continue
            # those found before have lesser ids, and the sort is stable
            row, bits, ids = np.concatenate([row, i]), np.concatenate([bits, new]), pa.concat_arrays([ids, theirs.cast(ids.type)])
            order = np.argsort(row, kind="stable")
            if len(order):
                order = order[_best(row[order], m, *graded(bits[order]), limit)]
            row, bits, ids = row[order], bits[order], ids.take(pa.array(order))
        if truth is not None:
            yield pa.table({"k": pa.array(range(len(columns)), pa.int32()), "pairs": counts[:, 0], "hits": counts[:, 1]})
        elif limit is not None and len(row):
            order = np.lexsort((graded(bits)[0], row))
            rank = np.empty(len(row), np.int32)
            rank[order] = np.arange(len(row)) - np.searchsorted(row, row) + 1
            yield shown(left, row, ids, bits, rank)

    return kernel
