"""MinHash near-dedup: DartMinHash.

Tokens are runs of letters and digits in lower case; a text's elements are its runs of
five tokens (a shorter text is one element), weighted by how often they occur. Two texts
are linked if their weighted Jaccard similarity is SIMILARITY or more; classes are the
connected groups.

Signatures. The region of an element of weight w is w units wide; hashed darts fall into
each unit as a Poisson process in time, each on one of K coordinates. Darts are thrown
up to a time at which every coordinate is hit with high probability (later, where one is
still free), and each keeps its earliest dart. Equal coordinates have the probability of
the weighted Jaccard similarity. BANDS bands of ROWS coordinates are the join keys.

Links. Texts with equal elements are one text from the start (a class representative with
members). In each bucket, of texts with a band in common, all texts are compared
with LEADERS texts that meet many others: LEADERS pairs per text, not all pairs. Where the
links so found leave a bucket in several groups, its texts are searched for links between groups: two sets that are
alike enough share one of their rarest elements (as many as the lesser similarity allows to differ, and one), so texts
meet by these, within the sizes that the elements which no other of these texts has leave possible, and never within one
group. What shares a bucket is compared. So each pair
in a bucket is compared, in one group already, or ruled out. Comparisons are exact, on
whole element sets. Texts that are alike, but not alike enough, and have hardly an element of their own still meet; their
pairs are spread over tasks, and give out links alone.

Defined results. Null and empty texts are all equal, one class. Null ids are allowed; a
class is named by its least id, null if it has no other. Repeated rows get a row each. An
empty table gives an empty result. Very long texts are read whole. Extra columns of the input are
not read and can have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.functions.session import bounded, forget, ship, stored
from entwine.llm import kernels as k
from entwine.llm.kernels import unused

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
K = BANDS * ROWS
LEADERS = 3


def elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the elements of a piece, one for each unit of weight: the n-th occurrence has a hash of its own."""
    words = k.Words(data, offsets)
    tokens = k.span_hashes(data, words.start, words.end)
    at = k.runs(words, SHINGLE)
    h, of = k.combine(tokens, at, tuple(range(SHINGLE))), words.doc[at]
    short = np.flatnonzero((words.counts < SHINGLE))
    whole = [np.uint64(0)] * len(short)
    for i, d in enumerate(short):
        mine = tokens[words.bounds[d] : words.bounds[d + 1]]
        whole[i] = k.combine(np.concatenate([mine, np.zeros(SHINGLE, np.uint64)]), np.zeros(1, np.int64), tuple(range(SHINGLE)), 1 + len(mine))[0]
    h, of = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    nth = np.arange(len(h)) - first[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    return np.where(nth > 0, k.mix(h + nth.astype(np.uint64), 5), h), of


def signatures(units: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """[text, coordinate]: the earliest dart, of texts that each have at least one unit; units are in order of texts."""
    counts = np.bincount(of, minlength=n)
    best = np.full((n, K), np.inf)
    value = np.zeros((n, K), np.uint64)
    until = (K * np.log(K) + 2 * K) / np.maximum(counts, 1)
    # of each unit: the time of its last dart, and how many it has thrown
    time, thrown = np.zeros(len(units)), np.zeros(len(units), np.int64)
    active = np.arange(len(units))
    while len(active):
        while len(active):
            ahead = min(64, max(1, 200_000 // len(active)))
            turn = thrown[active][:, None] + np.arange(ahead)
            draw = k.mix(k.mix(units[active])[:, None] + turn.astype(np.uint64) * k.M1, 21)
            at = time[active][:, None] + np.cumsum(-np.log1p(-((draw >> np.uint64(11)).astype(np.float64) / 2**53)), 1)
            hit = at <= until[of[active]][:, None]
            row, column = np.nonzero(hit)
            _land(best, value, of[active[row]], at[row, column], k.mix(draw[row, column], 22))
            n = hit.sum(1)
            some = np.flatnonzero(n)
            time[active[some]] = at[some, n[some] - 1]
            thrown[active] += n
            active = active[n == ahead]
        free = np.isinf(best).any(1) & (counts > 0)
        until = np.where(free, until * 2, until)
        active = np.flatnonzero(free[of])
    return value


def _land(best: np.ndarray, value: np.ndarray, text: np.ndarray, time: np.ndarray, dart: np.ndarray) -> None:
    """Keep darts that come before what their coordinate has."""
    cell = text * K + (dart % np.uint64(K)).astype(np.int64)
    flat, values = best.reshape(-1), value.reshape(-1)
    early = time < flat[cell]
    cell, time, dart = cell[early], time[early], dart[early]
    order = np.lexsort((dart, time, cell))
    cell, time, dart = cell[order], time[order], dart[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    flat[cell[first]], values[cell[first]] = time[first], dart[first]


def _content(units: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's element multiset."""
    ends = np.searchsorted(of, np.arange(n + 1))
    out = []
    for seed in (11, 12):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(k.mix(units, seed), dtype=np.uint64)])
        out.append(k.mix(sums[ends[1:]] - sums[ends[:-1]] + (ends[1:] - ends[:-1]).astype(np.uint64), seed).view(np.int64))
    return out[0], out[1]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in k.pieces(batch.column(1), True):
            units, of = elements(data, offsets)
            value = signatures(units, of, j - i).reshape(j - i, BANDS, ROWS)
            bands = np.zeros((j - i, BANDS), np.uint64)
            for r in range(ROWS):
                bands = k.mix(bands + value[:, :, r], r)
            c1, c2 = _content(units, of, j - i)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
            size = np.bincount(of, minlength=j - i).astype(np.int64)
            columns = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(c1), pa.array(c2), pa.array(size), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "c1", "c2", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in k.pieces(batch.column(1), True):
            units, of = elements(data, offsets)
            ends = np.searchsorted(of, np.arange(j - i + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(units.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["key", "units"])


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, similarity), exact."""
    one, two = sets.select(F.col("key").alias("a"), F.col("units").alias("ua")), sets.select(F.col("key").alias("b"), F.col("units").alias("ub"))
    both = F.size(F.array_intersect("ua", "ub"))
    similarity = both / (F.size("ua") + F.size("ub") - both)
    return pairs.join(one, "a").join(two, "b").select("a", "b", similarity.alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node of the connected group, for every node that is not itself the least.

    Each round every node takes the least of its neighbours, and the least of that one's; edges
    are renamed so and made distinct, so that their number falls fast.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    rounds = []
    while True:
        least = edges.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to"))
        further = least.select(F.col("from").alias("f2"), F.col("to").alias("t2"))
        least = stored(least.join(further, F.col("to") == F.col("f2"), "left").select("from", F.coalesce("t2", "to").alias("to")), "cc-least")
        rounds.append(least)
        roots = roots.join(least, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
        ends = edges.join(least.select(F.col("from").alias("fa"), F.col("to").alias("ta")), F.col("a") == F.col("fa"), "left")
        ends = ends.join(least.select(F.col("from").alias("fb"), F.col("to").alias("tb")), F.col("b") == F.col("fb"), "left")
        ends = ends.select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y")).where("x <> y")
        was, edges = edges, stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        forget(was)
        if edges.isEmpty():
            out = stored(roots.where("node <> root"), "cc-roots")
            forget(edges, *rounds)
            return out


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), content (c1, c2), size and bands of every row."""
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    sent = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))
    return sent.mapInArrow(_sign, f"doc_id {id_type}, mark long, c1 long, c2 long, size long, bands array<long>")


def _groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(g1, g2, root, links): the connected group of each content (c1, c2) of rows."""
    distinct = rows.groupBy("c1", "c2").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = stored(distinct.withColumn("key", F.xxhash64("c1", "c2")), "nd-texts")
    entries = texts.select("key", "size", F.posexplode("bands").alias("band", "value")).select("key", "size", "band", F.xxhash64("band", "value").alias("bucket"))
    many = stored(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nd-many")
    entries = stored(entries.join(bounded(many), "bucket"), "nd-entries")
    # texts that meet many others lie in the middle of their groups: they lead
    met = entries.groupBy(F.col("key").alias("k_")).agg(F.sum("n").alias("met"))
    ranked = entries.join(met, F.col("key") == F.col("k_"))
    central = [F.col("met"), *[F.floor(F.log2("met"))] * (LEADERS - 1)]
    turn = [F.max(F.struct(c.alias("met"), F.xxhash64(F.lit(i), "key").alias("turn"), F.col("key").alias("leader"), F.col("size").alias("leader_size"))).alias(f"l{i}") for i, c in enumerate(central)]
    leaders = F.array_distinct(F.array(*[F.struct(f"l{i}.leader", f"l{i}.leader_size") for i in range(LEADERS)]))
    led = stored(ranked.groupBy("bucket").agg(*turn).select("bucket", leaders.alias("leaders")), "nd-leaders")
    pairs = entries.join(led, "bucket").select("key", "size", F.explode("leaders").alias("l")).where("key <> l.leader")
    pairs = pairs.where(F.least("size", "l.leader_size") >= SIMILARITY * F.greatest("size", "l.leader_size"))
    pairs = pairs.select(F.least("key", "l.leader").alias("a"), F.greatest("key", "l.leader").alias("b")).distinct()
    sets = stored(_needed_sets(docs, rows, texts, entries.select("key").distinct()), "nd-sets")
    links = stored(_compare(pairs, sets).where(F.col("similarity") >= SIMILARITY).select("a", "b"), "nd-links")
    roots, spent = components(links), [many, led]
    forget(*spent)
    more = _remaining(texts, entries, roots, sets)
    spent = [texts, entries, sets, links, more, roots]
    if not more.isEmpty():
        links = stored(links.unionByName(more).distinct(), "nd-links")
        roots = components(links)
        spent += [links, roots]
    degree = links.select(F.explode(F.array("a", "b")).alias("k_")).groupBy("k_").agg(F.count(F.lit(1)).alias("links"))
    out = texts.select(F.col("c1").alias("g1"), F.col("c2").alias("g2"), "key").join(roots, F.col("key") == F.col("node"), "left").join(degree, F.col("key") == F.col("k_"), "left")
    out = stored(out.select("g1", "g2", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "nd-groups")
    forget(*spent)
    return out


def _needed_sets(docs: DataFrame, rows: DataFrame, texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, units): the element sets of the texts keys, from one document each."""
    wanted = texts.join(keys, "key", "left_semi").select("key", F.col("c1").alias("w1"), F.col("c2").alias("w2"))
    one = rows.join(wanted, (rows.c1 == wanted.w1) & (rows.c2 == wanted.w2)).groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("o"))
    one = bounded(stored(one.select("key", F.col("o.doc_id").alias("id_"), F.col("o.mark").alias("mark_")), "nd-wanted"))
    text = F.coalesce("text", F.lit(""))
    there = docs.select("doc_id", text.alias("text")).join(one, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("mark_")))
    return there.select("key", "text").mapInArrow(_sets, "key long, units array<long>").dropDuplicates(["key"])


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size) / F.lit(math.log(1.05)))


def _rarest(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, size, root, common, index) of the texts that can be alike with one of another group: index has, with their place in the order
    of rarity, the rarest elements that texts of several groups have, of which any such text must share one; common: elements that others have too."""
    units = open_.join(sets, "key").select("key", "size", "root", F.explode("units").alias("unit"))
    use = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), (F.min("root") != F.max("root")).alias("mixed"))
    shared = F.collect_list(F.when(F.col("n") > 1, F.struct("n", "unit", "mixed")))
    each = units.join(use, "unit").groupBy("key", "size", "root").agg(F.count_if(F.col("n") > 1).alias("common"), F.array_sort(shared).alias("shared"))
    least = F.ceil(SIMILARITY * F.col("size") - 1e-9)
    # of size - least + 1 elements those that others have
    prefix = F.slice("shared", 1, F.greatest(F.lit(0), (F.col("common") - least + 1).cast("int")))
    placed = F.transform(prefix, lambda x, i: F.struct(x["unit"].alias("unit"), (F.col("size") - F.col("common") + i).alias("place"), x["mixed"].alias("mixed")))
    index = F.filter(placed, lambda x: x["mixed"])
    return each.where(F.col("common") >= least).select("key", "size", "root", "common", index.alias("index")).where(F.size("index") > 0)


def _remaining(texts: DataFrame, entries: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different groups of a bucket."""
    mine = entries.join(roots, F.col("key") == F.col("node"), "left").select("key", "size", "bucket", F.coalesce("root", "key").alias("root"))
    several = mine.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    open_ = stored(mine.join(several, "bucket").select("key", "size", "root").distinct(), "nd-open")
    found = stored(_rarest(open_, sets), "nd-rarest")
    entry = found.select("key", "size", "root", "common", F.explode("index").alias("i")).select("key", "size", "root", "common", "i.unit", "i.place")
    # a pair is enumerated where one text at least is outside the group that most of an element's texts are in
    main = entry.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("unit").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    entry = stored(entry.join(main, "unit").withColumn("is_main", F.col("root") == F.col("main")).drop("main"), "nd-entries")
    side = lambda n: [F.col(c).alias(f"{c}_{n}") for c in ("key", "size", "root", "common", "place")]
    # the larger of two texts looks for sizes that it can be alike with; both have to share so many elements
    # that of the first one which they share, not too many are before it in either
    share = SIMILARITY / (1 + SIMILARITY)
    left = F.col("size") - F.col("place")
    most = F.least(F.col("size").cast("double"), F.col("common") / share - F.col("size") + 1e-6)
    classes = F.sequence(_size_class(SIMILARITY * F.col("size") - 1e-6), _size_class(most))
    seek = entry.where(most >= SIMILARITY * F.col("size") - 1e-6).select("*", F.explode(classes).alias("class"))
    seek = seek.where(left >= share * (F.col("size") + F.greatest(SIMILARITY * F.col("size"), F.pow(F.lit(1.05), F.col("class")))) - 1e-3).select("unit", "is_main", *side("a"), "class")
    offer = entry.where(left >= 2 * share * F.col("size") - 1e-9).select("unit", F.col("is_main").alias("main_b"), *side("b"), _size_class(F.col("size").cast("double")).alias("class"))
    needed = share * (F.col("size_a") + F.col("size_b")) - 1e-9
    alike = (F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= needed) & (F.least("common_a", "common_b") >= share * (F.col("size_a") + F.col("size_b")) - 1e-9) & (F.col("size_b") >= SIMILARITY * F.col("size_a") - 1e-9)
    smaller = (F.col("size_b") < F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("key_b") < F.col("key_a")))
    meet = lambda s, o: s.join(o, ["unit", "class"]).where(smaller & alike & (F.col("root_a") != F.col("root_b"))).select("key_a", "key_b")
    pairs = meet(seek.where("NOT is_main"), offer).unionByName(meet(seek.where("is_main"), offer.where("NOT main_b")))
    pairs = pairs.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()
    bands = lambda n: texts.select(F.col("key").alias(n), F.col("bands").alias(f"bands_{n}"))
    in_bucket = F.exists(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), lambda z: z)
    pairs = pairs.join(bands("a"), "a").join(bands("b"), "b").where(in_bucket).select("a", "b")
    out = stored(_compare(pairs, sets).where(F.col("similarity") >= SIMILARITY).select("a", "b"), "nd-more")
    forget(open_, found, entry)
    return out


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, mark, root and links of every row."""
    rows = stored(_signed(docs), "nd-rows")
    groups = _groups(docs, rows)
    out = stored(rows.join(groups, (rows.c1 == groups.g1) & (rows.c2 == groups.g2)).select("doc_id", "mark", "root", "links"), "nd-members")
    forget(rows, groups)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, checked_links, class_size for every row of docs (doc_id, text).

    class_id: the least doc_id of the row's class; checked_links: texts of other content that the
    row's text was found to be linked with directly, of the pairs that had to be compared to tell the classes: not
    the number of its near duplicates; class_size: rows of the class.
    """
    members = _members(docs)
    named = stored(members.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "nd-named")
    return members.join(named, "root").select("doc_id", "class_id", F.col("links").alias("checked_links"), "class_size")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs, with all its columns: one row of each class, that of least doc_id."""
    members = _members(docs)
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    kept = stored(members.groupBy("root").agg(F.min(one).alias("k")).select("root", "k.doc_id", "k.mark"), "nd-kept")
    same = ["root", "doc_id", "mark"]
    gone = members.alias("m").join(kept.alias("k"), [F.col(f"m.{c}").eqNullSafe(F.col(f"k.{c}")) for c in same], "left_anti")
    id_, mark_, turn = (unused(docs.columns, x) for x in ("__id", "__mark", "__turn"))
    named = [F.col("doc_id").alias(id_), F.col("mark").alias(mark_)]
    gone = bounded(stored(gone.select(*named).distinct(), "nd-gone"))
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    here = F.col("doc_id").eqNullSafe(F.col(id_)) & (mark == F.col(mark_))
    out = docs.join(gone, here, "left_anti")
    # rows of one id and one text are one document: the first by their columns' hash stays
    twice = stored(members.groupBy("doc_id", "mark").count().where("count > 1").select(*named), "nd-twice")
    if twice.isEmpty():
        return out
    first = out.join(bounded(twice), here, "left_semi").groupBy("doc_id", mark.alias(mark_)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(turn))
    return out.join(bounded(twice), here, "left_anti").unionByName(first.select(f"{turn}.*"))
