"""Mixing sources to target weights: certain whole copies, then Pareto order sampling.

Every source's target is a number of words. Each of its documents is taken
floor(target / words of the source) times for certain; the words that are left are one more copy
of some documents. A document of size s has the inclusion probability pi = min(1, c * s), with c such that
the expected words are those left: those with pi = 1 get their copy for certain, and of the others, whose pi sum
to n, exactly round(n) are taken, those of the least
q = (u / (1 - u)) / (pi / (1 - pi)), with u uniform by a hash of the document.

A sample of fixed size has its number of words by chance. What it lacks is made good by the
documents that are next in the order, of each size at most one, the greatest size not larger than the gap first; what
it has too much goes back likewise, last in the order first. At the end one more document may pass
the target if that brings the source nearer.

Where the order passes n is found by counting documents in bins of q / (1 + q) (4096 bins,
then 4096 within the crossing bin), so only the few rows of one small bin are ever
sorted; no source, however large, meets in one task. Sources are numbered within ranges of their names, and
the level of their targets is found in rounds of sums, so that neither do all sources.

Defined results. Null text has size 0. A null source is a source of its own, last in
order. An empty table gives an empty result. Repeated rows are separate documents. A
source without words has target 0 and takes nothing. Extra columns of the input are not
read and can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entwine.functions.session import bounded, stored

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3
SEED = "mix-1"
BINS = 4096
#: Equal rows that are numbered in one go.
TWINS = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) by 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts, F.lit(SEED))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right's rows of the same source, which right calls source_."""
    return left.join(right, left.source.eqNullSafe(right.source_), how).drop("source_")


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with place: 1, 2, ... in the order of their names, null last; ranges of names are numbered each on its own."""
    ranged = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(F.col("part").alias("part_")).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    numbered = ranged.join(F.broadcast(parts), F.col("part") == F.col("part_"))  # a row for each shuffle partition
    return numbered.withColumn("place", F.col("before") + F.row_number().over(inside)).drop("part", "part_", "n", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, words) -> (source, words, target): shares by weight, cut at max_copies times a source's words.

    The excess is reshared by weight among the others, in rounds, until no source is above its cut.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighed = stored(_numbered(sources).withColumn("weight", weight).select("source", "words", "weight"), "mix-weights")
    most = max_copies * F.col("words")
    level, cut = None, -1
    while True:
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > most
        sums = weighed.agg(F.sum("words").alias("all"), F.sum(F.when(above, most)).alias("cut"), F.count_if(above).alias("n"), F.sum(F.when(~above, F.col("weight"))).alias("weights")).first()
        if sums["n"] == cut or not sums["weights"]:
            break
        level, cut = (sums["all"] - (sums["cut"] or 0)) / sums["weights"], sums["n"]
    return weighed.select("source", "words", F.least(F.lit(level or 0.0) * F.col("weight"), most.cast("double")).alias("target"))


def _scales(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source_, top, c, n): pi = c * size for documents up to size top, 1 for larger ones; n of the former are taken."""
    hist = _by_source(rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), goals.select("source_", "left"))
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words, squares = F.col("n") * F.col("size"), F.col("n").cast("decimal(12,0)") * F.col("size").cast("decimal(12,0)") * F.col("size").cast("decimal(12,0)")
    each = hist.withColumns({"big": F.coalesce(F.sum(words).over(larger), F.lit(0)), "rest": F.sum(words).over(upto), "squares": exact(squares).over(upto).cast("double")})
    each = each.withColumn("c", (F.col("left") - F.col("big")) / F.col("squares")).where((F.col("left") >= F.col("big")) & (F.col("c") * F.col("size") < 1))
    found = each.groupBy("source").agg(F.max(F.struct("size", "c", "rest")).alias("f"))
    return found.select(F.col("source").alias("source_"), F.col("f.size").alias("top"), "f.c", F.round(F.col("f.c") * F.col("f.rest")).cast("long").alias("n"))


def _crossing(rows: DataFrame, need: DataFrame) -> DataFrame:
    """(source, bin) and (source_, n) -> (source_, bin_, n): the bin in which a source's rows pass n, and how many are left there.

    A source whose rows do not pass n has no row.
    """
    bins = rows.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("in_bin"))
    upto = Window.partitionBy("source").orderBy("bin")
    passed = _by_source(bins.withColumn("upto", F.sum("in_bin").over(upto)), need).where(F.col("upto") > F.col("n"))
    at = passed.groupBy(F.col("source").alias("source_")).agg(F.min(F.struct("bin", (F.col("n") - (F.col("upto") - F.col("in_bin"))).alias("n"))).alias("at"))
    return at.select("source_", F.col("at.bin").alias("bin_"), "at.n")


def _corrections(chosen: DataFrame) -> DataFrame:
    """(s_, d_, z_, t_): the documents to be taken besides, or not after all. chosen: (source, doc_id, size, twin, q, left, sure, chosen)."""
    gaps = stored(chosen.groupBy(F.col("source").alias("source_")).agg((F.first("left") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))).alias("gap")), "mix-gaps")
    open_ = _by_source(chosen, bounded(gaps.where("gap <> 0"))).where("size > 0 AND left > 0")
    one = F.struct("q", "doc_id", "twin")
    more = open_.where("gap > 0 AND NOT chosen").groupBy("source", "size").agg(F.min(one).alias("one"), F.first("gap").alias("gap"))
    less = open_.where("gap < 0 AND chosen AND NOT sure").groupBy("source", "size").agg(F.max(one).alias("one"), (-F.first("gap")).alias("gap"))
    # of each source one row for each size
    each = more.unionByName(less).groupBy("source").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(F.struct("size", "one")), asc=False).alias("each"))
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda a, x: F.when(x["size"] <= a["gap"], F.struct((a["gap"] - x["size"]).alias("gap"), F.concat(a["taken"], F.array(x["size"])).alias("taken"))).otherwise(a)
    each = each.withColumn("a", F.aggregate("each", start, step))
    over = F.array_min(F.filter(F.transform("each", lambda x: x["size"]), lambda z: (z > F.col("a.gap")) & (z < 2 * F.col("a.gap")) & ~F.array_contains("a.taken", z)))
    each = each.withColumn("taken", F.when(over.isNotNull(), F.concat("a.taken", F.array(over))).otherwise(F.col("a.taken")))
    picked = each.select("source", F.explode(F.filter("each", lambda x: F.array_contains("taken", x["size"]))).alias("e"))
    return picked.select(F.col("source").alias("s_"), F.col("e.one.doc_id").alias("d_"), F.col("e.size").alias("z_"), F.col("e.one.twin").alias("t_"))


def _twins(rows: DataFrame) -> DataFrame:
    """(doc_id, source, size), with twin: 1, 2, ... for equal rows."""
    groups = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    blocks = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / TWINS))).alias("block"))
    first = F.col("block") * TWINS + 1
    return blocks.select("doc_id", "source", "size", F.explode(F.sequence(first, F.least("rows", first + TWINS - 1))).alias("twin"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, source, text)."""
    rows = _twins(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("twin").cast("string"))
    rows = stored(rows.withColumn("u", u), "mix-sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("words")), weights, max_copies)
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.when(F.col("words") > 0, F.col("words")))).otherwise(F.lit(0))
    goals = goals.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("words")).withColumnRenamed("source", "source_")
    goals = stored(goals, "mix-goals")
    scales = stored(_scales(rows, goals), "mix-scales")
    goals = goals.join(scales.withColumnRenamed("source_", "s"), goals.source_.eqNullSafe(F.col("s")), "left").drop("s")
    pi = F.when((F.col("size") > 0) & (F.col("size") <= F.col("top")) & (F.col("c") > 0), F.col("c") * F.col("size"))
    ranked = _by_source(rows, bounded(goals)).withColumn("q", (F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi))).withColumn("sure", F.coalesce(F.col("size") > F.col("top"), F.lit(False)))
    # where the order of q passes the number that is to be taken
    place = F.col("q") / (1 + F.col("q"))
    binned = ranked.where("q IS NOT NULL").withColumns({"bin": F.floor(place * BINS), "fine": F.floor(place * (BINS * BINS))})
    first = stored(_crossing(binned, scales.select("source_", "n")), "mix-bins")
    inside = binned.select("source", "bin", "fine", "q", "doc_id", "size", "twin")
    inside = _by_source(inside, bounded(first.withColumnRenamed("n", "need"))).where("bin = bin_")
    second = stored(_crossing(inside.select("source", F.col("fine").alias("bin")), first.select("source_", "n")), "mix-fine")
    edge = _by_source(inside.drop("bin_", "need"), bounded(second.select("source_", F.col("bin_").alias("fine_"), "n"))).where("fine = fine_")
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size", "twin")
    key = F.struct("q", "doc_id", "size", "twin")
    last = edge.withColumn("turn", F.row_number().over(order)).where("turn <= n").groupBy(F.col("source").alias("e_")).agg(F.max(key).alias("last"))
    ends = second.join(last, second.source_.eqNullSafe(F.col("e_")), "left").select("source_", F.col("bin_").alias("cut"), "last")
    ends = stored(ends, "mix-ends")
    # all rows of a source whose order doesn't pass n are taken
    marked = _by_source(ranked, bounded(ends), "left")
    at = F.floor(place * (BINS * BINS))
    sampled = F.col("q").isNotNull() & (F.col("cut").isNull() | (at < F.col("cut")) | ((at == F.col("cut")) & F.coalesce(key <= F.col("last"), F.lit(False))))
    chosen = marked.withColumn("chosen", F.col("sure") | F.coalesce(sampled, F.lit(False)))
    flips = bounded(stored(_corrections(chosen.select("source", "doc_id", "size", "twin", "q", "left", "sure", "chosen")), "mix-corrections"))
    same = chosen.source.eqNullSafe(F.col("s_")) & chosen.doc_id.eqNullSafe(F.col("d_")) & (F.col("size") == F.col("z_")) & (F.col("twin") == F.col("t_"))
    final = chosen.join(flips, same, "left").withColumn("chosen", F.col("chosen") != F.col("t_").isNotNull())
    copies = (F.col("whole") + F.when(F.col("chosen"), 1).otherwise(0)).cast("long")
    return final.withColumn("copies", copies).select(
        "doc_id", "source", "size", F.col("words").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
