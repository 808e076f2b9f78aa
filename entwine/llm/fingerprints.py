"""Document fingerprints: canonical exact digest.

The canonical form of a text is its Unicode composition (NFC), fully case-folded, with
every run of whitespace turned into one space and none at the ends. Two 64-bit xxhashes
of it with unrelated seeds make a 128-bit bucket. Where a bucket has more than one row
the canonical texts themselves are compared, byte by byte, as the least and greatest of
the bucket: those aggregates combine before the shuffle, so a bucket with a third of all
rows meets no single task. If they differ, the bucket's texts are numbered and the
number becomes part of the fingerprint.

The ICU classes that Spark ships for its collations do the composition and the folding,
called by Spark's own SQL function reflect(); no Python runs on the executors.

Defined results. Null text is the empty text, which has a fingerprint of its own. Equal
texts have equal fingerprints. An empty table gives an empty result. Repeated rows each
get a row. Ids can have any type that has an order. Extra columns of the input are not read and can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType

from entwine.functions.session import bounded, stored

#: Characters that a range of neighbouring documents aims at, and the most ranges.
RANGE_CHARS, MAX_RANGES = 4_000_000, 65_536


def canonical(text: Column) -> Column:
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}]+", " "))


def wide_hash(text: Column, bits: int = 64) -> list[Column]:
    """Two xxhashes whose seeds are hashes of two labels; fewer bits are for tests of equal buckets."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(label), text), 64 - bits) if bits < 64 else F.xxhash64(F.lit(label), text) for label in ("a", "b")]


def _hex(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def contested(hashes: DataFrame) -> DataFrame:
    """The buckets (h1, h2) with more than one row."""
    return hashes.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")


def variants(texts: DataFrame) -> DataFrame:
    """(h1, h2, canon) of contested buckets -> (h1, h2, sha, variant) for the texts of those that hold unequal bytes.

    variant counts a bucket's texts from 0; sha is the text's SHA-256, by which rows find their variant.
    """
    ends = texts.groupBy("h1", "h2").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    unequal = stored(ends.where("least <> most").select("h1", "h2"), "fp-unequal")
    if unequal.isEmpty():
        return unequal.selectExpr("h1", "h2", "'' AS sha", "0 AS variant")
    each = texts.join(unequal, ["h1", "h2"], "left_semi").select("h1", "h2", "canon").distinct()
    number = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("canon")) - 1
    return stored(each.select("h1", "h2", F.sha2("canon", 256).alias("sha"), number.alias("variant")), "fp-variants")


def _key(canon: Column, bits: int) -> Column:
    h1, h2 = wide_hash(canon, bits)
    return F.struct(h1.alias("h1"), h2.alias("h2"), F.sha2(canon, 256).alias("sha"))


def _mark(keys: DataFrame, numbers: DataFrame, key: str, name: str) -> DataFrame:
    """keys with the fingerprint of the struct column key, as column name."""
    numbers = bounded(numbers.select(F.struct("h1", "h2", "sha").alias("k_"), F.col("variant").alias("v_")))
    mark = F.concat(_hex(F.col(f"{key}.h1"), F.col(f"{key}.h2")), F.when(F.col("v_") > 0, F.concat(F.lit("-"), F.col("v_"))).otherwise(""))
    return keys.join(numbers, F.col(key) == F.col("k_"), "left").withColumn(name, mark).drop("k_", "v_")


def fingerprint(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_chars, fingerprint, group_size for every row of docs (doc_id, text).

    group_size counts the rows with the same canonical text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    canon = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), canonical(text).alias("canon"))
    canon = canon.withColumn("own", _key(F.col("canon"), bits))
    keys = stored(canon.drop("canon"), "fp-keys")
    many = bounded(stored(contested(keys.select("own.h1", "own.h2")), "fp-many"))
    numbers = variants(canon.select("canon", "own.h1", "own.h2").join(many, ["h1", "h2"], "left_semi"))
    marked = _mark(keys, numbers, "own", "fingerprint")
    sizes = marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size"))
    return marked.join(sizes, "fingerprint").select("doc_id", "n_chars", "fingerprint", "group_size")


#: Copies of a row that are made in one go.
COPIES = 65_536


def _order_key(id_: Column, kind: DataType) -> Column:
    """A value of one type that is never null, in the order of the ids, null least."""
    if isinstance(kind, IntegralType):
        return F.coalesce(id_.cast("long"), F.lit(-(1 << 63)))
    return F.coalesce(id_.cast("double"), F.lit(float("-inf"))) if isinstance(kind, NumericType) else F.coalesce(F.concat(F.lit("1"), id_.cast("string")), F.lit("0"))


def _ranges(order: DataFrame) -> list:
    """Ascending keys, at most about MAX_RANGES of them, that end ranges of about equally many rows; a key that fills several ranges is there as often."""
    n, chars = order.agg(F.count(F.lit(1)), F.sum("chars")).first()
    if not n:
        return []
    least = 4 * int(order.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(MAX_RANGES, max(least, (chars or 0) // RANGE_CHARS), n)
    if order.schema["key"].dataType.simpleString() != "string":
        at = F.percentile_approx("key", [(i + 1) / k for i in range(k)], F.lit(min(1_000_000, 8 * k)))
        return sorted(order.agg(at).first()[0])
    parts = order.select("key").repartitionByRange(k, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("n"))
    return sorted(e for r in parts.collect() for e in [r["most"]] * (-(-r["n"] * k // n) if r["least"] == r["most"] else 1))


def _upto(value: Column, ends: list, kind: str, equal: bool) -> Column:
    """How many of ends are less than value (or equal to it), by binary search."""
    steps = [1 << i for i in reversed(range(len(ends).bit_length()))]
    all_ends = F.lit(ends).cast(f"array<{kind}>")
    before = (lambda e: e <= value) if equal else (lambda e: e < value)
    further = lambda at, step: at + F.when(F.coalesce(before(F.get(all_ends, at + step - 1)), F.lit(False)), step).otherwise(0)
    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), further)


def _repeated(row: Column, times: Column) -> Column:
    """row, times times, as an array to explode twice: blocks of COPIES."""
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / COPIES))
    return F.transform(blocks, lambda b: F.struct(row.alias("row"), F.least(F.lit(COPIES).cast("long"), times - b * COPIES).alias("n")))


def with_next(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text and others), as struct columns own and next the row that follows by descending doc_id, and times: rows that this row stands for.

    The first row follows the last. Null ids come last; rows of one id are in the order of two hashes of
    their text, and equal rows follow each other: they are grouped before anything is dealt out, as one row that its
    other copies follow, and one that the next text follows. Rows are dealt by ranges of ids, or within an id of their
    hashes, and the row that begins a range is handed to
    the range before it too, so that no window holds more than a range.
    """
    names, kind = docs.columns, docs.schema["doc_id"].dataType
    text = F.coalesce("text", F.lit(""))
    marks = wide_hash(text)
    keyed = docs.select(F.struct(*names).alias("own"), _order_key(F.col("doc_id"), kind).alias("key"), marks[0].alias("m1"), marks[1].alias("m2"))
    of = ["key", "m1", "m2"]
    order = stored(keyed.groupBy(*of).agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("own.text")).alias("chars")), "fp-order")
    ends = _ranges(order)
    key_type = order.schema["key"].dataType.simpleString()
    low, high = (_upto(F.col("key"), ends, key_type, equal) for equal in (False, True))
    # an id that ends several ranges is dealt among them by its texts' hash
    share = F.least(high - low - 1, F.floor((F.col("m1").cast("double") / 2.0**64 + 0.5) * (high - low)).cast("int"))
    here = F.when(high - low > 1, high - 1 - share).otherwise(low)
    ranges = order.select(*of, "copies", here.alias("range"))
    flip = lambda c: F.bitwise_not(F.col(c)).alias(c)
    first = ranges.groupBy("range").agg(F.max(F.struct("key", flip("m1"), flip("m2"))).alias("f"))
    by_range = Window.orderBy("range")  # a row for each range
    ahead = F.coalesce(F.lead("range").over(by_range), F.first("range").over(by_range))
    first = stored(first.select(F.col("f.key").alias("f_key"), flip("f.m1").alias("f_m1"), flip("f.m2").alias("f_m2"), ahead.alias("ahead")), "fp-firsts")
    many = bounded(stored(order.where("copies > 1").select(*[F.col(c).alias(f"c_{c}") for c in of], "copies"), "fp-copies"))
    same = lambda p: (F.col("key") == F.col(f"{p}_key")) & (F.col("m1") == F.col(f"{p}_m1")) & (F.col("m2") == F.col(f"{p}_m2"))
    single = keyed.join(many, same("c"), "left_anti").withColumn("copies", F.lit(1).cast("long"))
    grouped = keyed.join(many, same("c")).groupBy(*of).agg(F.first("own").alias("own"), F.first("copies").alias("copies"))
    rows = single.unionByName(grouped).withColumn("range", here).join(F.broadcast(first), same("f"), "left")
    place = lambda at, visitor: F.struct(at.alias("range"), F.lit(visitor).alias("visitor"))
    places = F.array_compact(F.array(place(F.col("range"), 0), F.when(F.col("ahead").isNotNull(), place(F.col("ahead"), 1))))
    inside = Window.partitionBy("range").orderBy("visitor", F.col("key").desc(), "m1", "m2")
    dealt = rows.withColumn("place", F.explode(places)).select("own", *of, "copies", "place.range", "place.visitor")
    found = dealt.withColumn("next", F.lead("own").over(inside)).where("visitor = 0")
    last = F.struct(F.col("next"), F.lit(1).cast("long").alias("times"))
    others = F.struct(F.col("own").alias("next"), (F.col("copies") - 1).alias("times"))
    return found.select("own", F.explode(F.array_compact(F.array(last, F.when(F.col("copies") > 1, others)))).alias("n")).select("own", "n.next", "n.times")


def _edited(docs: DataFrame, bits: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    digested = docs.select("doc_id", text.alias("text")).withColumn("key", _key(canonical(F.col("text")), bits))
    n = F.length("own.text")
    third = F.floor(n / 3).cast("int")
    new = F.concat(F.substring(F.col("own.text"), F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))
    rows = with_next(digested).select("own.doc_id", F.col("own.key").alias("own"), n.cast("long").alias("n_chars"), new.alias("edited"), F.col("next.doc_id").alias("next_id"), F.col("next.key").alias("next_own"), "times")
    return rows.withColumn("canon", canonical(F.col("edited"))).withColumn("changed", _key(F.col("canon"), bits))


def fingerprint_with_edits(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Fingerprints of every text, of its edited form and their likeness, for every row of docs (doc_id, text).

    The edited form has the last floor(n_chars / 3) code points replaced by the first as many
    of the next document's, by descending doc_id. An exact digest is like another fully or not
    at all: near_edited and near_next are 1.0 for equal fingerprints, else 0.0.
    """
    keys = stored(_edited(docs, bits).select("doc_id", "n_chars", "own", "next_id", "next_own", "changed", "times", F.sha2("edited", 256).alias("edited_sha256")), "fp-keys")
    both = keys.select("own.h1", "own.h2").unionByName(keys.select("changed.h1", "changed.h2"))
    many = bounded(stored(contested(both), "fp-many"))
    text = docs.select(canonical(F.coalesce(F.col("text"), F.lit(""))).alias("canon"))
    h1, h2 = wide_hash(F.col("canon"), bits)
    texts = text.withColumns({"h1": h1, "h2": h2}).join(many, ["h1", "h2"], "left_semi")
    again = keys.join(many, (keys.changed.h1 == F.col("h1")) & (keys.changed.h2 == F.col("h2")), "left_semi")
    ids = bounded(stored(again.select(F.explode(F.array("doc_id", "next_id")).alias("id")).distinct(), "fp-again"))
    needed = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    edited = _edited(needed, bits).select("canon", "changed.h1", "changed.h2").join(many, ["h1", "h2"], "left_semi")
    numbers = variants(texts.unionByName(edited))
    for key, name in (("own", "fingerprint"), ("changed", "edited_fingerprint"), ("next_own", "next_fingerprint")):
        keys = _mark(keys, numbers, key, name)
    like = lambda other: F.when(F.col("fingerprint") == F.col(other), 1.0).otherwise(0.0)
    row = F.struct("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
    blocks = keys.select(F.explode(_repeated(row, F.col("times"))).alias("b"))
    return blocks.select("b.row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("b.n"))).alias("i")).select("row.*")
