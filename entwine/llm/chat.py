"""Chat formatting: cumulative-snapshot collapse.

A conversation that was logged after every turn is there many times, each time a turn
longer. The hash of a prefix of k turns is the sum over its turns of a hash of place,
role and text (two sums of 60 bits each), so it rolls on from turn to turn. A conversation
whose hash and length are those of a shorter prefix of another one, or of an equal
conversation with a lesser id, is dropped by an anti-join; the maximal ones are rendered.

Sums and places are made in blocks of BLOCK turn numbers, first of blocks, then within
them, so that no task holds all turns of a very long conversation but for its final text.

Defined results. Turns are in the order of turn, role, text, nulls last; equal rows of
one conversation count once. Null role and null text are empty. A null conv_id is one
conversation. An empty table gives an empty result. Extra columns are not read and can
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entwine.functions.session import stored

BLOCK = 256


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")


def _running(rows: DataFrame, value: dict[str, Column], order: list[Column]) -> DataFrame:
    """rows with running sums of value within (conv_id, block) plus the sums of the blocks before."""
    sums = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"{n}_in") for n, c in value.items()])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c_"), F.col("block").alias("b_"), *[F.coalesce(F.sum(f"{n}_in").over(before), F.lit(0)).alias(f"{n}_before") for n in value])
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("block") == F.col("b_")))
    return joined.withColumns({n: F.col(f"{n}_before") + F.sum(c).over(inside) for n, c in value.items()}).drop("c_", "b_", *[f"{n}_before" for n in value])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, block, place, h1, h2, role, text for every distinct turn: h1 and h2 are of the prefix that ends there."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit((1 << 62))))
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    rows = _running(rows, {"place": F.lit(1).cast("long")}, order)
    digest = F.md5(F.concat_ws("\u0001", F.col("place").cast("string"), "role", "text"))
    rows = stored(rows.withColumn("digest", digest), "chat-turns")
    return _running(rows, {"h1": _half(F.col("digest"), 1), "h2": _half(F.col("digest"), 16)}, [F.col("place")]).drop("digest", "turn")


def maximal(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From prefixes(): (conv_id, n_turns, copies, h1, h2) of the conversations to keep; (n_turns, h1, h2, copies) of all, equal ones as one."""
    last = rows.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("l")).select("conv_id", F.col("l.place").alias("n_turns"), "l.h1", "l.h2")
    last = stored(last, "chat-last")
    whole = last.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    whole = stored(whole, "chat-whole")
    longer = rows.join(last.select(F.col("conv_id").alias("c_"), F.col("n_turns").alias("n_")), F.col("conv_id").eqNullSafe(F.col("c_"))).where("place < n_")
    longer = longer.select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return stored(whole.join(longer, ["n_turns", "h1", "h2"], "left_anti"), "chat-maximal"), whole


def render(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, rendered) of the conversations kept, in their turns' order."""
    piece = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    mine = rows.join(kept.select(F.col("conv_id").alias("c_")), F.col("conv_id").eqNullSafe(F.col("c_"))).select("conv_id", "block", "place", piece.alias("piece"))
    in_order = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "piece"))), lambda x: x["piece"]), "")
    blocks = mine.groupBy("conv_id", "block").agg(in_order("place").alias("piece"))
    return blocks.groupBy("conv_id").agg(in_order("block").alias("rendered"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, snapshots, rendered of the maximal conversations of turns (conv_id, turn, role, text).

    copies: conversations with the same turns, this one included; snapshots: logged
    conversations that are a shorter prefix of this one.
    """
    rows = stored(prefixes(turns), "chat-prefixes")
    kept, whole = maximal(rows)
    shorter = rows.join(kept.select(F.col("conv_id").alias("c_"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("c_"))).where("place < n_turns")
    shorter = shorter.select("conv_id", F.col("place").alias("n_turns"), "h1", "h2")
    counted = shorter.join(whole.select("n_turns", "h1", "h2", "copies"), ["n_turns", "h1", "h2"]).groupBy("conv_id").agg(F.sum("copies").alias("snapshots"))
    counted = counted.withColumnRenamed("conv_id", "s_")
    text = render(rows, kept).withColumnRenamed("conv_id", "r_")
    out = kept.join(text, F.col("conv_id").eqNullSafe(F.col("r_"))).join(counted, F.col("conv_id").eqNullSafe(F.col("s_")), "left")
    return out.select("conv_id", "n_turns", "copies", F.coalesce("snapshots", F.lit(0)).cast("long").alias("snapshots"), "rendered")
