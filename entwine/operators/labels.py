"""Ground truth, splits, labels and negative samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entwine.functions.session import BROADCAST_ROWS, bounded, stored
from entwine.functions.similarity import jaccard
from entwine.functions.text import split_list


def truth_pairs(truth: DataFrame) -> DataFrame:
    """Distinct (s1_id, cand_id) of list-valued truth; several rows of one id are united."""
    parts = F.explode(split_list(F.col("matched_entity_ids")))
    return truth.select(F.col("source1_entity_id").alias("s1_id"), parts.alias("cand_id")).distinct()


@dataclass(frozen=True)
class Truth:
    """Ground truth by its distinct lists: entities (s1_id, list) have a row an id, members (list, cand_id) a row for what is in a list.

    Where many entities have the same list, their pairs, as many as both sides multiplied, are never made.
    """

    entities: DataFrame
    members: DataFrame


def factored(truth: DataFrame) -> Truth:
    """truth_pairs of list-valued truth, as Truth: equal lists are one, rows of one id are united. Entities without a match have no row."""
    rows = truth.select(F.col("source1_entity_id").alias("s1_id"), F.col("matched_entity_ids").alias("text")).where("trim(text) <> ''").withColumn("digest", F.sha2("text", 256))
    texts = stored(rows.select("digest", "text").distinct().withColumn("list", F.monotonically_increasing_id().cast("string")), "truth-lists")
    members = texts.select("list", F.explode(split_list(F.col("text"))).alias("cand_id")).distinct()
    each = rows.select("s1_id", "digest").join(bounded(texts.select("digest", "list"), BROADCAST_ROWS // 4), "digest").groupBy("s1_id").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    entities = stored(each.withColumn("list", F.array_join("lists", "+")), "truth-entities")
    several = entities.where(F.size("lists") > 1).select("list", "lists").distinct()
    if not several.isEmpty():
        united = several.select(F.col("list").alias("all"), F.explode("lists").alias("list")).join(members, "list").select(F.col("all").alias("list"), "cand_id")
        members = members.unionByName(united.distinct())
    return Truth(entities.drop("lists"), stored(members, "truth-members"))


def marked(pairs: DataFrame, truth: DataFrame | Truth) -> DataFrame:
    """pairs with is_match: 1 for those of truth, (s1_id, cand_id) or Truth; else null."""
    if isinstance(truth, Truth):
        mine = pairs.join(bounded(truth.entities.withColumnRenamed("list", "truth_list")), "s1_id", "left")
        out = mine.join(truth.members.select(F.col("list").alias("truth_list"), "cand_id", F.lit(1).alias("is_match")), ["truth_list", "cand_id"], "left")
    else:
        out = pairs.join(truth.select("s1_id", "cand_id").distinct().withColumn("is_match", F.lit(1)), ["s1_id", "cand_id"], "left")
    return out.select(*pairs.columns, "is_match")


def sizes(truth: DataFrame | Truth, **more: Column) -> DataFrame:
    """(s1_id, actual, ...) of the entities with a match: how many, and of how many a condition on cand_id holds."""
    counts = [F.count(F.lit(1)).alias("actual"), *[F.count_if(ok).alias(name) for name, ok in more.items()]]
    if isinstance(truth, Truth):
        return truth.entities.join(truth.members.groupBy("list").agg(*counts), "list").drop("list")
    return truth.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(*counts)


def truth_lists(truth: DataFrame) -> DataFrame:
    """(s1_id, cand_ids) of list-valued truth, as it is: rows of one id are not united."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), split_list(F.col("matched_entity_ids")).alias("cand_ids"))


def truth_entities(truth: DataFrame) -> DataFrame:
    """Distinct (s1_id), those without a match too."""
    return truth.select(F.col("source1_entity_id").alias("s1_id")).distinct()


def hash_order(*parts: Column | str, seed: int = 42) -> Column:
    """A pseudo-random key that any engine with MD5 gives alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def entity_split(s1: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """(entity_id, is_validation): the first ceil(share * n) distinct ids in hash order are validation.

    The cut is found without a global sort: ids are counted by the first four hex digits of
    the hash, and only the digits' group in which the cut falls is ordered.
    """
    ids = s1.select("entity_id").distinct().withColumn("h", hash_order("entity_id", seed=seed)).withColumn("bin", F.substring("h", 1, 4))
    bins = ids.groupBy("bin").count()
    upto = Window.orderBy("bin")
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    goal = F.ceil(F.round(F.lit(test_share) * total, 9))
    cut = bins.select("bin", (goal - (F.sum("count").over(upto) - F.col("count"))).alias("left"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy("h", "entity_id"))
    return ids.withColumn("place", place).join(cut, "bin").select("entity_id", (F.col("place") <= F.col("left")).alias("is_validation"))


def labelled(candidates: DataFrame, truth: DataFrame | Truth) -> DataFrame:
    """candidates with label 1 for pairs of truth, else 0."""
    return marked(candidates, truth).withColumn("label", F.coalesce("is_match", F.lit(0))).drop("is_match")


def positives(candidates: DataFrame, truth: DataFrame | Truth) -> DataFrame:
    return marked(candidates, truth).where("is_match = 1").drop("is_match").withColumn("label", F.lit(1))


def negatives(candidates: DataFrame, truth: DataFrame | Truth) -> DataFrame:
    return marked(candidates, truth).where("is_match IS NULL").drop("is_match").withColumn("label", F.lit(0))


def missed(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of truth that are no candidates, of the entities that have candidates or none."""
    return truth.join(candidates, ["s1_id", "cand_id"], "left_anti")


def label_counts(candidates: DataFrame, truth: DataFrame | Truth, s1: DataFrame) -> DataFrame:
    """One row: truth pairs of s1's entities, how many are candidates, how many are missing."""
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    wanted = sizes(truth).join(ids, "s1_id", "left_semi").agg(F.coalesce(F.sum("actual"), F.lit(0)).alias("ground_truth_positives"))
    found = marked(candidates.select("s1_id", "cand_id").distinct().join(ids, "s1_id", "left_semi"), truth).agg(F.count("is_match").alias("positive_pairs"))
    return wanted.crossJoin(found).withColumn("missing_positives", F.col("ground_truth_positives") - F.col("positive_pairs"))


def sample_negatives(candidates: DataFrame, truth: DataFrame | Truth, s1: DataFrame, pool: DataFrame, n_random: int = 2, n_hard: int = 1, seed: int = 42) -> DataFrame:
    """Negatives of each s1_id: n_random in hash order, then of the rest the n_hard with the most alike name tokens.

    Ties of likeness go to the better candidate rank; an empty name has no hard negatives.
    kind says which a row is.
    """
    rest = negatives(candidates, truth)
    drawn = Window.partitionBy("s1_id").orderBy(hash_order("s1_id", "cand_id", seed=seed), "cand_id")
    numbered = rest.withColumn("turn", F.row_number().over(drawn))
    mine = s1.dropDuplicates(["entity_id"]).select(F.col("entity_id").alias("s1_id"), F.col("business_name_normalized").alias("n1"), F.col("business_name_tokens").alias("t1"))
    theirs = pool.select(F.col("entity_id").alias("cand_id"), F.col("business_name_tokens").alias("t2"))
    alike = jaccard(F.col("t1"), F.coalesce("t2", F.array().cast("array<string>")))
    hard = Window.partitionBy("s1_id", "is_random").orderBy(F.desc("alike"), "rank")
    scored = numbered.join(mine, "s1_id").join(theirs, "cand_id", "left").withColumns({"is_random": F.col("turn") <= n_random, "alike": alike})
    chosen = scored.withColumn("place", F.row_number().over(hard)).where(F.col("is_random") | ((F.col("place") <= n_hard) & (F.col("n1") != "")))
    kind = F.when(F.col("is_random"), "random").otherwise("hard")
    return chosen.select("s1_id", "cand_id", "rank", "provenance", "label", kind.alias("kind"))


def training_pairs(candidates: DataFrame, truth: DataFrame | Truth, s1: DataFrame, pool: DataFrame, n_random: int = 3, n_hard: int = 2) -> DataFrame:
    """Positives and sampled negatives."""
    columns = ["s1_id", "cand_id", "provenance", "label"]
    return positives(candidates, truth).select(*columns).unionByName(sample_negatives(candidates, truth, s1, pool, n_random, n_hard).select(*columns))


def validation_pairs(candidates: DataFrame, truth: DataFrame | Truth) -> DataFrame:
    """Positives and all negatives."""
    return labelled(candidates, truth).select("s1_id", "cand_id", "provenance", "label")


def subset_violations(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that are no candidates; there should be none."""
    return matches.join(candidates, ["s1_id", "cand_id"], "left_anti")
