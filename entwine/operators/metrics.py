"""Thresholds and quality measures, of entities and of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entwine.functions.session import stored
from entwine.operators.labels import Truth, marked, sizes

THRESHOLDS = 101


def apply_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """(s1_id, cand_id) with match_probability of threshold or more."""
    return scored.where(F.col("match_probability") >= F.lit(threshold)).select("s1_id", "cand_id").distinct()


def match_sets(scored: DataFrame, threshold: float) -> DataFrame:
    """(s1_id, matches) for every s1_id of scored, in order; empty arrays included."""
    hit = F.when(F.col("match_probability") >= F.lit(threshold), F.col("cand_id"))
    return scored.groupBy("s1_id").agg(F.array_sort(F.collect_set(hit)).alias("matches"))


def _f05(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f0_5 to rows with tp, predicted, actual; both empty is right, one empty is wrong."""
    both, one = (F.col("predicted") == 0) & (F.col("actual") == 0), (F.col("predicted") == 0) | (F.col("actual") == 0)
    value = lambda c: F.when(both, 1.0).when(one, 0.0).otherwise(c)
    p, r = F.col("tp") / F.col("predicted"), F.col("tp") / F.col("actual")
    safe_p = F.when(F.col("predicted") > 0, p).otherwise(0.0)
    safe_r = F.when(F.col("actual") > 0, r).otherwise(0.0)
    return counts.withColumns({"precision": value(safe_p), "recall": value(safe_r), "f0_5": value(_f05(safe_p, safe_r))})


def entity_metrics(predicted: DataFrame, truth: DataFrame | Truth, entities: DataFrame) -> DataFrame:
    """s1_id, tp, predicted, actual, precision, recall, f0_5 of every entity (s1_id); one without predictions has none."""
    counts = marked(predicted.select("s1_id", "cand_id").distinct(), truth).groupBy("s1_id").agg(F.count("is_match").alias("tp"), F.count(F.lit(1)).alias("predicted"))
    every = entities.select("s1_id").distinct().join(counts, "s1_id", "left").join(sizes(truth), "s1_id", "left").na.fill(0, ["tp", "predicted", "actual"])
    return entity_scores(every)


def macro_metrics(predicted: DataFrame, truth: DataFrame | Truth, entities: DataFrame) -> DataFrame:
    """One row: the means over all entities; zeros if there are none."""
    each = entity_metrics(predicted, truth, entities)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return each.agg(mean("precision"), mean("recall"), mean("f0_5"), F.count(F.lit(1)).alias("entities"))


def search_thresholds(scored: DataFrame, truth: DataFrame | Truth, truth_entities: DataFrame, include_uncandidated: bool = False) -> DataFrame:
    """A row for each of the thresholds 0, 0.01, ... 1: macro measures and match counts.

    Entities are those of the truth that have scored pairs, or all of the truth. Each pair becomes one step
    (the last threshold it passes), so a pair is read once, not 101 times; the matches
    of an entity at a threshold are a sum of its steps from there on.
    """
    spark = scored.sparkSession
    grid = spark.range(THRESHOLDS).select(F.col("id").cast("int").alias("step"), (F.col("id") * F.lit(0.01)).alias("threshold"))
    p = F.col("match_probability")
    # the last i with i * 0.01 <= p, mending what rounding does to p / 0.01
    guess = F.least(F.floor(p * 100) + 1, F.lit(THRESHOLDS - 1))
    last = F.when(guess * F.lit(0.01) <= p, guess).when((guess - 1) * F.lit(0.01) <= p, guess - 1).otherwise(guess - 2)
    steps = scored.select("s1_id", "cand_id", last.cast("int").alias("last")).where("last >= 0").groupBy("s1_id", "cand_id").agg(F.max("last").alias("last"))
    steps = marked(steps, truth).groupBy("s1_id", "last").agg(F.count(F.lit(1)).alias("n"), F.count("is_match").alias("h"))
    seen = scored.select("s1_id").distinct()
    judged = truth_entities.select("s1_id").distinct()
    judged = judged if include_uncandidated else judged.join(seen, "s1_id", "left_semi")
    every = seen.withColumn("is_seen", F.lit(1)).join(judged.withColumn("is_judged", F.lit(1)), "s1_id", "full").join(sizes(truth), "s1_id", "left")
    # for each entity a row of 101 counts by step; from the top down they are running sums
    table = steps.groupBy("s1_id").agg(F.map_from_entries(F.collect_list(F.struct("last", F.struct("n", "h")))).alias("by_step"))
    at = F.explode(F.sequence(F.lit(0), F.lit(THRESHOLDS - 1))).alias("step")
    rows = every.join(table, "s1_id", "left").select("s1_id", "is_seen", "is_judged", F.coalesce("actual", F.lit(0)).alias("actual"), "by_step", at)
    above = F.filter(F.map_entries(F.coalesce("by_step", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<struct<n:bigint,h:bigint>>")))), lambda e: e["key"] >= F.col("step"))
    total = lambda field: F.aggregate(above, F.lit(0).cast("long"), lambda s, e: s + e["value"][field])
    counted = entity_scores(rows.withColumns({"tp": total("h"), "predicted": total("n")}))
    mine = F.col("is_judged").isNotNull()
    mean = lambda c: F.coalesce(F.avg(F.when(mine, F.col(c))), F.lit(0.0))
    seen_only = F.col("is_seen").isNotNull()
    out = counted.groupBy("step").agg(
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
        mean("f0_5").alias("f0_5"),
        F.sum(F.when(seen_only, F.col("predicted")).otherwise(0)).alias("predicted_match_count"),
        F.count_if(seen_only & (F.col("predicted") > 0)).alias("matched_source1_count"),
        (F.sum(F.when(seen_only, F.col("predicted")).otherwise(0)) / F.greatest(F.count_if(seen_only), F.lit(1))).alias("average_matches_per_source1"),
    )
    joined = grid.join(out, "step", "left").na.fill(0)
    return joined.select(F.round("threshold", 2).alias("threshold"), *[c for c in out.columns if c != "step"])


def best_threshold(grid: DataFrame) -> float:
    """The least threshold of the greatest f0_5, equal to 12 places."""
    return float(grid.orderBy(F.desc(F.round("f0_5", 12)), "threshold").select("threshold").first()[0])


def pair_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: precision, recall, f1, f0_5 of pairs (label, match_probability) at a threshold; 0 where undefined."""
    hit = F.col("match_probability") >= F.lit(threshold)
    counts = scored.agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit).alias("predicted"), F.count_if(F.col("label") == 1).alias("actual"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).otherwise(0.0)
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return counts.select("tp", "predicted", "actual", p.alias("precision"), r.alias("recall"), f1.alias("f1"), _f05(p, r).alias("f0_5"))


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """One row: roc_auc, pr_auc (average precision, in steps) and log_loss of (label, match_probability); null where a class is missing.

    Pairs of one score are one step. The distinct scores are summed in ranges, each on its own,
    and continued from the sums of the ranges above it.
    """
    steps = scored.groupBy("match_probability").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    steps = stored(steps.repartitionByRange(F.desc("match_probability")).withColumn("part", F.spark_partition_id()), "score-steps")
    above, all_parts = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = steps.groupBy(F.col("part").alias("part_")).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    parts = parts.select(
        "part_", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("p", "n")], F.sum("p").over(all_parts).alias("all_pos"), F.sum("n").over(all_parts).alias("all_neg")
    )
    down = Window.partitionBy("part").orderBy(F.desc("match_probability")).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.join(F.broadcast(parts), F.col("part") == F.col("part_"))  # a row for each shuffle partition
    run = run.withColumns({"tp": F.col("p_above") + F.sum("pos").over(down), "fp": F.col("n_above") + F.sum("neg").over(down)})
    area = F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.max("all_pos") * F.max("all_neg"))
    precision = F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * F.col("tp") / (F.col("tp") + F.col("fp")))
    p = F.least(F.greatest("match_probability", F.lit(2.220446049250313e-16)), F.lit(1 - 2.220446049250313e-16))
    loss = F.try_divide(F.sum(-(F.col("pos") * F.log(p) + F.col("neg") * F.log(1 - p))), F.sum(F.col("pos") + F.col("neg")))
    return run.agg(area.alias("roc_auc"), precision.alias("pr_auc"), loss.alias("log_loss"))


def blocking_recall(candidates: DataFrame, truth: DataFrame | Truth) -> DataFrame:
    """One row: recall of truth pairs overall, and of ids beginning S2- and S3-."""
    prefix = {"s2": F.col("cand_id").startswith("S2-"), "s3": F.col("cand_id").startswith("S3-")}
    hits = marked(candidates.select("s1_id", "cand_id").distinct(), truth).where("is_match = 1")
    hits = hits.agg(F.count(F.lit(1)).alias("hit_actual"), *[F.count_if(ok).alias(f"hit_{k}") for k, ok in prefix.items()])
    wanted = sizes(truth, **prefix).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("actual", *prefix)])
    share = lambda c: F.col(f"hit_{c}") / F.greatest(F.col(c), F.lit(1))
    return wanted.crossJoin(hits).select(share("actual").alias("recall"), share("s2").alias("recall_s2"), share("s3").alias("recall_s3"), F.col("actual").alias("true_pairs"))


def strategy_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """For each strategy of (s1_id, cand_id, strategy): its pairs, how many are true, and its recall."""
    pairs = F.count(F.lit(1)).alias("pairs")
    hits = found.join(truth.withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left").groupBy("strategy").agg(pairs, F.count("hit").alias("hits"))
    return hits.select("strategy", "pairs", "hits", (F.col("hits") / F.lit(float(max(1, truth.count())))).alias("recall"))


def candidate_stats(candidates: DataFrame, s1: DataFrame, pool_size: int) -> DataFrame:
    """One row: candidates per entity of s1 (zeros too) and the reduction against all pairs."""
    counts = candidates.groupBy("s1_id").count()
    each = s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    reduction = 1 - F.try_divide(F.sum("n"), F.count(F.lit(1)) * F.lit(float(pool_size)))
    return each.agg(F.sum("n").alias("pairs"), F.avg("n").alias("avg_candidates"), F.median("n").alias("median_candidates"), F.max("n").alias("max_candidates"), reduction.alias("reduction_ratio"))


def match_stats(matches: DataFrame, s1: DataFrame) -> DataFrame:
    """One row: matches in all, entities with one, and the mean over all entities."""
    counts = matches.groupBy("s1_id").count()
    each = s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    return each.agg(F.sum("n").alias("total_matches"), F.count_if(F.col("n") > 0).alias("matched_source1"), F.avg("n").alias("avg_matches"))


def errors(scored: DataFrame, threshold: float, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(false positives by falling, false negatives by rising probability), of (label, match_probability)."""
    hit = F.col("match_probability") >= F.lit(threshold)
    wrong = scored.where(hit & (F.col("label") == 0)).orderBy(F.desc("match_probability"), "s1_id", "cand_id")
    lost = scored.where(~hit & (F.col("label") == 1)).orderBy("match_probability", "s1_id", "cand_id")
    return (wrong.limit(limit), lost.limit(limit)) if limit else (wrong, lost)


def candidate_recall(scored: DataFrame, truth: DataFrame | Truth) -> DataFrame:
    """One row: the share of truth pairs, of entities with scored pairs, that are scored; 1 if there are none."""
    hits = marked(scored.select("s1_id", "cand_id").distinct(), truth).agg(F.count("is_match").alias("hits"))
    n = F.col("true_pairs")
    wanted = sizes(truth).join(scored.select("s1_id"), "s1_id", "left_semi").agg(F.coalesce(F.sum("actual"), F.lit(0)).alias("true_pairs"))
    return wanted.crossJoin(hits).select(F.when(n == 0, 1.0).otherwise(F.col("hits") / n).alias("candidate_recall"), n)
