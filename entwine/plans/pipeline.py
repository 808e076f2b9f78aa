"""End-to-end drivers: training, threshold selection, inference."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.functions.session import settled, stored
from entwine.functions.text import preprocess
from entwine.operators import blocking, features, labels, metrics, model
from entwine.operators.boosting import Schedule
from entwine.schema import STRATEGIES
from entwine.sources import tsv


@dataclass
class Prepared:
    """Normalised sources, each written once: blocking, features and reports all read them."""

    s1: DataFrame
    s2: DataFrame
    s3: DataFrame

    @property
    def pool(self) -> DataFrame:
        return blocking.candidate_pool(self.s2, self.s3)


def prepare(s1: DataFrame, s2: DataFrame, s3: DataFrame) -> Prepared:
    return Prepared(*[stored(preprocess(s), f"prepared-{i}") for i, s in enumerate((s1, s2, s3), 1)])


@dataclass
class Trained:
    model: "model.Model"
    scored: DataFrame
    train: DataFrame
    candidates: DataFrame
    metadata: dict[str, Any]


def train(data: Prepared, truth_table: DataFrame, strategies: list[str] = STRATEGIES, rounds: int = Schedule.rounds, n_random: int = 3, n_hard: int = 2) -> Trained:
    """Split, block once for both parts, label, sample, make features, fit, score validation."""
    split = stored(labels.entity_split(data.s1), "split")
    truth = labels.factored(truth_table)
    found = settled(lambda: blocking.candidates(data.s1, data.s2, data.s3, strategies), "candidates")
    part = {v: found.join(split.where(F.col("is_validation") == v).select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi") for v in (False, True)}
    rows = {
        False: labels.training_pairs(part[False], truth, data.s1, data.pool, n_random, n_hard),
        True: labels.validation_pairs(part[True], truth),
    }
    made = {v: stored(features.features(p, data.s1, data.s2, data.s3), f"features-{v}") for v, p in rows.items()}
    schema = model.check_features(made[False], made[True])
    fitted = model.train(made[False], made[True], schema, rounds)
    scored = stored(model.score(made[True], fitted), "scored")
    ranking = metrics.ranking_metrics(scored).first().asDict()
    at_half = metrics.pair_metrics(scored, 0.5).first().asDict()
    diagnostic = {f"t={t}": metrics.pair_metrics(scored, t).first()["f0_5"] for t in (0.1, 0.3, 0.5, 0.7, 0.9)}
    train_s1 = data.s1.join(split.where("NOT is_validation"), "entity_id", "left_semi")
    counts = labels.label_counts(part[False], truth, train_s1).first()
    metadata = {
        "features": schema,
        **ranking,
        "f0_5_diagnostic": diagnostic,
        "reference": at_half,
        "train_candidate_recall": counts["positive_pairs"] / max(counts["ground_truth_positives"], 1),
        "importance": model.importance(fitted),
    }
    return Trained(fitted, scored, made[False], found, metadata)


def choose_threshold(scored: DataFrame, truth_table: DataFrame) -> tuple[float, DataFrame]:
    grid = stored(metrics.search_thresholds(scored, labels.factored(truth_table), labels.truth_entities(truth_table)), "grid")
    return metrics.best_threshold(grid), grid


def infer(data: Prepared, fitted: model.Model, threshold: float, schema: list[str], strategies: list[str] = STRATEGIES) -> tuple[DataFrame, DataFrame]:
    """(candidates, matches): every match is a candidate."""
    found = settled(lambda: blocking.candidates(data.s1, data.s2, data.s3, strategies), "candidates")
    rows = features.test_features(found, data.s1, data.s2, data.s3, schema)
    scored = stored(model.score(rows, fitted), "scored")
    return found, metrics.apply_threshold(scored, threshold)


def audit(matches: DataFrame, candidates: DataFrame, lists: DataFrame, s1: DataFrame) -> None:
    """AssertionError unless matches are candidates and lists has each id of s1 once."""
    if not labels.subset_violations(matches, candidates).isEmpty():
        raise AssertionError("a match is no candidate")
    n, ids, wanted = lists.count(), lists.select("source1_entity_id").distinct().count(), s1.select("entity_id").distinct().count()
    if not n == ids == wanted:
        raise AssertionError(f"{n} rows, {ids} ids, {wanted} entities")


def read_threshold(folder: str) -> float:
    """final_threshold.json, else threshold.json."""
    for name in ("final_threshold.json", "threshold.json"):
        try:
            return float(tsv.read_json(f"{folder}/{name}")["best_threshold"])
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"{folder}: no threshold")


def run_training(spark, train_folder: str, model_folder: str, rounds: int = Schedule.rounds) -> Trained:
    """Read the training bundle, train, and write model, schema, metadata, scored pairs, grid, threshold and experiments."""
    from entwine.plans import reports  # it reads this module

    data = tsv.read_train(spark, train_folder)
    ready = prepare(data["source1"], data["source2"], data["source3"])
    out = train(ready, data["ground_truth"], rounds=rounds)
    best, grid = choose_threshold(out.scored, data["ground_truth"])
    model.save(out.model, f"{model_folder}/match_model")
    names = {"s1_id": "source1_entity_id", "cand_id": "candidate_entity_id"}
    tsv.write_scored(out.scored.withColumnsRenamed(names), f"{model_folder}/validation_predictions.tsv")
    tsv.write_csv(grid, f"{model_folder}/threshold_results.csv", "threshold")
    importance = spark.createDataFrame(out.metadata["importance"], "feature string, gain double, split int")
    tsv.write_csv(importance, f"{model_folder}/feature_importance.csv")
    tsv.write_json(out.metadata["features"], f"{model_folder}/feature_schema.json")
    tsv.write_json(out.metadata, f"{model_folder}/metadata.json")
    for name in ("threshold.json", "final_threshold.json"):
        tsv.write_json({"best_threshold": best}, f"{model_folder}/{name}")
    at_half, selected = (reports.system_measures(out.scored, data["ground_truth"], t) for t in (0.5, best))
    rows = [reports.experiment(0, "Threshold 0.5", at_half, at_half), reports.experiment(1, "Best threshold", at_half, selected, component="Threshold", change=f"{best:.2f}")]
    tsv.write_experiments(spark, rows, f"{model_folder}/experiments.csv")
    tsv.write_json({"experiment_id": "EXP001", "selected_threshold": best}, f"{model_folder}/final_config.json")
    return out


def run_inference(spark, test_folder: str, model_folder: str, output_folder: str, single: bool = False) -> DataFrame:
    """Read the test bundle and the model's folder, match, audit, and write both list tables (single: as one file each); the match lists."""
    data = tsv.read_test(spark, test_folder)
    ready = prepare(data["source1"], data["source2"], data["source3"])
    fitted = model.load(f"{model_folder}/match_model")
    schema = tsv.read_json(f"{model_folder}/feature_schema.json")
    found, matches = infer(ready, fitted, read_threshold(model_folder), schema)
    lists = stored(tsv.match_lists(matches, ready.s1), "lists")
    audit(matches, found, lists, ready.s1)
    tsv.write_candidate_pairs(found, ready.s1, f"{output_folder}/candidate_pairs.tsv", single)
    tsv.write_matching_results(matches, ready.s1, f"{output_folder}/matching_results.tsv", single)
    return lists
