"""The match classifier: gradient-boosted trees over the feature vector."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from entwine.functions.session import ship
from entwine.operators.boosting import Schedule, Trees, fit
from entwine.operators.features import META, SCHEMA
from entwine.operators.labels import hash_order

#: Columns that tell the answer or the pair; none may be a feature.
FORBIDDEN = {"label", "is_match", "s1_id", "cand_id", "match_probability"}
#: Labelled rows that a fit takes at most, of training and of validation each: the first in hash order.
FIT_ROWS = 200_000
_NODES = "tree int, node int, feature string, threshold double, left int, right int, value double, gain double"


class Model:
    """Trees over features by name."""

    def __init__(self, schema: list[str], trees: Trees):
        self.schema, self.trees = schema, trees


def check_features(train: DataFrame, validation: DataFrame, schema: list[str] | None = None) -> list[str]:
    """The feature columns of train; ValueError if one is forbidden or validation has others."""
    own = schema or [c for c in train.columns if c not in META]
    if set(own) & FORBIDDEN:
        raise ValueError(f"features that tell the answer: {sorted(set(own) & FORBIDDEN)}")
    if [c for c in train.columns if c in own] != [c for c in validation.columns if c in own] or not set(own) <= set(validation.columns):
        raise ValueError("training and validation have different features")
    return own


def class_balance(train: DataFrame) -> DataFrame:
    """One row: positives, negatives, share of positives, and the weight of a positive."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return train.agg(
        pos.alias("positives"), neg.alias("negatives"), F.avg("label").alias("positive_ratio"), (neg / F.greatest(pos, F.lit(1))).alias("scale_pos_weight")
    )


def _matrix(rows: DataFrame, schema: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the first FIT_ROWS rows in hash order."""
    turn = hash_order("s1_id", "cand_id")
    kept = rows.select(*[F.col(c).cast("double").alias(c) for c in schema], F.col("label").cast("int").alias("label"), "s1_id", "cand_id", turn.alias("turn"))
    table = kept.orderBy("turn", "s1_id", "cand_id").limit(FIT_ROWS).toArrow()
    return np.stack([table[c].to_numpy() for c in schema], 1), table["label"].to_numpy()


def train(rows: DataFrame, validation: DataFrame | None = None, schema: list[str] = SCHEMA, rounds: int = Schedule.rounds, seed: int = Schedule.seed) -> Model:
    """Fit on rows (features, label, s1_id, cand_id); positives weigh negatives / positives; stops early by the validation rows, if given."""
    x, y = _matrix(rows, schema)
    more = _matrix(validation, schema) if validation is not None else (None, None)
    return Model(list(schema), fit(x, y, *more, plan=replace(Schedule(), rounds=rounds, seed=seed)))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows' pair columns with match_probability."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model.trees)

    @F.pandas_udf(DoubleType())
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(sent.value.probabilities(np.stack(vectors.to_numpy())) if len(vectors) else np.zeros(0))

    keep = [c for c in META if c in rows.columns]
    vector = F.array(*[F.col(c).cast("double") for c in model.schema])
    return rows.select(*keep, probability(vector).alias("match_probability"))


def importance(model: Model) -> list[tuple[str, float, int]]:
    """(feature, gain, splits) by falling gain, then name."""
    gain, splits = np.zeros(len(model.schema)), np.zeros(len(model.schema), int)
    for f, g in zip(model.trees.feature, model.trees.gain, strict=True):
        np.add.at(gain, f[f >= 0], g[f >= 0])
        np.add.at(splits, f[f >= 0], 1)
    return sorted(((n, float(gain[i]), int(splits[i])) for i, n in enumerate(model.schema)), key=lambda x: (-x[1], x[0]))


def nodes(spark: SparkSession, model: Model) -> DataFrame:
    """A row for each node of each tree; tree -1 has the value that all begin with, and tree -2 the features in order."""
    rows = [(-1, 0, None, None, None, None, model.trees.base, None)]
    rows += [(-2, i, name, None, None, None, None, None) for i, name in enumerate(model.schema)]
    t = model.trees
    for i, columns in enumerate(zip(t.feature, t.threshold, t.left, t.right, t.value, t.gain, strict=True)):
        for j, (f, threshold, left, right, value, gain) in enumerate(zip(*columns, strict=True)):
            rows.append((i, j, model.schema[f] if f >= 0 else None, float(threshold), int(left), int(right), float(value), float(gain)))
    return spark.createDataFrame(rows, _NODES)


def save(model: Model, path: str) -> None:
    nodes(SparkSession.active(), model).coalesce(1).write.mode("overwrite").parquet(path)


def load(path: str) -> Model:
    rows = SparkSession.active().read.schema(_NODES).parquet(path).toPandas().sort_values(["tree", "node"])
    schema = rows[rows["tree"] == -2]["feature"].tolist()
    place = {name: i for i, name in enumerate(schema)}
    out = Trees(float(rows[rows["tree"] == -1]["value"].iloc[0]))
    for _, tree in rows[rows["tree"] >= 0].groupby("tree"):
        out.feature.append(np.array([place.get(f, -1) for f in tree["feature"]], np.int64))
        out.threshold.append(tree["threshold"].to_numpy(float))
        out.left.append(tree["left"].to_numpy(np.int64))
        out.right.append(tree["right"].to_numpy(np.int64))
        out.value.append(tree["value"].to_numpy(float))
        out.gain.append(tree["gain"].to_numpy(float))
    return Model(schema, out)
