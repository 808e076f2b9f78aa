"""Quality classifier: Naive Bayes support vectors.

Features are indicators of byte n-grams (1 and 2 bytes as they are, 3 and 4 bytes hashed to
2**18 places each) and of repeated words: that a word equals the one 1, 2 or 3 before it,
at least once, twice, 4 or 8 times. r, the log-count ratio of a feature between the classes, comes from all
rows learnt from, counted in Spark: (1 + rows of label 1 that have it) against the same of label 0,
each over its sum. A text's vector has r at its features, scaled to length 1. A linear
hinge-loss model is fitted to these vectors by dual coordinate descent, on a bounded
sample of the distinct rows (doc_id, text) learnt from: the SAMPLE_ROWS with the least hash, cut where their features
pass SAMPLE_FEATURES. Margins become scores by a logistic curve fitted to margins that
two half-sample models gave to the other half.

Only texts enter a prediction.

Defined results. Null text is the empty text; it has no features and gets the curve at the model's bias.
Rows without a label, or whose label is neither 0 nor 1, are not learnt from; of several
labels of one id the mean is taken, 0.5 and more being 1. With no labelled row every
score is 0.5; with one class only, 1 or 0. An empty table gives an empty result; repeated
rows get a row each, and count as often as they are there, but are drawn once; very long texts are read whole. Extra columns are not read and can
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from entwine.functions.session import bounded, release, ship, stored
from entwine.llm import kernels as k
from entwine.llm.language_id import remainder

PLACES = 18
REPEATS = (1, 2, 4, 8)
BACK = (1, 2, 3)
STARTS = np.cumsum([0, 256, 1 << 16, 1 << PLACES, 1 << PLACES])
FEATURES = int(STARTS[-1]) + len(BACK) * len(REPEATS)
SAMPLE_ROWS, SAMPLE_FEATURES = 8192, 16_000_000
ACCEPT = 0.7
COST = 1.0
#: The descent ends when no dual variable can improve by more than TOLERANCE, or after so many epochs or steps, whichever are more.
TOLERANCE, EPOCHS, STEPS = 1e-3, 10, 80_000


class Reader:
    """Distinct features of one text at a time, in time linear in its length."""

    def __init__(self) -> None:
        self.seen = np.zeros(FEATURES, np.int64)

    def features(self, data: np.ndarray) -> np.ndarray:
        b = data.astype(np.uint32)
        pairs = (b[:-1] << np.uint32(8)) | b[1:]
        triples = (pairs[:-1] << np.uint32(8)) | b[2:]
        fours = (triples[:-1] << np.uint32(8)) | b[3:]
        hashed = [x * np.uint32(odd) >> np.uint32(32 - PLACES) for x, odd in ((triples, 0x9E3779B1), (fours, 0x85EBCA77))]
        parts = [x.astype(np.int64) + start for x, start in zip((b, pairs, *hashed), STARTS, strict=False)]
        words = k.Words(data, np.array([0, len(data)]), k.WHITE)
        of = k.span_hashes(data, words.start, words.end)
        times = [int((of[n:] == of[:-n]).sum()) for n in BACK]
        parts.append(np.array([int(STARTS[-1]) + i * len(REPEATS) + j for i, t in enumerate(times) for j, least in enumerate(REPEATS) if t >= least], np.int64))
        f = np.concatenate(parts)
        at = np.arange(len(f))
        self.seen[f] = at
        return f[self.seen[f] == at]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, j, data, offsets in k.pieces(batch.column(column), False):
        for d in range(j - i):
            yield i + d, data[offsets[d] : offsets[d + 1]]


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, counts = Reader(), np.zeros((2, FEATURES), np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for i, data in _texts(batch, 0):
            counts[label[i], reader.features(data)] += 1
    f = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(counts[0][f]), pa.array(counts[1][f])], ["f", "n0", "n1"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        for i, data in _texts(batch, 0):
            f = reader.features(data).astype(np.int32)
            arrays = [batch.column(1).slice(i, 1), batch.column(2).slice(i, 1), pa.array([f], pa.list_(pa.int32())), pa.array([len(f)])]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "turn", "features", "n"])


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = weights . r-vector + bias."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def __post_init__(self) -> None:
        self.gain, self.square = (self.ratio * self.weights).astype(np.float64), (self.ratio**2).astype(np.float64)

    def score(self, features: np.ndarray) -> float:
        length = float(np.sqrt(self.square[features].sum()))
        margin = float(self.gain[features].sum()) / length + self.bias if length > 0 else self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def descend(rows: list[np.ndarray], sign: np.ndarray, ratio: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|**2 / 2 + COST * sum of hinge losses, by dual coordinate descent."""
    weights, bias = np.zeros(FEATURES), 0.0
    # vectors are made when they are needed: what is held of a row is its features
    scale = [1 / max(1e-12, float(np.sqrt((ratio[f] ** 2).sum()))) for f in rows]
    norm = [float(((ratio[f] * s) ** 2).sum()) + 1.0 for f, s in zip(rows, scale, strict=True)]
    dual, draw = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(max(EPOCHS, STEPS // max(1, len(rows)))):
        most = 0.0
        for i in draw.permutation(len(rows)):
            value = ratio[rows[i]] * scale[i]
            slope = sign[i] * (float(weights[rows[i]] @ value) + bias) - 1
            new = min(max(dual[i] - slope / norm[i], 0.0), COST)
            if new != dual[i]:
                most = max(most, abs(new - dual[i]))
                step = (new - dual[i]) * sign[i]
                weights[rows[i]] += step * value
                bias += step
                dual[i] = new
        if most <= TOLERANCE:
            break
    return weights, bias


def curve(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least log loss against slightly softened labels, by Newton steps."""
    ones, zeros = label.sum(), (1 - label).sum()
    goal = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones(len(margins))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (goal - p))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def log_count_ratio(both: np.ndarray) -> np.ndarray:
    """Of the rows of either class that have each feature, one row for each class."""
    share = (both + 1) / (both + 1).sum(1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def learn(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model from the labelled rows of docs; a number if every text is to have that score."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = stored(known, "quality-labels")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labelled = rows.join(bounded(known), F.col("doc_id") == F.col("id")).select("text", "label")
    counts = labelled.mapInArrow(_class_counts, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    both = np.zeros((2, FEATURES))
    both[:, counts["f"].to_numpy(int)] = counts[["n0", "n1"]].to_numpy().T
    if not both.any():
        return 0.5
    if not both.any(1).all():
        return float(both[1].any())
    ratio = log_count_ratio(both)
    # rows that docs has, repeated ones once, in the order of a hash
    turn = F.xxhash64(F.lit("sample"), "doc_id", "text").alias("turn")
    there = rows.join(bounded(known), F.col("doc_id") == F.col("id")).select(turn, F.col("doc_id").alias("id"), "label").distinct()
    chosen = stored(there.orderBy("turn", "id").limit(SAMPLE_ROWS), "quality-chosen")
    drawn = rows.withColumn("row_turn", turn).join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("row_turn") == F.col("turn")))
    drawn = drawn.groupBy("turn", "id").agg(F.first("text").alias("text"), F.first("label").alias("label")).select("text", "label", "turn")
    vectors = stored(drawn.mapInArrow(_vectors, "label int, turn long, features array<int>, n long"), "quality-vectors")
    sizes = vectors.select("turn", "n").toPandas().sort_values("turn")
    fit = sizes["turn"][sizes["n"].cumsum() <= SAMPLE_FEATURES]
    last = int(fit.max()) if len(fit) else int(sizes["turn"].min())
    release(spark)
    sample = vectors.where(F.col("turn") <= last).select("label", "turn", "features").toArrow()
    order = np.argsort(sample["turn"].to_numpy(), kind="stable")
    label = sample["label"].to_numpy()[order]
    # views of the collected batches, without a copy
    ends = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in sample["features"].chunks]
    found = [flat[at[i] : at[i + 1]] for flat, at in ends for i in range(len(at) - 1)]
    sets = [found[i] for i in order]
    sign = np.where(label == 1, 1.0, -1.0)
    margins = np.zeros(len(sets))
    halves = np.arange(len(sets)) % 2
    for h in (0, 1):
        fit, other = np.flatnonzero(halves == h), np.flatnonzero(halves != h)
        half = Model(ratio, *descend([sets[i] for i in fit], sign[fit], ratio), 1.0, 0.0)
        for i in other:
            length = float(np.sqrt(half.square[sets[i]].sum()))
            margins[i] = (float(half.gain[sets[i]].sum()) / length if length > 0 else 0.0) + half.bias
    return Model(ratio, *descend(sets, sign, ratio), *curve(margins, label))


def predict(docs: DataFrame, model: Model | float, *keep: Column | str, into: str = "score") -> DataFrame:
    """The columns keep of docs with the score of the column text, under the name into."""
    spark = docs.sparkSession
    ship(spark)
    kept = docs.select(*keep)
    names = kept.columns
    schema = StructType([*kept.schema.fields, StructField(into, DoubleType())])
    sent, text = spark.sparkContext.broadcast(model), k.unused(names, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = sent.value, Reader()
        for batch in batches:
            score = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                for i, data in _texts(batch, len(names)):
                    score[i] = model.score(reader.features(data))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(names))], pa.array(score)], [*names, into])

    return docs.select(*keep, F.col("text").alias(text)).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); learns where held_out is false."""
    model = learn(docs.where(remainder(4) != 2), labels)
    scored = predict(docs, model, "doc_id", (remainder(4) == 2).alias("held_out"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
