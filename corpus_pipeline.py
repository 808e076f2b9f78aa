"""Corpus pipeline: language ID, quality, near-duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
All but the last return the columns of documents. The models are learnt from the stage's
own input and from the labels of sf_dir.

Defined results. A text without a letter is rejected by language ID, as is one of whose trigrams the language
found has too few (coverage under LEAST_COVERAGE, which doesn't depend on the number of languages). Without labels of both classes the quality stage keeps all. Nulls
and repeated rows are as in each operator. An empty input gives an empty result. Extra columns come along
under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.functions.session import stored
from entwine.llm import decontaminate, language_id, mixing, neardup, quality
from entwine.llm.kernels import unused

#: Share of a text's trigrams that the predicted language must have.
LEAST_COVERAGE = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known."""
    filters = language_id.learn(docs.where(language_id.remainder(3) != 1))
    lang, score, coverage = (unused(docs.columns, x) for x in ("__lang", "__score", "__coverage"))
    found = language_id.predict(docs, filters, *docs.columns, into=(lang, score, coverage))
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(coverage) >= LEAST_COVERAGE)).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts."""
    model = quality.learn(docs.where(language_id.remainder(4) != 2), _table(spark, sf_dir, "labels"))
    if isinstance(model, float):  # nothing to tell classes apart by
        return docs
    score = unused(docs.columns, "__score")
    return quality.predict(docs, model, *docs.columns, into=score).where(F.col(score) >= quality.ACCEPT).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return neardup.deduplicate(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place in the mix."""
    return mixing.mix(docs)


STAGES = [("language_id", languages), ("quality", good), ("neardup", distinct), ("decontaminate", unleaked), ("mixing", mixed)]

#: Language ID, the classifier and the signatures have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
