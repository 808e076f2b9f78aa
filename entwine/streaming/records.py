"""Records that arrive as files: the same normalisation and matching, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from entwine.functions.text import preprocess
from entwine.operators.model import Model
from entwine.plans.pipeline import Prepared, infer
from entwine.schema import SOURCE


def normalised_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of normalised records from the TSV files of folder."""
    rows = spark.readStream.schema(SOURCE).options(sep="\t", header=True, quote='"', escape='"').csv(folder)
    return preprocess(rows.na.fill(""))


def match_stream(records: DataFrame, pool: Prepared, model: Model, threshold: float, schema: list[str], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Match each batch of s1 records against the prepared s2 and s3; write gets (matches, batch number)."""

    def run(batch: DataFrame, number: int) -> None:
        _, matches = infer(Prepared(batch, pool.s2, pool.s3), model, threshold, schema)
        write(matches, number)

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
