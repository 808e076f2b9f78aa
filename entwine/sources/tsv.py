"""TSV sources and sinks. Every field is text; a missing field is the empty string."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from entwine.functions.text import split_list
from entwine.schema import SOURCE, TEST_FILES, TRAIN_FILES, TRUTH

SCORED = StructType(
    [
        StructField("source1_entity_id", StringType()),
        StructField("candidate_entity_id", StringType()),
        StructField("candidate_source", StringType()),
        StructField("label", IntegerType()),
        StructField("match_probability", DoubleType()),
    ]
)

#: The columns of the experiment registry.
EXPERIMENT = StructType(
    [
        StructField("experiment_id", StringType()),
        StructField("experiment_name", StringType()),
        StructField("hypothesis", StringType()),
        StructField("component", StringType()),
        StructField("change", StringType()),
        StructField("baseline_f0_5", DoubleType()),
        StructField("experiment_f0_5", DoubleType()),
        StructField("delta_f0_5", DoubleType()),
        StructField("precision", DoubleType()),
        StructField("recall", DoubleType()),
        StructField("candidate_count", LongType()),
        StructField("blocking_recall", DoubleType()),
        StructField("accepted", BooleanType()),
    ]
)


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at path; ValueError unless its header is schema's columns in order. Rows with too many fields fail the read, short ones are filled.

    A field with a line break leaves a quote open on its line: only files that have such a line are read in one piece.
    """
    header = spark.read.text(path).limit(1).collect()
    columns = header[0][0].lstrip("﻿").rstrip("\r").split("\t") if header else []
    if columns != schema.fieldNames():
        raise ValueError(f"{path}: columns {columns}, expected {schema.fieldNames()}")
    wide = StructType([*schema.fields, StructField("__more", StringType())])
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    breaks = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    options = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": breaks, "header": True, "enforceSchema": True, "nullValue": "\u0000"}
    rows = spark.read.schema(wide).options(**options).csv(path)
    fits = F.when(F.col("__more").isNotNull(), F.raise_error(F.lit(f"{path}: a row has too many fields"))).otherwise(F.lit(True))
    return rows.where(fits).drop("__more").na.fill("")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, SOURCE)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TRUTH)


def read_train(spark: SparkSession, folder: str, files: dict[str, str] = TRAIN_FILES) -> dict[str, DataFrame]:
    return {k: (read_ground_truth if k == "ground_truth" else read_source)(spark, f"{folder}/{f}") for k, f in files.items()}


def read_test(spark: SparkSession, folder: str, files: dict[str, str] = TEST_FILES) -> dict[str, DataFrame]:
    return {k: read_source(spark, f"{folder}/{f}") for k, f in files.items()}


def read_candidates(spark: SparkSession, path: str, s1: DataFrame, separator: str = ",") -> DataFrame:
    """(s1_id, cand_id) of a list table; empty parts and ids that s1 lacks are left out."""
    schema = StructType([StructField("source1_entity_id", StringType()), StructField("candidate_entity_ids", StringType())])
    rows = read_tsv(spark, path, schema)
    pairs = rows.select(F.col("source1_entity_id").alias("s1_id"), F.explode(split_list(F.col("candidate_entity_ids"), separator)).alias("cand_id"))
    return pairs.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORED).options(sep="\t", header=True).csv(path)


def match_lists(pairs: DataFrame, s1: DataFrame, separator: str = ";") -> DataFrame:
    """(source1_entity_id, candidate_entity_ids) for every id of s1: its candidates in order of their names, empty if none."""
    listed = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), separator).alias("listed"))
    ids = s1.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    joined = ids.join(listed, F.col("source1_entity_id") == F.col("s1_id"), "left")
    return joined.select("source1_entity_id", F.coalesce("listed", F.lit("")).alias("candidate_entity_ids"))


def ranked_lists(candidates: DataFrame, s1: DataFrame, separator: str = ",") -> DataFrame:
    """As match_lists, with candidates in order of rank."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))), lambda x: x["cand_id"])
    listed = candidates.groupBy("s1_id").agg(F.array_join(in_order, separator).alias("listed"))
    joined = s1.select(F.col("entity_id").alias("source1_entity_id")).distinct().join(listed, F.col("source1_entity_id") == F.col("s1_id"), "left")
    return joined.select("source1_entity_id", F.coalesce("listed", F.lit("")).alias("candidate_entity_ids"))


def write_table(df: DataFrame, path: str, separator: str = "\t", *order: str, single: bool = False) -> None:
    """Headed files in a folder, whose rows are in the given order from file to file; empty strings stay empty. single: one file, which one task writes."""
    out = df.orderBy(*order) if order else df
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").options(sep=separator, header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_match_lists(pairs: DataFrame, s1: DataFrame, path: str, single: bool = False) -> None:
    write_table(match_lists(pairs, s1), path, "\t", "source1_entity_id", single=single)


write_candidate_pairs = write_matching_results = write_match_lists


def write_ranked_lists(candidates: DataFrame, s1: DataFrame, path: str) -> None:
    write_table(ranked_lists(candidates, s1), path)


def write_scored(scored: DataFrame, path: str) -> None:
    write_table(scored.select(*SCORED.fieldNames()), path, "\t", "source1_entity_id", "candidate_entity_id")


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """Feature importance, threshold grid, experiment registry: small tables, one file each."""
    write_table(df, path, ",", *order, single=True)


def write_experiments(spark: SparkSession, experiments: list[dict[str, Any]], path: str) -> None:
    """The experiment registry: a row for each, by id; what is missing stays empty."""
    rows = [tuple(e.get(c) for c in EXPERIMENT.fieldNames()) for e in experiments]
    write_csv(spark.createDataFrame(rows, EXPERIMENT), path, "experiment_id")


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERIMENT).options(header=True).csv(path)


def _file(path: str) -> tuple[Any, Any]:
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(text: str, path: str) -> None:
    """One small file, on any file system that Spark knows."""
    system, at = _file(path)
    out = system.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(path: str) -> str:
    system, at = _file(path)
    if not system.exists(at):
        raise FileNotFoundError(path)
    return SparkSession.active().read.text(path, wholetext=True).first()[0]


def write_json(value: Any, path: str) -> None:
    write_text(json.dumps(value, indent=2, sort_keys=True), path)


def read_json(path: str) -> Any:
    return json.loads(read_text(path))


def sha256_of_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))
