"""Schemas and the constants of the linkage pipeline."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# Fixed values of the linkage task.
SOURCE_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]
NORMALISED = [
    "business_name_normalized",
    "business_name_core",
    "business_name_tokens",
    "business_address_normalized",
    "business_address_postal",
    "business_address_numeric_tokens",
    "business_address_tokens",
    "country_normalized",
]
TRAIN_FILES = {"source1": "train_source1.tsv", "source2": "train_source2.tsv", "source3": "train_source3.tsv", "ground_truth": "train_ground_truth.tsv"}
TEST_FILES = {"source1": "test_source1.tsv", "source2": "test_source2.tsv", "source3": "test_source3.tsv"}
MAX_BLOCK_FREQUENCY = 1000
MAX_CANDIDATES = 50
MIN_TOKEN_LENGTH = 3
TOP_K_NGRAM = 20
NGRAM_RANGE = (2, 4)
MIN_NGRAM_DOCUMENTS = 2
STRATEGY_WEIGHTS = {"exact_name": 100, "postal": 50, "country_name_token": 30, "address_token": 20, "char_ngram": 10, "numeric_address": 5}
STRATEGIES = ["exact_name", "country_name_token", "postal", "address_token", "numeric_address", "char_ngram"]
LEGAL_SUFFIXES = ["inc", "llc", "corp", "corporation", "ltd", "limited", "pvt", "private", "co", "company"]
LEGAL_TERMS = ["inc", "llc", "corp", "ltd", "pvt", "limited", "co", "company"]
FEATURES = [
    "name_missing_s1",
    "name_missing_candidate",
    "name_exact",
    "name_core_exact",
    "name_levenshtein",
    "name_jaro_winkler",
    "name_token_intersection_count",
    "name_token_union_count",
    "name_token_jaccard",
    "name_token_overlap",
    "name_length_difference",
    "name_length_ratio",
    "name_token_count_difference",
    "address_missing_s1",
    "address_missing_candidate",
    "address_exact",
    "address_levenshtein",
    "address_jaro_winkler",
    "address_token_intersection_count",
    "address_token_union_count",
    "address_token_jaccard",
    "address_token_overlap",
    "address_length_difference",
    "address_length_ratio",
    "address_token_count_difference",
    "postal_missing_s1",
    "postal_missing_candidate",
    "postal_both_present",
    "postal_exact_match",
    "postal_mismatch",
    "numeric_token_intersection_count",
    "numeric_token_jaccard",
    "numeric_token_overlap",
    "has_common_numeric_token",
    "country_missing_s1",
    "country_missing_candidate",
    "country_both_present",
    "country_exact_match",
    "country_mismatch",
    "candidate_source_is_s2",
    "candidate_source_is_s3",
    "blocked_by_exact_name",
    "blocked_by_country_name_token",
    "blocked_by_postal",
    "blocked_by_address_token",
    "blocked_by_numeric_address",
    "blocked_by_char_ngram",
]

SOURCE = StructType([StructField(c, StringType()) for c in SOURCE_COLUMNS])
TRUTH = StructType([StructField(c, StringType()) for c in TRUTH_COLUMNS])
