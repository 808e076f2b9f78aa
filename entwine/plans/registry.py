"""Queries over the driver's tables, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from entwine.functions import similarity, text
from entwine.functions.session import settled, shared_folder, ship, stored
from entwine.operators import blocking, features, labels, metrics, model, profile
from entwine.plans import adapter, pipeline, reports
from entwine.schema import LEGAL_TERMS, MAX_BLOCK_FREQUENCY, MAX_CANDIDATES, SOURCE_COLUMNS, STRATEGIES, STRATEGY_WEIGHTS, TEST_FILES, TRAIN_FILES
from entwine.sources import tsv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (normalised sources) under its name; sql follows the common table expressions."""

    def add(f: Callable[[adapter.Sources], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(adapter.normalised(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = COMMON + sql
        return f

    return add


_BLOCKS = f"""
, j1 AS (
  SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id
  FROM (SELECT entity_id, unnest([business_name_normalized, business_name_core]) AS k FROM s1) a
  JOIN (SELECT entity_id, unnest([business_name_normalized, business_name_core]) AS k FROM pool) b ON a.k = b.k WHERE a.k <> ''
), j2_tokens AS (
  SELECT entity_id, country_normalized AS c, unnest(business_name_tokens) AS t FROM pool WHERE country_normalized <> ''
), j2_usual AS (
  SELECT c, t FROM j2_tokens WHERE length(t) >= 3 GROUP BY ALL HAVING count(*) <= {MAX_BLOCK_FREQUENCY}
), j2 AS (
  SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id
  FROM (SELECT entity_id, country_normalized AS c, unnest(business_name_tokens) AS t FROM s1) a JOIN j2_usual u ON a.c = u.c AND a.t = u.t JOIN j2_tokens b ON a.c = b.c AND a.t = b.t
), j3 AS (
  SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM s1 a JOIN pool b USING (business_address_postal) WHERE business_address_postal <> ''
), j4_tokens AS (
  SELECT DISTINCT entity_id, unnest(business_address_tokens) AS t FROM pool
), j4_usual AS (
  SELECT t FROM j4_tokens WHERE length(t) >= 3 GROUP BY ALL HAVING count(*) <= {MAX_BLOCK_FREQUENCY}
), j4 AS (
  SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM (SELECT entity_id, unnest(business_address_tokens) AS t FROM s1) a JOIN j4_usual u ON a.t = u.t JOIN j4_tokens b ON a.t = b.t
), j5 AS (
  SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id
  FROM (SELECT entity_id, unnest(business_address_numeric_tokens) AS t FROM s1) a JOIN (SELECT entity_id, unnest(business_address_numeric_tokens) AS t FROM pool) b ON a.t = b.t
), j6_positions AS (
  SELECT entity_id, source, business_name_normalized AS n, unnest([2, 3, 4]) AS size FROM full_prep
), j6_grams AS (
  SELECT entity_id, source, substr(n, i, size) AS g FROM (SELECT *, unnest(range(1, length(n) - size + 2)) AS i FROM j6_positions WHERE length(n) >= size)
), j6_tf AS (
  SELECT entity_id, source, g, count(*) AS tf FROM j6_grams GROUP BY ALL
), j6_idf AS (
  SELECT g, ln((1 + (SELECT count(*) FROM pool)::DOUBLE) / (1 + count(*))) + 1 AS idf FROM j6_tf WHERE source > 1 GROUP BY g HAVING count(*) >= 2
), j6_w AS (
  SELECT entity_id, source, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY entity_id)) AS w FROM j6_tf JOIN j6_idf USING (g)
), j6_sim AS (
  SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, round(sum(a.w * b.w), 9) AS similarity FROM j6_w a JOIN j6_w b USING (g) WHERE a.source = 1 AND b.source > 1 GROUP BY ALL
), j6 AS (
  SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY similarity DESC, cand_id) AS rank FROM j6_sim WHERE similarity > 0 QUALIFY rank <= 20
), found AS (
  SELECT s1_id, cand_id, 'exact_name' AS strategy FROM j1 UNION ALL SELECT s1_id, cand_id, 'country_name_token' FROM j2 UNION ALL SELECT s1_id, cand_id, 'postal' FROM j3
  UNION ALL SELECT s1_id, cand_id, 'address_token' FROM j4 UNION ALL SELECT s1_id, cand_id, 'numeric_address' FROM j5 UNION ALL SELECT s1_id, cand_id, 'char_ngram' FROM j6
), weights(strategy, weight, place) AS (VALUES {", ".join(f"('{s}', {STRATEGY_WEIGHTS[s]}, {i})" for i, s in enumerate(STRATEGIES))}),
merged AS (
  SELECT s1_id, cand_id, sum(weight)::INTEGER AS score, list(strategy ORDER BY place) AS provenance FROM found JOIN weights USING (strategy) GROUP BY ALL
), cands AS (
  SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id)::INTEGER AS rank FROM merged QUALIFY rank <= {MAX_CANDIDATES}
), pairs AS (
  SELECT c.s1_id, c.cand_id, c.rank, c.provenance, a AS l, b AS r, b.candidate_source,
    CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS label,
    CASE WHEN a.business_name_normalized = '' OR b.business_name_normalized = '' THEN 0.0::DOUBLE
      ELSE 1 - levenshtein(a.business_name_normalized, b.business_name_normalized)::DOUBLE / greatest(length(a.business_name_normalized), length(b.business_name_normalized)) END AS p
  FROM cands c JOIN s1 a ON c.s1_id = a.entity_id JOIN pool b ON c.cand_id = b.entity_id LEFT JOIN truth t ON c.s1_id = t.s1_id AND c.cand_id = t.cand_id
)
"""
COMMON = "WITH " + adapter.PREP_SQL + _BLOCKS


def every(d: adapter.Sources) -> DataFrame:
    return d.s1.unionByName(d.s2).unionByName(d.s3)


def prepared(d: adapter.Sources) -> pipeline.Prepared:
    """The normalised sources, read and written at once."""
    table = stored(d.every, "prepared")
    return pipeline.Prepared(*[table.where(F.col("source") == i).drop("source") for i in (1, 2, 3)])


def combined(d: adapter.Sources) -> tuple[pipeline.Prepared, DataFrame]:
    ready = prepared(d)
    return ready, settled(lambda: blocking.candidates(ready.s1, ready.s2, ready.s3), "candidates")


def scored(d: adapter.Sources) -> tuple[pipeline.Prepared, labels.Truth, DataFrame]:
    """Candidates with label and, as match_probability, the Levenshtein similarity of the names."""
    ready, found = combined(d)
    truth = labels.factored(d.truth)
    pairs = features.with_records(labels.labelled(found, truth), ready.s1, ready.s2, ready.s3)
    rule = similarity.levenshtein_similarity(F.col("l.business_name_normalized"), F.col("r.business_name_normalized"))
    return ready, truth, stored(pairs.select("s1_id", "cand_id", "candidate_source", "label", "rank", "provenance", rule.alias("match_probability")), "scored")


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- projections

for _name, _column, _make, _sql in (
    ("b1_normalize_text", "business_name", text.normalize_text, "business_name_basic"),
    ("b2_normalize_country", "country", text.normalize_country, "country_normalized"),
    ("b3_name_basic", "business_name", text.normalize_business_name, "business_name_basic"),
    ("b4_name_norm", "business_name", text.normalize_business_name_advanced, "business_name_normalized"),
    ("b5_name_core", "business_name", lambda c: text.business_name_core(text.normalize_business_name_advanced(c)), "business_name_core"),
    ("b6_address_norm", "business_address", text.normalize_business_address, "business_address_normalized"),
    ("b7_postal", "business_address", text.postal_code, "business_address_postal"),
    ("b8_numeric_tokens", "business_address", lambda c: F.array_join(text.numeric_tokens(c), ","), "array_to_string(business_address_numeric_tokens, ',')"),
    ("b9_tokens", "business_name", lambda c: F.array_join(text.tokens(text.normalize_business_name_advanced(c)), "|"), "array_to_string(business_name_tokens, '|')"),
):

    def _run(spark: SparkSession, sf_dir: str, column=_column, make=_make) -> DataFrame:
        return adapter.records(spark, sf_dir).select("entity_id", make(F.col(column)).alias("value"))

    QUERIES[_name] = _run
    ORACLES[_name] = f"{COMMON} SELECT entity_id, {_sql} AS value FROM full_prep"


@query("""SELECT entity_id, business_name_normalized, business_name_core, array_to_string(business_name_tokens, '|') AS name_tokens, business_address_normalized,
business_address_postal, array_to_string(business_address_numeric_tokens, '|') AS numbers, array_to_string(business_address_tokens, '|') AS address_tokens, country_normalized FROM full_prep""")
def b10_preprocess(d):
    joined = lambda c: F.array_join(f"business_{c}", "|")
    return every(d).select(
        "entity_id", "business_name_normalized", "business_name_core", joined("name_tokens").alias("name_tokens"), "business_address_normalized", "business_address_postal",
        joined("address_numeric_tokens").alias("numbers"), joined("address_tokens").alias("address_tokens"), "country_normalized",
    )


@query("SELECT s1_id, cand_id FROM truth")
def b13_split_truth(d):
    return labels.truth_pairs(d.truth)


# --- joins

for _i, _strategy in enumerate(STRATEGIES[:5], 1):

    def _block(d, strategy=_strategy):
        return blocking.REGISTRY[strategy](d.s1, blocking.candidate_pool(d.s2, d.s3))

    _block.__name__ = f"j{_i}_{_strategy}"
    query(f"SELECT s1_id, cand_id FROM j{_i}")(_block)


@query("SELECT s1_id, cand_id, similarity FROM j6")
def j6_char_ngram_topk(d):
    ready = prepared(d)
    return blocking.char_ngram_scores(ready.s1, ready.pool).select("s1_id", "cand_id", "similarity")


@query("SELECT s1_id, cand_id, candidate_source, l.business_name_normalized AS s1_name, r.business_name_normalized AS cand_name FROM pairs")
def j7_pair_records(d):
    ready, found = combined(d)
    pairs = features.with_records(found, ready.s1, ready.s2, ready.s3)
    return pairs.select("s1_id", "cand_id", "candidate_source", F.col("l.business_name_normalized").alias("s1_name"), F.col("r.business_name_normalized").alias("cand_name"))


@query("SELECT s1_id, cand_id, label FROM pairs")
def j8_labels(d):
    _, found = combined(d)
    return labels.labelled(found, labels.factored(d.truth)).select("s1_id", "cand_id", "label")


@query("SELECT s1_id, cand_id FROM truth EXCEPT SELECT s1_id, cand_id FROM cands")
def j9_missed_matches(d):
    _, found = combined(d)
    return labels.missed(found, labels.truth_pairs(d.truth)).select("s1_id", "cand_id")


@query("SELECT s1_id, cand_id, 0 AS label FROM cands c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1_id = c.s1_id AND t.cand_id = c.cand_id)")
def j10_negatives(d):
    _, found = combined(d)
    return labels.negatives(found, labels.factored(d.truth)).select("s1_id", "cand_id", "label")


@query("SELECT s1_id, cand_id FROM pairs WHERE p >= 0.9 EXCEPT SELECT s1_id, cand_id FROM cands")
def j11_subset_violations(d):
    _, _, pairs = scored(d)
    return labels.subset_violations(metrics.apply_threshold(pairs, 0.9), pairs)


@query("SELECT s1_id, coalesce(string_agg(cand_id, ';' ORDER BY cand_id) FILTER (WHERE p >= 0.9), '') AS matches FROM pairs GROUP BY s1_id")
def j12_match_sets(d):
    _, _, pairs = scored(d)
    return metrics.match_sets(pairs, 0.9).select("s1_id", F.array_join("matches", ";").alias("matches"))


@query("""SELECT count(*) AS pairs, avg((a.business_name = b.business_name)::INT) AS same_business_name, avg((a.business_name_normalized = b.business_name_normalized)::INT) AS same_business_name_normalized,
avg((a.business_name_core = b.business_name_core)::INT) AS same_business_name_core, avg((a.business_address = b.business_address)::INT) AS same_business_address,
avg((a.business_address_normalized = b.business_address_normalized)::INT) AS same_business_address_normalized, avg((a.country = b.country)::INT) AS same_country,
avg((a.country_normalized = b.country_normalized)::INT) AS same_country_normalized FROM truth t JOIN s1 a ON t.s1_id = a.entity_id JOIN s2 b ON t.cand_id = b.entity_id""")
def j13_agreement(d):
    return profile.agreement(labels.truth_pairs(d.truth), d.s1, d.s2)


@query("""SELECT t.s1_id, t.cand_id, a.business_name AS s1_name, a.business_address AS s1_address, b.business_name AS cand_name, b.business_address AS cand_address
FROM truth t JOIN s1 a ON t.s1_id = a.entity_id JOIN pool b ON t.cand_id = b.entity_id ORDER BY t.s1_id, t.cand_id LIMIT 5""")
def j14_match_examples(d):
    out = profile.match_examples(labels.truth_pairs(d.truth), d.s1, blocking.candidate_pool(d.s2, d.s3))
    return out.select("s1_id", "cand_id", "s1_name", "s1_address", "cand_name", "cand_address")


# --- combination

@query("SELECT s1_id, cand_id, score, array_to_string(provenance, ';') AS provenance FROM merged")
def k1_strategy_union(d):
    ready = prepared(d)
    out = blocking.union(ready.s1, ready.pool, STRATEGIES)
    return out.select("s1_id", "cand_id", "score", F.array_join("provenance", ";").alias("provenance"))


@query("SELECT s1_id, cand_id, score, rank, array_to_string(provenance, ';') AS provenance FROM cands")
def k3_combined_candidates(d):
    _, found = combined(d)
    return found.withColumn("provenance", F.array_join("provenance", ";"))


@query("""SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM s1
LEFT JOIN (SELECT s1_id, string_agg(cand_id, ';' ORDER BY cand_id) AS ids FROM cands GROUP BY 1) ON entity_id = s1_id""")
def a7_match_lists(d):
    ready, found = combined(d)
    return tsv.match_lists(found, ready.s1)


@query("""SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM s1
LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY rank) AS ids FROM cands GROUP BY 1) ON entity_id = s1_id""")
def a10_ranked_lists(d):
    ready, found = combined(d)
    return tsv.ranked_lists(found, ready.s1)


# --- features

def _feature_sql() -> str:
    flag = lambda c: f"({c})::INTEGER"
    out: list[tuple[str, str]] = []
    sets = lambda f: f"len(list_distinct({f}))"

    def words(kind: str, f: str, tokens: str) -> None:
        a, b, ta, tb = f"l.{f}", f"r.{f}", f"l.{tokens}", f"r.{tokens}"
        both, union = f"len(list_intersect({ta}, {tb}))", f"len(list_distinct(list_concat({ta}, {tb})))"
        none = f"({a} = '' OR {b} = '')"
        out.extend([(f"{kind}_missing_s1", flag(f"{a} = ''")), (f"{kind}_missing_candidate", flag(f"{b} = ''")), (f"{kind}_exact", flag(f"{a} <> '' AND {a} = {b}"))])
        if kind == "name":
            out.append(("name_core_exact", flag("l.business_name_core <> '' AND l.business_name_core = r.business_name_core")))
        out.extend(
            [
                (f"{kind}_levenshtein", f"round(CASE WHEN {none} THEN 0.0::DOUBLE ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END, 9)"),
                (f"{kind}_jaro_winkler", f"round(CASE WHEN {none} THEN 0.0::DOUBLE ELSE jaro_winkler_similarity({a}, {b}) END, 9)"),
                (f"{kind}_token_intersection_count", f"{both}::INTEGER"),
                (f"{kind}_token_union_count", f"{union}::INTEGER"),
                (f"{kind}_token_jaccard", f"round(CASE WHEN {union} = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / {union} END, 9)"),
                (f"{kind}_token_overlap", f"round(CASE WHEN least({sets(ta)}, {sets(tb)}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / least({sets(ta)}, {sets(tb)}) END, 9)"),
                (f"{kind}_length_difference", f"abs(length({a}) - length({b}))::INTEGER"),
                (f"{kind}_length_ratio", f"round(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0::DOUBLE ELSE least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) END, 9)"),
                (f"{kind}_token_count_difference", f"abs(len({ta}) - len({tb}))::INTEGER"),
            ]
        )

    def code(kind: str, f: str) -> None:
        a, b = f"l.{f}", f"r.{f}"
        out.extend(
            [
                (f"{kind}_missing_s1", flag(f"{a} = ''")),
                (f"{kind}_missing_candidate", flag(f"{b} = ''")),
                (f"{kind}_both_present", flag(f"{a} <> '' AND {b} <> ''")),
                (f"{kind}_exact_match", flag(f"{a} <> '' AND {a} = {b}")),
                (f"{kind}_mismatch", flag(f"{a} <> '' AND {b} <> '' AND {a} <> {b}")),
            ]
        )

    words("name", "business_name_normalized", "business_name_tokens")
    words("address", "business_address_normalized", "business_address_tokens")
    code("postal", "business_address_postal")
    n = "business_address_numeric_tokens"
    both, union = f"len(list_intersect(l.{n}, r.{n}))", f"len(list_distinct(list_concat(l.{n}, r.{n})))"
    least = f"least({sets('l.' + n)}, {sets('r.' + n)})"
    out.extend(
        [
            ("numeric_token_intersection_count", f"{both}::INTEGER"),
            ("numeric_token_jaccard", f"round(CASE WHEN {union} = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / {union} END, 9)"),
            ("numeric_token_overlap", f"round(CASE WHEN {least} = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE / {least} END, 9)"),
            ("has_common_numeric_token", flag(f"{both} > 0")),
        ]
    )
    code("country", "country_normalized")
    out.extend([(f"candidate_source_is_{s}", flag(f"candidate_source = '{s}'")) for s in ("s2", "s3")])
    out.extend([(f"blocked_by_{s}", flag(f"list_contains(provenance, '{s}')")) for s in STRATEGIES])
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in out) + ", s1_id, cand_id, candidate_source FROM pairs"


@query(_feature_sql())
def f_all_features(d):
    ready, found = combined(d)
    return rounded(features.features(found, ready.s1, ready.s2, ready.s3))


for _name, _expression in (
    ("f7_token_jaccard", "name_token_jaccard"),
    ("f8_token_overlap", "name_token_overlap"),
    ("f9_levenshtein", "name_levenshtein"),
    ("f10_jaro_winkler", "name_jaro_winkler"),
    ("f11_length_ratio", "name_length_ratio"),
    ("f12_token_count_difference", "name_token_count_difference"),
):

    def _one(d, column=_expression):
        ready, found = combined(d)
        ship(found.sparkSession)
        pairs = features.with_records(found, ready.s1, ready.s2, ready.s3)
        return rounded(pairs.select("s1_id", "cand_id", features.feature_columns()[column].alias("value")))

    _one.__name__ = _name
    query(f"SELECT s1_id, cand_id, {_expression} AS value FROM ({_feature_sql()})")(_one)


# --- aggregations

@query("""SELECT business_name_normalized AS normalized, count(DISTINCT business_name) AS raw_values FROM full_prep
WHERE business_name <> '' AND business_name_normalized <> '' GROUP BY 1 HAVING count(DISTINCT business_name) > 1""")
def g2_collisions(d):
    return profile.collisions(every(d), "business_name", "business_name_normalized")


@query("SELECT country AS value, count(*) AS rows, 100 * count(*) / sum(count(*)) OVER () AS percent FROM full_prep GROUP BY country")
def g3_country_counts(d):
    return profile.value_counts(every(d), "country")


@query(" UNION ALL ".join(f"""SELECT {i} AS source, count(*) AS rows, count(*) - count(DISTINCT entity_id) AS duplicate_ids, count_if(entity_id = '')::BIGINT AS empty_entity_id, count_if(business_name = '')::BIGINT AS empty_business_name,
count_if(business_address = '')::BIGINT AS empty_business_address, count_if(country = '')::BIGINT AS empty_country, count_if(NOT starts_with(entity_id, 'S{i}-'))::BIGINT AS wrong_prefix FROM s{i}""" for i in (1, 2, 3)))
def g5_validation(d):
    rows = [profile.validate(s, f"S{i}-").select(F.lit(i).alias("source"), "*") for i, s in enumerate((d.s1, d.s2, d.s3), 1)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT coalesce(min(length(business_name)), 0)::BIGINT AS min_length, coalesce(max(length(business_name)), 0)::BIGINT AS max_length, coalesce(avg(length(business_name)), 0)::DOUBLE AS mean_length, coalesce(median(length(business_name)), 0)::DOUBLE AS median_length FROM full_prep WHERE business_name <> ''")
def g7_length_stats(d):
    return profile.length_stats(every(d), "business_name")


def _length_sql(column: str) -> str:
    return f"""count_if({column} = '')::BIGINT AS {column}_empty, 100 * avg(({column} = '')::INT) AS {column}_empty_percent, coalesce(min(length({column})) FILTER (WHERE {column} <> ''), 0)::BIGINT AS {column}_min_length,
coalesce(max(length({column})) FILTER (WHERE {column} <> ''), 0)::BIGINT AS {column}_max_length, coalesce(avg(length({column})) FILTER (WHERE {column} <> ''), 0)::DOUBLE AS {column}_mean_length, coalesce(median(length({column})) FILTER (WHERE {column} <> ''), 0)::DOUBLE AS {column}_median_length"""


@query("SELECT source, count(*) AS rows, 4 AS columns, count(DISTINCT entity_id) AS unique_ids, " + ", ".join(map(_length_sql, ("business_name", "business_address", "country"))) + " FROM full_prep GROUP BY source")
def g4_source_stats(d):
    named = [s.withColumn("source", F.lit(i)) for i, s in enumerate((d.s1, d.s2, d.s3), 1)]
    return profile.source_stats(named[0].unionByName(named[1]).unionByName(named[2]), "source")


KEY_FEATURES = ["name_jaro_winkler", "name_token_jaccard", "address_token_jaccard", "address_levenshtein", "postal_exact_match"]


@query("SELECT label, " + ", ".join(f"median({c})::DOUBLE AS {c}" for c in KEY_FEATURES) + " FROM (SELECT f.*, label FROM (" + _feature_sql() + ") f JOIN pairs USING (s1_id, cand_id)) GROUP BY label")
def g8_label_medians(d):
    ready, found = combined(d)
    made = features.features(labels.labelled(found, labels.factored(d.truth)), ready.s1, ready.s2, ready.s3)
    return profile.label_medians(rounded(made), KEY_FEATURES)


@query("""SELECT sum(n)::BIGINT AS pairs, avg(n) AS avg_candidates, median(n) AS median_candidates, max(n)::BIGINT AS max_candidates, 1 - sum(n)::DOUBLE / (count(*) * (SELECT count(*) FROM pool)::DOUBLE) AS reduction_ratio
FROM (SELECT entity_id, count(cand_id) AS n FROM s1 LEFT JOIN cands ON entity_id = s1_id GROUP BY 1)""")
def g9_candidate_stats(d):
    ready, found = combined(d)
    return metrics.candidate_stats(found, ready.s1, ready.pool.count())


@query("""SELECT count(c.s1_id) / greatest(count(*), 1) AS recall, count(c.s1_id) FILTER (WHERE starts_with(t.cand_id, 'S2-')) / greatest(count(*) FILTER (WHERE starts_with(t.cand_id, 'S2-')), 1) AS recall_s2,
count(c.s1_id) FILTER (WHERE starts_with(t.cand_id, 'S3-')) / greatest(count(*) FILTER (WHERE starts_with(t.cand_id, 'S3-')), 1) AS recall_s3, count(*) AS true_pairs FROM truth t LEFT JOIN cands c USING (s1_id, cand_id)""")
def g10_blocking_recall(d):
    _, found = combined(d)
    return metrics.blocking_recall(found, labels.factored(d.truth))


@query("""SELECT strategy, count(*) AS pairs, count(t.s1_id) AS hits, count(t.s1_id) / (SELECT greatest(count(*), 1) FROM truth)::DOUBLE AS recall FROM found f LEFT JOIN truth t ON f.s1_id = t.s1_id AND f.cand_id = t.cand_id GROUP BY strategy""")
def g11_strategy_recall(d):
    ready = prepared(d)
    return blocking.strategy_recall(ready.s1, ready.pool, STRATEGIES, labels.truth_lists(d.truth))


@query("""SELECT count(*) AS entities, count_if(n = 0)::BIGINT AS without_match, count_if(n > 0)::BIGINT AS with_match, min(n)::BIGINT AS min_matches, max(n)::BIGINT AS max_matches, avg(n) AS mean_matches, median(n) AS median_matches,
count_if(n2 > 0 AND n3 = 0)::BIGINT AS only_s2, count_if(n2 = 0 AND n3 > 0)::BIGINT AS only_s3, count_if(n2 > 0 AND n3 > 0)::BIGINT AS both
FROM (SELECT entity_id, count(cand_id) AS n, count_if(starts_with(cand_id, 'S2-')) AS n2, count_if(starts_with(cand_id, 'S3-')) AS n3 FROM s1 LEFT JOIN truth ON entity_id = s1_id GROUP BY 1)""")
def g12_gt_distribution(d):
    return profile.truth_distribution(d.truth)


_ENTITY = """, preds AS (SELECT s1_id, cand_id FROM pairs WHERE p >= 0.9), each_entity AS (
  SELECT entity_id AS s1_id, (SELECT count(*) FROM preds p JOIN truth t USING (s1_id, cand_id) WHERE p.s1_id = entity_id) AS tp,
    (SELECT count(*) FROM preds p WHERE p.s1_id = entity_id) AS predicted, (SELECT count(*) FROM truth t WHERE t.s1_id = entity_id) AS actual FROM s1
), entity_scores AS (
  SELECT *, CASE WHEN predicted = 0 AND actual = 0 THEN 1.0::DOUBLE WHEN predicted = 0 OR actual = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS precision,
    CASE WHEN predicted = 0 AND actual = 0 THEN 1.0::DOUBLE WHEN predicted = 0 OR actual = 0 THEN 0.0::DOUBLE ELSE tp / actual END AS recall FROM each_entity
), entity_f AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * precision * recall / (0.25::DOUBLE * precision + recall) END AS f0_5 FROM entity_scores
)
"""


@query(_ENTITY + "SELECT s1_id, tp::BIGINT AS tp, predicted::BIGINT AS predicted, actual::BIGINT AS actual, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f0_5, 9) AS f0_5 FROM entity_f")
def g13_entity_metrics(d):
    _, truth, pairs = scored(d)
    return rounded(metrics.entity_metrics(metrics.apply_threshold(pairs, 0.9), truth, labels.truth_entities(d.truth)))


@query(_ENTITY + "SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f0_5), 9) AS f0_5, count(*) AS entities FROM entity_f")
def g14_macro_metrics(d):
    _, truth, pairs = scored(d)
    return rounded(metrics.macro_metrics(metrics.apply_threshold(pairs, 0.9), truth, labels.truth_entities(d.truth)))


@query("""SELECT CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE count(c.s1_id) / count(*) END AS candidate_recall, count(*) AS true_pairs
FROM truth t LEFT JOIN cands c USING (s1_id, cand_id) WHERE t.s1_id IN (SELECT s1_id FROM cands)""")
def g15_candidate_recall(d):
    _, truth, pairs = scored(d)
    return metrics.candidate_recall(pairs, truth)


@query("""SELECT tp::BIGINT AS tp, predicted::BIGINT AS predicted, actual::BIGINT AS actual, round(pr, 9) AS precision, round(re, 9) AS recall,
round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1, round(CASE WHEN pr + re = 0 THEN 0 ELSE 1.25::DOUBLE * pr * re / (0.25::DOUBLE * pr + re) END, 9) AS f0_5
FROM (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN actual > 0 THEN tp / actual ELSE 0 END AS re
FROM (SELECT count_if(p >= 0.9 AND label = 1) AS tp, count_if(p >= 0.9) AS predicted, count_if(label = 1) AS actual FROM pairs))""")
def g16_pair_metrics(d):
    _, _, pairs = scored(d)
    return rounded(metrics.pair_metrics(pairs, 0.9))


@query(""", steps AS (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM pairs GROUP BY p), run AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg, greatest(least(p, 1 - 2.220446049250313e-16::DOUBLE), 2.220446049250313e-16::DOUBLE) AS q
  FROM steps WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(neg * (tp - pos / 2)) / (max(all_pos) * max(all_neg)), 9) AS roc_auc, round(sum(pos / all_pos * tp / (tp + fp)), 9) AS pr_auc, round(sum(-(pos * ln(q) + neg * ln(1 - q))) / sum(pos + neg), 6) AS log_loss FROM run""")
def g17_average_precision(d):
    _, _, pairs = scored(d)
    return metrics.ranking_metrics(pairs).select(F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc"), F.round("log_loss", 6).alias("log_loss"))


@query("SELECT sum(n)::BIGINT AS total_matches, count_if(n > 0)::BIGINT AS matched_source1, avg(n) AS avg_matches FROM (SELECT entity_id, count(cand_id) AS n FROM s1 LEFT JOIN (SELECT * FROM pairs WHERE p >= 0.9) ON entity_id = s1_id GROUP BY 1)")
def g18_match_stats(d):
    ready, _, pairs = scored(d)
    return metrics.match_stats(metrics.apply_threshold(pairs, 0.9), ready.s1)


@query("SELECT avg((business_address_postal <> '')::INT) AS with_postal, avg((len(business_address_numeric_tokens) > 0)::INT) AS with_numbers, avg((business_name_core <> business_name_normalized)::INT) AS core_differs FROM full_prep")
def g19_extraction_rates(d):
    return profile.extraction_rates(every(d))


@query("SELECT count_if(label = 1)::BIGINT AS positives, count_if(label = 0)::BIGINT AS negatives, avg(label) AS positive_ratio, count_if(label = 0) / greatest(count_if(label = 1), 1) AS scale_pos_weight FROM pairs")
def g20_class_balance(d):
    _, found = combined(d)
    return model.class_balance(labels.labelled(found, labels.factored(d.truth)))


_WORD = r"[^\p{L}\p{M}\p{N}_\s]"


def _share_sql(name: str, condition: str) -> str:
    return f"count_if({condition})::BIGINT AS {name}, 100 * avg(({condition})::INT) AS {name}_percent"


def _profile_sql(column: str, what: str, short: int, long: int, more: list[str]) -> str:
    distinct = lambda ok: f"count(DISTINCT {column}) FILTER (WHERE {ok})"
    parts = [f"count_if({column} <> '')::BIGINT AS non_empty", f"{distinct(f"{column} <> '' AND length({column}) <= {short}")} AS short_{what}", f"{distinct(f'length({column}) > {long}')} AS long_{what}", *more]
    return "SELECT " + ", ".join(parts) + " FROM full_prep WHERE source < 3"


@query(_profile_sql("business_name", "names", 5, 50, [
    _share_sql("with_punctuation", f"regexp_matches(business_name, '{_WORD}')"), _share_sql("with_digits", "regexp_matches(business_name, '\\p{Nd}')"),
    *[f"count_if(regexp_matches(lower(business_name), '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){t}(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])'))::BIGINT AS term_{t}" for t in LEGAL_TERMS],
]))
def g6_name_profile(d):
    return profile.name_profile(d.s1.unionByName(d.s2))


@query(_profile_sql("business_address", "addresses", 10, 100, [
    _share_sql("with_digits", "regexp_matches(business_address, '\\p{Nd}')"), _share_sql("with_postal_code", "regexp_matches(business_address, '\\b[0-9]{5,6}\\b')"), _share_sql("with_punctuation", f"regexp_matches(business_address, '{_WORD}')"),
]))
def g6_address_profile(d):
    return profile.address_profile(d.s1.unionByName(d.s2))


# --- sets, windows, splits

@query("SELECT business_name AS value FROM s1 WHERE business_name <> '' INTERSECT SELECT business_name FROM s2 WHERE business_name <> ''")
def u4_name_overlap(d):
    return profile.shared_values(d.s1, d.s2, "business_name")


@query("SELECT business_address AS value FROM s1 WHERE business_address <> '' INTERSECT SELECT business_address FROM s2 WHERE business_address <> ''")
def u4_address_overlap(d):
    return profile.shared_values(d.s1, d.s2, "business_address")


@query("SELECT DISTINCT country AS value FROM s2 EXCEPT SELECT country FROM s1")
def u5_unseen_countries(d):
    return profile.unseen_values(d.s2, d.s1, "country")


@query("SELECT entity_id, candidate_source FROM pool")
def u1_candidate_pool(d):
    return blocking.candidate_pool(d.s2, d.s3).select("entity_id", "candidate_source")


@query("SELECT normalized, raw_values FROM (SELECT business_name_normalized AS normalized, count(DISTINCT business_name) AS raw_values FROM full_prep WHERE business_name <> '' AND business_name_normalized <> '' GROUP BY 1 HAVING count(DISTINCT business_name) > 1) ORDER BY raw_values DESC, normalized LIMIT 5")
def w6_top_collisions(d):
    return profile.top_collisions(every(d), "business_name", "business_name_normalized")


@query("SELECT s1_id, cand_id, label, round(p, 9) AS match_probability FROM pairs WHERE p >= 0.35 AND label = 0 ORDER BY p DESC, s1_id, cand_id LIMIT 10")
def c7_false_positives(d):
    _, _, pairs = scored(d)
    return rounded(metrics.errors(pairs, 0.35, 10)[0].select("s1_id", "cand_id", "label", "match_probability"))


@query("SELECT s1_id, cand_id, label, round(p, 9) AS match_probability FROM pairs WHERE p < 0.95 AND label = 1 ORDER BY p, s1_id, cand_id LIMIT 10")
def c7_false_negatives(d):
    _, _, pairs = scored(d)
    return rounded(metrics.errors(pairs, 0.95, 10)[1].select("s1_id", "cand_id", "label", "match_probability"))


#: A cap that tokens of the driver's small tables pass, unlike that of the task.
_CAP = 20


@query(f""", usual2 AS (SELECT c, t FROM j2_tokens WHERE length(t) >= 3 GROUP BY ALL HAVING count(*) <= {_CAP}), usual4 AS (SELECT t FROM j4_tokens WHERE length(t) >= 3 GROUP BY ALL HAVING count(*) <= {_CAP})
SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id, 'country_name_token' AS strategy
FROM (SELECT entity_id, country_normalized AS c, unnest(business_name_tokens) AS t FROM s1) a JOIN usual2 u ON a.c = u.c AND a.t = u.t JOIN j2_tokens b ON a.c = b.c AND a.t = b.t
UNION ALL SELECT DISTINCT a.entity_id, b.entity_id, 'address_token' FROM (SELECT entity_id, unnest(business_address_tokens) AS t FROM s1) a JOIN usual4 u ON a.t = u.t JOIN j4_tokens b ON a.t = b.t""")
def c3_frequency_cap(d):
    ready = prepared(d)
    one = blocking.country_name_token(ready.s1, ready.pool, cap=_CAP).withColumn("strategy", F.lit("country_name_token"))
    return one.unionByName(blocking.address_token(ready.s1, ready.pool, cap=_CAP).withColumn("strategy", F.lit("address_token")))


@query(f"SELECT s1_id, cand_id, name_jaro_winkler FROM ({_feature_sql()}) JOIN pairs USING (s1_id, cand_id) WHERE label = 0 AND name_jaro_winkler > 0.85 ORDER BY s1_id, cand_id LIMIT 50")
def c6_hard_negatives(d):
    ready, found = combined(d)
    made = rounded(features.features(labels.labelled(found, labels.factored(d.truth)), ready.s1, ready.s2, ready.s3))
    return profile.hard_negatives(made).select("s1_id", "cand_id", "name_jaro_winkler")


@query("SELECT entity_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', entity_id)), entity_id) <= ceil(round(0.2::DOUBLE * count(*) OVER (), 9)) AS is_validation FROM s1")
def m1_entity_split(d):
    return labels.entity_split(d.s1)


@query("SELECT count(*) AS ground_truth_positives, count(c.s1_id) AS positive_pairs, count_if(c.s1_id IS NULL)::BIGINT AS missing_positives FROM truth t LEFT JOIN cands c USING (s1_id, cand_id)")
def m3_label_counts(d):
    ready, found = combined(d)
    return labels.label_counts(found, labels.factored(d.truth), ready.s1)


@query(""", drawn AS (
  SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY md5(concat_ws(':', '42', s1_id, cand_id)), cand_id) <= 3 AS is_random,
    len(list_intersect(l.business_name_tokens, r.business_name_tokens))::DOUBLE / greatest(len(list_distinct(list_concat(l.business_name_tokens, r.business_name_tokens))), 1) AS alike FROM pairs WHERE label = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY s1_id, is_random ORDER BY alike DESC, rank) AS place FROM drawn
)
SELECT s1_id, cand_id, 0 AS label, CASE WHEN is_random THEN 'random' ELSE 'hard' END AS kind FROM placed WHERE is_random OR (place <= 2 AND l.business_name_normalized <> '')""")
def m4_negatives(d):
    ready, found = combined(d)
    out = labels.sample_negatives(found, labels.factored(d.truth), ready.s1, ready.pool, 3, 2)
    return out.select("s1_id", "cand_id", "label", "kind")


_DRAWN = """, drawn AS (
  SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY md5(concat_ws(':', '42', s1_id, cand_id)), cand_id) <= 3 AS is_random,
    len(list_intersect(l.business_name_tokens, r.business_name_tokens))::DOUBLE / greatest(len(list_distinct(list_concat(l.business_name_tokens, r.business_name_tokens))), 1) AS alike FROM pairs WHERE label = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY s1_id, is_random ORDER BY alike DESC, rank) AS place FROM drawn
), training AS (
  SELECT s1_id, cand_id, 0 AS label FROM placed WHERE is_random OR (place <= 2 AND l.business_name_normalized <> '') UNION ALL SELECT s1_id, cand_id, 1 FROM pairs WHERE label = 1
)
"""


@query(_DRAWN + "SELECT s1_id, cand_id, label FROM training")
def u6_training_pairs(d):
    ready, found = combined(d)
    return labels.training_pairs(found, labels.factored(d.truth), ready.s1, ready.pool).select("s1_id", "cand_id", "label")


@query("SELECT s1_id, cand_id, label FROM pairs")
def m6_validation_pairs(d):
    _, found = combined(d)
    return labels.validation_pairs(found, labels.factored(d.truth)).select("s1_id", "cand_id", "label")


@query(_feature_sql().replace(", s1_id, cand_id, candidate_source FROM pairs", ", s1_id, cand_id FROM pairs"))
def f14_test_matrix(d):
    ready, found = combined(d)
    return rounded(features.test_features(found, ready.s1, ready.s2, ready.s3, features.SCHEMA))


@query(_DRAWN + f"SELECT f.*, t.label FROM ({_feature_sql()}) f JOIN training t USING (s1_id, cand_id)")
def f15_training_matrix(d):
    ready, found = combined(d)
    rows = labels.training_pairs(found, labels.factored(d.truth), ready.s1, ready.pool)
    return rounded(features.features(rows, ready.s1, ready.s2, ready.s3))


_GRID = """, grid AS (SELECT i, i * 0.01::DOUBLE AS t FROM range(101) x(i)), seen AS (SELECT DISTINCT s1_id FROM pairs), per AS (
  SELECT g.i, g.t, s.s1_id, count(p.cand_id) AS predicted, count(p.cand_id) FILTER (WHERE p.label = 1) AS tp, (SELECT count(*) FROM truth WHERE truth.s1_id = s.s1_id) AS actual
  FROM grid g CROSS JOIN seen s LEFT JOIN pairs p ON p.s1_id = s.s1_id AND p.p >= g.t GROUP BY ALL
), graded AS (
  SELECT *, CASE WHEN predicted = 0 AND actual = 0 THEN 1.0::DOUBLE WHEN predicted = 0 OR actual = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS pr,
    CASE WHEN predicted = 0 AND actual = 0 THEN 1.0::DOUBLE WHEN predicted = 0 OR actual = 0 THEN 0.0::DOUBLE ELSE tp / actual END AS re FROM per
), graph AS (
  SELECT round(t, 2) AS threshold, round(avg(pr), 9) AS precision, round(avg(re), 9) AS recall, round(avg(CASE WHEN pr + re = 0 THEN 0 ELSE 1.25::DOUBLE * pr * re / (0.25::DOUBLE * pr + re) END), 9) AS f0_5,
    sum(predicted)::BIGINT AS predicted_match_count, count_if(predicted > 0)::BIGINT AS matched_source1_count, round(sum(predicted)::DOUBLE / greatest(count(*), 1), 9) AS average_matches_per_source1 FROM graded GROUP BY t
)
"""


@query(_GRID + "SELECT * FROM graph")
def m13_threshold_grid(d):
    _, truth, pairs = scored(d)
    return rounded(metrics.search_thresholds(pairs, truth, labels.truth_entities(d.truth)))


@query(_GRID + "SELECT threshold FROM graph ORDER BY f0_5 DESC, threshold LIMIT 1")
def m14_best_threshold(d):
    _, truth, pairs = scored(d)
    grid = metrics.search_thresholds(pairs, truth, labels.truth_entities(d.truth))
    return grid.orderBy(F.desc(F.round("f0_5", 9)), "threshold").select("threshold").limit(1)


def trained(d: adapter.Sources) -> tuple[pipeline.Prepared, pipeline.Trained]:
    ready = prepared(d)
    return ready, pipeline.train(ready, d.truth)


@query()
def m7_gbt_scores(d):
    """Validation pairs scored by the trained model."""
    return trained(d)[1].scored


@query()
def m9_importance(d):
    """Gain and splits of each feature in the trained model."""
    _, made = trained(d)
    return made.scored.sparkSession.createDataFrame(made.metadata["importance"], "feature string, gain double, splits int")


@query(f"SELECT unnest([{', '.join(repr(c) for c in features.SCHEMA)}]) AS feature, true AS in_training, true AS in_validation, false AS tells_the_answer")
def m10_feature_checks(d):
    """M10 and M11: the features of both matrices, and none that tells the answer."""
    ready, found = combined(d)
    truth = labels.factored(d.truth)
    rows = [labels.training_pairs(found, truth, ready.s1, ready.pool), labels.validation_pairs(found, truth)]
    one, two = (features.features(r, ready.s1, ready.s2, ready.s3) for r in rows)
    own = model.check_features(one, two)
    return found.sparkSession.createDataFrame([(c, c in one.columns, c in two.columns, c in model.FORBIDDEN) for c in own], "feature string, in_training boolean, in_validation boolean, tells_the_answer boolean")


@query()
def m15_match_lists(d):
    """Train, choose the threshold, match all of s1, and list the matches."""
    ready, made = trained(d)
    best, _ = pipeline.choose_threshold(made.scored, d.truth)
    _, matches = pipeline.infer(ready, made.model, best, made.metadata["features"])
    return tsv.match_lists(matches, ready.s1)


@query("SELECT (SELECT count(*) FROM pairs WHERE p >= 0.9 AND (s1_id, cand_id) NOT IN (SELECT (s1_id, cand_id) FROM cands)) AS violations, count(*) AS lists, count(DISTINCT entity_id) AS ids FROM s1")
def m16_audit(d):
    """Matches at 0.9 pass the audit; what it counts."""
    ready, _, pairs = scored(d)
    matches = metrics.apply_threshold(pairs, 0.9)
    lists = stored(tsv.match_lists(matches, ready.s1), "lists")
    pipeline.audit(matches, pairs, lists, ready.s1)
    return lists.agg(F.lit(labels.subset_violations(matches, pairs).count()).cast("long").alias("violations"), F.count(F.lit(1)).alias("lists"), F.countDistinct("source1_entity_id").alias("ids"))


@query("SELECT 0.37::DOUBLE AS only_threshold, 0.42::DOUBLE AS with_final")
def m17_threshold_fallback(d):
    """The threshold of a folder with threshold.json alone, and with final_threshold.json too."""
    folder = _folder(d, "threshold")
    tsv.write_json({"best_threshold": 0.37}, f"{folder}/threshold.json")
    first = pipeline.read_threshold(folder)
    tsv.write_json({"best_threshold": 0.42}, f"{folder}/final_threshold.json")
    return d.s1.sparkSession.createDataFrame([(first, pipeline.read_threshold(folder))], "only_threshold double, with_final double")


@query(_GRID + """, half AS (SELECT * FROM graph WHERE threshold = 0.5), chosen AS (SELECT * FROM graph ORDER BY f0_5 DESC, threshold LIMIT 1), fixed AS (
  SELECT (SELECT count(c.s1_id) / greatest(count(*), 1) FROM truth t LEFT JOIN cands c USING (s1_id, cand_id) WHERE t.s1_id IN (SELECT s1_id FROM cands)) AS recall, (SELECT count(*) FROM pairs)::DOUBLE AS n
), sides AS (
  SELECT unnest(['blocking_recall', 'precision', 'recall', 'f0_5', 'candidate_count', 'predicted_match_count']) AS measure,
    unnest([fixed.recall, half.precision, half.recall, half.f0_5, fixed.n, half.predicted_match_count]) AS baseline, unnest([fixed.recall, chosen.precision, chosen.recall, chosen.f0_5, fixed.n, chosen.predicted_match_count]) AS selected FROM half, chosen, fixed
) SELECT measure, round(baseline, 6) AS baseline, round(selected, 6) AS selected, round(round(selected, 6) - round(baseline, 6), 6) AS difference FROM sides""")
def r16_comparison(d):
    """The rule at 0.5 against the rule at its best threshold."""
    _, truth, pairs = scored(d)
    best = metrics.best_threshold(stored(metrics.search_thresholds(pairs, truth, labels.truth_entities(d.truth)), "grid"))
    baseline, selected = ({c: round(float(v), 6) for c, v in reports.system_measures(pairs, d.truth, t).items()} for t in (0.5, round(best * 100) * 0.01))
    return rounded(reports.comparison(pairs.sparkSession, baseline, selected), 6)


# --- files: written to the shared folder and read back


def _folder(d: adapter.Sources, name: str) -> str:
    return f"{shared_folder(d.s1.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"


def _raw(s: DataFrame) -> DataFrame:
    return s.select(*SOURCE_COLUMNS)


def _bundle(d: adapter.Sources, files: dict[str, str]) -> str:
    folder = _folder(d, "bundle")
    for name, s in {"source1": _raw(d.s1), "source2": _raw(d.s2), "source3": _raw(d.s3), "ground_truth": d.truth}.items():
        if name in files:
            tsv.write_table(s, f"{folder}/{files[name]}")
    return folder


_SOURCE_SQL = "entity_id, business_name, business_address, country"


@query(f"SELECT {_SOURCE_SQL} FROM s1")
def a1_tsv_scan(d):
    path = f"{_folder(d, 'scan')}/source1.tsv"
    tsv.write_table(_raw(d.s1), path)
    return tsv.read_source(d.s1.sparkSession, path)


@query("SELECT source1_entity_id, matched_entity_ids FROM truth_lists")
def a2_truth_scan(d):
    path = f"{_folder(d, 'scan')}/truth.tsv"
    tsv.write_table(d.truth, path)
    return tsv.read_ground_truth(d.s1.sparkSession, path)


@query(" UNION ALL ".join(f"SELECT 'source{i}' AS part, entity_id AS id, business_name AS value FROM s{i}" for i in (1, 2, 3)) + " UNION ALL SELECT 'ground_truth', source1_entity_id, matched_entity_ids FROM truth_lists")
def a3_train_bundle(d):
    data = tsv.read_train(d.s1.sparkSession, _bundle(d, TRAIN_FILES))
    out = data["ground_truth"].toDF("id", "value").select(F.lit("ground_truth").alias("part"), "id", "value")
    for k in ("source1", "source2", "source3"):
        out = out.unionByName(data[k].select(F.lit(k).alias("part"), F.col("entity_id").alias("id"), F.col("business_name").alias("value")))
    return out


@query(" UNION ALL ".join(f"SELECT 'source{i}' AS part, {_SOURCE_SQL} FROM s{i}" for i in (1, 2, 3)))
def a4_test_bundle(d):
    data = tsv.read_test(d.s1.sparkSession, _bundle(d, TEST_FILES))
    parts = [s.select(F.lit(k).alias("part"), "*") for k, s in data.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT s1_id, cand_id FROM cands")
def a5_candidate_scan(d):
    ready, found = combined(d)
    path = f"{_folder(d, 'lists')}/candidate_pairs.tsv"
    tsv.write_candidate_pairs(found, ready.s1, path)
    return tsv.read_candidates(found.sparkSession, path, ready.s1, ";")


_LISTS = StructType([StructField("source1_entity_id", StringType()), StructField("candidate_entity_ids", StringType())])


@query("""SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM s1
LEFT JOIN (SELECT s1_id, string_agg(cand_id, ';' ORDER BY cand_id) AS ids FROM cands GROUP BY 1) ON entity_id = s1_id""")
def a8_candidate_pairs_sink(d):
    ready, found = combined(d)
    path = f"{_folder(d, 'lists')}/candidate_pairs.tsv"
    tsv.write_candidate_pairs(found, ready.s1, path)
    return tsv.read_tsv(found.sparkSession, path, _LISTS)


@query("""SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM s1
LEFT JOIN (SELECT s1_id, string_agg(cand_id, ';' ORDER BY cand_id) AS ids FROM pairs WHERE p >= 0.9 GROUP BY 1) ON entity_id = s1_id""")
def a9_matches_sink(d):
    ready, _, pairs = scored(d)
    path = f"{_folder(d, 'lists')}/matching_results.tsv"
    tsv.write_matching_results(metrics.apply_threshold(pairs, 0.9), ready.s1, path)
    return tsv.read_tsv(pairs.sparkSession, path, _LISTS)


@query("SELECT s1_id AS source1_entity_id, cand_id AS candidate_entity_id, candidate_source, label, round(p, 9) AS match_probability FROM pairs")
def a11_scored_files(d):
    """A6 and A11: scored pairs written and read."""
    _, _, pairs = scored(d)
    path = f"{_folder(d, 'scored')}/validation_predictions.tsv"
    tsv.write_scored(pairs.withColumnsRenamed({"s1_id": "source1_entity_id", "cand_id": "candidate_entity_id"}), path)
    return rounded(tsv.read_scored(pairs.sparkSession, path))


@query(_GRID + "SELECT * FROM graph")
def a12_csv_sink(d):
    """The threshold grid as CSV."""
    _, truth, pairs = scored(d)
    grid = rounded(metrics.search_thresholds(pairs, truth, labels.truth_entities(d.truth)))
    path = f"{_folder(d, 'grid')}/threshold_results.csv"
    tsv.write_csv(grid, path, "threshold")
    return pairs.sparkSession.read.schema(grid.schema).options(header=True).csv(path)


_REGISTRY_SQL = "SELECT 'EXP{0:03}' AS experiment_id, '{1}' AS experiment_name, 'N/A' AS hypothesis, 'All' AS component, 'None' AS change, 0.5::DOUBLE AS baseline_f0_5, {2}::DOUBLE AS experiment_f0_5, {3}::DOUBLE AS delta_f0_5, 0.75::DOUBLE AS precision, 0.25::DOUBLE AS recall, 10::BIGINT AS candidate_count, 1.0::DOUBLE AS blocking_recall, {4} AS accepted"


@query(_REGISTRY_SQL.format(0, "first", 0.5, 0.0, "true") + " UNION ALL " + _REGISTRY_SQL.format(1, "second", 0.25, -0.25, "false"))
def a12_experiment_registry(d):
    spark, path = d.s1.sparkSession, f"{_folder(d, 'experiments')}/experiments.csv"
    measures = [{"f0_5": f, "precision": 0.75, "recall": 0.25, "candidate_count": 10, "blocking_recall": 1.0} for f in (0.5, 0.25)]
    tsv.write_experiments(spark, [reports.experiment(i, n, measures[0], m) for i, (n, m) in enumerate(zip(("first", "second"), measures, strict=True))], path)
    return tsv.read_experiments(spark, path)


@query(f"SELECT unnest(range({len(features.SCHEMA)}))::INTEGER AS place, unnest([{', '.join(repr(c) for c in features.SCHEMA)}]) AS feature")
def a13_json_artefact(d):
    """The feature schema as JSON."""
    path = f"{_folder(d, 'schema')}/feature_schema.json"
    tsv.write_json(features.SCHEMA, path)
    return d.s1.sparkSession.createDataFrame(list(enumerate(tsv.read_json(path))), "place int, feature string")


@query("SELECT 0::BIGINT AS different")
def a14_saved_model(d):
    """Pairs that the model, saved and loaded, scores otherwise."""
    ready, made = trained(d)
    path = f"{_folder(d, 'model')}/match_model"
    model.save(made.model, path)
    rows = features.features(made.scored.select("s1_id", "cand_id", "label").join(made.candidates.select("s1_id", "cand_id", "provenance"), ["s1_id", "cand_id"]), ready.s1, ready.s2, ready.s3)
    again = model.score(rows, model.load(path)).select("s1_id", "cand_id", F.col("match_probability").alias("p"))
    return made.scored.join(again, ["s1_id", "cand_id"], "left").agg(F.count_if(~F.col("p").eqNullSafe(F.col("match_probability"))).alias("different"))


@query("SELECT sha256('one\ntwo\n') AS sha256 UNION ALL SELECT sha256('three')")
def b16_file_digest(d):
    folder = _folder(d, "digest")
    tsv.write_text("one\ntwo\n", f"{folder}/a.txt")
    tsv.write_text("three", f"{folder}/b.txt")
    return tsv.sha256_of_files(d.s1.sparkSession, [f"{folder}/a.txt", f"{folder}/b.txt"]).select("sha256")


@query("SELECT row_number() OVER (ORDER BY entity_id) AS line, entity_id AS source1_entity_id FROM s1")
def w7_sorted_output(d):
    """The lines of a sorted table of lists, by their place in the file."""
    ready, found = combined(d)
    path = f"{_folder(d, 'sorted')}/lists.tsv"
    tsv.write_match_lists(found, ready.s1, path, single=True)
    lines = found.sparkSession.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text")).where("line > 0 AND text <> ''")
    return lines.select(F.col("line").cast("long").alias("line"), F.split("text", "\t")[0].alias("source1_entity_id"))


def _first_letter(s1: DataFrame, pool: DataFrame) -> DataFrame:
    letter = lambda x, i: x.where("business_name_normalized <> ''").select(F.col("entity_id").alias(i), F.substring("business_name_normalized", 1, 1).alias("letter"))
    return letter(s1, "s1_id").join(letter(pool, "cand_id"), "letter").select("s1_id", "cand_id").distinct()


@query(f""", weighed AS (SELECT s1_id, cand_id, 100 AS weight FROM j1 UNION ALL SELECT a.entity_id, b.entity_id, 1 FROM s1 a JOIN pool b ON substr(a.business_name_normalized, 1, 1) = substr(b.business_name_normalized, 1, 1) WHERE a.business_name_normalized <> '')
SELECT * FROM (SELECT s1_id, cand_id, sum(weight)::INTEGER AS score FROM weighed GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) <= {MAX_CANDIDATES}""")
def j0_own_strategy(d):
    """A strategy of the caller's beside one of ours."""
    ready = prepared(d)
    blocking.register("first_letter", _first_letter)
    try:
        return stored(blocking.candidates(ready.s1, ready.s2, ready.s3, ["exact_name", "first_letter"]).select("s1_id", "cand_id", "score"), "own")
    finally:
        del blocking.REGISTRY["first_letter"]
