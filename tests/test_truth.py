"""Ground truth by its distinct lists: the same results as by its pairs, which are never made."""

import random

import duckdb
import numpy as np
import pytest

from entwine.operators import labels, metrics, tiles
from entwine.plans import adapter, registry

TABLE = "source1_entity_id string, matched_entity_ids string"
rows = lambda df: sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def known(spark):
    """Lists that many have, rows of one id, blank lists and a null."""
    many = ",".join(f"S{2 + i % 2}-{i}" for i in range(30))
    table = [(f"S1-{i}", many) for i in range(40)] + [("S1-3", "S2-90,S3-91"), ("S1-4", many), ("S1-5", "S2-90,S3-91"), ("S1-50", "S2-1"), ("S1-51", " "), ("S1-52", None), ("S1-53", ",,")]
    df = spark.createDataFrame(table, TABLE)
    return labels.truth_pairs(df), labels.factored(df), labels.truth_entities(df)


@pytest.fixture(scope="module")
def pairs(spark):
    draw = random.Random(5)
    made = {(f"S1-{draw.randrange(56)}", f"S{draw.choice((2, 3))}-{draw.choice((draw.randrange(40), 90, 91))}") for _ in range(400)}
    return spark.createDataFrame([(a, b, i % 50 + 1, ["postal"], i % 101 / 100) for i, (a, b) in enumerate(sorted(made))], "s1_id string, cand_id string, rank int, provenance array<string>, match_probability double")


def test_equal_lists_are_kept_once(known):
    plain, truth, _ = known
    assert rows(truth.entities.join(truth.members, "list").select("s1_id", "cand_id")) == rows(plain)
    assert plain.count() > 1200 and truth.members.count() == 30 + 2 + 1 + 32 and truth.entities.count() == 42


def test_measures_by_lists_are_those_by_pairs(known, pairs, spark):
    plain, truth, entities = known
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in (1, 2, 3, 3, 50, 51, 99)], "entity_id string")
    for f in (
        lambda t: labels.labelled(pairs, t),
        lambda t: labels.positives(pairs, t),
        lambda t: labels.negatives(pairs, t),
        lambda t: labels.label_counts(pairs, t, s1),
        lambda t: metrics.blocking_recall(pairs, t),
        lambda t: metrics.candidate_recall(pairs, t),
        lambda t: metrics.entity_metrics(pairs, t, entities),
        lambda t: metrics.search_thresholds(pairs, t, entities),
    ):
        assert rows(f(truth)) == rows(f(plain))
    hits = {(r.s1_id, r.cand_id) for r in plain.collect()} & {(r.s1_id, r.cand_id) for r in pairs.collect()}
    assert {(r.s1_id, r.cand_id) for r in labels.positives(pairs, truth).collect()} == hits
    none = labels.factored(spark.createDataFrame([("S1-1", "")], TABLE))
    assert tuple(metrics.blocking_recall(pairs, none).first()) == (0, 0, 0, 0)


def test_lists_of_pages_are_those_of_sql(spark, tmp_path):
    """Also of ids that several records have, with different titles or without one; and no pair of records is shuffled."""
    titles = ["North Works", "north works!", "Steel", "123", "", "Stone"]
    page = lambda i, t: (i, f"http://a{i}.org/", f'<html lang="en"><title>{titles[t]}</title></html>')
    table = [page(i, i % 5) for i in range(60)] + [page(0, 2), page(0, 2), page(3, 4), page(6, 5), page(7, 5)]
    spark.createDataFrame(table, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    truth = adapter.sources(spark, str(tmp_path)).truth
    assert sorted(map(tuple, truth.collect())) == sorted(db.sql(registry.ORACLES["a2_truth_scan"]).fetchall())
    assert "cand_id" not in truth._jdf.queryExecution().executedPlan().toString()


def test_best_of_a_row_without_a_sort():
    draw = np.random.default_rng(7)
    for limit in (1, 3, 50):
        row = np.sort(draw.integers(0, 9, 300))
        grade = draw.integers(0, 4, 300)
        want = np.concatenate([np.flatnonzero(row == r)[np.argsort(grade[row == r], kind="stable")[:limit]] for r in range(9)])
        assert sorted(want) == list(np.flatnonzero(tiles._best(row, 9, grade, 4, limit)))
    assert not len(tiles._best(np.zeros(0, int), 2, np.zeros(0, int), 4, 3))
