"""Pairs in tiles: the same results as joins, without a shuffle of pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from entwine.functions.text import preprocess
from entwine.operators import blocking, labels, metrics, tiles
from entwine.schema import STRATEGIES

RECORD = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def sources(spark):
    draw = random.Random(3)
    words = ["north", "south", "trading", "works", "steel", "harbour", "group", "silver", "stone"]
    name = lambda: " ".join(draw.choice(words) for _ in range(draw.randrange(4))) + draw.choice(["", " Ltd", f" {draw.randrange(30)}"])
    one = lambda s, i: (f"S{s}-{i}", name(), f"{draw.randrange(5)} {draw.choice(words)} Rd {10000 + draw.randrange(9)}", draw.choice(["US", "CA", ""]))
    return [preprocess(spark.createDataFrame([one(s, i) for i in range(n)], RECORD)) for s, n in ((1, 60), (2, 80), (3, 70))]


@pytest.fixture
def cut_fine(monkeypatch):
    """Blocks of a few hundred keys, chunks of a few cells, so that even small tables make many tiles."""
    for name, value in (("ENTRIES", 3000), ("LEAST", 600), ("CELLS", 100)):
        monkeypatch.setattr(tiles, name, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ngram_neighbours_shuffle_no_pairs(sources, cut_fine, monkeypatch):
    s1, pool = sources[0], blocking.candidate_pool(*sources[1:])
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(blocking.char_ngram_scores(s1, pool))
    monkeypatch.setattr(blocking, "PLAIN", 0)
    got = blocking.char_ngram_scores(s1, pool)
    assert rows(got) == want
    assert not re.search(r"hashpartitioning\(q#\d+L, p#", plan(got))


@pytest.mark.parametrize("limit", [1, 4, 50])
def test_candidates_in_tiles_are_those_of_joins(limit, sources, cut_fine, monkeypatch):
    """All strategies and one of the caller's, with few and with many hot keys; no shuffle by pairs."""
    monkeypatch.setitem(blocking.REGISTRY, "own", lambda s1, pool: blocking.postal(s1, pool).union(s1.select("entity_id", F.lit("elsewhere"))))
    for name, cap in (("country_name_token", 9), ("address_token", 20)):
        monkeypatch.setitem(blocking.KEYED, name, blocking.Keyed(getattr(blocking, name), blocking.KEYED[name].keys, blocking.KEYED[name].counted, cap))
        monkeypatch.setattr(getattr(blocking, name), "__defaults__", (cap,))
    s1, s2, s3 = sources
    s1 = s1.unionByName(s1.limit(3).withColumn("business_name_normalized", F.lit("steel works")))
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(blocking.candidates(s1, s2, s3, limit=limit))
    every = rows(blocking.union(s1, blocking.candidate_pool(s2, s3), list(blocking.REGISTRY))) if limit == 4 else None
    monkeypatch.setattr(blocking, "HOT", 0)
    got = blocking.candidates(s1, s2, s3, limit=limit)
    assert rows(got) == want
    assert not re.search(r"hashpartitioning\(s1_id#\d+, cand_id#", plan(got))
    if every:
        assert rows(blocking.union(s1, blocking.candidate_pool(s2, s3), list(blocking.REGISTRY))) == every


def test_recall_in_tiles_is_that_of_joins(spark, sources, cut_fine):
    """Truth with an entity in two rows, one without matches, and pairs that no strategy has; no join by pairs."""
    s1, pool = sources[0], blocking.candidate_pool(*sources[1:])
    rows = [(f"S1-{i}", ",".join(f"S{2 + j % 2}-{j}" for j in range(i % 4, 60, 5))) for i in range(0, 60, 2)] + [("S1-0", "S2-1,S2-2"), ("S1-1", ""), ("S1-3", "gone")]
    truth = spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string")
    want = metrics.strategy_recall(blocking.by_strategy(s1, pool, STRATEGIES), labels.truth_pairs(truth))
    got = blocking.strategy_recall(s1, pool, STRATEGIES, labels.truth_lists(truth))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "cand_id" not in plan(got).split("FlatMapCoGroupsInArrow")[0]
