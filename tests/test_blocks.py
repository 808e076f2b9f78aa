"""Blocks of tiles are written once and read by every task; what they were made of goes."""

import random

import pytest

from entwine.functions import session
from entwine.functions.text import preprocess
from entwine.operators import blocking, tiles


@pytest.fixture(scope="module")
def sources(spark):
    draw = random.Random(4)
    words = ["north", "south", "steel", "group", "silver"]
    one = lambda s, i: (f"S{s}-{i}", " ".join(draw.choice(words) for _ in range(3)), f"{draw.randrange(9)} Rd 1000{draw.randrange(9)}", "US")
    return [preprocess(spark.createDataFrame([one(s, i) for i in range(50)], "entity_id string, business_name string, business_address string, country string")) for s in (1, 2, 3)]


def test_right_rows_are_written_once_and_nothing_is_shuffled_after(sources, monkeypatch):
    """With many blocks of either side: before, every row was shuffled once for each block of the other side."""
    for name, value in (("ENTRIES", 200), ("LEAST", 100)):
        monkeypatch.setattr(tiles, name, value)
    s1, pool = sources[0], blocking.candidate_pool(*sources[1:])
    want = sorted(map(str, blocking.combine(blocking.by_strategy(s1, pool), 7).collect()))
    written = []
    keep = tiles.stored
    monkeypatch.setattr(tiles, "stored", lambda df, name: written.append(keep(df, name)) or written[-1])
    got = blocking.Sharing(s1, pool, list(blocking.REGISTRY)).best(7)
    assert sorted(map(str, got.collect())) == want
    assert len(written[-1].inputFiles()) > 3 and written[-1].count() == pool.count()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "explode" not in plan and plan.count("Exchange") == 1


def test_ties_between_blocks_go_to_the_lesser_id(spark, monkeypatch):
    """All names of a side equal but for their last word: similarities tie across blocks, also when the table is read in reverse."""
    monkeypatch.setattr(tiles, "ENTRIES", 100)
    monkeypatch.setattr(blocking, "PLAIN", 0)
    names = [("left", "alpha beta gamma")]
    pool = [(f"P-{i:02}", f"alpha beta {chr(97 + i % 26)}{chr(97 + i % 25)}") for i in reversed(range(60))]
    s1, right = (spark.createDataFrame(x, "entity_id string, business_name_normalized string") for x in (names, pool))
    got = blocking.char_ngram_scores(s1, right, top=9).orderBy("rank").collect()
    monkeypatch.setattr(blocking, "PLAIN", 1 << 60)
    want = blocking.char_ngram_scores(s1, right, top=9).orderBy("rank").collect()
    assert [(r.cand_id, r.rank) for r in got] == [(r.cand_id, r.rank) for r in want]


def test_settled_leaves_only_its_result(spark):
    made = []

    def make():
        made.append(session.stored(spark.range(5).toDF("x"), "step"))
        return made[0].where("x > 1")

    before = session.stored(spark.range(2).toDF("x"), "before")
    out = session.settled(make, "settled-test")
    assert sorted(r.x for r in out.collect()) == [2, 3, 4] and before.count() == 2
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(*made[0].inputFiles() or [f"{session.shared_folder(spark)}/step-gone"]).count()
