from pathlib import Path

import duckdb
import pytest

from entwine.functions.session import stored
from entwine.plans import adapter, pipeline, registry


@pytest.fixture(scope="module", autouse=True)
def shared_steps():
    """The steps that many queries begin with are made once for all of them."""
    patch, made = pytest.MonkeyPatch(), {}
    for name in ("prepared", "combined", "scored", "trained"):
        step = getattr(registry, name)
        patch.setattr(registry, name, lambda d, name=name, step=step: made[name] if name in made else made.setdefault(name, step(d)))
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


#: Nothing is to be found by these, whatever the tables.
EMPTY = {"j11_subset_violations"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - EMPTY))
def test_sql_has_rows(name, data):
    """An equal result that is empty shows nothing."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{Path(data).parent}/sf0.01/pages.parquet')")
    assert con.execute(f"SELECT count(*) FROM ({registry.ORACLES[name]})").fetchone()[0] > 0


def test_trained_scores_tell_matches(spark, data):
    d = adapter.normalised(spark, f"{Path(data).parent}/sf0.01")
    made = pipeline.train(pipeline.Prepared(*[stored(s, "prepared") for s in (d.s1, d.s2, d.s3)]), d.truth)
    scores = made.scored.toPandas()
    assert scores["match_probability"].between(0, 1).all()
    # better than chance by far: the names tell nearly all
    pos, neg = (scores[scores["label"] == i]["match_probability"].to_numpy() for i in (1, 0))
    assert ((pos[:, None] > neg[None]) + (pos[:, None] == neg[None]) / 2).mean() > 0.9
    assert made.metadata["roc_auc"] > 0.9


def test_trained_queries(spark, data):
    assert registry.QUERIES["m7_gbt_scores"](spark, data).where("match_probability BETWEEN 0 AND 1").count() > 0
    lists = registry.QUERIES["m15_match_lists"](spark, data)
    assert lists.count() == lists.select("source1_entity_id").distinct().count()
    gains = registry.QUERIES["m9_importance"](spark, data).collect()
    assert len(gains) == 47 and sum(r["splits"] for r in gains) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
