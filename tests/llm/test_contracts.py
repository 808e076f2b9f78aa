"""Each query over whole tables: against SQL, or against brute force."""

import unicodedata
from pathlib import Path

import pytest
import xxhash

from entwine.llm import queries

import tests.llm.helpers as h


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


def documents(oracle):
    return oracle.execute("SELECT doc_id, text FROM documents").fetchall()


def test_language_id(spark, data, oracle):
    rows = {r["doc_id"]: r for r in queries.op2_language_id(spark, data).collect()}
    true = dict(oracle.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert rows.keys() == true.keys()
    assert all(r["held_out"] == h.held(i, 3, 1) and 0 <= r["score"] <= 1 for i, r in rows.items())
    unseen = [i for i in rows if rows[i]["held_out"]]
    assert sum(rows[i]["lang_pred"] == true[i] for i in unseen) >= 0.95 * len(unseen)


def test_language_counts_as_brute_force_has_them(spark, data, oracle):
    """The corrected counts of the filters against exact sets of trigrams."""
    rows = oracle.execute("SELECT doc_id, text, lang FROM documents").fetchall()
    of = h.language_counts([r for r in rows if not h.held(r[0], 3, 1)])
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, data).collect()}
    for i, text, _ in rows:
        exact, n = of(text)
        if n < 20:
            continue
        best = max(exact.values())
        assert exact[got[i]["lang_pred"]] >= best - 0.02 * n
        assert got[i]["coverage"] == pytest.approx(best / n, abs=0.03) and got[i]["score"] == pytest.approx(best / sum(exact.values()), abs=0.03)


def test_quality(spark, data, oracle):
    rows = {r["doc_id"]: r for r in queries.op4_quality(spark, data).collect()}
    true = dict(oracle.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert len(rows) == len(documents(oracle))
    assert all(r["held_out"] == h.held(i, 4, 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    unseen = [i for i in true if i in rows and rows[i]["held_out"]]
    assert sum(rows[i]["predicted"] == true[i] for i in unseen) >= 0.85 * len(unseen)


def test_lm_scores(spark, data, oracle):
    rows = queries.op5_lm_scoring(spark, data).collect()
    got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    want = h.unigram_scores(documents(oracle))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9, abs=1e-5)
    assert {r["doc_id"]: r["score"] for r in rows} == pytest.approx(h.ngram_scores(documents(oracle)), rel=1e-4, abs=1e-3)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_near_duplicates(spark, data, oracle):
    got = {r["doc_id"]: r["class_id"] for r in queries.op3_neardup(spark, data).collect()}
    assert got == h.near_classes(documents(oracle))


def test_decontamination(spark, data, oracle):
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_decontaminate(spark, data).collect()}
    assert got == h.leaked(documents(oracle), oracle.execute("SELECT item_id, text FROM benchmark").fetchall())


def fingerprint(text):
    canon = " ".join(unicodedata.normalize("NFC", text).casefold().split())
    seeds = [xxhash.xxh64_intdigest(x, 42) for x in ("a", "b")]
    return "".join(f"{xxhash.xxh64_intdigest(canon.encode(), s):016x}" for s in seeds)


def test_fingerprints(spark, data, oracle):
    import hashlib

    docs = sorted(((i, t or "") for i, t in documents(oracle)), reverse=True)
    got = {r["doc_id"]: r for r in queries.op10_fingerprints(spark, data).collect()}
    assert len(got) == len(docs)
    for at, (i, text) in enumerate(docs):
        following = docs[(at + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own, changed = fingerprint(text), fingerprint(edited)
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, float(own == changed), float(own == fingerprint(following)))
        assert tuple(got[i][c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_is_near_its_targets(sf, spark, data):
    """Within a hundredth for every source that has thirty documents; for others within half of one."""
    rows = queries.op8_mixing(spark, f"{Path(data).parent}/{sf}").collect()
    taken, goal, size, n = {}, {}, {}, {}
    for r in rows:
        s = r["source"]
        taken[s], n[s] = taken.get(s, 0) + r["taken"], n.get(s, 0) + 1
        goal[s], size[s] = r["target"], max(size.get(s, 0), r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert sum(goal.values()) == pytest.approx(sum({r["source"]: r["source_size"] for r in rows}.values()))
    assert all(abs(taken[s] - goal[s]) <= (0.01 * goal[s] if n[s] >= 30 else max(0.01 * goal[s], size[s] / 2)) for s in goal)
    if sf == "sf0.001":
        assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op8_mixing(spark, data).collect()))


def test_pipeline(spark, data, oracle):
    import corpus_pipeline
    from entwine.functions.session import stored

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, texts = docs.columns, dict(documents(oracle))
    left = {"start": set(texts)}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data))
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        left[name] = set(ids)
        assert len(ids) == len(left[name])
        if name != "mixing":
            assert docs.columns == columns
    steps = list(left.values())
    assert all(b <= a for a, b in zip(steps, steps[1:], strict=False))
    assert len(left["language_id"]) >= 0.97 * len(texts)
    classes = h.near_classes([(i, texts[i]) for i in left["quality"]])
    assert left["neardup"] == {i for i, c in classes.items() if i == c}
    items = oracle.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert left["decontaminate"] == left["neardup"] - {d for d, _ in h.leaked([(i, texts[i]) for i in left["neardup"]], items)}
    assert left["mixing"] == left["decontaminate"]
