import pytest
from pyspark.sql import functions as F

from entwine.functions.text import preprocess
from entwine.operators import blocking, features, labels, metrics

RECORD = "entity_id string, business_name string, business_address string, country string"


def records(spark, rows):
    return preprocess(spark.createDataFrame(rows, RECORD))


def pairs(df):
    return {(r["s1_id"], r["cand_id"]) for r in df.collect()}


@pytest.fixture(scope="module")
def small(spark):
    s1 = records(spark, [("S1-1", "Maple Tools Ltd", "1 A Road 70001", "CA"), ("S1-2", "", "", ""), ("S1-3", "maple tools", "", "ca")])
    s2 = records(spark, [("S2-1", "Maple Tools, Ltd.", "9 B Road 70001", "CA"), ("S2-2", "Birch Works", "3 C 30303", "CA"), ("S2-3", "Maple-Tools Ltd", "", "FR"), ("X", "Maple Tools", "", "CA")])
    s3 = records(spark, [("S3-1", "MAPLE TOOLS LTD", "70001", "CA"), ("S3-2", "Cedar", "40404", "CA"), ("X", "Other", "", "CA")])
    return s1, s2, s3


def test_pool_prefers_the_second_source(small):
    pool = blocking.candidate_pool(small[1], small[2])
    got = {r["entity_id"]: (r["candidate_source"], r["business_name"]) for r in pool.collect()}
    assert got["X"] == ("s2", "Maple Tools") and len(got) == 6


def test_exact_name_and_postal(small):
    pool = blocking.candidate_pool(small[1], small[2])
    names = pairs(blocking.exact_name(small[0], pool))
    assert {c for s, c in names if s == "S1-1"} == {"S2-1", "S2-3", "S3-1", "X"}
    assert {c for s, c in names if s == "S1-3"} == {"S2-1", "S2-3", "S3-1", "X"}
    assert not any(s == "S1-2" for s, _ in names)
    assert pairs(blocking.postal(small[0], pool)) == {("S1-1", "S2-1"), ("S1-1", "S3-1")}


def test_token_caps_count_occurrences_or_records(spark):
    s1 = records(spark, [("S1-1", "foo bar", "foo street", "us")])
    pool = records(spark, [(f"S2-{i}", "foo foo", "foo foo", "us") for i in range(3)]).withColumn("candidate_source", F.lit("s2"))
    assert len(pairs(blocking.country_name_token(s1, pool, cap=6))) == 3
    assert pairs(blocking.country_name_token(s1, pool, cap=5)) == set()
    assert len(pairs(blocking.address_token(s1, pool, cap=3))) == 3
    assert pairs(blocking.address_token(s1, pool, cap=2)) == set()


def test_combine_order_provenance_and_cap(spark):
    rows = [("S1-1", c, "exact_name") for c in ("S3-4", "S2-7", "S2-8")] + [("S1-1", c, "postal") for c in ("S2-88", "S3-4", "S2-7")] + [("S1-1", "S2-7", "postal"), ("S1-1", "N", "new")]
    found = spark.createDataFrame(rows, "s1_id string, cand_id string, strategy string")
    got = blocking.combine(found).orderBy("rank").collect()
    assert [r["cand_id"] for r in got] == ["S2-7", "S3-4", "S2-8", "S2-88", "N"]
    assert got[0]["provenance"] == ["exact_name", "postal"] and got[0]["score"] == 150 and got[4]["score"] == 1
    assert [r["cand_id"] for r in blocking.combine(found, 3).orderBy("rank").collect()] == ["S2-7", "S3-4", "S2-8"]


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_hot_keys_bring_the_best_candidates(limit, spark, monkeypatch):
    """Names, postal codes and numbers that nearly all records share: the same candidates as with all pairs."""
    import random

    draw = random.Random(8)
    one = lambda s, i: (f"S{s}-{i}", draw.choice(["Twin Peaks Ltd", "twin peaks", f"Own {i % 9} Name"]), f"{draw.randrange(3)} Way {draw.choice([10001, 20002, 20002])}", draw.choice(["US", "CA"]))
    s1, s2, s3 = (records(spark, [one(s, i) for i in range(n)]) for s, n in ((1, 12), (2, 70), (3, 50)))
    names = ["exact_name", "postal", "numeric_address", "country_name_token"]
    rows = lambda: sorted(map(str, blocking.candidates(s1, s2, s3, names, limit).collect()))
    want = rows()
    monkeypatch.setattr(blocking, "HOT", 0)
    assert rows() == want
    assert len(blocking.candidates(s1, s2, s3, ["postal"], limit).collect()) == len(blocking.combine(blocking.by_strategy(s1, blocking.candidate_pool(s2, s3), ["postal"]), limit).collect())


def test_ngram_neighbours_as_brute_force_has_them(spark, monkeypatch):
    """However few postings the first search takes; names alike enough that usual n-grams are left out."""
    import collections
    import math
    import random

    draw = random.Random(6)
    words = ["north", "south", "trading", "works", "steel", "harbour", "company", "group", "silver", "stone"]
    name = lambda: " ".join(draw.choice(words) for _ in range(draw.randrange(1, 4))) + draw.choice(["", f" {draw.randrange(40)}"])
    left, right = [(f"S1-{i:03}", name()) for i in range(40)], [(f"S2-{i:03}", name()) for i in range(150)]
    grams = lambda t: collections.Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))
    df = collections.Counter(g for _, t in right for g in grams(t))
    idf = {g: math.log((1 + len(right)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}

    def vector(t):
        v = {g: n * idf[g] for g, n in grams(t).items() if g in idf}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / length for g, x in v.items()} if length else {}

    theirs, want = {i: vector(t) for i, t in right}, set()
    for i, t in left:
        mine = vector(t)
        order = sorted((-round(sum(x * v.get(g, 0.0) for g, x in mine.items()), 9), j) for j, v in theirs.items())
        want |= {(i, j, place + 1) for place, (s, j) in enumerate(order[:5]) if s < 0}
    s1, pool = (records(spark, [(i, t, "", "") for i, t in rows]) for rows in (left, right))
    for plain, first in ((blocking.PLAIN, 1000), (0, 1000), (0, 5)):
        monkeypatch.setattr(blocking, "PLAIN", plain)
        monkeypatch.setattr(blocking, "FIRST", first)
        assert {(r["s1_id"], r["cand_id"], r["rank"]) for r in blocking.char_ngram_scores(s1, pool, 5).collect()} == want


def test_ngram_neighbours(spark):
    s1 = records(spark, [("S1-1", "acme widgets", "", ""), ("S1-2", "", "", "")])
    pool = records(spark, [("S2-1", "acme widgets", "", ""), ("S2-2", "acme widget", "", ""), ("S2-3", "zzz", "", ""), ("S2-4", "acme widgets", "", "")])
    got = blocking.char_ngram_scores(s1, pool).orderBy("rank").collect()
    assert [r["cand_id"] for r in got] == ["S2-1", "S2-4", "S2-2"] and got[0]["similarity"] == pytest.approx(1)
    assert len(blocking.char_ngram_scores(s1, pool, top=2).collect()) == 2
    assert blocking.char_ngram_scores(s1, pool.limit(0)).collect() == []


NAMES = ("harbour coffee roasters inc", "77 quay street dublin 20177", "ie")


@pytest.mark.parametrize(
    "other,wanted",
    [
        (NAMES, {"name_exact": 1, "name_core_exact": 1, "name_levenshtein": 1.0, "address_jaro_winkler": 1.0, "postal_exact_match": 1, "country_exact_match": 1, "numeric_token_jaccard": 1.0}),
        (("northern steel works", "12 foundry lane 90210", "ie"), {"name_exact": 0, "name_token_jaccard": 0.0, "postal_mismatch": 1, "has_common_numeric_token": 0}),
        (("", "", ""), {"name_missing_candidate": 1, "postal_mismatch": 0, "name_jaro_winkler": 0.0, "name_token_overlap": 0.0, "name_length_ratio": 0.0}),
        (("harbor coffee roasters inc", "77 quay st dublin", "ie"), {"name_token_intersection_count": 3, "name_token_jaccard": 0.6, "name_token_count_difference": 0}),
    ],
)
def test_features(spark, other, wanted):
    s1 = records(spark, [("S1-1", *NAMES)])
    s2, s3 = records(spark, [("S2-1", *other)]), records(spark, [])
    one = spark.createDataFrame([("S1-1", "S2-1", ["postal"]), ("S1-1", "gone", [])], "s1_id string, cand_id string, provenance array<string>")
    got = features.features(one, s1, s2, s3)
    assert got.columns[:47] == features.SCHEMA and len(features.SCHEMA) == 47
    row = got.collect()
    assert len(row) == 1 and {k: row[0][k] for k in wanted} == pytest.approx(wanted)
    assert (row[0]["blocked_by_postal"], row[0]["blocked_by_exact_name"], row[0]["candidate_source_is_s2"]) == (1, 0, 1)
    with pytest.raises(KeyError):
        features.test_features(one, s1, s2, s3, ["nothing"])


def test_split_sizes_and_stability(spark):
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in range(10)], "entity_id string")
    got = labels.entity_split(s1).collect()
    assert sum(r["is_validation"] for r in got) == 2 and len(got) == 10
    assert sorted(got) == sorted(labels.entity_split(s1.repartition(7)).collect())


def truth(spark, *rows):
    return labels.truth_pairs(spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string"))


CANDIDATES = "s1_id string, cand_id string, rank int, provenance array<string>"


def test_labels(spark):
    known = truth(spark, ("S1-1", "S2-1,S3-1"), ("S1-2", "S2-2"), ("S1-3", " "), ("S1-4", ",,"))
    found = spark.createDataFrame([("S1-1", "S2-1", 1, []), ("S1-1", "S2-2", 2, []), ("S1-2", "S3-1", 1, [])], CANDIDATES)
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    assert tuple(labels.label_counts(found, known, s1).first()) == (3, 1, 2)
    assert pairs(labels.missed(found, known)) == {("S1-1", "S3-1"), ("S1-2", "S2-2")}
    assert pairs(labels.positives(found, known)) == {("S1-1", "S2-1")}


def test_negative_samples(spark):
    known = truth(spark, ("S1-1", "S2-1"))
    s1 = records(spark, [("S1-1", "red fox", "", ""), ("S1-2", "", "", "")])
    pool = records(spark, [(f"S2-{i}", "red fox" if i == 9 else f"n{i}", "", "") for i in range(1, 10)])
    found = spark.createDataFrame([(s, f"S2-{i}", i, []) for s in ("S1-1", "S1-2") for i in range(1, 10)], CANDIDATES)
    got = labels.sample_negatives(found, known, s1, pool, 2, 1).collect()
    mine = [r for r in got if r["s1_id"] == "S1-1"]
    assert len(mine) == 3 and len({r["cand_id"] for r in mine}) == 3 and "S2-1" not in {r["cand_id"] for r in mine}
    assert any(r["cand_id"] == "S2-9" for r in mine)
    assert [r["kind"] for r in got if r["s1_id"] == "S1-2"] == ["random", "random"]


def test_entity_metrics(spark):
    preds = spark.createDataFrame([("b", "S2-1"), ("d", "S2-1"), ("d", "S2-2")], "s1_id string, cand_id string")
    known = spark.createDataFrame([("c", "S2-1"), ("d", "S2-1"), ("d", "S3-1")], "s1_id string, cand_id string")
    entities = spark.createDataFrame([(x,) for x in "abcd"], "s1_id string")
    got = {r["s1_id"]: (r["precision"], r["recall"], r["f0_5"]) for r in metrics.entity_metrics(preds, known, entities).collect()}
    assert got == {"a": (1, 1, 1), "b": (0, 0, 0), "c": (0, 0, 0), "d": (0.5, 0.5, 0.5)}
    assert metrics.macro_metrics(preds, known, entities).first()["f0_5"] == pytest.approx(1.5 / 4)
    assert tuple(metrics.macro_metrics(preds, known, entities.limit(0)).first()) == (0, 0, 0, 0)


def test_boosted_trees_follow_their_schedule():
    """Splits are the best there are, leaves and rows are bounded, and the fit stops by its patience."""
    import numpy as np

    from entwine.operators.boosting import Schedule, Trees, auc, fit, log_loss

    draw = np.random.default_rng(1)
    x = np.round(draw.random((3000, 6)), 2)
    y = ((x[:, 0] + x[:, 1] > 1) ^ (draw.random(3000) < 0.05)).astype(int)
    made = fit(x[:2000], y[:2000], x[2000:], y[2000:])
    assert len(made) < 500 and all((f < 0).sum() <= 31 for f in made.feature)
    margin = made.margins(x[2000:])
    assert auc(margin, y[2000:]) > 0.9 and log_loss(margin, y[2000:]) < 0.35
    # the first split of one tree, by brute force
    one = fit(x[:300], y[:300], plan=Schedule(rounds=1, leaves=2, columns=1.0))
    g = (0.5 - y[:300]) * np.where(y[:300] == 1, (300 - y[:300].sum()) / y[:300].sum(), 1.0)
    h = 0.25 * np.where(y[:300] == 1, (300 - y[:300].sum()) / y[:300].sum(), 1.0)
    gains = {(f, t): sum(g[m].sum() ** 2 / h[m].sum() for m in (x[:300, f] <= t, x[:300, f] > t)) for f in range(6) for t in np.unique(x[:300, f])[:-1] if 20 <= (x[:300, f] <= t).sum() <= 280}
    f, t = one.feature[0][0], one.threshold[0][0]
    best = max(gains.values())
    assert gains[(f, max(v for v in np.unique(x[:300, f]) if v <= t))] == pytest.approx(best)
    # leaves of each row by walking down, and the same in batches
    def walk(row):
        total = made.base
        for f, t, left, right, v in zip(made.feature, made.threshold, made.left, made.right, made.value, strict=True):
            at = 0
            while f[at] >= 0:
                at = left[at] if row[f[at]] <= t[at] else right[at]
            total += v[at]
        return total

    assert made.margins(x[:50], 7) == pytest.approx([walk(r) for r in x[:50]])
    assert len(fit(x[:10], np.ones(10))) == 0 and Trees(0.3).probabilities(x[:3]) == pytest.approx(np.full(3, 1 / (1 + np.exp(-0.3))))


SCORED = "s1_id string, cand_id string, label int, match_probability double"


def test_thresholds(spark):
    scored = spark.createDataFrame([("S1-1", "S2-1", 1, 0.9), ("S1-1", "S2-2", 0, 0.4), ("S1-2", "S2-3", 1, 0.6), ("S1-3", "S2-4", 0, 0.07), ("S1-3", "S2-5", 0, 1.0)], SCORED)
    sets = lambda t: {r["s1_id"]: r["matches"] for r in metrics.match_sets(scored, t).collect()}
    assert sets(0.5) == {"S1-1": ["S2-1"], "S1-2": ["S2-3"], "S1-3": ["S2-5"]}
    assert sets(0.95) == {"S1-1": [], "S1-2": [], "S1-3": ["S2-5"]}
    known = scored.where("label = 1").select("s1_id", "cand_id")
    entities = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",), ("S1-9",)], "s1_id string")
    grid = metrics.search_thresholds(scored, known, entities).orderBy("threshold").collect()
    assert len(grid) == 101
    for row in grid:
        t = row["threshold"]
        at = metrics.apply_threshold(scored, round(t * 100) * 0.01)
        want = metrics.macro_metrics(at, known, entities.where("s1_id <> 'S1-9'")).first() if t in (0.0, 0.07, 0.4, 0.41, 0.6, 0.9, 1.0) else None
        if want:
            assert (row["precision"], row["recall"], row["f0_5"], row["predicted_match_count"]) == pytest.approx((want["precision"], want["recall"], want["f0_5"], at.count()))
    assert metrics.best_threshold(metrics.search_thresholds(scored, known, entities)) == 0.41
    everyone = metrics.search_thresholds(scored, known, entities, include_uncandidated=True).where("threshold = 0.5").first()
    assert everyone["f0_5"] == pytest.approx((1 + 1 + 0 + 1) / 4)


def test_pair_and_ranking_metrics(spark):
    scored = spark.createDataFrame([("a", "1", 1, 0.9), ("a", "2", 0, 0.8), ("b", "3", 1, 0.8), ("b", "4", 0, 0.1)], SCORED)
    got = metrics.ranking_metrics(scored).first()
    assert got["roc_auc"] == pytest.approx(0.875) and got["pr_auc"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    at = metrics.pair_metrics(scored, 0.5).first()
    assert (at["precision"], at["recall"]) == pytest.approx((2 / 3, 1))
    assert metrics.ranking_metrics(scored.where("label = 0")).first()["roc_auc"] is None
    assert metrics.ranking_metrics(scored.limit(0)).first()["log_loss"] is None
    many = spark.range(5000).selectExpr("'a' AS s1_id", "string(id) AS cand_id", "int(id % 7 = 0 OR id % 11 = 3) AS label", "(id * 37 % 1009) / 1009D AS match_probability")
    y, p = zip(*[(r["label"], r["match_probability"]) for r in many.collect()], strict=True)
    order = sorted(range(5000), key=lambda i: -p[i])
    area, seen, precision, at = 0.0, [0, 0], 0.0, 0
    while at < 5000:
        step = [i for i in order[at : at + 20] if p[i] == p[order[at]]]
        pos = sum(y[i] for i in step)
        area += (len(step) - pos) * (seen[1] + pos / 2)
        seen = [seen[0] + len(step) - pos, seen[1] + pos]
        precision += pos * seen[1] / sum(seen)
        at += len(step)
    got = metrics.ranking_metrics(many).first()
    assert got["roc_auc"] == pytest.approx(area / (seen[0] * seen[1])) and got["pr_auc"] == pytest.approx(precision / seen[1])
    none = metrics.pair_metrics(scored.limit(0), 0.5).first()
    assert (none["precision"], none["recall"], none["f0_5"]) == (0, 0, 0)
