"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from entwine.llm import chat, decontaminate, fingerprints, language_id, licenses, license_texts, lm_scoring, mixing, neardup, quality, url_filter

import tests.llm.helpers as h

COMMON_LICENSES = Path("/usr/share/common-licenses")

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def labels(spark, rows=((1, 1, 0), (2, 0, 0), (5, 1, 0), (7, None, 0), (None, 1, 0), (9, 0, None), (9, 0, None))):
    return spark.createDataFrame(list(rows), LABELS)


def items(spark, rows=((1, "the cat sat on the mat and saw the dog"), (2, None), (3, ""), (None, "too short"))):
    return spark.createDataFrame(list(rows), ITEMS)


RUNS = {
    "licenses": lambda s, d: licenses.scan(d),
    "language_id": lambda s, d: language_id.identify(d),
    "neardup": lambda s, d: neardup.classes(d),
    "quality": lambda s, d: quality.classify(d, labels(s)),
    "lm_scoring": lambda s, d: lm_scoring.score_documents(d),
    "mixing": lambda s, d: mixing.mix(d),
    "fingerprints": lambda s, d: fingerprints.fingerprint_with_edits(d),
    "fingerprint": lambda s, d: fingerprints.fingerprint(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_each_get_a_row(name, spark):
    rows = RUNS[name](spark, h.frame(spark)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((i is not None, i or 0) for i, *_ in h.ODD)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(name, spark):
    assert RUNS[name](spark, h.frame(spark, [])).collect() == []


def test_language_of_odd_texts(spark):
    rows = {r["doc_id"]: r for r in language_id.identify(h.frame(spark)).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (3, 4, 6, 7, 8))
    assert rows[9]["lang_pred"] != "und"
    nothing = language_id.predict(h.frame(spark), None, "doc_id").collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_bitmask_filters_hold_many_languages(spark):
    rows = [(i * 10 + j, f"{chr(0x4E00 + 40 * i)}{chr(0x4E01 + 40 * i)}{chr(0x4E02 + 40 * i)} " * 5, f"l{i:03}", "a", 1) for i in range(70) for j in range(4)]
    got = language_id.predict(h.frame(spark, rows), language_id.learn(h.frame(spark, rows)), "doc_id", "lang").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_quality_without_labels_or_with_one_class(spark):
    docs = h.frame(spark)
    assert {r["score"] for r in quality.classify(docs, labels(spark, [])).collect()} == {0.5}
    assert {r["score"] for r in quality.classify(docs, labels(spark, [(i, 1, 0) for i in range(20)])).collect()} == {1.0}


def test_language_filters_leave_no_rare_trigram_out(spark):
    """A language of very many trigrams keeps those that occur once; a tie goes to the lesser name."""
    many = " ".join(chr(0x4E00 + i % 20000) + chr(0x4E00 + (i * 7) % 20000) + chr(0x4E00 + (i * 13) % 20000) for i in range(60_000))
    rows = [(1, many, "zh", "a", 1), (2, "plain words here", "en", "a", 1), (3, "both alike", "b", "a", 1), (4, "both alike", "a", "a", 1)]
    filters = language_id.learn(h.frame(spark, rows))
    assert filters.masks.shape[1] >= 8 * 60_000 and filters.false_rate.max() < 0.05
    asked = [(10 + i, many[40 * i : 40 * i + 7], None, "a", 1) for i in range(50)] + [(99, "both alike", None, "a", 1)]
    got = {r["doc_id"]: r for r in language_id.predict(h.frame(spark, asked), filters, "doc_id").collect()}
    assert all(got[10 + i]["lang_pred"] == "zh" and got[10 + i]["coverage"] > 0.5 for i in range(50)) and got[99]["lang_pred"] == "a"


def test_counts_of_trigrams_are_given_out_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language_id, "HELD", 5)
    batch = pa.RecordBatch.from_pydict({"text": ["abc def ghi jkl", "abc xyz", None, "uvw"] * 3, "lang": ["a", "b", "a", "a"] * 3})
    rows = [r for b in language_id._count(iter([batch.filter(pa.compute.is_valid(batch["text"]))] * 2)) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows if r["lang"] == "a") == 6 * (4 * 3 + 3) and sum(r["n"] for r in rows if r["lang"] == "b") == 6 * 6


def test_quality_draws_repeated_rows_once(spark):
    from entwine.functions.session import stored

    rows = [(1, "one and the same text", "en", "a", 1)] * 10_000 + [(i, f"text of number {i} {'good words' if i % 2 else 'bad words'}", "en", "a", 1) for i in range(2, 60)]
    drawn = []
    original = quality.stored
    try:
        quality.stored = lambda df, name="table": drawn.append((name, original(df, name))) or drawn[-1][1]
        quality.learn(h.frame(spark, rows), labels(spark, [(i, i % 2, 0) for i in range(1, 60)]))
    finally:
        quality.stored = original
    assert dict(drawn)["quality-vectors"].count() == 59


def test_quality_model_as_brute_force_has_it():
    """Log-count ratios by sets of features, and the descent's solution against a projected gradient on the dual."""
    import numpy as np
    import pyarrow as pa

    from entwine.llm import kernels as k

    draw = np.random.default_rng(2)
    texts = [" ".join(draw.choice(["good", "fine", "bad", "poor", "so", "so"], 6)) + (" yes" if i % 2 else " no") for i in range(40)]
    label = np.array([i % 2 for i in range(40)])
    reader = quality.Reader()
    sets = [reader.features(data[offsets[d] : offsets[d + 1]].copy()) for _, j, data, offsets in k.pieces(pa.array(texts), False) for d in range(j)]
    assert all(len(set(s.tolist())) == len(s) for s in sets)
    assert sum(x < 256 for x in sets[0]) == len(set(texts[0])) and sum(256 <= x < 256 + 65536 for x in sets[0]) == len({texts[0][i : i + 2] for i in range(len(texts[0]) - 1)})
    both = np.zeros((2, quality.FEATURES))
    for s, y in zip(sets, label, strict=True):
        both[y, s] += 1
    ratio = quality.log_count_ratio(both)
    one = sets[0][0]
    want = np.log((both[1][one] + 1) / (both[1] + 1).sum() / ((both[0][one] + 1) / (both[0] + 1).sum()))
    assert ratio[one] == pytest.approx(want)
    sign = np.where(label == 1, 1.0, -1.0)
    x = np.zeros((40, quality.FEATURES))
    for row, s in zip(x, sets, strict=True):
        row[s] = ratio[s] / np.sqrt((ratio[s] ** 2).sum())
    gram = (x @ x.T + 1) * np.outer(sign, sign)
    dual = np.zeros(40)
    for _ in range(20_000):
        dual = np.clip(dual - 0.02 * (gram @ dual - 1), 0, quality.COST)
    goal = lambda w, b: (w @ w + b * b) / 2 + quality.COST * np.maximum(0, 1 - sign * (x @ w + b)).sum()
    best = goal((dual * sign) @ x, float(dual @ sign))
    assert goal(*quality.descend(sets, sign, ratio)) <= 1.01 * best


def test_lm_scores_of_odd_texts(spark):
    rows = [(i, t) for i, t, *_ in h.ODD]
    got = lm_scoring.score_documents(h.frame(spark)).collect()
    assert [tuple(x[:5]) for x in sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got)] == [w[:5] for w in h.unigram_scores(rows)]
    want = sorted(w[5] for w in h.unigram_scores(rows))
    assert sorted(r["base_score"] for r in got) == pytest.approx(want, abs=1e-5)


def test_files_of_a_folder_that_is_not_mounted(tmp_path, monkeypatch):
    """They are fetched once into the working folder, and mapped there; writing again leaves the same."""
    import numpy as np
    from pyarrow import fs

    from entwine.llm import shared_files

    (tmp_path / "far").mkdir()
    (tmp_path / "here").mkdir()
    far = fs.SubTreeFileSystem(str(tmp_path / "far"), fs.LocalFileSystem())
    monkeypatch.setattr(shared_files, "_at", lambda uri: (far, uri.removeprefix("far://")))
    monkeypatch.chdir(tmp_path / "here")
    for _ in range(2):
        uri = shared_files.put("far://lm/x.bin", {"a": np.arange(5), "b": np.zeros(0)})
    got = shared_files.arrays_of(uri)
    assert got["a"].tolist() == [0, 1, 2, 3, 4] and not len(got["b"])
    assert [p.name for p in (tmp_path / "here").iterdir()] == ["fetched-lm-x.bin"] and len(list((tmp_path / "far" / "lm").iterdir())) == 1
    assert shared_files.arrays_of(uri) is got


def test_elias_fano():
    """Access, successors and children against plain arrays."""
    import numpy as np

    from entwine.llm.elias_fano import EliasFano, Level

    draw = np.random.default_rng(0)
    for n, universe in ((1000, 5000), (5, 10**6), (10_000, 20_000), (300, 300), (1, 1), (4000, 1 << 40)):
        values = np.sort(draw.integers(0, universe, n))
        made = EliasFano.of(values, universe)
        assert (made.access(np.arange(n)) == values).all()
        asked = draw.integers(0, universe, 2000)
        at, equal = made.successor(asked)
        assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()
    keys = np.unique(draw.integers(0, 500_000, 3000))
    level = Level.of(keys // 1000, keys % 1000, 501, draw.random(len(keys)), draw.random(len(keys)))
    assert (level.find(keys // 1000, keys % 1000) == np.arange(len(keys))).all()
    asked = draw.integers(0, 500_000, 5000)
    assert ((level.find(asked // 1000, asked % 1000) >= 0) == np.isin(asked, keys)).all()


def test_lm_probabilities_sum_to_one(spark):
    """Over all known words and one unknown, after each context."""
    import numpy as np

    rows = [(i, "a b a b c a b " * (1 + i % 3) + f"w{i % 5}", "en", "a", 1) for i in range(60)]
    of, _, _, _ = lm_scoring.learn(h.frame(spark, rows))
    model = lm_scoring.model_of(of)
    hashes = np.array(model.words.index.hashes)
    for first in range(len(hashes)):
        for second in range(len(hashes)):
            texts = np.stack([np.full(len(hashes) + 1, hashes[first]), np.full(len(hashes) + 1, hashes[second]), np.append(hashes, np.uint64(1 << 40))], 1)
            _, _, logs, _, _ = model.log_probs(texts.reshape(-1), np.arange(0, texts.size + 1, 3))
            logs = logs.reshape(-1, 3)[:, 2] - np.append(np.zeros(len(hashes)), np.log10(model.words.total + model.words.distinct + 1))
            assert (10**logs).sum() == pytest.approx(1, abs=1e-3)


def test_lm_scores_count_every_repeated_ngram(spark, monkeypatch):
    """Bounds of what each worker maps don't change the model: scores are those of all n-grams seen twice."""
    import random

    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(40)))) for i in range(80)]
    want = h.ngram_scores(rows)
    table = h.frame(spark, [(i, t, "en", "a", 1) for i, t in rows])
    for bounds in ((1 << 22, 1 << 26, 1 << 20, 1 << 21), (1 << 22, 1 << 26, 16, 64), (16, 64, 1 << 20, 64), (1 << 22, 64, 8, 64), (1, 1, 1, 64)):
        for name, bound in zip(("WORDS", "GRAMS", "SHARD", "PART"), bounds, strict=True):
            monkeypatch.setattr(lm_scoring, name, bound)
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(table).collect()}
        assert got == pytest.approx(want, abs=1e-5), bounds


def test_near_duplicates_of_one_large_group(spark):
    """Many near copies of a text, of which few are alike enough to each other, are one class."""
    import random

    draw = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base), "en", "a", 1)]
    for i in range(1, 120):
        mine = list(base)
        for at in draw.sample(range(200), 1 + i % 5):
            mine[at] = f"x{i}_{at}"
        rows.append((i, " ".join(mine), "en", "a", 1))
    rows += [(1000 + i, " ".join(f"{c}{i}" for c in base), "en", "a", 1) for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(h.frame(spark, rows)).collect()}
    assert got == h.near_classes([r[:2] for r in rows])


def test_near_duplicates_without_a_middle(spark):
    """Texts around the threshold of each other, of unequal lengths, without one that is like all: classes as brute force has them."""
    import random

    draw = random.Random(9)
    rows = []
    for g in range(6):
        base = [f"b{g}_{i}" for i in range(draw.choice([30, 80, 150]))]
        for i in range(25):
            mine = base[draw.randrange(0, 4) : len(base) - draw.randrange(0, 12)]
            for at in draw.sample(range(len(mine)), draw.randrange(1, 2 + len(mine) // 25)):
                mine[at] = f"own{g}_{i}_{at}"
            rows.append((g * 100 + i, " ".join(mine), "en", "a", 1))
    from entwine.llm import sql

    found = neardup.classes(h.frame(spark, [*rows, (None, None, None, None, None), (None, "", None, None, None), (900, "", None, None, None)]))
    got = {r["doc_id"]: r["class_id"] for r in found.where("doc_id < 900").collect()}
    assert got == h.near_classes([r[:2] for r in rows])
    have = sorted(str((r["class_id"], r["class_size"], r["doc_id"])) for r in found.collect())
    assert have == by_sql(sql.NEARDUP, documents=("doc_id BIGINT, text VARCHAR", [*[r[:2] for r in rows], (None, None), (None, ""), (900, "")]))
    assert 6 < len(set(got.values())) < 150


def test_links_between_groups_by_rarest_elements(spark):
    """All pairs that are alike enough, where no leader has linked any: every text is its own group."""
    import random

    draw = random.Random(4)
    sets = {i: sorted({draw.randrange(40) for _ in range(draw.randrange(1, 34))} | ({100 + i} if i % 3 == 0 else set())) for i in range(160)}
    table = spark.createDataFrame([(i, len(u), [7] * 16, u) for i, u in sets.items()], "key long, size long, bands array<long>, units array<long>")
    entries = table.selectExpr("key", "size", "1L AS bucket")
    roots = spark.createDataFrame([], "node long, root long")
    got = {(r["a"], r["b"]) for r in neardup._remaining(table, entries, roots, table.select("key", "units")).collect()}
    assert got == {(i, j) for i in sets for j in sets if i < j and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}


def test_near_duplicates_name_what_was_checked(spark):
    """Not all pairs of a class are compared, so the column isn't named as if they were."""
    assert neardup.classes(h.frame(spark)).columns == ["doc_id", "class_id", "checked_links", "class_size"]


def test_deduplicate_keeps_one_of_each(spark):
    kept = neardup.deduplicate(h.frame(spark)).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 1, 3, 5, 7, 9, 10]
    assert neardup.deduplicate(h.frame(spark, [])).collect() == []


def test_signatures_estimate_weighted_similarity():
    import numpy as np
    import pyarrow as pa

    from entwine.llm import kernels as k

    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" for i in range(300, 1000))
    for _, j, data, offsets in k.pieces(pa.array([a, b, a, "x y", "x y", ""]), True):
        units, of = neardup.elements(data, offsets)
        s = neardup.signatures(units, of, j)
    assert (s[0] == s[2]).all() and (s[3] == s[4]).all()
    assert (s != 0).all()
    share = np.mean([(neardup.signatures(units, of, j)[0] == neardup.signatures(units, of, j)[1]).mean()])
    assert abs(share - 696 / 996) < 0.2


def test_decontamination_edges(spark):
    docs = h.frame(spark)
    assert {r["doc_id"] for r in decontaminate.leaks(docs, items(spark)).collect()} == {1, 2}
    assert len(decontaminate.leaks(docs, items(spark)).collect()) == 3
    assert decontaminate.leaks(docs, items(spark, [])).collect() == []
    assert decontaminate.leaks(h.frame(spark, []), items(spark)).collect() == []
    kept = decontaminate.clean(docs, items(spark))
    assert kept.columns == docs.columns and kept.count() == len(h.ODD) - 3


def test_decontamination_bears_substitutions(spark):
    item = [f"q{i}" for i in range(30)]
    pad = " ".join(f"p{i}" for i in range(300))
    text = lambda words: f"{pad} {' '.join(words)} {pad}"
    six = [f"z{i}" if i % 5 == 4 else w for i, w in enumerate(item)]
    half = [f"z{i}" if i % 2 else w for i, w in enumerate(item)]
    inserted = item[:15] + ["extra"] + item[15:]
    rows = [(1, text(item)), (2, text(six)), (3, text(half)), (4, text(inserted)), (5, text(item[:8])), (6, text(item).upper().replace(" ", ", "))]
    docs = h.frame(spark, [(i, t, "en", "a", 1) for i, t in rows])
    assert {r["doc_id"] for r in decontaminate.leaks(docs, items(spark, [(1, " ".join(item))])).collect()} == {1, 2, 4, 6}


@pytest.mark.parametrize("broadcast_chars", [decontaminate.BROADCAST_CHARS, 20], ids=["broadcast", "joined"])
def test_decontamination_finds_every_item_with_a_fifth_substituted(broadcast_chars, spark, monkeypatch):
    """Items of 1 to 50 tokens, substitutions at random places; quotes and dashes of Unicode part words."""
    import random

    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", broadcast_chars)
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(4000)}"
    many = [(i, [word() for _ in range(size)]) for i, size in enumerate(list(range(1, 51)) * 6)]
    rows = []
    for i, tokens in many:
        mine = list(tokens)
        for at in draw.sample(range(len(mine)), draw.choice([0, len(mine) // 5, len(mine) // 5])):
            mine[at] = f"sub{at}"
        rows.append((i, " ".join([word() for _ in range(30)]) + " \u201c" + "\u2014".join(mine) + "\u201d " + " ".join(word() for _ in range(30)), "en", "a", 1))
    bench = [(i, " ".join(t)) for i, t in many]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(h.frame(spark, rows), items(spark, bench)).collect()}
    assert {(i, i) for i, t in many} <= got
    long = {i for i, t in bench if t.count(" ") >= 4}
    assert {x for x in got if x[1] in long} == h.leaked([r[:2] for r in rows], bench)


def by_sql(query, **tables):
    """Sorted rows of a query over tables of (columns, rows), by sorted columns."""
    import duckdb

    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    got = con.execute(query)
    names = [c[0] for c in got.description]
    return sorted(str(tuple(r[names.index(c)] for c in sorted(names))) for r in got.fetchall())


def test_leaks_as_sql_has_them(spark):
    """Parts, substitutions, insertions, repeated items and short ones."""
    import random

    from entwine.llm import sql

    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(60)}"
    bench = [(i, " ".join(word() for _ in range(draw.choice([1, 3, 5, 8, 15, 16, 24, 40])))) for i in range(40)] + [(None, "w1 w2 w3 w4 w5"), (90, "W1, w2 w3 w4 w5"), (91, None)]
    rows = []
    for i in range(150):
        mine = (draw.choice(bench)[1] or "").split()
        cut = mine[draw.randrange(0, 4) :] if draw.random() < 0.4 else mine
        mixed = [x for w in cut for x in ([word()] if draw.random() < 0.15 else [w, word()] if draw.random() < 0.05 else [w])]
        rows.append((i, " ".join([word() for _ in range(draw.randrange(20))] + mixed + [word() for _ in range(draw.randrange(20))])))
    found = decontaminate.leaks(h.frame(spark, [(i, t, "en", "a", 1) for i, t in rows]), items(spark, bench))
    got = sorted(str(tuple(r[c] for c in sorted(found.columns))) for r in found.collect())
    assert got == by_sql(sql.LEAKS, documents=("doc_id BIGINT, text VARCHAR", rows), benchmark=("item_id BIGINT, text VARCHAR", bench)) and len(got) > 150


def test_decontamination_joined_as_broadcast(spark, monkeypatch):
    docs = h.frame(spark).withColumn("w1", F.lit(1))
    some = items(spark, [*((i, t) for i, t, *_ in h.ODD if i), (None, "the cat sat on the mat and saw a dog"), (20, "the cat sat on the mat and saw the dog")])
    want = sorted(map(str, decontaminate.annotate(docs, some).selectExpr("doc_id", "text", "array_sort(__leaks)").collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", 0)
    assert sorted(map(str, decontaminate.annotate(docs, some).selectExpr("doc_id", "text", "array_sort(__leaks)").collect())) == want
    assert decontaminate.clean(docs, some).columns == docs.columns


def test_decontamination_with_ids_as_text(spark):
    docs = spark.createDataFrame([("a", "one two three four five six"), (None, "nothing")], "doc_id string, text string")
    bench = spark.createDataFrame([("x", "One two, three four five six!"), (None, "one two three four five six")], "item_id string, text string")
    assert [tuple(r) for r in decontaminate.leaks(docs, bench).collect()] == [("a", "x", 1.0, 0)]


def test_fingerprints_compare_bytes_in_equal_buckets(spark):
    rows = [(i, f"text {i % 40}", "en", "a", 1) for i in range(80)]
    for run in (fingerprints.fingerprint, fingerprints.fingerprint_with_edits):
        got = {r["doc_id"]: r["fingerprint"] for r in run(h.frame(spark, rows), bits=2).collect()}
        assert all((got[a] == got[b]) == (a % 40 == b % 40) for a in got for b in got)


def test_canonical_fingerprint(spark):
    same = ["Straße  café", "STRASSE café ", "\tstrasse\ncafé"]
    rows = [(i, t, "de", "a", 1) for i, t in enumerate([*same, "strasse cafe"])]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(h.frame(spark, rows)).collect()}
    assert got[0] == got[1] == got[2] != got[3]


@pytest.mark.parametrize("ids,kind", [([-5, 0, 1, 2, 3, 10**15, 10**15 + 1, 2**62, None], "long"), (["a", "doc-1", "doc-10", "doc-2", "doc-20", "\u00e9", "z", None], "string"), ([1.5, -2.0, 0.1, None], "double")])
def test_next_document_over_uneven_ids(ids, kind, spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], f"doc_id {kind}, text string")
    got = {r["own"]["doc_id"]: r["next"]["doc_id"] for r in fingerprints.with_next(docs).collect()}
    order = sorted((i for i in ids if i is not None), key=lambda i: i.encode() if kind == "string" else i, reverse=True) + [None]
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_next_document_among_many_rows_of_one_id(spark, monkeypatch):
    """Rows without an id, or of one id, are dealt among ranges by their texts; equal rows follow each other."""
    monkeypatch.setattr(fingerprints, "COPIES", 3)
    rows = [(None, f"t{i}") for i in range(300)] + [(5, f"u{i % 100}") for i in range(300)] + [(i, "v") for i in range(10, 20)] + [(7, None)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["times"] for r in got) == len(rows)
    pairs = [(r["own"], r["next"]) for r in got for _ in range(r["times"])]
    # every row is followed once, ids don't rise but where the first follows the last, and equal rows stand together
    key = lambda x: str((x["doc_id"], x["text"]))
    assert sorted(key(a) for a, _ in pairs) == sorted(key(b) for _, b in pairs)
    rises = [(a["doc_id"], b["doc_id"]) for a, b in pairs if (a["doc_id"] is None and b["doc_id"] is not None) or (a["doc_id"] is not None and b["doc_id"] is not None and b["doc_id"] > a["doc_id"])]
    assert rises == [(None, 19)]
    assert sum(key(a) == key(b) for a, b in pairs) == 200
    assert len(fingerprints.fingerprint_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == len(rows)


def test_parts_with_substitutions_and_short_items_leak(spark):
    item = [f"q{i}" for i in range(59)]
    part = [f"z{i}" if i % 15 == 14 else w for i, w in enumerate(item[:40])]
    few = [f"z{i}" if i % 3 == 2 else w for i, w in enumerate(item[:40])]
    rows = [(1, "a b " + " ".join(part) + " c d"), (2, " ".join(few)), (3, "x Short, ITEM. y"), (4, "short y item"), (5, "short item short item"), (6, " ".join(item[:19]))]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "short item"), (3, ""), (4, "solo"), (5, "..."), (6, "one two three four")], ITEMS)
    table = h.frame(spark, [(i, t, "en", "a", 1) for i, t in [*rows, (7, "Solo"), (8, "one two three four"), (9, "one two three for")]])
    got = sorted((r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.leaks(table, items).collect())
    assert got == [(1, 1, 2), (3, 2, 1), (5, 2, 0), (7, 4, 0), (8, 6, 0)]


def test_mixing_targets(spark):
    """Weights 1, 2, 3 over unequal sources; what passes three times a source is reshared."""
    rows = [("a", 1000), ("b", 10), ("c", 90), (None, 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, words long")).collect()}
    assert got["b"] == 30 and got["c"] == 270 and got["a"] == pytest.approx(800) and got[None] == 0


def test_mixing_with_one_hot_source(spark):
    rows = [(i, "w " * (1 + i % 50), "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(3000)]
    got = mixing.mix(h.frame(spark, rows)).collect()
    taken, goal = {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 0.005 * goal[s] for s in goal)


def test_mixing_takes_larger_documents_with_more_probability(spark):
    """Over many sources that are alike, shares taken by size are as the inclusion probabilities c * size."""
    rows = [(i * 100 + j, "w " * (1 + 3 * (j % 10)), "en", f"s{i:03}", 1) for i in range(60) for j in range(60)]
    got = mixing.mix(h.frame(spark, rows)).collect()
    part = [r for r in got if r["target"] < r["source_size"]]
    share = {z: sum(r["copies"] for r in part if r["size"] == z) / sum(r["size"] == z for r in part) for z in (4, 13, 28)}
    assert share[4] < share[13] < share[28]


def test_mixing_numbers_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TWINS", 7)
    rows = [(None, "same text", "en", "a", 1)] * 50 + [(1, "other words here", "en", "b", 1)] * 3
    got = mixing.mix(h.frame(spark, rows)).collect()
    assert sum(r["doc_id"] is None for r in got) == 50 and len(got) == 53


def test_licenses(spark):
    mit = license_texts.TEXTS["MIT"]
    texts = [
        mit,
        "Copyright (c) 2020 Someone\n\n" + mit.upper(),
        mit.replace("sublicense", "sub-license").replace('"', "“"),
        mit + " And more.",
        "Prose.\nlicensed under the apache licence, version 2.0\n© 2021 A. Body\nReleased under the MIT License.",
        None,
    ]
    got = {r["doc_id"]: r for r in licenses.scan(h.frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])).collect()}
    assert [got[i]["license"] for i in range(6)] == ["MIT"] * 3 + [None] * 3
    assert got[4]["notices"] == "Apache-2.0;MIT" and got[4]["notice_lines"] == 2
    assert [got[i]["digest"] for i in range(6)] == [licenses.digest_of(t or "") for t in texts]


def test_terms_that_begin_with_c_in_brackets_stay(spark):
    """A line is a copyright line by its word, sign or year, not by a letter in brackets."""
    mit = license_texts.TEXTS["MIT"]
    texts = [mit + "\n(c) You may not use this Software for any commercial purpose whatsoever.", "(c) 2001-2020 Someone\n" + mit, "\u00a9 Someone\n" + mit, "Copyright \u00a9 Someone\n" + mit, "* Copyright 1999, Someone\n" + mit]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(h.frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])).collect()}
    assert got == {0: None, 1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT"}


@pytest.mark.parametrize("name", sorted(license_texts.TEXTS))
def test_every_text_is_its_own_license(name, spark):
    assert licenses.known_whole()[licenses.digest_of(license_texts.TEXTS[name])] == name.split(" (")[0]


def test_notices_of_the_caller(spark):
    """Whatever words they have; a line in public-domain's other spelling is found too."""
    notices = {"CC-BY-4.0": "CC BY 4.0", "GPL-3.0": "GPL v3 or later", "PD": "In the public domain"}
    rows = [(1, "Prose.\nCC-BY 4.0\n\ngpl v3, or later", "en", "a", 1), (2, "In the public-domain.", "en", "a", 1), (3, "", "en", "a", 1)]
    got = {r["doc_id"]: (r["notices"], r["notice_lines"]) for r in licenses.scan(h.frame(spark, rows), notices=notices).collect()}
    assert got == {1: ("CC-BY-4.0;GPL-3.0", 2), 2: ("PD", 1), 3: (None, 0)}


@pytest.mark.skipif(not COMMON_LICENSES.is_dir(), reason="no licences on this system")
def test_whole_licenses(spark):
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0-Perl"}
    texts = {f: (COMMON_LICENSES / f).read_text() for f in names}
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts.values())] + [(100, "\n".join(x.strip() for x in texts["GPL-3"].partition("How to Apply")[0].split("\n")), "en", "a", 1)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(h.frame(spark, rows)).collect()}
    assert got == {i: n for i, n in enumerate(names.values())} | {100: "GPL-3.0"}


TURNS = "conv_id long, turn long, role string, text string"


def talk(conv, n, start=0, extra=""):
    return [(conv, start + t, "user" if t % 2 == 0 else "assistant", f"turn {t}{extra if t == n - 1 else ''}") for t in range(n)]


def test_snapshots_collapse(spark):
    rows = talk(1, 2) + talk(2, 4) + talk(3, 6) + talk(4, 6, start=7) + talk(5, 4, extra=" other") + talk(6, 6)[:3]
    got = {r["conv_id"]: r for r in chat.collapse(h.frame(spark, rows, TURNS)).collect()}
    assert got.keys() == {3, 5}
    assert got[3]["copies"] == 2 and got[3]["snapshots"] == 3 and got[5]["snapshots"] == 2
    assert got[5]["rendered"].endswith("<|im_start|>assistant\nturn 3 other<|im_end|>\n")


def test_chat_edges(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (2, 300, "user", "c"), (2, 2, None, "d")]
    got = {r["conv_id"]: r for r in chat.collapse(h.frame(spark, rows, TURNS)).collect()}
    assert got[1]["n_turns"] == 2 and got[2]["rendered"] == "<|im_start|>\nd<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert None in got
    assert chat.collapse(h.frame(spark, [], TURNS)).collect() == []


PAGES = "page_id long, url string, html string"


def test_url_rules_and_edges(spark):
    urls = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "http://example.org", "http://x.com/fr/", "http://x.com/de/#a", "no scheme", None, "http:///p", "http://notorg/"]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(h.frame(spark, [(i, u, None) for i, u in enumerate(urls)], PAGES)).orderBy("page_id").collect()]
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block")
    assert got[2] == ("example.org", "", None, "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("", "/p", None, "allow") and got[8][2:] == (None, "allow")
    assert url_filter.judge(h.frame(spark, [], PAGES)).collect() == []


def test_trust_and_distrust_follow_links(spark):
    link = lambda *to: "".join(f'<a href="https://{t}/x">' for t in to)
    rows = [
        (1, "http://good.org/", link("cited.net")),
        (2, "http://cited.net/a", link("further.net")),
        (3, "http://further.net/a", None),
        (4, "http://bad.com/de/1", link("innocent.net")),
        (5, "http://spammer.net/a", link("bad.com", "bad.com")),
        (6, "http://feeder.net/a", link("spammer.net")),
        (7, "http://innocent.net/a", ""),
        (8, "http://bad.com/en/1", ""),
    ]
    got = {r["page_id"]: r for r in url_filter.judge(h.frame(spark, rows, PAGES)).collect()}
    assert {i for i, r in got.items() if r["verdict"] == "block"} == {4, 5, 6, 8}
    assert got[2]["trust"] > got[3]["trust"] > 0 and got[5]["distrust"] > got[6]["distrust"] > 0 and got[7]["distrust"] == 0


def test_heavy_hosts_meet_their_ranks_apart(spark, monkeypatch):
    """A hub that most pages are of and link to: the same by broadcast, by joins, and by joins without it."""
    link = lambda *to: "".join(f"<a href='//{t}/x'>" for t in to)
    rows = [(i, f"http://{'hub.com' if i % 3 else f'h{i}.net'}/{'de' if i % 5 == 0 else 'x'}/{i}", link("hub.com", f"h{i * 3 % 40}.net", "good.org")) for i in range(60)]
    run = lambda: sorted(map(str, url_filter.judge(h.frame(spark, [*rows, (99, None, None), (98, "http://good.org/", link("hub.com"))], PAGES)).collect()))
    want = run()
    for heavy in (4, 10_000):
        monkeypatch.setattr(url_filter, "SMALL", 0)
        monkeypatch.setattr(url_filter, "HEAVY", heavy)
        assert run() == want


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    """With a tolerance: h0 -> h1 -> ... -> h13 -> a blocked host, and a cycle."""
    hosts = [*(f"h{i}.net" for i in range(14)), "bad.com"]
    rows = [(i, f"http://{a}/p", f"<a href='//{b}/x'>") for i, (a, b) in enumerate(zip(hosts, hosts[1:], strict=False))]
    rows += [(50, "http://bad.com/de/1", None), (60, "http://x.net/", "<a href='//y.net/'>"), (61, "http://y.net/", "<a href='//x.net/'><a href='//bad.com/'>")]
    got = {r["page_id"]: r for r in url_filter.judge(h.frame(spark, rows, PAGES), tolerance=1e-9).collect()}
    assert all(got[i]["verdict"] == "block" and got[i]["distrust"] > 0 for i in range(14))
    # bad.com is linked to by h13 and y; of what y passes on, x gets all, and the other way round
    y = 0.85 * 0.15 / 2 / (1 - 0.85**2)
    assert got[61]["distrust"] == pytest.approx(y, abs=1e-6) and got[60]["distrust"] == pytest.approx(0.85 * y, abs=1e-6)


def test_links_as_sql_has_them(spark, oracle, tmp_path):
    """The graph part of the URL query's SQL, on pages that link to each other."""
    import duckdb

    from entwine.llm import sql

    link = lambda *to: "".join(f"<a href='//{t}/x'>" for t in to)
    rows = [(i, f"http://h{i % 7}.{'org' if i % 3 == 0 else 'com'}/{'de' if i % 2 else 'fr'}/{i}", link(f"h{(i * 3) % 7}.com", f"n{i % 4}.net")) for i in range(40)]
    rows += [(100 + i, f"http://n{i}.net/p", link(f"h{i}.com")) for i in range(4)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    got = con.execute(sql.URLS)
    names = [c[0] for c in got.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall())
    mine = url_filter.judge(h.frame(spark, rows, PAGES))
    have = sorted(tuple(r[c] for c in sorted(names)) for r in mine.collect())
    assert [tuple(str(x) for x in r[:5]) for r in have] == [tuple(str(x) for x in r[:5]) for r in want] or have == pytest.approx(want)


def very_long(spark):
    """One text of 400,000 words among short ones, repeated."""
    long = " ".join(f"word{i % 5000} the{i % 7}" for i in range(200_000))
    rows = [(i, f"short text of number {i} here", "en", "a", 1) for i in range(20)]
    return h.frame(spark, [*rows, (100, long, "en", "a", len(long)), (101, long, "en", "a", len(long)), (102, long[: len(long) // 2], "en", "b", 1)])


@pytest.mark.parametrize("name", RUNS)
def test_very_long_texts(name, spark):
    rows = {r["doc_id"]: r for r in RUNS[name](spark, very_long(spark)).collect()}
    assert len(rows) == 23
    if name == "neardup":
        assert rows[100]["class_id"] == rows[101]["class_id"] == 100 and rows[102]["class_id"] == 102
    if name == "lm_scoring":
        assert rows[100]["n_tokens"] == 400_001
    if name == "mixing":
        assert rows[100]["size"] == 400_000
    if name == "fingerprint":
        assert rows[100]["fingerprint"] == rows[101]["fingerprint"] != rows[102]["fingerprint"]


def test_decontamination_in_a_very_long_text(spark):
    item = "a passage that stands near the very end of it"
    docs = very_long(spark).withColumn("text", F.when(F.col("doc_id") == 100, F.concat("text", F.lit(f" {item}"))).otherwise(F.col("text")))
    got = decontaminate.leaks(docs, items(spark, [(1, item)])).collect()
    assert [(r["doc_id"], r["start"]) for r in got] == [(100, 400_000)]


def test_very_long_conversation(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(3000)] + [(2, t, "user", f"turn {t}") for t in range(2999)]
    got = chat.collapse(h.frame(spark, rows, TURNS)).collect()
    assert [(r["conv_id"], r["n_turns"], r["snapshots"]) for r in got] == [(1, 3000, 1)]


def test_equal_alignments_and_scores_are_settled(spark):
    """Ties: an item that is in a text twice begins at the first place, and equal texts score alike."""
    docs = h.frame(spark, [(1, "x one two three four five y one two three four five", "en", "a", 1), (2, "x one two three four five y one two three four five", "fr", "a", 1)])
    assert {(r["doc_id"], r["start"]) for r in decontaminate.leaks(docs, items(spark, [(1, "one two three four five")])).collect()} == {(1, 1), (2, 1)}
    for name in ("quality", "lm_scoring", "language_id"):
        rows = RUNS[name](spark, docs).collect()
        assert len({r["score"] for r in rows}) == 1 and len(rows) == 2


def test_columns_named_as_our_own_come_along(spark, data):
    import corpus_pipeline

    docs = h.frame(spark)
    for name in ("__text", "__leaks", "__class", "__turn", "__id", "__mark", "__lang", "__score", "__coverage", "T1", "w1", "__found"):
        docs = docs.withColumn(name, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        assert all(r["__text"] == r["T1"] == "mine" for r in out.collect())


@pytest.mark.parametrize("rows", [h.ODD, []], ids=["odd", "empty"])
def test_stages_bear_odd_rows(rows, spark, data):
    import corpus_pipeline

    docs = h.frame(spark, rows)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        seen.append(docs.count())
        assert name == "mixing" or docs.columns == columns
    assert seen == sorted(seen, reverse=True) and seen[0] <= len(rows)
