import pytest

from entwine.operators import labels
from entwine.plans import pipeline, reports
from entwine.sources import tsv
from entwine.streaming import records

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fields_stay_text(spark, tmp_path):
    path = put(tmp_path / "a.tsv", HEAD + 'S1-1\tNA\t\t007\nS1-2\t"with ""quotes"" and\na line"\tx\n')
    got = tsv.read_source(spark, path).orderBy("entity_id").collect()
    assert tuple(got[0]) == ("S1-1", "NA", "", "007")
    assert tuple(got[1]) == ("S1-2", 'with "quotes" and\na line', "x", "")


def test_files_are_split_unless_a_field_has_a_line_break(spark, tmp_path):
    """Quotes that close on their line don't make a file one task."""
    rows = "".join(f'S1-{i}\t"quoted ""{i}"""\tstreet {i}\tx\n' for i in range(2000))
    whole, broken = put(tmp_path / "w.tsv", HEAD + rows), put(tmp_path / "x.tsv", HEAD + rows + 'S1-x\t"two\nlines"\t\t\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        one, two = tsv.read_source(spark, whole), tsv.read_source(spark, broken)
        assert one.rdd.getNumPartitions() > 1 and two.rdd.getNumPartitions() == 1
        assert one.count() == 2000 and two.count() == 2001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_white_space_is_kept(spark, tmp_path):
    rows = [("S1-1", " lead", "trail ", "\u00a0x")]
    tsv.write_table(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"), str(tmp_path / "ws.tsv"))
    assert [tuple(r) for r in tsv.read_source(spark, str(tmp_path / "ws.tsv")).collect()] == rows


def test_header_and_width_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        tsv.read_source(spark, put(tmp_path / "b.tsv", "entity_id\tcountry\tbusiness_name\tbusiness_address\n"))
    with pytest.raises(Exception):
        tsv.read_source(spark, put(tmp_path / "c.tsv", HEAD + "1\t2\t3\t4\t5\n")).collect()
    with pytest.raises(Exception):
        tsv.read_source(spark, str(tmp_path / "missing.tsv"))
    assert tsv.read_source(spark, put(tmp_path / "d.tsv", HEAD)).collect() == []


def test_list_tables(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-2",), ("S1-1",), ("S1-3",)], "entity_id string")
    found = spark.createDataFrame([("S1-1", "S3-1", 1), ("S1-1", "S2-9", 2), ("S1-2", "S2-1", 1)], "s1_id string, cand_id string, rank int")
    path = str(tmp_path / "out.tsv")
    tsv.write_match_lists(found, s1, path, single=True)
    text = next((tmp_path / "out.tsv").glob("part-*")).read_text()
    assert text == "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-9;S3-1\nS1-2\tS2-1\nS1-3\t\n"
    assert {r["candidate_entity_ids"] for r in tsv.ranked_lists(found, s1).collect()} == {"S3-1,S2-9", "S2-1", ""}
    back = tsv.read_candidates(spark, path, s1, ";").collect()
    assert {tuple(r) for r in back} == {("S1-1", "S2-9"), ("S1-1", "S3-1"), ("S1-2", "S2-1")}


def test_file_digest(spark, tmp_path):
    import hashlib

    path = put(tmp_path / "x.bin", "abc")
    assert tsv.sha256_of_files(spark, path).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def bundle(folder, prefix, n=40):
    folder.mkdir()
    line = lambda s, i, name: f"S{s}-{i}\t{name}\t{i} Main St 1{i:04}\tUS\n"
    (folder / f"{prefix}_source1.tsv").write_text(HEAD + "".join(line(1, i, f"Company {chr(65 + i % 26)}{i} Inc") for i in range(n)))
    (folder / f"{prefix}_source2.tsv").write_text(HEAD + "".join(line(2, i, f"company {chr(65 + i % 26)}{i}") for i in range(0, n, 2)))
    (folder / f"{prefix}_source3.tsv").write_text(HEAD + "".join(line(3, i, f"Company {chr(65 + i % 26)}{i}, Ltd") for i in range(0, n, 3)))
    truth = "".join(f"S1-{i}\t{','.join([f'S2-{i}'] * (i % 2 == 0) + [f'S3-{i}'] * (i % 3 == 0))}\n" for i in range(n))
    (folder / f"{prefix}_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + truth)


def test_train_and_match_from_files(spark, tmp_path):
    bundle(tmp_path / "train", "train")
    bundle(tmp_path / "test", "test")
    model_folder, out = str(tmp_path / "model"), str(tmp_path / "out")
    trained = pipeline.run_training(spark, str(tmp_path / "train"), model_folder, rounds=5)
    assert trained.metadata["roc_auc"] > 0.9 and 0 < trained.metadata["train_candidate_recall"] <= 1
    lists = pipeline.run_inference(spark, str(tmp_path / "test"), model_folder, out)
    rows = {r["source1_entity_id"]: r["candidate_entity_ids"] for r in lists.collect()}
    assert len(rows) == 40
    right = sum(set(filter(None, rows[f"S1-{i}"].split(";"))) == set([f"S2-{i}"] * (i % 2 == 0) + [f"S3-{i}"] * (i % 3 == 0)) for i in range(40))
    assert right >= 30
    data = tsv.read_train(spark, str(tmp_path / "train"))
    ready = pipeline.prepare(data["source1"], data["source2"], data["source3"])
    with pytest.raises(AssertionError):
        wrong = spark.createDataFrame([("S1-1", "nobody")], "s1_id string, cand_id string")
        pipeline.audit(wrong, trained.candidates, lists, ready.s1)
    assert "Ground truth" in reports.eda_report(data, tsv.read_test(spark, str(tmp_path / "test")))
    assert "Extraction" in reports.normalisation_report(ready, data["ground_truth"])
    assert "False positives" in reports.model_report(trained, 0.5)
    assert "Lost by blocking" in reports.error_report(trained.scored, data["ground_truth"], 0.5)
    assert "Medians" in reports.feature_report(trained.train) and "a second" in reports.feature_report(trained.train)
    kept = {r["experiment_id"]: r for r in tsv.read_experiments(spark, f"{model_folder}/experiments.csv").collect()}
    assert kept["EXP001"]["experiment_f0_5"] >= kept["EXP000"]["experiment_f0_5"] and kept["EXP000"]["accepted"]
    half = reports.system_measures(trained.scored, data["ground_truth"], 0.5)
    assert "0.0000" in reports.final_comparison(spark, half, half, "Nothing is better.", f"{out}/final_comparison.md")
    assert "Nothing is better." in tsv.read_text(f"{out}/final_comparison.md")
    known = labels.truth_pairs(data["ground_truth"])
    assert known.count() == 34


def test_stream_normalises_as_batch_does(spark, tmp_path):
    bundle(tmp_path / "train", "train", 5)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text((tmp_path / "train" / "train_source1.tsv").read_text())
    q = records.normalised_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("norm").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["entity_id"]: r["business_name_core"] for r in spark.table("norm").collect()}
    want = {r["entity_id"]: r["business_name_core"] for r in pipeline.preprocess(tsv.read_source(spark, str(tmp_path / "train" / "train_source1.tsv"))).collect()}
    assert got == want and len(got) == 5
