"""Made-up sources, training out of fold, the saved matcher, the index, the command line, audits."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from grove.__main__ import main
from grove.functions.text import clean, learn_token_map, mapped_names, name_tokens
from grove.operators import audit, decisions, features
from grove.plans import serving, training
from grove.sources import records, reports, synthetic


@pytest.fixture(scope="module")
def world(spark):
    return synthetic.synthesize(spark, synthetic.World(entities=120, seed=5))


@pytest.fixture(scope="module")
def trained(world):
    return training.train(world.s1, world.recs, world.truth, trees=3, members=("boosted", "forest"), blends=("weights",), min_count=2, expand_count=5)


def test_world(spark, world):
    again = synthetic.synthesize(spark, synthetic.World(entities=120, seed=5))
    assert again.recs.exceptAll(world.recs).isEmpty() and world.s1.count() == 120
    assert world.recs.count() == world.recs.select("entity_id").distinct().count()
    assert world.truth.join(world.recs, world.truth.rec == world.recs.entity_id, "left_anti").isEmpty()
    owned = world.truth.select("s1").distinct().count()
    assert 100 <= owned < 120 and world.recs.where("source = 2").count() > 50 and world.recs.count() > world.truth.count()


def test_folds(spark):
    rows = [(f"S1-{i}", "US", f"s{i % 5}" if i % 7 else None) for i in range(70)]
    regions = spark.createDataFrame(rows, "entity_id string, country string, state string")
    got = regions.join(training.fold_of(regions, 2).withColumnRenamed("s1", "entity_id"), "entity_id").collect()
    assert len(got) == 70 and {r["fold"] for r in got} == {0, 1}
    for s in range(5):
        assert len({r["fold"] for r in got if r["state"] == f"s{s}"}) == 1


def test_training_orders_the_steps(trained):
    ladder = {r["step"].split(" at ")[0]: r["f05"] for r in trained.report["ladder"]}
    assert ladder["exact keys"] < ladder["stage 1, expected F"] and trained.report["final"]["f05"] > 0.9
    assert trained.report["blocking"]["recall"] > 0.95 and abs(sum(r["gain"] for r in trained.report["importance"]) - 1) < 1e-6
    assert abs(sum(trained.matcher.meta["weights"].values()) - 1) < 1e-9 and "stage 2, weights" in ladder
    assert trained.oof.count() == trained.oof.select("s1", "rec").distinct().count()


def test_index_matches_as_the_batch_does(spark, world, trained, tmp_path):
    held = world.recs.where(F.pmod(F.xxhash64("entity_id"), F.lit(12)) == 0).select(*world.s1.columns)
    rest = world.recs.join(held.select("entity_id"), "entity_id", "left_anti")
    index = serving.build(str(tmp_path / "index"), trained.matcher, world.s1, rest, world.truth)
    odd = spark.createDataFrame([("q-empty", None, None, "US"), ("q-far", "Nowhere Traders", "1 Mill Road", "Peru")], records.RAW)
    got = serving.match(index, held.unionByName(odd)).collect()
    batch = {(r["s1"], r["rec"]) for r in training.apply(trained.matcher, world.s1, world.recs).matches.join(held.select(F.col("entity_id").alias("rec")), "rec").collect()}
    single = {(r["s1"], r["rec"]) for r in got if r["matched"]}
    assert len(batch & single) >= 0.9 * len(batch | single) and len(single) > 5
    assert {r["rec"] for r in got} >= {"q-empty", "q-far"} and [r["s1"] for r in got if r["rec"] == "q-far"] == [None]
    alone = serving.match(index, held.limit(1)).collect()
    assert {(r["s1"], r["rank"], round(r["p1"], 9)) for r in alone} == {(r["s1"], r["rank"], round(r["p1"], 9)) for r in got if r["rec"] == alone[0]["rec"]}
    one = next(iter(single))[0]
    view = serving.entity_view(index["pairs"], index["matches"], index["truth"], one).collect()
    flags = [r["matched"] for r in view]
    assert flags == sorted(flags, reverse=True) and all(r["went_to"] != one for r in view)
    total, page = decisions.list_entities(serving.entities(index), outcome="errors")
    assert total == len(page.limit(1000).collect()) or total > 25
    few = serving.examples(index["recs"])
    assert few.groupBy("country").count().where("count > 3").isEmpty() and few.count() >= 4


def test_command_line(spark, world, trained, tmp_path):
    data, model = str(tmp_path / "made"), str(tmp_path / "model")
    assert main(["synth", data, "--entities", "60", "--seed", "5"], spark) == 0
    trained.matcher.save(model)
    assert main(["evaluate", data, model, "--report", str(tmp_path / "report.json")], spark) == 0
    assert json.loads((tmp_path / "report.json").read_text())["final"]["f05"] > 0.8
    assert main(["resolve", data, model, str(tmp_path / "out")], spark) == 0
    assert main(["validate", data, str(tmp_path / "out/matching_results.tsv"), "--candidates", str(tmp_path / "out/candidate_pairs.tsv")], spark) == 0
    reports.bundle([str(tmp_path / "out"), str(tmp_path / "report.json")], str(tmp_path / "all.zip"))
    names = zipfile.ZipFile(tmp_path / "all.zip").namelist()
    assert "report.json" in names and any(n.startswith("out/matching_results.tsv/") for n in names) and not any("_SUCCESS" in n for n in names)


def test_files(spark, tmp_path):
    bad = tmp_path / "bad.tsv"
    bad.write_text("source1_entity_id,matched_entity_ids\nS1-1\tS2-1\textra\nS1-2\t\nS1-2\t\n")
    got = {r["issue"]: r["n"] for r in reports.file_issues(spark, str(bad)).collect()}
    assert got == {"columns are separated by commas, not tabs": 1, "lines without exactly two columns": 1, "repeated lines": 1}
    log = tmp_path / "log.csv"
    reports.log_metrics(str(log), "v1", 42, {"f05": 0.5})
    reports.log_metrics(str(log), "v2", 42, {"f05": 0.6})
    assert [line.split(",")[1] for line in log.read_text().splitlines()] == ["version", "v1", "v2"]


def test_indic_names(spark):
    rows = [("a", "राम मार्केटिंग प्राइवेट लिमिटेड"), ("b", "সিলভার ১২"), ("c", None), ("d", "")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string")
    got = {r[0]: r[1] for r in df.select("entity_id", clean(F.col("business_name"))).collect()}
    assert got == {"a": "ram marketing praivet limited", "b": "silbhar 12", "c": "", "d": ""}
    pairs = spark.createDataFrame([(["sanraij", "praivet"], ["sunrise", "private"])] * 3, "rec array<string>, s1 array<string>")
    named = {r[0]: r[1] for r in mapped_names(df, learn_token_map(pairs)).collect()}
    assert named["a"] == "ram marketing" and named["c"] == named["d"] == ""
    assert df.where("entity_id = 'a'").select(name_tokens(F.col("business_name"))).first()[0][:2] == ["ram", "marketing"]


def test_maxima_and_masks(spark):
    pairs = spark.createDataFrame([("a", "x", 0.5, 0.2, 0.4), ("a", "y", 0.1, 0.1, 0.1), ("b", "x", None, None, None)], "s1 string, rec string, cos_name double, cos_addr double, cos_comb double")
    same = features.competition_against(pairs, features.maxima(pairs)).orderBy("s1", "rec").collect()
    assert same == features.competition_features(pairs).orderBy("s1", "rec").collect()
    wide = features.competition_against(pairs.where("rec = 'y'"), features.maxima(pairs)).first()
    assert wide["ctx_is_best_cos"] == 0 and wide["ctx_gap_cos"] == pytest.approx(0.3)
    masked = {(r["s1"], r["rec"]): r for r in features.key_masked(features.competition_features(pairs)).collect()}
    assert masked["b", "x"]["rev_rel_cos"] is None and masked["a", "x"]["rev_rel_cos"] == 1 and masked["b", "x"]["ctx_rel_cos"] is not None


def test_mapped_features(spark):
    s1 = spark.createDataFrame([("a", "sunrise technology")], "entity_id string, name_tok string")
    recs = spark.createDataFrame([("x", True), ("y", False)], "entity_id string, nonlatin boolean")
    mapped = spark.createDataFrame([("x", "technology sunrise"), ("y", "sunrise")], "entity_id string, mapped string")
    pairs = spark.createDataFrame([("a", "x"), ("a", "y")], "s1 string, rec string")
    got = {r["rec"]: r for r in features.mapped_features(pairs, s1, mapped, recs).collect()}
    assert got["x"]["tr_tset"] == 100 and got["y"]["tr_tset"] is None and got["y"]["tr_jw"] is None


def test_gains_equal_recomputed_scores(spark):
    pair = lambda rows: spark.createDataFrame(rows, "s1 string, rec string")
    pred, truth = pair([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")]), pair([("a", "1"), ("a", "5"), ("b", "4")])
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1 string")
    wrong = pred.join(truth, ["s1", "rec"], "left_anti").withColumn("category", F.lit("false: all"))
    lost = truth.join(pred, ["s1", "rec"], "left_anti").withColumn("category", F.lit("missed"))
    f05 = lambda p: decisions.summary(decisions.per_entity(p, truth, ids)).first()["f05"]
    got = {r["category"]: r["gain"] for r in audit.gains(wrong.unionByName(lost), pred, truth, ids).collect()}
    assert got["false: all"] == pytest.approx(f05(pred.join(wrong, ["s1", "rec"], "left_anti")) - f05(pred))
    assert got["missed"] == pytest.approx(f05(pred.unionByName(lost.select("s1", "rec"))) - f05(pred))


def test_truth_of_lists(spark, world):
    lists = records.id_lists(world.s1.select(F.col("entity_id").alias("s1")), world.truth)
    assert records.truth_pairs(lists).exceptAll(world.truth).isEmpty()
