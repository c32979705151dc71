"""The entity-resolution operators against literal results."""

import random

import pytest
from pyspark.sql import functions as F

from grove.functions import similarity, text
from grove.operators import blocking, collective, decisions, features
from grove.sources import records

RAW = "entity_id string, business_name string, business_address string, country string"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("f", "value", "expected"), [
    (text.clean, "Silver Fóundation Pvt. Ltd.", "silver foundation pvt ltd"), (text.clean, "Tucker [Metro-Transalta]", "tucker metro transalta"), (text.clean, None, ""),
    (text.name_key, "Yazzie-Empire Enterprises LLC", "empire enterprises yazzie"), (text.name_key, "LLC", ""), (text.name_key, "Dukes Chadwick Có", "chadwick dukes"),
    (text.house_no, "24800 EUCLID AVE, EUCLID, OH", "24800"), (text.house_no, "02A/3, DELHI", "2"), (text.house_no, "OH, EUCLID AVE", ""), (text.house_no, "000", "0"),
    (text.name_tokens, "tuckermetrotransalta.com", ["tuckermetrotransalta"]), (text.name_tokens, ">> www.shreethreads.com", ["shreethreads"]), (text.name_tokens, "surgical care associates of topeka inc #35740", ["surgical", "care", "associates", "topeka"]),
    (text.nums, "Door No 276 H 15South Extn Part I", ["276", "15"]), (text.nums, "09-9-232/1/A/1, Ramnagar", ["9", "232", "1"]), (text.nums, "", []),
    (text.addr_parts, "OH, EUCLID AVE, EUCLID", ["oh", "euclid ave", "euclid"]), (text.addr_parts, " , N/A", ["n a"]),
    (text.is_nonlatin, "सिल्वर फाउंडेशन", True), (text.is_nonlatin, "Silver Fóundation Lìmited", False), (text.legal_form, "ACME Incorporated", "inc"),
])
def test_text(spark, f, value, expected):
    assert one(spark, value, f) == expected


def test_rule(spark):
    s1 = text.normalize(spark.createDataFrame([("S1-1", "Yazzie Empire Enterprises LLC", "24800 Euclid Avenue, Euclid, OH", "US"), ("S1-2", "Primary Care Group", "10 Main St, Austin, TX", "US"), ("S1-3", "Primary Care Group", "10 Main Street, Austin, Texas", "US"), ("S1-4", "Lonely Shop", "5 Rue de Valmy, Lille", "France")], RAW))
    recs = text.normalize(spark.createDataFrame([("S2-1", "YAZZIE EMPIRE  ENTERPRISES", "24800 EUCLID AVE, EUCLID, OH", "US"), ("S3-1", "YAZZIE EMPIRE ENTERPRISES", "24801 EUCLID AVE", "US"), ("S2-5", "PRIMARY CARE GROUP", "10 MAIN ST, AUSTIN, TX", "US"), ("S2-7", "Lonely Shop", "5 Main St", "US"), ("S2-8", "LLC", "1 X St", "US"), ("S2-9", "Acme", "", "US")], RAW))
    assert [tuple(r) for r in blocking.rule_matches(s1, recs).collect()] == [("S1-1", "S2-1")]


def test_states(spark):
    df = spark.createDataFrame([("a", "US", ["fostoria", "oh", "534 stinchomb dr"]), ("b", "US", ["1 main st", "euclid", "oh"]), ("c", "US", ["5 elm st", "toledo", "oh"]), ("d", "US", ["7"])], "entity_id string, country string, parts array<string>")
    assert {r[0]: r[1] for r in blocking.s1_state(df).collect()} == {"a": "oh", "b": "oh", "c": "oh", "d": None}
    alias = spark.createDataFrame([("US", "euclid", "oh"), ("US", "ohio", "oh")], "country string, part string, state string")
    rows = spark.createDataFrame([("1", "US", ["x", "euclid", "ohio"]), ("2", "US", ["nowhere"]), ("3", "France", ["euclid"])], "entity_id string, country string, parts array<string>")
    assert {r[0]: r[1] for r in blocking.infer_state(rows, alias).collect()} == {"1": "oh", "2": None, "3": None}


def test_retrieval(spark):
    names = [("yazzie empire enterprises", "24800 euclid avenue euclid oh"), ("surgical care associates topeka", "3906 33rd terrace topeka ks"), ("blue program", "261 jo mar road ardmore al")]
    df = lambda rows, p: spark.createDataFrame([(f"{p}{i}", "US", n, a) for i, (n, a) in enumerate(rows)], "entity_id string, country string, name_tok string, addr string")
    got = blocking.retrieve(df(names, "a"), df([("yazzie empier enterprises", "oh euclid ave euclid"), ("surgical caare associates topeka", "3906a 33rd ter topeka kansas"), ("blue program", "")], "q"), ["country"], keep=1)
    assert {r["rec"]: r["s1"] for r in got.collect()} == {"q0": "a0", "q1": "a1", "q2": "a2"}
    same = blocking.retrieve(df(names, "a"), df(names, "q"), ["country"], keep=1).collect()
    assert all(abs(r["cos_comb"] - 1) < 1e-9 for r in same)


def test_decode(spark):
    scored = spark.createDataFrame([("a", "r1", 0.95), ("a", "r2", 0.90), ("a", "r3", 0.20), ("b", "r4", 0.30), ("c", "r5", 0.99), ("c", "r1", 0.10)], "s1 string, rec string, p double")
    assert {(r[0], r[1]) for r in decisions.decode(scored).collect()} == {("a", "r1"), ("a", "r2"), ("c", "r5")}


def test_metrics(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "s1 string, rec string")
    ids = spark.createDataFrame([("a",), ("b",)], "s1 string")
    got = {r["s1"]: r["f05"] for r in decisions.per_entity(pairs(("b", "S2-1"), ("b", "S2-2"), ("b", "S3-3")), pairs(("b", "S2-1"), ("b", "S3-3")), ids).collect()}
    assert got["a"] == 1 and abs(got["b"] - 0.7142857) < 1e-6


def test_competition(spark):
    c = spark.createDataFrame([("A", "r1", 0.9, 0.8, 0.86), ("A", "r2", 0.5, 0.9, 0.66), ("B", "r1", 0.8, 0.2, 0.56)], "s1 string, rec string, cos_name double, cos_addr double, cos_comb double")
    got = {(r["s1"], r["rec"]): r for r in features.competition_features(c).collect()}
    assert got["A", "r1"]["rev_is_best_cos"] == 1 and abs(got["A", "r1"]["rev_margin_cos"] - 0.30) < 1e-9 and abs(got["B", "r1"]["rev_margin_cos"] + 0.30) < 1e-9 and got["A", "r2"]["ctx_is_best_cos"] == 0


def test_id_lists_and_validation(spark):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1 string")
    got = records.id_lists(ids, spark.createDataFrame([("S1-1", "S3-9"), ("S1-1", "S2-4"), ("S1-1", "S2-4"), ("S1-9", "S2-1")], "s1 string, rec string"))
    assert {tuple(r) for r in got.collect()} == {("S1-1", "S2-4,S3-9"), ("S1-2", ""), ("S1-3", "")}
    bad = spark.createDataFrame([("S1-2", "S1-X"), ("S1-3", "")], "source1_entity_id string, matched_entity_ids string")
    issues = {r["issue"] for r in records.validate(bad, bad, ids.withColumnRenamed("s1", "entity_id"), spark.createDataFrame([("S2-4",)], "entity_id string")).collect()}
    assert {"matching_results: missing reference entities", "matching_results: lists with ids that are not Source-2/3 records"} <= issues


def test_components(spark):
    edges = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("x", "3"), ("y", "3")], "entity_id string, key string")
    assert {r[0]: r[1] for r in collective.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_group_gains(spark):
    pairs = spark.createDataFrame([("A", "good", 0.9, 100.0, 100.0), ("A", "slip", 0.3, 70.0, 95.0), ("A", "swap", 0.6, 60.0, 100.0), ("A", "moved", 0.5, 90.0, 90.0)], "s1 string, rec string, p1 double, name_tset double, addr_tset double")
    recs = spark.createDataFrame([("good", "northern lights bakery", "12 hill road", "12"), ("slip", "northern lihgts bakery", "12 hill road", "12"), ("swap", "southern crown bakery", "12 hill road", "12"), ("moved", "northern lights bakery", "14 hill road", "14")], "entity_id string, name_tok string, addr string, hn string")
    got = {r["rec"]: r for r in collective.group_gains(pairs, recs).collect()}
    assert abs(got["slip"]["g_p1_gain"] - 0.6) < 1e-9 and got["slip"]["g_name_gain"] == 30 and got["slip"]["g_addr_gain"] == 5
    assert all(got[r]["g_p1_gain"] == got[r]["g_name_gain"] == 0 for r in ("good", "swap", "moved"))


def test_vocab_features(spark):
    names = lambda *x: spark.createDataFrame(list(x), "entity_id string, country string, name_tok string")
    s1 = names(("A", "US", "harbor daniels"), ("B", "US", "hanner mill"), ("C", "US", "hanner creek"))
    recs = names(("r1", "US", "harbor danels"), ("r2", "US", "harbor hanner"), ("r3", "US", "harbor daniels hanner"), ("r4", "US", "harbor"))
    pairs = spark.createDataFrame([("A", f"r{i}") for i in range(1, 5)], "s1 string, rec string")
    got = {r["rec"]: tuple(r)[2:] for r in features.vocab_features(pairs, s1, recs, features.token_df(s1), features.generic_tokens(s1, 0.9)).collect()}
    assert got["r1"][:2] == (0, 1) and got["r1"][2] > 90 and got["r1"][3] == -1
    assert got["r2"][:2] == (1, 0) and 0 < got["r2"][3] < 80 and got["r3"] == (1, 0, -1.0, 0.0) and got["r4"] == (0, 0, -1.0, -1.0)


def test_raw_names(spark):
    assert one(spark, "  Élan &  Sons Ltd ", text.raw_name) == "elan & sons ltd"
    raw = spark.createDataFrame([("A", "elan sons limited"), ("r", "elan&sons the ltd")], "entity_id string, raw string")
    assert features.raw_features(spark.createDataFrame([("A", "r")], "s1 string, rec string"), raw, raw).first()["raw_small_diff"] == 2


def test_entity_pages(spark):
    e = spark.createDataFrame([("S1-1", "Alder Mill", "1 A St", "US", "exact"), ("S1-2", "Birch Mill", "2 B St", "US", "false_merge"), ("S1-3", "Cedar", "mill lane", "India", "missed_match")], "s1 string, business_name string, business_address string, country string, outcome string")
    total, page = decisions.list_entities(e, q="MILL", offset=1, limit=1)
    assert total == 3 and [r["s1"] for r in page.collect()] == ["S1-2"]
    assert decisions.list_entities(e, country="US", outcome="errors")[0] == 1


def test_similarity():
    rng = random.Random(1)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert similarity.lcs(a, b) == plain(a, b)
    assert similarity.token_set_of("a b", "b a c") == 100 and similarity.token_set_of("", "a") == 0 and similarity.ratio_of("", "") == 100
    assert abs(similarity.jaro_winkler_of("martha", "marhta") - 0.961111) < 1e-5


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", 'say "x', "", "US")], RAW)
    records.write_tsv(df, f"file://{tmp_path}/t")
    assert [tuple(r) for r in records.read_tsv(spark, f"file://{tmp_path}/t").collect()] == [("S1-1", 'say "x', "", "US")]
    with pytest.raises(ValueError):
        records.check_source(df, 2)
