"""Canonical addresses, default states, chains of keys, chosen cosines, resumable tables, both result tables, similarity columns."""

import math

from pyspark.sql import functions as F

from grove.functions import address, similarity
from grove.operators import blocking, collective, decisions, features, store
from grove.sources import records


def test_canonical_addresses(spark):
    rows = [("a", "France", ["7 r des lilas", "angers", "maine et loire"]), ("b", "France", ["7 rue des lilas", "angers", "pays de la loire"]), ("c", "US", ["12 n oak blvd", "salem", "oregon"]), ("d", "Peru", ["5 st ave"]), ("e", "India", None), ("f", None, ["no 4"])]
    got = {r["entity_id"]: r["canon"] for r in address.canonical_addresses(spark.createDataFrame(rows, "entity_id string, country string, parts array<string>")).collect()}
    assert got["a"] == got["b"] == "7 rue des lilas angers pays de la loire" and got["c"] == "12 north oak boulevard salem or" and got["d"] == "5 st ave" and got["e"] == "" and got["f"] == "no 4"
    canon = spark.createDataFrame(list(got.items()), "entity_id string, canon string")
    pair = features.canonical_features(spark.createDataFrame([("a", "b"), ("e", "e")], "s1 string, rec string"), canon, canon).orderBy("s1").collect()
    assert tuple(pair[0])[2:] == (100.0, 100.0, 1.0) and pair[1]["ca_jacc"] == 0


def test_states_replace_learned_aliases(spark):
    parts = lambda rows: spark.createDataFrame(rows, "entity_id string, country string, parts array<string>")
    s1 = parts([(f"p{i}", "US", ["1 mill rd", "indiana", "pa"]) for i in range(4)] + [(f"q{i}", "US", ["2 mill rd", "gary", "in"]) for i in range(6)])
    got = {(r["part"], r["state"]) for r in blocking.learn_aliases(s1, s1.limit(0), min_count=2).collect()}
    assert ("indiana", "in") in got and ("gary", "in") in got and ("indiana", "pa") not in got and len(blocking.US_STATES) == 51


def test_long_chains_converge(spark):
    n = 150
    edges = spark.createDataFrame([(f"{i + d:04d}", f"k{i:04d}") for i in range(n) for d in (0, 1)], "entity_id string, key string")
    got = collective.components(edges).collect()
    assert len(got) == n + 1 and {r["comp"] for r in got} == {"0000"}


def test_keys(spark):
    row = spark.createDataFrame([("a", "US", "", "", "", "15south 7 rd", "15")], "entity_id string, country string, name_key string, name_ns string, name_tok string, addr string, hn string")
    assert {(r["kind"], r["key"]) for r in blocking.with_keys(row).collect()} == {("v0", "US||15"), ("hn_street", "US|15|south"), ("name1_hn", "US||15")}


def test_chosen_cosines_equal_all_cosines(spark):
    name = "entity_id string, country string, name_tok string, addr string"
    s1 = spark.createDataFrame([("a", "US", "harbor mill", "1 oak road"), ("b", "US", "harbor tea house", "2 elm road"), ("c", "US", "zinc", "")], name)
    recs = spark.createDataFrame([("r", "US", "harbour mill", "1 oak road"), ("t", "US", "", "2 elm road"), ("u", "US", "qqqq", "")], name)
    ours, theirs = blocking.weighted(s1, recs, ["country"])
    pairs = s1.select(F.col("entity_id").alias("s1")).crossJoin(recs.select(F.col("entity_id").alias("rec")))
    got = {(r["s1"], r["rec"]): r for r in blocking.pair_cosines(pairs, ours, theirs).collect()}
    assert len(got) == 9
    for view in ("name", "addr"):
        whole = {(r["s1"], r["rec"]): r["cos"] for r in blocking.cosines(*blocking.tfidf(s1, recs, view, ["country"]), ["country"]).collect()}
        assert all(math.isclose(r[f"cos_{view}"], whole.get(k, 0.0), abs_tol=1e-9) for k, r in got.items())
    assert all(math.isclose(r["cos_comb"], 0.6 * r["cos_name"] + 0.4 * r["cos_addr"], abs_tol=1e-12) for r in got.values())
    best = {r["rec"]: r["s1"] for r in blocking.retrieve(s1, recs, ["country"], keep=1).collect()}
    assert best == {"r": "a", "t": "b"}


def test_frequent_terms_find_nothing_but_score(spark):
    """In a part of 1,000 entities and more a term of over 5 % retrieves no pair; the cosines of a found pair still hold it."""
    name = "entity_id string, country string, name_tok string, addr string"
    s1 = spark.createDataFrame([(f"s{i}", "US", f"club w{i:05d}", f"{i} rue x") for i in range(1200)], name)
    recs = spark.createDataFrame([("r", "US", "club", "rue x"), ("t", "US", "club w00042", "42 rue x")], name)
    got = blocking.retrieve(s1, recs, ["country"]).collect()
    assert {r["rec"] for r in got} == {"t"} and max(got, key=lambda r: r["cos_comb"])["s1"] == "s42" and max(r["cos_name"] for r in got) > 0.999


def test_resumable_tables(spark, tmp_path):
    df, made = spark.createDataFrame([(i % 5, float(i)) for i in range(40)], "k long, v double"), []

    def step(part):
        made.append(1)
        return part.groupBy("k").agg(F.sum("v").alias("v"))

    whole = sorted(tuple(r) for r in df.groupBy("k").agg(F.sum("v")).collect())
    for _ in range(2):
        assert sorted(tuple(r) for r in store.bucketed(df, f"file://{tmp_path}/b", step, "k", 3).select("k", "v").collect()) == whole
    assert len(made) == 3
    # A table that was not finished is written anew.
    (tmp_path / "b" / "bucket=1" / "_SUCCESS").unlink()
    store.bucketed(df, f"file://{tmp_path}/b", step, "k", 3)
    assert len(made) == 4


def test_both_result_tables_are_checked(spark):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    pairs = lambda *x: spark.createDataFrame(list(x), "s1 string, rec string")
    s1, recs = ids.withColumnRenamed("s1", "entity_id"), spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    good, few = records.result_tables(ids, pairs(("S1-1", "S2-1")), pairs(("S1-1", "S3-1")))
    assert [tuple(r) for r in records.validate(good, few, s1, recs).collect()] == [("warning: lists of matches that are no candidates", 1)]
    assert records.validate(good, None, s1, recs).count() == 0 and [r["issue"][:15] for r in records.validate(good, good, s1, recs).collect()] == ["candidate_pairs"]
    worse = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S2-9")], "source1_entity_id string, candidate_entity_ids string")
    issues = {r["issue"].split(": ")[1] for r in records.validate(good, worse, s1, recs).collect()}
    assert issues == {"missing reference entities", "repeated reference entities", "lists with repeated ids", "lists with ids that are not Source-2/3 records"}


def test_similarity_columns_by_definition(spark):
    """The columns that SQL cannot give, against the plain functions."""
    raw1 = spark.createDataFrame([("A", "elan & sons ltd"), ("B", "mill house")], "entity_id string, raw string")
    raw2 = spark.createDataFrame([("r", "sons elan ltd"), ("t", "mil house inc")], "entity_id string, raw string")
    pairs = spark.createDataFrame([("A", "r"), ("B", "t"), ("A", "t")], "s1 string, rec string")
    texts = {r["entity_id"]: r["raw"] for r in raw1.unionByName(raw2).collect()}
    for r in features.raw_features(pairs, raw1, raw2).collect():
        a, b = texts[r["s1"]], texts[r["rec"]]
        assert r["raw_ratio"] == similarity.ratio_of(a, b) and r["raw_tsort"] == similarity.token_sort_of(a, b)
    names = lambda rows: spark.createDataFrame(rows, "entity_id string, country string, name_tok string")
    s1, recs = names([("A", "US", "harbor mill group"), ("B", "US", "tea group")]), names([("r", "US", "group harber mill"), ("t", "US", "tea")])
    got = {(r["s1"], r["rec"]): r for r in features.generic_features(pairs, s1, recs, features.generic_tokens(s1, 0.9)).collect()}
    assert got["A", "r"]["core_tset"] == similarity.token_set_of("harbor mill", "harber mill") and got["B", "t"]["core_eq"] == 1 and got["B", "t"]["n_miss_generic"] == 1


def test_best_threshold(spark):
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.4), ("b", "z", 0.6)], "s1 string, rec string, p double")
    truth = spark.createDataFrame([("a", "x")], "s1 string, rec string")
    got = decisions.best_threshold(spark, scored, truth, spark.createDataFrame([("a",), ("b",)], "s1 string")).first()
    assert got["t"] == 0.625 and got["f05"] == 1 and len(decisions.FINE_GRID) == 38
