"""Contributions against all coalitions, reasons, weights and stacked models, feature sets, the search over a country."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grove.functions.text import normalize
from grove.operators import blocking, collective
from grove.plans import ensemble, explain, training
from grove.plans import resolve as plan

COLS = ["name_tset", "addr_tset", "hn_eq", "rank_fz"]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        x = [rng.uniform(0, 100), rng.choice([None, rng.uniform(0, 100)]), float(rng.random() < 0.5), float(rng.randint(1, 5))]
        rows.append((f"S1-{i % 90}", f"S2-{i}", *x, int(x[0] + 30 * x[2] - 8 * x[3] + (x[1] or 0) / 4 + rng.gauss(0, 10) > 60)))
    return spark.createDataFrame(rows, "s1 string, rec string, name_tset double, addr_tset double, hn_eq double, rank_fz double, y int").cache()


@pytest.fixture(scope="module")
def model(pairs):
    return training.fit_member(pairs, COLS, "boosted", 4)


def test_shapley_equals_all_coalitions(pairs, model):
    found = explain.leaves(model)
    x = np.array([[plan.MISSING if v is None else v for v in r] for r in pairs.select(*COLS).limit(25).collect()])
    base, got = explain.shapley(found, x)

    def worth(row, known):
        return sum(leaf.value * math.prod(float(lo < row[f] <= hi) if f in known else s for f, lo, hi, s in zip(leaf.features, leaf.low, leaf.high, leaf.share)) for leaf in found)

    n = len(COLS)
    for row, impacts in zip(x, got):
        assert abs(base - worth(row, ())) < 1e-9
        for f in range(n):
            rest = [g for g in range(n) if g != f]
            want = sum(math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (worth(row, (*s, f)) - worth(row, s)) for k in range(n) for s in itertools.combinations(rest, k))
            assert abs(impacts[f] - want) < 1e-9


def test_impacts_add_up_to_the_log_odds(pairs, model):
    p = training.score(model, pairs, COLS, "p")
    rows = explain.contributions(model, pairs, COLS).join(p, ["s1", "rec"]).collect()
    assert len(rows) == 500
    for r in rows:
        assert abs(r["base"] + sum(r["impacts"]) - math.log(r["p"] / (1 - r["p"]))) < 1e-6
    assert explain.contributions(model, pairs.limit(0), COLS).count() == 0


def test_reasons(pairs, model):
    impacts = {r["rec"]: dict(zip(COLS, r["impacts"])) for r in explain.contributions(model, pairs, COLS).collect()}
    got = explain.explained(model, pairs, COLS, top=3).collect()
    assert len(got) == 500
    for r in got:
        own = impacts[r["rec"]]
        want = sorted((f for f in COLS if abs(own[f]) > 0.001), key=lambda f: (-abs(own[f]), f))[:3]
        assert [x["feature"] for x in r["reasons"]] == want
        assert all(x["shown"] == explain.shown(x["feature"], x["value"]) for x in r["reasons"])
        sums = {x["family"]: x["impact"] for x in r["families"]}
        assert abs(sums["house number"] - own["hn_eq"]) < 1e-9 and abs(sum(sums.values()) - sum(own.values())) < 1e-9
    assert [explain.shown(*a) for a in (("hn_eq", 1.0), ("name_tset", 88.4), ("cos_name", 0.123), ("rank_fz", 3.0), ("addr_tset", -1.0))] == ["yes", "88%", "0.12", "3", "n/a"]


def test_weights_and_stack(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        truth = rng.random()
        y = int(rng.random() < truth)
        rows.append((f"S1-{i}", f"S2-{i}", y, i % 2, min(max(truth + rng.gauss(0, 0.05), 0.01), 0.99), rng.uniform(0.01, 0.99)))
    df = spark.createDataFrame(rows, "s1 string, rec string, y int, fold int, good double, noise double").cache()
    members = ["good", "noise"]
    w = ensemble.fit_weights(df, members)
    loss = lambda w: ensemble.log_loss(df.withColumn("p", ensemble.blend(w)))
    grid = [loss({"good": k / 20, "noise": 1 - k / 20}) for k in range(21)]
    assert abs(sum(w.values()) - 1) < 1e-9 and loss(w) <= min(grid) + 1e-3
    each = {how: ensemble.log_loss(ensemble.cross_fitted(df, members, 2, how).join(df.select("s1", "rec", "y"), ["s1", "rec"])) for how in ("mean", "weights", "stacked")}
    assert each["weights"] < each["mean"] and each["stacked"] < each["mean"]
    assert ensemble.fit_weights(df.limit(0), members) == {"good": 0.5, "noise": 0.5}
    side = ensemble.side_by_side({m: df.select("s1", "rec", F.col(m).alias("p")) for m in members}, df)
    assert side.columns == ["s1", "rec", "y", "fold", *members] and side.count() == 1200


def test_normal_scores(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(math.exp(rng.gauss(0, 1)), -1.0 if rng.random() < 0.5 else 1.0, 4.0) for _ in range(4000)], "a double, `b` double, same double")
    got = training.normal_scores(df, ["a", "b", "same"]).transform(df).toPandas()
    inner = got[(got.a > got.a.quantile(0.01)) & (got.a < got.a.quantile(0.99))]
    assert np.abs(inner.normal_a - np.log(inner.a)).max() < 0.25
    assert np.array_equal(got.a.rank().to_numpy(), got.normal_a.rank().to_numpy())
    assert got.normal_same.abs().max() < 1e-9 and (got.groupby("b").normal_b.nunique() == 1).all() and got.normal_b.min() < 0 < got.normal_b.max()
    beyond = training.normal_scores(df, ["a"]).transform(spark.createDataFrame([(-5.0,), (1e9,)], "a double")).toPandas().normal_a
    assert beyond[0] < -5 and beyond[1] > 5


def test_net_learns_from_normal_scores(pairs, tmp_path):
    net = training.fit_member(pairs, COLS, "net")
    net.write().overwrite().save(str(tmp_path / "net"))
    again = type(net).load(str(tmp_path / "net"))
    p = training.score(net, pairs, COLS, "p").join(training.score(again, pairs, COLS, "q"), ["s1", "rec"]).join(pairs, ["s1", "rec"])
    assert p.where("p <> q").isEmpty() and p.where("(p >= 0.5) = (y = 1)").count() > 400


def test_feature_sets():
    assert collective.feature_set("all") == collective.COLLECTIVE
    assert not set(collective.TWINS) & set(collective.feature_set("no_twins")) and "claims_s1" not in collective.feature_set("no_counts")
    assert collective.feature_set("no_twins_grp", ["g_p1_gain"])[-1] == "g_p1_gain" and len(collective.feature_set("no_s1_side")) == 4
    with pytest.raises(ValueError):
        collective.feature_set("other")


def test_country_search(spark):
    schema = "entity_id string, business_name string, business_address string, country string"
    s1 = normalize(spark.createDataFrame([("S1-1", "Harbour Lantern Works", "1 Quay, Kent", "X"), ("S1-2", "Harbor Lantern Walks", "9 Hill, Kent", "X"), ("S1-3", "Harbour Lantern Works", "1 Quay, Kent", "Y")], schema))
    recs = normalize(spark.createDataFrame([("S2-1", "Harbour Lantern Work", "", "X"), ("S2-2", "Harbour Lantern Work", "1 Quay, Kent", "X"), ("S2-3", "Harbour Lantern", "", "Z"), ("S2-4", None, "", "X")], schema))
    states = spark.createDataFrame([("S2-1", None), ("S2-2", "kent"), ("S2-3", None), ("S2-4", None)], "entity_id string, state string")
    got = blocking.country_candidates(s1, recs, states).orderBy(F.desc("cos_name")).collect()
    assert [(r["s1"], r["rec"]) for r in got] == [("S1-1", "S2-1"), ("S1-2", "S2-1")] and all(r["cos_addr"] == 0 for r in got)
    assert [r["s1"] for r in blocking.country_candidates(s1, recs, states, k=1).collect()] == ["S1-1"]
    # Terms of more than one entity take no part in the search: what is left meets S1-1 alone, scored over all terms.
    rare = blocking.country_candidates(s1, recs, states, most=1).collect()
    assert [r["s1"] for r in rare] == ["S1-1"] and abs(rare[0]["cos_name"] - got[0]["cos_name"]) < 1e-12
