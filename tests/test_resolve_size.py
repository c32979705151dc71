"""What resolve puts on the disks: texts meet by kind, steps leave no exchanged rows, scores need no join."""

import time

import pytest
from pyspark.sql import functions as F

from grove.functions.text import normalize
from grove.operators import blocking, features
from grove.operators.store import written
from grove.plans import resolve

RAW = "entity_id string, business_name string, business_address string, country string"
NAMES = ["harbor ring", "harbor bolt inc", "zinc ring", "Árbol ring llc", "", "zinc"]


@pytest.fixture(scope="module")
def copied(spark):
    """Six texts, each of them five times on either side."""
    e = [(f"S{n}-{9 * i + j}", name, f"{7 + i % 2} {name} St, state A" if i % 3 else "", "US" if i % 2 else "India") for i, name in enumerate(NAMES) for j in range(5) for n in (1, 2 + j % 2)]
    e = written(normalize(spark.createDataFrame(e, RAW)))
    s1, recs = e.where("entity_id LIKE 'S1-%'"), e.where("entity_id NOT LIKE 'S1-%'")
    part = blocking.retrieve(s1, recs, ["country"])
    lone = s1.select(F.col("entity_id").alias("s1")).crossJoin(recs.select(F.col("entity_id").alias("rec"))).join(part, ["s1", "rec"], "left_anti").where("(hash(s1, rec) & 3) = 0")
    pairs = part.withColumn("in_keys", F.lit(False)).unionByName(lone.withColumn("in_keys", F.lit(True)), allowMissingColumns=True)
    return written(pairs), s1, recs


def test_texts_of_copies_meet_once(copied, monkeypatch):
    """The features are those of the single steps, one after the other over all pairs."""
    pairs, s1, recs = copied
    d = features.diff_features(features.competition_features(pairs), s1, recs)
    d = features.pair_features(features.generic_features(d, s1, recs, features.generic_tokens(s1)), s1, recs)
    rows = lambda x: sorted(map(repr, x.collect()))
    sides, met = features.sides, []
    monkeypatch.setattr(features, "sides", lambda pairs, *a: met.append(pairs.count()) or sides(pairs, *a))
    made = resolve.featurize(pairs, s1, recs)
    assert made.columns == d.columns and pairs.count() > 200 and rows(made) == rows(d)
    assert met and max(met) <= len(NAMES) ** 2


def test_written_leaves_no_exchanged_rows(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for name in str(store.getAllFiles().mkString("\n")).split("\n") if "/shuffle_" in name}
    before = files()
    assert len(written(spark.range(10_000).groupBy(F.xxhash64("id").alias("h")).count()).collect()) == 10_000
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_predict_joins_nothing(spark):
    d = written(spark.range(60).selectExpr("concat('a', id) AS s1", "concat('b', id) AS rec", "double(id) AS x", "CASE WHEN id % 7 > 0 THEN id % 2 = 0 END AS z", "int(id > 30) AS y"))
    got = resolve.predict(resolve.fit(d, ["x", "z"], trees=2), d, ["x", "z"], "p")
    assert got.columns == [*d.columns, "p"] and got.drop("p").exceptAll(d).isEmpty() and got.count() == 60
    p = {r["s1"]: r["p"] for r in got.collect()}
    assert p["a5"] < 0.5 < p["a55"] and all(0 < x < 1 for x in p.values())
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
