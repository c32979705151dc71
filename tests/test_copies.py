"""Tables of repeated texts: the queries give their SQL's rows, and copies are not paired one by one."""

import math

import duckdb
import pytest

from grove.functions.text import normalize
from grove.operators import blocking, collective
from grove.plans import queries, resolve
from grove.plans.registry import QUERIES, SQL


def rows(frame):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def by_sql(name, d):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet/*.parquet'")
    return con.sql(SQL[name]).df()


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """A part table of 12 texts, each of them 7 times on either side: no key is unique, so no pair is known."""
    names = [f"{a} {b}" for a in ("large", "hot", "blue") for b in ("ring", "bolt")]
    rows = [(42 * i + 3 * j + side, name, "STANDARD", 7 if i % 2 else 40) for i, name in enumerate(2 * names) for j in range(7) for side in (0, 1)]
    d = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").coalesce(1).write.parquet(f"file://{d}/part.parquet")
    return d


def test_key_recall_without_true_pairs(spark, copied):
    got = QUERIES["key_recall"](spark, copied).toPandas()
    assert len(got) and all(math.isnan(x) for x in got["recall"])
    assert rows(got) == rows(by_sql("key_recall", copied))


def test_candidates_of_copies(spark, copied, monkeypatch):
    """Twelve kinds of texts meet, however many copies each has; the rows stay those of the SQL."""
    summed, met = blocking._summed, []
    monkeypatch.setattr(blocking, "_summed", lambda d, keys: met.append(d.select(*keys).distinct().count()) or summed(d, keys))
    got = rows(QUERIES["tfidf_candidates"](spark, copied).toPandas())
    assert len(got) > 84 and got == rows(by_sql("tfidf_candidates", copied))
    assert max(met) <= 12 * 12


def test_blocks_of_copies(spark, copied, monkeypatch):
    """The retrieval of resolve meets kinds of texts within a region, not their copies."""
    summed, met = blocking._summed, []
    monkeypatch.setattr(blocking, "_summed", lambda d, keys: met.append(d.select(*keys).distinct().count()) or summed(d, keys))
    e = normalize(queries.ents(spark, copied))
    s1, recs = e.where("entity_id LIKE 'S1-%'"), e.where("entity_id NOT LIKE 'S1-%'")
    assert resolve.block(s1, recs, min_count=2, expand_count=5).count() >= 84 * 5 and met and max(met) <= 180


def test_top_names_of_copies(spark, copied, monkeypatch):
    tfidf, weighed = blocking.tfidf, []
    monkeypatch.setattr(blocking, "tfidf", lambda *a, **k: [weighed.append(d.select("entity_id").distinct().count()) or d for d in tfidf(*a, **k)])
    got = rows(QUERIES["tfidf_name_topk"](spark, copied).toPandas())
    assert len(got) > 84 and got == rows(by_sql("tfidf_name_topk", copied))
    assert len(weighed) == 2 and max(weighed) <= 12


def test_kinds_keep_repeated_ids(spark):
    """An id that stands in two parts, or twice in one, is one entity with all its rows, as in the weights of entities."""
    name = "entity_id string, country string, name_tok string, addr string"
    s1 = spark.createDataFrame([("a", "US", "harbor mill", "1 oak road"), ("a", "India", "harbor mill", "1 oak road"), ("b", "US", "harbor mill", "1 oak road"), ("c", "US", "harbor tea", ""), ("c", "US", "zinc", "2 elm road")], name)
    recs = spark.createDataFrame([("r", "US", "harbor mill", "1 oak road"), ("r", "India", "harbor mill", "oak road"), ("t", "US", "zinc tea", "2 elm road"), ("u", None, "zinc", "")], name)
    whole = {(r["s1"], r["rec"]): round(r["cos"], 6) for r in blocking.cosines(*blocking.tfidf(s1, recs, "name", ["country"]), ["country"]).collect()}
    assert {(r["s1"], r["rec"]): r["cos"] for r in blocking.top_cosines(s1, recs, "name", ["country"], 9).collect()} == whole
    every = [(a, r) for a in "abc" for r in "rtu"]
    pairs = blocking.pair_cosines(spark.createDataFrame(every, "s1 string, rec string"), *blocking.weighted(s1, recs, ["country"])).where("cos_comb > 0")
    combined = lambda d: {(r["s1"], r["rec"]): round(r["cos_comb"], 9) for r in d.collect()}
    assert combined(blocking.retrieve(s1, recs, ["country"], keep=None)) == combined(pairs)


def test_twins_of_large_components(spark):
    """4,000 records of one component: their 16 million meetings are counted, not made."""
    n = 4000
    scored = spark.createDataFrame([(s1, f"r{i:04d}", p) for i in range(n) for s1, p in ((f"a{i % 3}", 0.5 + i / n / 4), ("z", 0.25))], "s1 string, rec string, p1 double")
    comp = spark.createDataFrame([(f"r{i:04d}", "c") for i in range(n)] + [("alone", "d")], "entity_id string, comp string")
    made = collective.collective(scored, comp)
    got = {(r["s1"], r["rec"]): r for r in made.collect()}
    assert len(got) == 2 * n and {r["n_twins"] for r in got.values()} == {n - 1}
    assert got["a0", "r0000"]["twins_agree"] == 1333 and got["z", "r0000"]["twins_agree"] == 0 and got["z", "r0000"]["twins_best_p1_same"] == 0
    top, runner = got["a0", "r3999"], got["a0", "r0003"]
    assert top["twins_best_p1_same"] == 0.5 + 3996 / n / 4 and runner["twins_best_p1_same"] == 0.5 + 3999 / n / 4
    assert _most_rows(made) <= 4 * n
    several = collective.collective(scored, comp.unionByName(comp.limit(2).selectExpr("entity_id", "'b' AS comp")))
    again = {(r["s1"], r["rec"]): r for r in several.collect()}
    assert again["z", "r0000"]["n_twins"] == n and again["a0", "r0000"]["twins_agree"] == 1333 and all(again[k] == got[k] for k in got if k[1] > "r0001")
    assert _most_rows(several) <= 4 * n


def _most_rows(df):
    """The most rows that a join of df's finished plan put out."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        p = p.finalPhysicalPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan() if p.nodeName().endswith("QueryStage") else p
        if "Join" in p.nodeName():
            most = max(most, p.metrics().get("numOutputRows").get().value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most
