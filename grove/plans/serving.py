"""Resolved tables kept for questions: one entity's view, and new records matched as if they had been there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.functions.text import normalize
from grove.operators import blocking, collective, decisions
from grove.operators import features as feats
from grove.operators.store import written
from grove.plans import resolve as plan
from grove.plans import training
from grove.plans.training import Matcher

PART = ["country", "state"]
TABLES = ("raw", "s1", "recs", "states", "aliases", "idf", "weights", "pairs", "comp", "matches", "truth")


@dataclass
class Index:
    """raw, s1: reference entities; recs: normalised records; states: entity_id, state; aliases, idf, weights: what retrieval
    needs; pairs: s1, rec, cosines, fz, p1, p; comp: twins; matches: s1, rec, p; truth: s1, rec (none if not known)."""

    matcher: Matcher
    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(Matcher.load(f"{path}/matcher"), {t: spark.read.parquet(f"{path}/{t}") for t in TABLES})


def build(path: str, matcher: Matcher, s1: DataFrame, recs: DataFrame, truth: DataFrame | None = None) -> Index:
    """Raw tables resolved by matcher and written below path, each table once; opened again by Index.open."""
    spark = s1.sparkSession
    how = matcher.meta.get("how", {})
    done = training.apply(matcher, s1, recs)
    ready = done.ready
    states = written(blocking.s1_state(ready.s1))
    placed = ready.s1.join(states.where("state is not null"), "entity_id")
    ours = written(blocking.both_views(placed, PART))
    idf = blocking.vocabulary(ours, placed, PART)
    aliases = blocking.learn_aliases(ready.s1, ready.recs, how.get("min_count", blocking.MIN_COUNT), expand_count=how.get("expand_count", blocking.EXPAND_COUNT), codes=how.get("codes"))
    tables = {
        "raw": s1.select("entity_id", "business_name", "business_address", "country"), "s1": ready.s1, "recs": ready.recs, "states": states, "aliases": aliases, "idf": idf, "weights": blocking.unit_weights(ours, idf, PART),
        "pairs": ready.featured.select("s1", "rec", "cos_name", "cos_addr", "cos_comb", "fz").join(done.scored, ["s1", "rec"]), "comp": ready.comp, "matches": done.matches,
        "truth": truth.select("s1", "rec") if truth is not None else spark.createDataFrame([], "s1 string, rec string"),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    matcher.save(f"{path}/matcher")
    return Index.open(spark, path)


def entities(index: Index) -> DataFrame:
    """The reference entities with their counts and outcome; see decisions.list_entities for pages of them."""
    raw = index["raw"].withColumnRenamed("entity_id", "s1")
    per = decisions.outcomes(decisions.per_entity(index["matches"], index["truth"], raw))
    return raw.join(per, "s1")


def entity_view(pairs: DataFrame, matches: DataFrame, truth: DataFrame, s1: str) -> DataFrame:
    """s1, rec, p1, p, matched, true, went_to of one entity's candidates and of its records that are none.

    went_to: the other entity that holds the record. Matched ones come first, then by p (null last), p1 and rec."""
    own = pairs.where(F.col("s1") == s1).select("rec", "p1", "p")
    real = truth.where(F.col("s1") == s1).select("rec").distinct().withColumn("true", F.lit(True))
    here = own.join(real, "rec", "full")
    held = matches.join(here.select("rec"), "rec", "left_semi").groupBy("rec").agg(F.max(F.col("s1") == s1).alias("matched"), F.min(F.when(F.col("s1") != s1, F.col("s1"))).alias("went_to"))
    d = here.join(held, "rec", "left").select(F.lit(s1).alias("s1"), "rec", "p1", "p", F.coalesce("matched", F.lit(False)).alias("matched"), F.coalesce("true", F.lit(False)).alias("true"), "went_to")
    return d.orderBy(F.desc("matched"), F.desc_nulls_last("p"), F.desc_nulls_last("p1"), "rec")


def examples(recs: DataFrame, each: int = 2, seed: int = 42) -> DataFrame:
    """Records to try: each of every country and one in another script, drawn by a hash."""
    order = F.xxhash64(F.lit(seed), "entity_id")
    some = recs.withColumn("_r", F.row_number().over(Window.partitionBy("country").orderBy(order, "entity_id"))).where(F.col("_r") <= each).drop("_r")
    other = recs.where("nonlatin").orderBy(order, "entity_id").limit(1)
    return some.unionByName(other.join(some.select("entity_id"), "entity_id", "left_anti").select(*some.columns))


def query_pairs(index: Index, queries: DataFrame) -> DataFrame:
    """s1, rec, cosines, in_keys, searched of normalised queries: retrieval in the inferred region, or in all regions of the
    country where none is recognised, and the pairs that keys add."""
    found = queries.join(blocking.infer_state(queries, index["aliases"]), "entity_id")
    regions = index["states"].join(index["s1"].select("entity_id", "country"), "entity_id").where("state is not null").select(*PART).distinct()
    placed = found.join(regions, PART, "left_semi").withColumn("searched", F.lit("region"))
    lost = found.join(placed.select("entity_id"), "entity_id", "left_anti").drop("state").join(regions, "country").withColumn("searched", F.lit("all regions"))
    at = written(placed.unionByName(lost.select(*placed.columns)))
    theirs = written(blocking.unit_weights(blocking.both_views(at, PART), index["idf"], PART))
    near = written(blocking.nearest_pairs(index["weights"], theirs, PART).withColumn("in_keys", F.lit(False)))
    only = blocking.key_candidates(index["s1"], queries).join(near, ["s1", "rec"], "left_anti").withColumn("in_keys", F.lit(True))
    where = at.select(F.col("entity_id").alias("rec"), "searched").distinct()
    return near.unionByName(only, allowMissingColumns=True).join(where, "rec", "left")


def _world(query, id_):
    return F.concat_ws("|", query, id_)


def query_features(index: Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first stage's features of s1, rec, cosines, in_keys: entities' maxima, ranks and counts include their stored pairs.

    Every query stands alone: it meets stored pairs, never another query."""
    mine = pairs.select("rec", "s1").distinct()
    stored = index["pairs"].join(pairs.select("s1").distinct(), "s1", "left_semi")
    beside = mine.withColumnRenamed("rec", "query").join(stored.select("s1", F.col("rec").alias("other"), "cos_name", "cos_addr", "cos_comb", "fz"), "s1")
    best = feats.maxima(pairs.select("s1", "cos_name", "cos_addr", "cos_comb", F.col("rec").alias("query")).unionByName(beside.select("s1", "cos_name", "cos_addr", "cos_comb", "query")).withColumn("s1", _world("query", "s1")))
    apart = feats.competition_against(pairs.withColumn("s1", _world("rec", "s1")), best)
    d = apart.withColumn("s1", F.expr("substr(s1, length(rec) + 2)"))
    d = feats.diff_features(d, index["s1"], queries)
    d = feats.generic_features(d, index["s1"], queries, feats.generic_tokens(index["s1"]))
    own = feats.pair_features(d, index["s1"], queries)
    above = beside.join(own.select("s1", F.col("rec").alias("query"), F.col("fz").alias("mine")), ["s1", "query"]).groupBy("s1", F.col("query").alias("rec")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("fz") > F.col("mine")).alias("_above"))
    more = {"rev_rank_fz": F.coalesce("_above", F.lit(0)) + 1, "n_cand_s1": F.coalesce("_n", F.lit(0)) + 1}
    return own.join(above, ["s1", "rec"], "left").withColumns(more).drop("_n", "_above")


def query_collective(index: Index, queries: DataFrame, kept: DataFrame) -> DataFrame:
    """Collective features of queries' pairs (s1, rec, p1) among the stored scores; a query joins all its twins' components."""
    live = index["pairs"].where(F.col("p1") >= plan.PRUNE).select("s1", "rec", "p1")
    keys = collective.twin_keys(queries).withColumnRenamed("entity_id", "query").join(collective.twin_keys(index["recs"]), "key")
    size = keys.groupBy("query", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < collective.TWINS_MOST)
    twins = written(keys.join(size.select("query", "key"), ["query", "key"], "left_semi").select("query", F.col("entity_id").alias("rec")).distinct())
    comps = index["comp"].withColumnRenamed("entity_id", "rec")
    joined = twins.join(comps, "rec", "left").select("query", F.coalesce("comp", "rec").alias("comp"), "rec")
    members = joined.select("query", "comp").distinct().join(comps, "comp").select("query", "rec").unionByName(joined.select("query", "rec")).unionByName(joined.select("query", F.col("query").alias("rec"))).distinct()
    beside = kept.select(F.col("rec").alias("query"), "s1").distinct().join(live.select("s1", "rec"), "s1").select("query", "rec")
    around = beside.unionByName(members.select("query", "rec")).distinct().join(live, "rec").select("query", "s1", "rec", "p1")
    rows = around.unionByName(kept.select(F.col("rec").alias("query"), "s1", "rec", F.col("p1").cast("double").alias("p1")))
    world = rows.select(_world("query", "s1").alias("s1"), _world("query", "rec").alias("rec"), "p1")
    comp = members.select(_world("query", "rec").alias("entity_id"), F.col("query").alias("comp"))
    own = kept.select("s1", "rec", _world("rec", "s1").alias("_s"), _world("rec", "rec").alias("_r"))
    out = collective.collective(world, comp).withColumnsRenamed({"s1": "_s", "rec": "_r"})
    return own.join(out, ["_s", "_r"]).drop("_s", "_r", "p1")


def decide(index: Index, scored: DataFrame) -> DataFrame:
    """s1, rec of queries that their best entity's cluster keeps when each is added to it alone. scored: s1, rec, p."""
    best = decisions.exclusive(scored.where("p is not null").select("s1", "rec", "p"))
    cluster = decisions.exclusive(index["pairs"].where("p is not null").select("s1", "rec", "p"))
    beside = best.select("s1", F.col("rec").alias("query")).join(cluster, "s1")
    world = beside.select(_world("query", "s1").alias("s1"), F.concat(F.lit("+"), "rec").alias("rec"), "p").unionByName(best.select(_world("rec", "s1").alias("s1"), F.concat(F.lit("?"), "rec").alias("rec"), "p"))
    kept = decisions.expected_f(world).where(F.startswith("rec", F.lit("?"))).select(F.expr("substr(rec, 2)").alias("rec"))
    return best.join(kept, "rec", "left_semi").select("s1", "rec")


def match(index: Index, records: DataFrame, top: int = 5) -> DataFrame:
    """rec, rank, s1, p, p1, searched, cluster_size, matched: the top entities of each new raw record, best first.

    records: entity_id (not one of the stored), business_name, business_address, country. Records are matched one by one
    among what is stored, however many come. One without any candidate has a row with null s1 and rank; pairs that the
    first stage prunes have a null p and come last. Ties go to the smaller s1."""
    queries = written(normalize(records))
    pairs = written(query_pairs(index, queries))
    featured = query_features(index, queries, pairs)
    if index.matcher.meta.get("more"):
        featured = plan.featurize_more(written(featured), index["s1"], queries, index["raw"], records)
    featured = written(featured)
    one = written(featured.join(index.matcher.p1(featured), ["s1", "rec"]))
    kept = one.where(F.col("p1") >= plan.PRUNE)
    two = written(kept.join(query_collective(index, queries, kept.select("s1", "rec", "p1")), ["s1", "rec"]))
    scored = written(one.select("s1", "rec", "p1").join(index.matcher.p2(two), ["s1", "rec"], "left"))
    sure = decide(index, scored).withColumn("matched", F.lit(True))
    sizes = index["matches"].groupBy("s1").agg(F.count(F.lit(1)).alias("cluster_size"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc_nulls_last("p"), F.desc("p1"), "s1"))).where(F.col("rank") <= top)
    full = ranked.join(sure, ["s1", "rec"], "left").join(sizes, "s1", "left").join(pairs.select("s1", "rec", "searched"), ["s1", "rec"], "left")
    every = queries.select(F.col("entity_id").alias("rec")).join(full, "rec", "left")
    return every.select("rec", "rank", "s1", "p", "p1", "searched", F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"), F.coalesce("matched", F.lit(False)).alias("matched"))
