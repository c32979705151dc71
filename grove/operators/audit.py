"""Where matches are lost and won: errors by cause, regions, keys, decoding settings, twins, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.operators import blocking, decisions

# Name and address similarities that tell kinds of errors apart.
SIMILAR, UNLIKE, RENAMED, SAME_PLACE = 90, 70, 50, 85


def _numbers_differ() -> Column:
    return (F.col("hn_eq") < 0.5) & (F.col("hn_missing_rec") < 0.5) & (F.col("hn_missing_s1") < 0.5)


def false_matches(pred: DataFrame, truth: DataFrame, featured: DataFrame) -> DataFrame:
    """s1, rec, category of predicted pairs that are not true; the first cause that fits counts."""
    wrong = pred.select("s1", "rec").distinct().join(truth.select("s1", "rec"), ["s1", "rec"], "left_anti")
    owned = truth.select("rec").distinct().withColumn("owned", F.lit(True))
    has = truth.select("s1").distinct().withColumn("has", F.lit(True))
    d = wrong.join(featured, ["s1", "rec"], "left").join(owned, "rec", "left").join(has, "s1", "left")
    name = F.col("name_tset")
    cause = (
        F.when(F.col("owned"), "record of another entity").when(F.col("has").isNull(), "entity without records").when(F.col("namekey_eq") > 0.5, "same name key")
        .when((name >= SIMILAR) & _numbers_differ(), "similar name, other house number").when((name < UNLIKE) & (F.col("addr_tset") >= SAME_PLACE), "other name, same address")
        .when(name >= SIMILAR, "similar name").otherwise("other")
    )
    return d.select("s1", "rec", F.concat(F.lit("false: "), cause).alias("category"))


def missed_matches(pred: DataFrame, truth: DataFrame, candidates: DataFrame, featured: DataFrame, s1_states: DataFrame, rec_states: DataFrame) -> DataFrame:
    """s1, rec, category of true pairs that were not predicted: lost by the models, or never candidates.

    featured: pairs that the first stage kept. s1_states, rec_states: entity_id, state."""
    lost = truth.select("s1", "rec").distinct().join(pred.select("s1", "rec"), ["s1", "rec"], "left_anti")
    met = candidates.select("s1", "rec").distinct().withColumn("met", F.lit(True))
    scored = featured.withColumn("kept", F.lit(True))
    d = lost.join(met, ["s1", "rec"], "left").join(scored, ["s1", "rec"], "left")
    d = d.join(s1_states.select(F.col("entity_id").alias("s1"), F.col("state").alias("_own")), "s1", "left").join(rec_states.select(F.col("entity_id").alias("rec"), F.col("state").alias("_rec")), "rec", "left")
    model = (
        F.when(F.col("kept").isNull(), "pruned by the first stage").when(F.col("empty_addr") > 0.5, "empty address").when(F.col("nonlatin") > 0.5, "other script")
        .when(F.col("name_tset") < RENAMED, "renamed").when(_numbers_differ(), "house numbers differ").otherwise("low score")
    )
    never = F.when(F.col("_rec").isNull(), "no region").when(F.col("_own").isNull() | (F.col("_rec") != F.col("_own")), "another region").otherwise("same region, not retrieved")
    return d.select("s1", "rec", F.when(F.col("met"), F.concat(F.lit("missed, candidate: "), model)).otherwise(F.concat(F.lit("missed, no candidate: "), never)).alias("category"))


def gains(errors: DataFrame, pred: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """category, pairs, gain: how much the macro F0.5 would rise if just these errors were put right.

    errors: s1, rec, category; categories that start with 'false' leave the prediction, others join it. Every category's
    effect is the sum of its entities' changes, so all are weighed in one pass."""
    per = decisions.per_entity(pred, truth, s1)
    n = errors.groupBy("category", "s1").agg(F.count(F.lit(1)).alias("x"))
    false = F.startswith("category", F.lit("false"))
    d = n.join(per, "s1").withColumn("p", F.col("n_pred") + F.when(false, -F.col("x")).otherwise(F.col("x"))).withColumn("t", F.col("tp") + F.when(false, 0).otherwise(F.col("x")))
    after = F.when(F.col("n_true") == 0, (F.col("p") == 0).cast("double")).otherwise(1.25 * F.col("t") / (F.col("p") + 0.25 * F.col("n_true")))
    total = per.agg(F.count(F.lit(1)).alias("n_s1"))
    return d.groupBy("category").agg(F.sum("x").alias("pairs"), F.sum(after - F.col("f05")).alias("won")).join(F.broadcast(total), F.lit(True)).select("category", "pairs", (F.col("won") / F.col("n_s1")).alias("gain"))


def state_report(rec_states: DataFrame, s1_states: DataFrame, truth: DataFrame, country: DataFrame) -> DataFrame:
    """country, n, covered, right of true pairs: records with a region, and with their entity's one. country: s1, country."""
    d = truth.select("s1", "rec").distinct().join(country, "s1").join(rec_states.select(F.col("entity_id").alias("rec"), F.col("state").alias("_r")), "rec", "left").join(s1_states.select(F.col("entity_id").alias("s1"), F.col("state").alias("_s")), "s1", "left")
    return d.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count("_r").alias("covered"), F.count_if(F.col("_r") == F.col("_s")).alias("right"))


def confused_states(rec_states: DataFrame, s1_states: DataFrame, truth: DataFrame) -> DataFrame:
    """state, inferred, n of true pairs whose record was placed in another region than its entity."""
    d = truth.select("s1", "rec").distinct().join(rec_states.select(F.col("entity_id").alias("rec"), F.col("state").alias("inferred")), "rec").join(s1_states.select(F.col("entity_id").alias("s1"), "state"), "s1")
    return d.where(F.col("inferred") != F.col("state")).groupBy("state", "inferred").agg(F.count(F.lit(1)).alias("n"))


def key_recall(s1: DataFrame, recs: DataFrame, truth: DataFrame, cap: int = blocking.CAP) -> DataFrame:
    """kind, pairs, hits, recall of each kind of key, and of all together (kind 'any'); without any true pair recall is NaN."""
    theirs = blocking.with_keys(recs).withColumnRenamed("entity_id", "rec")
    met = blocking._capped(s1, cap).join(theirs, ["kind", "key"]).select("kind", "s1", "rec").distinct()
    every = met.unionByName(met.select(F.lit("any").alias("kind"), "s1", "rec").distinct())
    real = truth.select("s1", "rec").distinct()
    total = real.agg(F.count(F.lit(1)).alias("n"))
    d = every.join(real.withColumn("hit", F.lit(1)), ["s1", "rec"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("hits"))
    return d.join(F.broadcast(total), F.lit(True)).select("kind", "pairs", "hits", F.coalesce(F.try_divide(F.col("hits"), F.col("n")), F.lit(float("nan"))).alias("recall"))


def decode_grid(scored: DataFrame, truth: DataFrame, s1: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """c, floor, f05 of expected_f under each setting, all settings in one pass. scored: exclusive pairs."""
    steps = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(float(f)).alias("floor")) for c, f in grid])
    d = scored.select("s1", "rec", "p", F.explode(steps).alias("g")).select("s1", "rec", "p", "g.c", "g.floor")
    kept = decisions.expected_f(d, F.col("c"), F.col("floor"), by=("c", "floor", "s1"))
    hit = truth.select("s1", "rec").distinct().withColumn("hit", F.lit(1))
    got = kept.join(hit, ["s1", "rec"], "left").groupBy("c", "floor", "s1").agg(F.count(F.lit(1)).alias("n_pred"), F.count("hit").alias("tp"))
    n_true = truth.select("s1", "rec").distinct().groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    every = s1.select("s1").distinct().join(n_true, "s1", "left").select("s1", "n_true", F.explode(steps).alias("g")).select("s1", "n_true", "g.c", "g.floor")
    e = every.join(got, ["c", "floor", "s1"], "left").fillna(0)
    f = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).otherwise(1.25 * F.col("tp") / (F.col("n_pred") + 0.25 * F.col("n_true")))
    return e.groupBy("c", "floor").agg(F.avg(f).alias("f05"))


def propagation(comp: DataFrame, truth: DataFrame) -> DataFrame:
    """components, pure, pairs, right: components with two owned records and more, those with one owner, and how often a
    twin's owner is the record's (pairs: records times owners of their other twins).

    comp: entity_id, comp. Twins are counted by owner, never paired one by one."""
    own = comp.withColumnRenamed("entity_id", "rec").join(truth.select("s1", "rec").distinct(), "rec")
    by = own.groupBy("comp", "s1").agg(F.count(F.lit(1)).alias("n"))
    per = by.groupBy("comp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("owners"), F.sum(F.col("n") * (F.col("n") - 1)).alias("right")).where("n >= 2")
    sums = per.agg(F.count(F.lit(1)).alias("components"), F.count_if(F.col("owners") == 1).alias("pure"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.sum("right").alias("right"))
    return sums.fillna(0)


def key_overlap(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """kind, entities, hits: how many entities of one normalised split have a key that the other split has too."""
    a, b = blocking.with_keys(ours), blocking.with_keys(theirs).select("kind", "key").distinct().withColumn("hit", F.lit(True))
    return a.join(b, ["kind", "key"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), F.count("hit").alias("hits"))


def sample_regions(regions: DataFrame, share: float = 0.15, seed: int = 42) -> DataFrame:
    """country, state, n: whole regions of entity_id, country, state, in hashed order, until share of each country's entities
    is reached. A country's window orders its regions alone."""
    n = regions.where("country is not null and state is not null").groupBy("country", "state").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("country")
    order = w.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "country", "state")), "state").rowsBetween(Window.unboundedPreceding, -1)
    d = n.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("total", F.sum("n").over(w))
    return d.where(F.col("before") < share * F.col("total")).select("country", "state", "n")


def doubled(scored: DataFrame, truth: DataFrame, suffix: str = "#2") -> DataFrame:
    """A denser world: every candidate whose record no entity owns stands twice, the second time as another record."""
    lone = scored.join(truth.select("rec").distinct(), "rec", "left_anti").select(*scored.columns)
    return scored.unionByName(lone.withColumn("rec", F.concat("rec", F.lit(suffix))))


def vote_report(votes: DataFrame, names: list[str], prior_weight: float = 10.0) -> DataFrame:
    """pattern, n, tp, rate, bound of pairs by which submissions hold them (columns names, true or false; hit).

    pattern: a + or - a submission, in order. rate is drawn towards the mean of all with prior_weight; bound: the most
    pairs that a pattern of n may stand for, n + 2 sqrt(n) + 3."""
    pattern = F.concat(*[F.when(F.col(c), "+").otherwise("-") for c in names])
    n = votes.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("tp"))
    prior = n.agg((F.sum("tp") / F.sum("n")).alias("prior"))
    rate = (F.col("tp") + prior_weight * F.col("prior")) / (F.col("n") + prior_weight)
    return n.join(F.broadcast(prior), F.lit(True)).select("pattern", "n", "tp", rate.alias("rate"), (F.col("n") + 2 * F.sqrt("n") + 3).alias("bound"))


def without_patterns(votes: DataFrame, names: list[str], dropped: list[str]) -> DataFrame:
    """votes without the pairs of the named patterns."""
    return votes.where(~F.concat(*[F.when(F.col(c), "+").otherwise("-") for c in names]).isin(dropped)) if dropped else votes
