"""From scored pairs to matches, and how good matches are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRIOR_MISSES, FLOOR = 0.15, 0.05


def exclusive(scored: DataFrame) -> DataFrame:
    """Every record stays with its most probable entity; ties to the smaller id."""
    return scored.withColumn("_rn", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("p"), "s1"))).where("_rn = 1").drop("_rn")


def expected_f(scored: DataFrame, c: float | Column = PRIOR_MISSES, floor: float | Column = FLOOR, by: tuple[str, ...] = ("s1",)) -> DataFrame:
    """The records of each entity (of each group of by), most probable first, up to the number that maximises the expected F0.5.

    Values within 1e-9 are equal, and the smaller number wins; none where keeping none is best."""
    all_ = Window.partitionBy(*by)
    first = all_.orderBy(F.desc("p"), "rec")
    order = first.rowsBetween(Window.unboundedPreceding, 0)
    d = scored.where(F.col("p") >= floor).withColumn("k", F.row_number().over(first)).withColumn("upto", F.sum("p").over(order)).withColumn("total", F.sum("p").over(all_))
    d = d.withColumn("EF", F.round(1.25 * F.col("upto") / (F.col("k") + 0.25 * (F.col("total") + c)), 9)).withColumn("EF0", F.exp(F.sum(F.log(1 - F.least("p", F.lit(1 - 1e-9)))).over(all_)))
    d = d.withColumn("best", F.max("EF").over(all_)).withColumn("stop", F.min(F.when(F.col("EF") == F.col("best"), F.col("k"))).over(all_))
    return d.where((F.col("best") > F.col("EF0")) & (F.col("k") <= F.col("stop"))).select(*scored.columns)


def decode(scored: DataFrame) -> DataFrame:
    return expected_f(exclusive(scored))


def per_entity(pred: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """s1, n_true, n_pred, tp, f05 for every id of s1 (column s1). Without truth: 1 if nothing is predicted, else 0."""
    n = lambda d, c: d.groupBy("s1").agg(F.count(F.lit(1)).alias(c))
    pred, truth = pred.select("s1", "rec").distinct(), truth.select("s1", "rec").distinct()
    d = s1.select("s1").distinct().join(n(truth, "n_true"), "s1", "left").join(n(pred, "n_pred"), "s1", "left").join(n(pred.join(truth, ["s1", "rec"]), "tp"), "s1", "left").fillna(0)
    f = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).otherwise(1.25 * F.col("tp") / (F.col("n_pred") + 0.25 * F.col("n_true")))
    return d.select("s1", "n_true", "n_pred", "tp", f.alias("f05"))


def summary(per: DataFrame) -> DataFrame:
    alone = F.col("n_true") == 0
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    f1 = F.when(alone, (F.col("n_pred") == 0).cast("double")).otherwise(2 * F.col("tp") / (F.col("n_pred") + F.col("n_true")))
    return per.agg(F.avg("f05").alias("f05"), F.avg(f1).alias("f1"), ratio("tp", "n_pred").alias("precision"), ratio("tp", "n_true").alias("recall"), F.count(F.lit(1)).alias("n_s1"), F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred"), F.avg(alone.cast("double")).alias("singleton_share"), F.avg(F.when(alone, F.col("f05"))).alias("singleton_accuracy"), F.avg(((F.col("tp") == F.col("n_true")) & (F.col("tp") == F.col("n_pred"))).cast("double")).alias("exact_share"))


def candidate_metrics(pairs: DataFrame, truth: DataFrame, s1: DataFrame, n_recs: int) -> DataFrame:
    """recall of the candidates, the F0.5 that a perfect choice from them would reach, candidates an entity, share of pairs pruned."""
    per = per_entity(pairs, truth, s1)
    oracle = F.when(F.col("n_true") == 0, 1.0).otherwise(1.25 * F.col("tp") / (F.col("tp") + 0.25 * F.col("n_true")))
    return per.agg((F.sum("tp") / F.sum("n_true")).alias("recall"), F.avg(oracle).alias("oracle_f05"), F.avg("n_pred").alias("cand_per_s1"), (1 - F.sum("n_pred") / (F.count(F.lit(1)) * F.lit(float(n_recs)))).alias("reduction"))


def threshold_curve(spark: SparkSession, scored: DataFrame, truth: DataFrame, s1: DataFrame, grid: list[float]) -> DataFrame:
    """t, f05 for each threshold: one pass over the pairs, which are counted at every threshold they reach."""
    steps = F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col("p"))
    hit = scored.join(truth.select("s1", "rec", F.lit(1).alias("hit")), ["s1", "rec"], "left").select("s1", F.explode(steps).alias("t"), F.coalesce("hit", F.lit(0)).alias("hit"))
    got = hit.groupBy("s1", "t").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("hit").alias("tp"))
    every = s1.select("s1").distinct().join(truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true")), "s1", "left").select("s1", F.coalesce("n_true", F.lit(0)).alias("n_true"), F.explode(F.array(*[F.lit(t) for t in grid])).alias("t"))
    d = every.join(got, ["s1", "t"], "left").fillna(0)
    f = F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double")).otherwise(1.25 * F.col("tp") / (F.col("n_pred") + 0.25 * F.col("n_true")))
    return d.groupBy("t").agg(F.avg(f).alias("f05"))


#: Thresholds that the best one is picked from.
FINE_GRID = [round(0.05 + 0.025 * i, 3) for i in range(38)]


def best_threshold(spark: SparkSession, scored: DataFrame, truth: DataFrame, s1: DataFrame, grid: list[float] = FINE_GRID) -> DataFrame:
    """One row, t and f05: the threshold of highest macro F0.5 (nine digits), ties to the smallest."""
    return threshold_curve(spark, scored, truth, s1, grid).orderBy(F.desc(F.round("f05", 9)), "t").limit(1)


def outcomes(per: DataFrame) -> DataFrame:
    """per_entity's rows with outcome: how an entity's matches compare with the truth."""
    alone, none = F.col("n_true") == 0, F.col("n_pred") == 0
    kind = F.when(alone & none, "correct_singleton").when(alone, "false_merge").when((F.col("tp") == F.col("n_true")) & (F.col("n_pred") == F.col("n_true")), "exact").when(F.col("tp") < F.col("n_pred"), "has_false_match").otherwise("missed_match")
    return per.withColumn("outcome", kind)


def list_entities(entities: DataFrame, country: str | None = None, q: str | None = None, outcome: str | None = None, offset: int = 0, limit: int = 25) -> tuple[int, DataFrame]:
    """How many entities fit, and one page of them by id. q: a literal part of name, id or address in any case; outcome: one, or errors."""
    d = entities
    if country:
        d = d.where(F.col("country") == country)
    if q and q.strip():
        d = d.where(F.contains(F.lower(F.concat_ws("\n", "business_name", "s1", "business_address")), F.lit(q.strip().lower())))
    if outcome:
        d = d.where(F.col("outcome").isin("false_merge", "has_false_match", "missed_match") if outcome == "errors" else F.col("outcome") == outcome)
    return d.count(), d.orderBy("s1").offset(offset).limit(limit)


def by_country(scored: DataFrame, country: DataFrame, thresholds: dict[str, float], default: float = 0.7) -> DataFrame:
    """Pairs that reach the threshold of their entity's country. country: s1, country."""
    least = F.coalesce(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("country")], F.lit(default)) if thresholds else F.lit(default)
    return scored.join(country, "s1").where(F.col("p") >= least).select(*scored.columns)


def rescaled(scored: DataFrame, a: float) -> DataFrame:
    """p with its odds multiplied by a."""
    return scored.withColumn("p", a * F.col("p") / (a * F.col("p") + 1 - F.col("p")))


def record_slices(pred: DataFrame, truth: DataFrame, of: DataFrame) -> DataFrame:
    """slice, n_true, n_pred, tp, precision, recall of the records of each slice. of: rec, slice, for instance a record's
    source or its script. Empty denominators give 0."""
    n = lambda d, c: d.select("s1", "rec").distinct().join(of, "rec").groupBy("slice").agg(F.count(F.lit(1)).alias(c))
    hit = pred.select("s1", "rec").distinct().join(truth.select("s1", "rec").distinct(), ["s1", "rec"])
    d = of.select("slice").distinct().join(n(truth, "n_true"), "slice", "left").join(n(pred, "n_pred"), "slice", "left").join(n(hit, "tp"), "slice", "left").fillna(0)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return d.select("slice", "n_true", "n_pred", "tp", share("tp", "n_pred").alias("precision"), share("tp", "n_true").alias("recall"))


def slices(pred: DataFrame, truth: DataFrame, s1: DataFrame, country: DataFrame) -> DataFrame:
    """country, n_s1, f05 and recall of each country's entities. country: s1, country."""
    return per_entity(pred, truth, s1).join(country, "s1").groupBy("country").agg(F.count(F.lit(1)).alias("n_s1"), F.avg("f05").alias("f05"), F.coalesce(F.try_divide(F.sum("tp"), F.sum("n_true")), F.lit(0.0)).alias("recall"))
