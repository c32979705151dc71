"""Training on known matches: folds of whole regions, out-of-fold scores of both stages, the saved matcher, the report."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.functions.text import normalize
from grove.operators import blocking, collective, decisions
from grove.operators.store import written
from grove.plans import ensemble, explain
from grove.plans import resolve as plan

SEED = 42
#: Members of the second stage. MLlib has no extremely randomised trees; a random forest stands for them.
MEMBERS = ("boosted", "forest", "net")
#: Shares at which a feature's quantiles are taken for normal scores, closer towards the tails, and the tails' own share.
SHARES, TAIL = sorted({0.0, 0.001, 0.005, 0.01, 0.025, *(k / 20 for k in range(1, 20)), 0.975, 0.99, 0.995, 0.999, 1.0}), 1e-7


def fold_of(regions: DataFrame, k: int = 2, seed: int = SEED) -> DataFrame:
    """s1, fold (0 to k - 1) of entity_id, country, state: a region's entities share a fold; those without a region go by id.

    Regions are dealt out in the order of a hash, so folds hold equally many. The window orders the different regions
    alone, whose number does not grow with the entities."""
    digest = lambda *x: F.md5(F.concat_ws("|", F.lit(str(seed)), *x))
    known = regions.where("country is not null and state is not null").select("country", "state").distinct()
    dealt = known.select("country", "state", ((F.row_number().over(Window.orderBy(digest("country", "state"), "country", "state")) - 1) % k).alias("fold"))
    lone = F.conv(F.substring(digest("entity_id"), 1, 8), 16, 10).cast("bigint") % k
    return regions.join(dealt, ["country", "state"], "left").select(F.col("entity_id").alias("s1"), F.coalesce("fold", lone).cast("int").alias("fold"))


def classifier(member: str, n: int, trees: int, seed: int) -> list[Estimator]:
    """The stages after the feature vector of n columns."""
    if member == "boosted":
        return [GBTClassifier(labelCol="y", maxIter=trees, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=seed)]
    if member == "forest":
        return [RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=10, featureSubsetStrategy="0.5", minInstancesPerNode=5, seed=seed)]
    if member == "net":
        scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
        return [scaled, MultilayerPerceptronClassifier(labelCol="y", featuresCol="scaled", layers=[n, 64, 32, 2], maxIter=100, seed=seed)]
    raise ValueError(f"unknown member {member}")


def _numbers(df: DataFrame, cols: list[str], *others: str) -> DataFrame:
    return df.select(*others, *[F.coalesce(F.col(c).cast("double"), F.lit(plan.MISSING)).alias(c) for c in cols])


def normal_scores(df: DataFrame, cols: list[str]) -> SQLTransformer:
    """Adds normal_<c> for every column: its normal score among the values of df, linear between quantiles of one approximate
    pass. Values that fill several quantiles get the middle of their scores, values beyond the ends the end's score."""
    z = [NormalDist().inv_cdf(min(max(u, TAIL), 1 - TAIL)) for u in SHARES]
    scores, last = f"array({', '.join(f'{x!r}D' for x in z)})", len(z) - 1
    parts = []
    for c, found in zip(cols, df.approxQuantile(cols, SHARES, 0.0005)):
        points = f"array({', '.join(f'{x!r}D' for x in found or [0.0] * len(z))})"
        below, upto = f"size(filter({points}, x -> x < `{c}`))", f"size(filter({points}, x -> x <= `{c}`))"
        tied = f"(get({scores}, {below}) + get({scores}, {upto} - 1)) / 2"
        between = f"get({scores}, {below} - 1) + (get({scores}, {below}) - get({scores}, {below} - 1)) * (`{c}` - get({points}, {below} - 1)) / (get({points}, {below}) - get({points}, {below} - 1))"
        parts.append(f"CASE WHEN {upto} > {below} THEN {tied} WHEN {below} = 0 THEN {z[0]!r}D WHEN {below} > {last} THEN {z[-1]!r}D ELSE {between} END AS `normal_{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_member(df: DataFrame, cols: list[str], member: str = "boosted", trees: int = 20, seed: int = SEED) -> PipelineModel | None:
    """A classifier of y; None where df holds one class alone."""
    if df.select("y").distinct().count() < 2:
        return None
    filled, inputs, first = _numbers(df, cols, "y").withColumn("y", F.col("y").cast("double")), cols, []
    if member == "net":
        first, inputs = [normal_scores(filled, cols)], [f"normal_{c}" for c in cols]
    stages = [*first, VectorAssembler(inputCols=inputs, outputCol="features"), *classifier(member, len(cols), trees, seed)]
    return Pipeline(stages=stages).fit(filled)


def score(model: PipelineModel | None, df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """s1, rec and the probability; 0 without a model."""
    if model is None:
        return df.select("s1", "rec", F.lit(0.0).alias(name))
    return model.transform(_numbers(df, cols, "s1", "rec")).select("s1", "rec", vector_to_array("probability")[1].alias(name))


def out_of_fold(df: DataFrame, cols: list[str], k: int, name: str, member: str = "boosted", trees: int = 20, seed: int = SEED) -> DataFrame:
    """s1, rec, name: every pair scored by a model that saw no pair of its fold."""
    each = [score(fit_member(df.where(F.col("fold") != f), cols, member, trees, seed), df.where(F.col("fold") == f), cols, name) for f in range(k)]
    return reduce(DataFrame.unionByName, each)


def mean_of(scored: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """s1, rec, p: the plain mean of the members' p, or their mean under weights."""
    of = lambda m: F.lit(1.0 if weights is None else weights[m])
    every = reduce(DataFrame.unionByName, [d.select("s1", "rec", "p", of(m).alias("w")) for m, d in scored.items()])
    return every.groupBy("s1", "rec").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))


@dataclass
class Matcher:
    """Both stages. meta: what it was trained on and how well it did out of fold."""

    stage1: PipelineModel
    cols1: list[str]
    stage2: dict[str, PipelineModel]
    cols2: list[str]
    meta: dict = field(default_factory=dict)

    def p1(self, featured: DataFrame) -> DataFrame:
        return score(self.stage1, featured, self.cols1, "p1")

    def p2(self, featured: DataFrame) -> DataFrame:
        return mean_of({name: score(m, featured, self.cols2, "p") for name, m in self.stage2.items()}, self.meta.get("weights"))

    def explain(self, featured: DataFrame, top: int = explain.TOP) -> DataFrame:
        """s1, rec, base, families, reasons of pairs with second-stage features, under the boosted member."""
        return explain.explained(self.stage2["boosted"], featured, self.cols2, top)

    def save(self, path: str) -> None:
        """The models and meta below path, on any file system that Spark writes to."""
        self.stage1.write().overwrite().save(f"{path}/stage1")
        for name, model in self.stage2.items():
            model.write().overwrite().save(f"{path}/stage2/{name}")
        about = json.dumps({"cols1": self.cols1, "cols2": self.cols2, "members": list(self.stage2), "meta": self.meta})
        SparkSession.active().createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> Matcher:
        about = json.loads(SparkSession.active().read.text(f"{path}/about").first()["value"])
        stage2 = {name: PipelineModel.load(f"{path}/stage2/{name}") for name in about["members"]}
        return cls(PipelineModel.load(f"{path}/stage1"), about["cols1"], stage2, about["cols2"], about["meta"])


@dataclass
class Prepared:
    """Normalised tables, candidates with features, and the components of twins."""

    s1: DataFrame
    recs: DataFrame
    featured: DataFrame
    comp: DataFrame


def prepare(s1: DataFrame, recs: DataFrame, more: bool = False, **how) -> Prepared:
    """From raw tables. more: also the legal-form, raw-name, canonical-address and vocabulary features. how: see plan.block."""
    a, b = written(normalize(s1)), written(normalize(recs))
    featured = plan.featurize(written(plan.block(a, b, **how)), a, b)
    if more:
        featured = plan.featurize_more(written(featured), a, b, s1, recs)
    return Prepared(a, b, written(featured), collective.components(collective.twin_edges(b)))


def second_stage(one: DataFrame, comp: DataFrame) -> DataFrame:
    """Featured pairs with p1, pruned, with the collective features."""
    kept = one.where(F.col("p1") >= plan.PRUNE)
    return kept.join(collective.collective(kept, comp).drop("p1"), ["s1", "rec"])


def _numbers_of(df: DataFrame) -> dict:
    return {k: (v if not isinstance(v, float) or math.isfinite(v) else None) for k, v in df.first().asDict().items()}


def importance(model: PipelineModel, cols: list[str]) -> list[dict]:
    """Each feature's share of the gain of a tree model, highest first."""
    gain = model.stages[-1].featureImportances.toArray()
    return sorted(({"feature": c, "gain": float(g)} for c, g in zip(cols, gain)), key=lambda r: (-r["gain"], r["feature"]))


@dataclass
class Trained:
    matcher: Matcher
    report: dict
    oof: DataFrame
    matches: DataFrame


def train(s1: DataFrame, recs: DataFrame, truth: DataFrame, k: int = 2, trees: int = 20, members: tuple[str, ...] = MEMBERS, more: bool = False, blends: tuple[str, ...] = (), **how) -> Trained:
    """Both stages fitted on all pairs, and judged on scores out of fold.

    s1, recs: raw tables; truth: s1, rec. blends: further ways of ensemble.cross_fitted to judge; with "weights" among them
    the matcher weighs its members so. The second stage learns from first-stage scores out of fold, in the same folds.
    """
    spark = s1.sparkSession
    json.dumps(how)  # What the matcher is saved with must be text.
    ready = prepare(s1, recs, more, **how)
    ids = ready.s1.select(F.col("entity_id").alias("s1"))
    regions = ready.s1.select("entity_id", "country").join(blocking.s1_state(ready.s1), "entity_id")
    folds = written(fold_of(regions, k))
    hit = truth.select("s1", "rec").distinct().withColumn("y", F.lit(1))
    cols1 = plan.columns(ready.featured)
    all_ = written(ready.featured.join(hit, ["s1", "rec"], "left").fillna(0, ["y"]).join(folds, "s1"))
    oof1 = written(out_of_fold(all_, cols1, k, "p1", trees=trees))
    two = written(second_stage(all_.join(oof1, ["s1", "rec"]), ready.comp))
    cols2 = [c for c in plan.columns(two.drop("fold")) if c != "p1"] + ["p1"]
    each = {m: written(out_of_fold(two, cols2, k, "p", m, trees, SEED + 1)) for m in members}
    oof = written(mean_of(each))
    matches = written(decisions.decode(oof))
    first = oof1.withColumnRenamed("p1", "p")
    rule = blocking.rule_matches(ready.s1, ready.recs)
    fuzzy = ready.featured.select("s1", "rec", (F.col("fz") / 100).alias("p"))
    alone = written(decisions.exclusive(fuzzy))
    t = decisions.best_threshold(spark, alone, truth, ids).first()["t"]
    judge = lambda pred: _numbers_of(decisions.summary(decisions.per_entity(pred, truth, ids)))
    steps = {"exact keys": rule, f"fuzzy score at {t:.3f}": alone.where(F.col("p") >= t), "stage 1 at 0.5": decisions.exclusive(first).where("p >= 0.5"), "stage 1, expected F": decisions.decode(first)}
    steps |= {f"stage 2, {m}": decisions.decode(p) for m, p in each.items()} | {"stage 2, mean": matches}
    meta = {"more": more, "how": how}
    if blends:
        side = written(ensemble.side_by_side(each, two))
        steps |= {f"stage 2, {way}": decisions.decode(written(ensemble.cross_fitted(side, list(members), k, way))) for way in blends}
        if "weights" in blends:
            meta["weights"] = ensemble.fit_weights(side, list(members))
    ladder = [{"step": name, **judge(pred)} for name, pred in steps.items()]
    stage1 = fit_member(all_, cols1, "boosted", trees)
    if stage1 is None:
        raise ValueError("training needs matches and other pairs among the candidates")
    stage2 = {m: model for m in members if (model := fit_member(two, cols2, m, trees, SEED + 1)) is not None}
    by_fold = decisions.per_entity(matches, truth, ids).join(folds, "s1").groupBy("fold").agg(F.count(F.lit(1)).alias("n_s1"), F.avg("f05").alias("f05"))
    country = ready.s1.select(F.col("entity_id").alias("s1"), "country")
    report = {
        "protocol": {"folds": k, "regions": regions.where("state is not null").select("country", "state").distinct().count()},
        "blocking": _numbers_of(decisions.candidate_metrics(ready.featured, truth, ids, ready.recs.count())),
        "ladder": ladder, "final": (final := next(r for r in ladder if r["step"] == "stage 2, mean")),
        "folds": [r.asDict() for r in by_fold.orderBy("fold").collect()],
        "countries": [r.asDict() for r in decisions.slices(matches, truth, ids, country).orderBy("country").collect()],
        "threshold_curve": [r.asDict() for r in decisions.threshold_curve(spark, decisions.exclusive(oof), truth, ids, [round(0.05 * i, 2) for i in range(1, 20)]).orderBy("t").collect()],
        "importance": importance(stage1, cols1),
    }
    return Trained(Matcher(stage1, cols1, stage2, cols2, {"oof_f05": final["f05"], **meta}), report, oof, matches)


@dataclass
class Resolved:
    """p: null for pairs that the first stage pruned."""

    ready: Prepared
    scored: DataFrame
    matches: DataFrame


def apply(matcher: Matcher, s1: DataFrame, recs: DataFrame) -> Resolved:
    """Raw tables resolved by a trained matcher: scored (s1, rec, p1, p) and matches (s1, rec, p)."""
    ready = prepare(s1, recs, matcher.meta.get("more", False), **matcher.meta.get("how", {}))
    one = written(ready.featured.join(matcher.p1(ready.featured), ["s1", "rec"]))
    p = written(matcher.p2(written(second_stage(one, ready.comp))))
    return Resolved(ready, one.select("s1", "rec", "p1").join(p, ["s1", "rec"], "left"), written(decisions.decode(p)))


def evaluate(matcher: Matcher, s1: DataFrame, recs: DataFrame, truth: DataFrame) -> dict:
    """What a trained matcher reaches on labelled tables that it has not seen."""
    done = apply(matcher, s1, recs)
    ids = done.ready.s1.select(F.col("entity_id").alias("s1"))
    country = done.ready.s1.select(F.col("entity_id").alias("s1"), "country")
    return {
        "final": _numbers_of(decisions.summary(decisions.per_entity(done.matches, truth, ids))),
        "blocking": _numbers_of(decisions.candidate_metrics(done.ready.featured, truth, ids, done.ready.recs.count())),
        "countries": [r.asDict() for r in decisions.slices(done.matches, truth, ids, country).orderBy("country").collect()],
    }
