"""End to end: normalise, block, featurise, score in two stages, decode."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions import address, text
from grove.functions.text import normalize
from grove.operators import blocking, collective, decisions
from grove.operators import features as feats
from grove.operators.store import written

MISSING, PRUNE = -1.0, 0.01


@dataclass
class Prepared:
    s1: DataFrame
    recs: DataFrame
    pairs: DataFrame


def block(s1: DataFrame, recs: DataFrame, codes: DataFrame | None = None, min_count: int = blocking.MIN_COUNT, expand_count: int = blocking.EXPAND_COUNT) -> DataFrame:
    """s1, rec, cos_name, cos_addr, cos_comb, in_keys: retrieval within country and inferred state, and pairs that only keys find."""
    aliases = written(blocking.learn_aliases(s1, recs, min_count, expand_count=expand_count, codes=codes))
    part = ["country", "state"]
    at = lambda d, states: d.join(states.where("state is not null"), "entity_id")
    near = written(blocking.retrieve(at(s1, blocking.s1_state(s1)), at(recs, blocking.infer_state(recs, aliases)), part))
    only = blocking.key_candidates(s1, recs).join(near, ["s1", "rec"], "left_anti")
    return near.withColumn("in_keys", F.lit(False)).unionByName(only.withColumn("in_keys", F.lit(True)), allowMissingColumns=True)


def featurize(pairs: DataFrame, s1: DataFrame, recs: DataFrame) -> DataFrame:
    """pairs (once each, written) with competition, differences, generic words, similarities and ranks.

    What texts alone decide is found once for each pair of kinds of texts. Rows travel by record and by entity with their
    cosines, kinds and one score, and meet the features of their kinds last."""
    (ours, a), (theirs, b) = (blocking.text_classes(d, ["country"], feats.TEXTS) for d in (s1, recs))
    named = lambda d, of, kind: d.select(F.col("entity_id").alias(of), F.col("kind").alias(kind))
    known = written(pairs.join(named(theirs, "rec", "_k2"), "rec").join(named(ours, "s1", "_k1"), "s1").select(*pairs.columns, "_k1", "_k2"))
    texts = written(known.select(F.col("_k1").alias("s1"), F.col("_k2").alias("rec")).distinct())
    own = feats.generic_features(feats.diff_features(texts, a, b), a, b, feats.generic_tokens(s1))
    own = written(feats.pair_scores(own, a, b).withColumnsRenamed({"s1": "_k1", "rec": "_k2"}))
    d = feats.context_by_record(feats.competition_by_record(known.join(own.select("_k1", "_k2", "fz"), ["_k1", "_k2"])))
    d = written(feats.context_by_entity(feats.competition_by_entity(d)).drop("fz"))
    d = d.join(own.drop("src3"), ["_k1", "_k2"]).withColumn("src3", F.startswith("rec", F.lit("S3")).cast("double"))
    return d.select(*pairs.columns, *feats.COMP, *own.columns[2:], *feats.CONTEXT)


def featurize_more(featured: DataFrame, s1: DataFrame, recs: DataFrame, raw1: DataFrame, raw2: DataFrame) -> DataFrame:
    """featured with legal-form, raw-name, canonical-address and vocabulary features. s1, recs: normalised; raw1, raw2: raw."""
    of = lambda d, name, f: d.select("entity_id", f(F.col("business_name")).alias(name))
    d = feats.legal_features(featured, of(raw1, "legal", text.legal_form), of(raw2, "legal", text.legal_form))
    d = feats.raw_features(d, of(raw1, "raw", text.raw_name), of(raw2, "raw", text.raw_name))
    d = feats.canonical_features(d, address.canonical_addresses(s1), address.canonical_addresses(recs))
    return feats.vocab_features(d, s1, recs, feats.token_df(s1), feats.generic_tokens(s1))


def columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if c not in ("s1", "rec", "y", "p1", "p") and t not in ("string",)]


def vector(cols: list[str]) -> Column:
    """cols as a vector of numbers; missing ones are MISSING."""
    return array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in cols]))


def fit(df: DataFrame, cols: list[str], trees: int = 20, seed: int = 42) -> GBTClassificationModel:
    """A boosted-tree classifier of y; missing features are MISSING."""
    d = df.select(vector(cols).alias("features"), F.col("y").cast("double"))
    return GBTClassifier(labelCol="y", maxIter=trees, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=seed).fit(d)


def predict(model: GBTClassificationModel, df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """df with the model's probability; the rows stay where they are."""
    return model.transform(df.withColumn("features", vector(cols))).select(*df.columns, vector_to_array("probability")[1].alias(name))


def fuzzy_matches(featured: DataFrame, t: float = 75.0) -> DataFrame:
    """Without learning: the best pair of each record by 0.6 name + 0.4 address token-set similarity, at t or more."""
    return decisions.exclusive(featured.select("s1", "rec", F.col("fz").alias("p"))).where(F.col("p") >= t)


def resolve(s1: DataFrame, recs: DataFrame, truth: DataFrame, **how) -> DataFrame:
    """s1, rec, p: matches of raw tables, by two stages trained on the known pairs of truth (s1, rec)."""
    a, b = written(normalize(s1)), written(normalize(recs))
    known = truth.select("s1", "rec", F.lit(1).alias("y"))
    featured = written(featurize(written(block(a, b, **how).join(known, ["s1", "rec"], "left").fillna(0, ["y"])), a, b))
    cols = columns(featured)
    one = written(predict(fit(featured, cols), featured, cols, "p1").where(F.col("p1") >= PRUNE))
    more = collective.collective(one, collective.components(collective.twin_edges(b)))
    two = written(one.join(more.drop("p1"), ["s1", "rec"]))
    cols2 = columns(two) + ["p1"]
    return decisions.decode(predict(fit(two, cols2, seed=43), two, cols2, "p").select("s1", "rec", "p"))
