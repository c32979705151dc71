"""Ways to join the members' scores: fitted weights and a stacked model, each fitted on the other folds."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.operators.store import written

EDGE = 1e-6


def side_by_side(scored: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """s1, rec, y, fold and one column a member, from each member's s1, rec, p. labels: s1, rec, y, fold."""
    return reduce(lambda d, m: d.join(scored[m].select("s1", "rec", F.col("p").alias(m)), ["s1", "rec"]), scored, labels.select("s1", "rec", "y", "fold"))


def blend(weights: dict[str, float]) -> Column:
    return sum(F.lit(w) * F.col(m) for m, w in weights.items())


def fit_weights(df: DataFrame, members: list[str], rounds: int = 50, tolerance: float = 1e-4) -> dict[str, float]:
    """The weights, 0 or more and 1 in sum, under which the mean of the members' probabilities has the least log-loss of y.

    The labels' likelihood is that of a mixture, so weights move to the members' mean shares in it: the loss falls with
    every round, and each is one aggregate over df. Without rows all weights are equal."""
    w = {m: 1 / len(members) for m in members}
    likely = {m: F.greatest(F.when(F.col("y") == 1, F.col(m)).otherwise(1 - F.col(m)), F.lit(EDGE)) for m in members}
    for _ in range(rounds):
        whole = sum(F.lit(w[m]) * likely[m] for m in members)
        got = df.agg(*[F.avg(F.lit(w[m]) * likely[m] / whole).alias(m) for m in members]).first().asDict()
        if None in got.values():
            break
        moved = max(abs(got[m] - w[m]) for m in members)
        w = got
        if moved < tolerance:
            break
    return w


def _logits(df: DataFrame, members: list[str], *others: str) -> DataFrame:
    safe = lambda m: F.greatest(F.least(F.col(m), F.lit(1 - EDGE)), F.lit(EDGE))
    return df.select(*others, *[F.log(safe(m) / (1 - safe(m))).alias(m) for m in members])


def fit_stack(df: DataFrame, members: list[str]) -> PipelineModel:
    """A logistic model of y over the members' log-odds."""
    stages = [VectorAssembler(inputCols=members, outputCol="features"), LogisticRegression(labelCol="y", regParam=1e-3)]
    return Pipeline(stages=stages).fit(_logits(df, members, "y").withColumn("y", F.col("y").cast("double")))


def stacked(model: PipelineModel, df: DataFrame, members: list[str]) -> DataFrame:
    return model.transform(_logits(df, members, "s1", "rec")).select("s1", "rec", vector_to_array("probability")[1].alias("p"))


def cross_fitted(df: DataFrame, members: list[str], k: int, how: str = "weights") -> DataFrame:
    """s1, rec, p: every fold under what was fitted on the others. how: mean, weights or stacked."""
    df = written(df)
    if how == "mean":
        return df.select("s1", "rec", blend({m: 1 / len(members) for m in members}).alias("p"))
    out = []
    for f in range(k):
        rest, fold = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        if how == "weights":
            out.append(fold.select("s1", "rec", blend(fit_weights(rest, members)).alias("p")))
        elif how == "stacked":
            out.append(stacked(fit_stack(rest, members), fold, members))
        else:
            raise ValueError(f"unknown way {how}")
    return reduce(DataFrame.unionByName, out)


def log_loss(df: DataFrame, p: str = "p") -> float:
    """Of y under p; nan without rows."""
    safe = F.greatest(F.least(F.col(p), F.lit(1 - EDGE)), F.lit(EDGE))
    found = df.agg(F.avg(-F.log(F.when(F.col("y") == 1, safe).otherwise(1 - safe)))).first()[0]
    return float("nan") if found is None else found
