"""Why a pair got its score: exact contributions of the features to a boosted model's log-odds, and the reasons they give."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.plans import resolve as plan

TOP = 6
#: Families of features, by the start of the feature's name; the first that fits counts.
FAMILIES = {
    "twins and rivals": ("p1", "rank_among", "claims", "best_other", "n_twins", "twins", "g_"),
    "other candidates": ("rev_", "ctx_", "rank_fz", "gap_fz", "margin_fz", "n_cand", "cos_comb", "fz", "in_keys"),
    "house number": ("hn_", "nums_"),
    "address": ("addr", "cos_addr", "ca_", "empty_addr"),
    "name": ("name", "ns_", "cos_name", "n_tok", "n_extra", "n_miss", "core", "raw", "lf_", "tok_", "vocab", "tr_", "len_name", "nonlatin"),
}


def family(feature: str) -> str:
    return next((name for name, starts in FAMILIES.items() if feature.startswith(starts)), "record")


def shown(feature: str, value: float | None) -> str:
    """A feature's value as a reader sees it: flags in words, similarities as percentages, cosines and numbers in few digits."""
    if value is None or math.isnan(value) or value == plan.MISSING:
        return "n/a"
    if feature.endswith(("_eq", "_equal", "_missing_rec", "_missing_s1", "_prefix", "_substr")) or feature in ("in_keys", "src3", "nonlatin", "empty_addr", "lf_diff", "lf_one_side"):
        return "yes" if value >= 0.5 else "no"
    if feature.endswith(("_ratio", "_tset", "_tsort", "_partial")):
        return f"{value:.0f}%"
    if feature.startswith("cos_"):
        return f"{value:.2f}"
    return f"{value:.0f}" if value == int(value) else f"{value:.3g}"


@dataclass(frozen=True)
class Leaf:
    """value: what the leaf adds to the log-odds; per feature on its path: the interval (low, high] and the share of the
    training rows that went the path's way at the feature's splits."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def _leaves(node, scale: float, path: dict[int, tuple[float, float, float]]) -> Iterator[Leaf]:
    if node.getClass().getSimpleName() == "LeafNode":
        sides = [(f, *path[f]) for f in sorted(path)]
        yield Leaf(scale * node.prediction(), *(tuple(x) for x in zip(*sides))) if sides else Leaf(scale * node.prediction(), (), (), (), ())
        return
    split, n = node.split(), node.impurityStats().count()
    f, at = split.featureIndex(), split.threshold()
    low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
    for child, bounds in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
        yield from _leaves(child, scale, path | {f: (*bounds, share * child.impurityStats().count() / n)})


def leaves(model: PipelineModel) -> list[Leaf]:
    """All leaves of a boosted classifier; its log-odds are twice the weighted sum of its trees."""
    boosted = model.stages[-1]._java_obj
    return [leaf for tree, w in zip(boosted.trees(), boosted.treeWeights()) for leaf in _leaves(tree.rootNode(), 2.0 * w, {})]


def shapley(found: list[Leaf], x: np.ndarray) -> tuple[float, np.ndarray]:
    """The base and each feature's Shapley value for the rows of x. A feature that is out of a coalition follows the training
    rows' shares at its splits. A leaf's value is a product over the features on its path, so the coalitions of one size
    are the coefficients of a polynomial, and their number does not matter."""
    base, out = 0.0, np.zeros(x.shape)
    for leaf in found:
        m = len(leaf.features)
        base += leaf.value * math.prod(leaf.share)
        inside = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)]
        for i, f in enumerate(leaf.features):
            sizes = [np.ones(len(x))]
            for j in range(m):
                if j != i:
                    grown = [c * leaf.share[j] for c in sizes] + [np.zeros(len(x))]
                    for k, c in enumerate(sizes):
                        grown[k + 1] += c * inside[j]
                    sizes = grown
            weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
            out[:, f] += leaf.value * (inside[i] - leaf.share[i]) * sum(w * c for w, c in zip(weight, sizes))
    return base, out


def contributions(model: PipelineModel, df: DataFrame, cols: list[str]) -> DataFrame:
    """s1, rec, base, impacts (one a feature, in the order of cols): base and impacts add up to the pair's log-odds.

    Missing features count as the model saw them. The leaves, a few thousand of a model, travel with the task."""
    found = leaves(model)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 2 + len(cols))])
                base, out = shapley(found, x)
                impacts = pa.array(list(out), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(x), base)), impacts], ["s1", "rec", "base", "impacts"])

    filled = [F.coalesce(F.col(c).cast("double"), F.lit(plan.MISSING)).alias(c) for c in cols]
    return df.select("s1", "rec", *filled).mapInArrow(run, "s1 string, rec string, base double, impacts array<double>")


def explained(model: PipelineModel, df: DataFrame, cols: list[str], top: int = TOP) -> DataFrame:
    """s1, rec, base, families and reasons. families: name and summed impact, the strongest first; reasons: feature, value,
    shown, impact of the `top` strongest features of either sign, ties by name, none under a thousandth."""
    impacts = contributions(model, df, cols)
    names = F.array(*[F.lit(c) for c in cols])
    values = df.select("s1", "rec", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(plan.MISSING)) for c in cols]).alias("values"))
    say = F.udf(lambda fs, vs: [shown(f, v) for f, v in zip(fs, vs)], "array<string>")
    each = F.transform(F.arrays_zip(names.alias("feature"), F.col("values").alias("value"), F.col("impacts").alias("impact")), lambda r: F.struct((-F.abs(r["impact"])).alias("order"), r["feature"].alias("feature"), r["value"].alias("value"), r["impact"].alias("impact")))
    best = F.slice(F.array_sort(F.filter(each, lambda r: r["order"] < -0.001)), 1, top)
    of = {name: [k for k, c in enumerate(cols) if family(c) == name] for name in [*FAMILIES, "record"]}
    sums = [F.struct((-F.abs(v)).alias("order"), F.lit(name).alias("family"), v.alias("impact")) for name, ks in of.items() if ks for v in [sum(F.col("impacts")[k] for k in ks)]]
    joined = impacts.join(values, ["s1", "rec"]).select("s1", "rec", "base", best.alias("best"), F.array_sort(F.array(*sums)).alias("sums"))
    worded = joined.withColumn("words", say(F.transform("best", lambda r: r["feature"]), F.transform("best", lambda r: r["value"])))
    reasons = F.zip_with("best", "words", lambda r, w: F.struct(r["feature"].alias("feature"), r["value"].alias("value"), w.alias("shown"), r["impact"].alias("impact")))
    return worded.select("s1", "rec", "base", F.transform("sums", lambda r: F.struct(r["family"].alias("family"), r["impact"].alias("impact"))).alias("families"), reasons.alias("reasons"))
