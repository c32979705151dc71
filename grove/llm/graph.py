"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.base import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every node's larger neighbours are tied to its smallest one. Small: its smaller neighbours and itself are."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    tied = around.join(least, "u")
    ends = tied.where("v > u").select(F.col("m").alias("u"), "v") if large else tied.select(F.col("m").alias("u"), "v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return ends.where("u < v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node that it can reach.

    edges: columns u and v of one orderable type; loops, repeats and nulls are ignored. Every round is written out,
    no node's neighbours are ever gathered into one row, and the rounds grow with the logarithm of a component's width.
    """
    now = scratch.keep(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), name)
    mark = _mark(now)
    while mark[0]:
        wide = scratch.keep(_star(now, True), name)
        then = scratch.keep(_star(wide, False), name)
        scratch.drop(wide, now)
        before, now, mark = mark, then, _mark(then)
        if mark == before:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
