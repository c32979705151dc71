"""Uniform shuffles into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.llm.base import Scratch, table

#: Logical partitions at least, rows that one should hold, and numbers of the matrix at most (the driver holds it).
LEAST_PARTS, PART_ROWS, MOST_CELLS = 64, 200_000, 1 << 22
#: A row that stands more often than this share of a partition is dealt out copy by copy.
HEAVY = 0.05


def _stirling_error(n: float) -> float:
    """log n! less Stirling's approximation of it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / m) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where x is near the mean."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            now = total + term / (2 * j + 1)
            if now == total:
                return now
            total, j = now, j + 1
    return x * math.log(x / mean) + mean - x


def _binomial(x: int, n: int, p: float) -> float:
    """The binomial law by its saddle point expansion: right to double precision for any n."""
    q = 1 - p
    if x in (0, n):
        return math.exp(n * math.log1p(-p)) if x == 0 else math.exp(n * math.log(p))
    log = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return math.exp(log) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def _law(k: int, good: int, bad: int, n: int) -> float:
    """The hypergeometric law as three binomial ones."""
    p = n / (good + bad)
    return _binomial(k, good, p) * _binomial(n - k, bad, p) / _binomial(n, good + bad, p)


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn from good + bad without replacement.

    By one method at every size: the law is inverted outwards from its mode, in steps of the ratio of neighbours.
    """
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    at = min(max(lo, (n + 1) * (good + 1) // (good + bad + 2)), hi)
    up = down = at
    p_up = p_down = _law(at, good, bad, n)
    left = rng.random() - p_up
    while left > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) / (up + 1) * (n - up) / (bad - n + up + 1)
            up, left = up + 1, left - p_up
            if left <= 0:
                return up
        if down > lo:
            p_down *= down / (good - down + 1) * (bad - n + down) / (n - down + 1)
            down, left = down - 1, left - p_down
            if left <= 0:
                return down
    return at


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """How many rows of each partition go to each shard in a uniform random assignment that fills the shards exactly.

    Partition after partition, its counts are drawn from the multivariate hypergeometric law of the room that is left.
    """
    rng, room, out = np.random.Generator(np.random.PCG64(seed)), list(shards), []
    for n in rows:
        left, total, line = n, sum(room), []
        for r in room:
            total -= r
            k = _draw(rng, r, total, left)
            line.append(k)
            left -= k
        room = [r - k for r, k in zip(room, line, strict=True)]
        out.append(line)
    return out


def shard(docs: DataFrame, shards: int, seed: int = 10, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row of docs with shard and slot: a uniform shuffle whose shards' row counts are at most one apart.

    Rows are written once, with a number and a hash of their whole content, and fall into logical partitions by that hash;
    copies of a row that is too frequent for one partition fall there by their number. The matrix says how many of a
    partition's rows each shard gets; rows are permuted within their partition, dealt out by the matrix, and permuted again
    within their shard, where slots count from 0 without gaps. The driver sees the partitions' counts and the matrix:
    MOST_CELLS numbers at most. A rerun deals equally, but for equal rows, which are interchangeable.

    Nulls are hashed as such; map columns are not hashed; empty tables give no rows; fewer rows than shards leave the last
    shards empty. Columns of docs named shard or slot, in any case, give way to the result's.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    hashed = [F.col(f"`{c}`") for c, t in docs.dtypes if c in key] + [F.col(f"`{c}`") for c, t in docs.dtypes if c not in key and "map<" not in t]
    held = scratch.keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.xxhash64(*hashed).alias("mark"), F.xxhash64(F.lit(seed), *hashed).alias("tie"), F.monotonically_increasing_id().alias("row")), "rows")
    total = held.count()
    parts = max(LEAST_PARTS, min(MOST_CELLS // shards, total // PART_ROWS))
    # At most parts / HEAVY rows stand so often.
    heavy = held.groupBy("mark").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > max(20.0, HEAVY * total / parts)).select("mark", F.lit(True).alias("heavy"))
    held = held.join(F.broadcast(heavy), "mark", "left").withColumn("salt", F.when(F.col("heavy"), F.col("row")).otherwise(F.lit(0))).drop("heavy")
    held = held.withColumn("part", F.pmod(F.xxhash64("mark", "tie", "salt", F.lit(seed)), F.lit(parts)).cast("int"))
    counts = dict(held.groupBy("part").count().collect())
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], [total // shards + (s < total % shards) for s in range(shards)], seed)
    bounds = spark.createDataFrame([(p, np.cumsum(line).tolist()) for p, line in zip(order, matrix, strict=True)], "part int, bounds array<bigint>")
    by = lambda n: (F.xxhash64("mark", "tie", "salt", F.lit(seed + n)), "mark", "tie", "row")
    local = Window.partitionBy("part").orderBy(*by(1))
    dealt = held.withColumn("place", F.row_number().over(local) - 1).join(F.broadcast(bounds), "part").withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("place"))).cast("int"))
    stretches = max(1, parts // shards)
    dealt = dealt.drop("part", "place", "bounds").withColumn("stretch", F.pmod(F.shiftright(by(2)[0], 32), F.lit(stretches)).cast("int"))
    counts = dealt.groupBy("shard", "stretch").count()
    offsets = counts.select(F.col("shard").alias("o_shard"), F.col("stretch").alias("o_stretch"), (F.sum("count").over(Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("offset"))
    within = Window.partitionBy("shard", "stretch").orderBy(*by(2))
    # One row for each shard and stretch, at most about as many as partitions.
    placed = dealt.withColumn("slot", F.row_number().over(within) - 1).join(F.broadcast(offsets), (F.col("shard") == F.col("o_shard")) & (F.col("stretch") == F.col("o_stretch")))
    return placed.select("doc", "shard", (F.col("slot") + F.col("offset")).cast("long").alias("slot")).select("doc.*", "shard", "slot")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shard(docs, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
