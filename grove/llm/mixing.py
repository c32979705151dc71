"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every copy of a document has a virtual finish time. The copies are sorted by it and cut where their running total reaches the
budget: time is dealt into ranges, which hold about equal numbers of words because all sources advance in proportion to their
targets; totals run over the ranges, and the copies of the range that meets the budget are sorted to find the one cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.llm.base import WORD, Scratch, table

#: Rows that one running sum covers: a source of more is cut into so many stretches of its shuffled order, the mix into ranges.
STRETCH = 2_000
EPOCHS = 2
#: What mix adds; columns of docs of these names give way.
RESULTS = ("size", "source_size", "target", "taken", "copies", "finish")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, epochs: int = EPOCHS) -> DataFrame:
    """source, n, source_size, target, place from source, n, source_size: one row a source; place is its number by name.

    Sources by code point, null last, weigh as `weights` say, repeating, and share `share` times all words. A source whose
    part would pass `epochs` times its size stops there; the excess goes to the others by weight until none is above.
    Closed form: by rising capacity for its weight, those sources stop whose capacity the level of the rest exceeds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("w", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("open", F.col("cap") >= F.col("level") * F.col("w"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level").alias("level")))).over(every)["level"]
    return s.select("source", "n", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"), "place")


def _running(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with source_size, target, place and cum, the words of their source up to and with them in its shuffled order."""
    goals = goals.withColumnRenamed("source", "goal_source").withColumn("stretches", F.ceil(F.col("n") / STRETCH)).drop("n")
    placed = rows.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source").withColumn("stretch", F.floor(F.col("point") / F.lit(float(1 << 48)) * F.col("stretches")).cast("long")).drop("stretches")
    sums = placed.groupBy("place", "stretch").agg(F.sum("size").alias("all"))
    offsets = sums.select(F.col("place").alias("o_place"), F.col("stretch").alias("o_stretch"), (F.sum("all").over(Window.partitionBy("place").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")).alias("offset"))
    within = Window.partitionBy("place", "stretch").orderBy("point", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("cum", F.sum("size").over(within)).join(offsets, (F.col("place") == F.col("o_place")) & (F.col("stretch") == F.col("o_stretch")))
    return summed.withColumn("cum", F.col("cum") + F.col("offset")).drop("o_place", "o_stretch", "offset", "stretch")


def _copies(run: DataFrame) -> Column:
    """A document's copies: their place in the order of the mix (finish, then source, then words so far)."""
    ends = [F.col("cum") + F.col("source_size") * e for e in range(EPOCHS)]
    return F.array(*[F.struct((end / F.col("target")).alias("finish"), F.col("place").alias("place"), end.alias("end")) for end in ends])


def _cut(run: DataFrame, goals: DataFrame, share: float) -> DataFrame:
    """One row: budget, the copy (at) at which the running total of the sorted mix reaches it, and the words of it before (part).

    No row where there are no words."""
    total = goals.agg(F.sum("source_size").alias("words"), F.sum("n").alias("n")).where("words > 0")
    total = total.select(F.floor(F.least(F.col("words") * F.lit(float(share)), F.col("words") * F.lit(float(EPOCHS)))).cast("long").alias("budget"), F.greatest(F.lit(1), F.ceil(F.col("n") / STRETCH)).alias("ranges"))
    # One row; finish times beyond 2 share the last range, which the budget never meets unless all before it is taken.
    copies = run.where("size > 0 and target > 0").select(F.explode(_copies(run)).alias("at"), "size").join(F.broadcast(total), F.lit(True))
    timed = copies.withColumn("range", F.floor(F.least(F.col("at.finish"), F.lit(2.0)) * F.col("ranges")).cast("long"))
    sums = timed.groupBy("range", "budget").agg(F.sum("size").alias("all"))
    upto = sums.withColumn("upto", F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    met = upto.where(F.col("upto") >= F.col("budget")).orderBy("range").limit(1).select(F.col("range").alias("met"), (F.col("upto") - F.col("all")).alias("before"))
    last = timed.join(F.broadcast(met), F.col("range") == F.col("met"))
    ordered = last.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return ordered.where(F.col("upto") >= F.col("budget")).orderBy("upto").limit(1).select("budget", F.col("at").alias("cut"), (F.col("budget") - (F.col("upto") - F.col("size"))).alias("part"))


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, seed: int = 8, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs with size, source_size, target, taken, copies and finish.

    A document's size is its number of words. Within its source the documents stand in the order of a hash of their id;
    each one's virtual finish time is the source's cumulative words, itself included, divided by the source's target, and
    its second copy finishes one whole source later. All copies sorted by finish time (ties by source, then by cumulative
    words) are the mix; it is truncated where the running total reaches the budget of `share` times all words. taken: the
    document's words before the cut, all its copies together; of the copy that is cut, the part before the cut counts.
    copies: how many of its copies lie before the cut by at least half. finish: the first copy's time (null without target
    or size). `mixed` gives the sorted mix of whole copies.

    Null texts have size 0 and are never taken, a null source is a source of its own, null ids are sorted last. Rows that
    repeat an id stay rows of their own; equal rows are interchangeable. Empty table: empty result. keep: the columns of
    docs that travel along (all by default); those named like a result column, in any case, give way. Reruns agree.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    point = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("long")
    own = [F.col("doc_id").alias("id"), F.col("source"), word_count(F.col("text")).alias("size"), point.alias("point")]
    scratch = Scratch(docs.sparkSession)
    # Words are counted once for the plan of the mix; only ids, sources and sizes are written.
    plain = scratch.keep(docs.select(*own), "sizes")
    goals = scratch.keep(targets(plain.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")), weights, share), "goals")
    run = _running(plain, goals)
    cut = scratch.keep(_cut(run, goals, share), "cut")
    if names != ["doc_id"]:
        run = _running(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), *own), goals)
    else:
        run = run.withColumn("doc", F.struct(F.col("id").alias("doc_id")))
    placed = run.join(F.broadcast(cut), F.lit(True), "left").withColumn("each", F.when((F.col("target") > 0) & (F.col("size") > 0), _copies(run)))
    words = lambda c: F.when(c < F.col("cut"), F.col("size")).when(c == F.col("cut"), F.col("part")).otherwise(F.lit(0)).cast("long")
    taken = F.coalesce(F.aggregate(F.transform("each", words), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)).cast("long")
    copies = F.coalesce(F.size(F.filter(F.transform("each", words), lambda w: 2 * w >= F.col("size"))), F.lit(0))
    found = F.struct("size", "source_size", "target", taken.alias("taken"), F.greatest(copies, F.lit(0)).alias("copies"), F.get("each", F.lit(0))["finish"].alias("finish"))
    return placed.select("doc", found.alias("found")).select("doc.*", "found.*")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every taken copy as a row of docs, range-sorted by virtual finish time.

    Documents without words, null texts among them, are in no mix. Columns of docs keep their names and values, whatever
    they are called."""
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", "source", "text")
    found = mix(inside, keep=["whole"], **how).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.col("finish") + F.col("epoch") * F.col("source_size") / F.col("target")
    return found.withColumn("finish", at).orderBy("finish", "whole.doc_id").select("whole.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"]).drop("copies", "finish")


SQL = {
    "op8_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':8'), 1, 12) AS point FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS level FROM w
      WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE cap >= level * w),
t AS (SELECT source, place, source_size, least(cap, coalesce((SELECT level FROM o) * w, cap)) AS target FROM w),
c AS (SELECT row_number() OVER () AS row, d.doc_id, d.size, t.place, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY point, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT row, size, place, CAST(cum + k * source_size AS BIGINT) AS fin, (cum + k * source_size)::DOUBLE / target AS finish FROM c, (VALUES (0), (1)) AS copy(k) WHERE size > 0 AND target > 0),
q AS (SELECT row, size, CAST(sum(size) OVER (ORDER BY finish, place, fin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM e),
b AS (SELECT CAST(floor(1.5::DOUBLE * sum(size)) AS BIGINT) AS budget FROM d),
k AS (SELECT row, CAST(sum(least(size, greatest(0, budget - (upto - size)))) AS BIGINT) AS taken FROM q, b GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM c LEFT JOIN k USING (row)""",
}
