"""Near-duplicate detection by HyperMinHash registers.

A document is the set of its distinct word shingles, as 64-bit hashes. Each hash names one of 256 buckets by its high
bits; the bucket's register keeps the smallest remainder as a leading-zero count and the ten mantissa bits behind it. A
small set first takes every shingle several times under different hashes, which leaves similarities as they are and fills
the registers. Bands of six registers propose pairs, the registers' agreement, corrected for chance collisions, dismisses
the hopeless ones, and whole shingle sets decide.

A band with a third of all documents is not expanded into pairs. Its members are compared with its centre, the member
that shares most bands. Then, around every centre, only members that stay outside the largest component are compared
further, with those that differing sizes and the distances to the centre (1 - similarity is a metric) leave possible. So
no link between different texts that the bands propose is lost.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.base import Scratch, as_bytes, mix64, shingle_set, slices, table, word_hashes
from grove.llm.graph import components

BUCKET_BITS, MANTISSA_BITS = 8, 10
BUCKETS = 1 << BUCKET_BITS
#: Registers a band, and bands. A pair of similarity 0.8 shares no band with a chance of 3e-6.
BAND, BANDS = 6, 42
#: Sets of up to 2 ** level shingles take each TOP_LEVEL - level doublings often, so that a register sees four hashes or more.
TOP_LEVEL = 11
#: Standard errors that the estimate may fall short of the threshold by before a pair is dismissed.
SLACK = 4.5
#: Members around a centre, and shingles of theirs, that one task compares with as many others; pairs whose registers it
#: holds side by side.
BLOCK_ROWS, BLOCK_SHINGLES, SIDE_BY_SIDE = 1024, 1_000_000, 16_384
#: Bytes of shingle sets that a verifying worker remembers.
REMEMBERED = 32 << 20
#: Bits of the filter that keeps texts of no pair from travelling, and bits of one of its chunks, as powers of two. A fuller
#: filter lets more texts pass; the join behind it decides.
FILTER_BITS, CHUNK_BITS = 25, 19
#: Centres with members to settle (four numbers each) that are broadcast at most.
FEW_CENTERS = 100_000


def level(n: int) -> int:
    return min(TOP_LEVEL, max(0, (n - 1).bit_length()))


def registers(shingles: np.ndarray, at: int) -> np.ndarray:
    """The registers of a sorted hash set on a level: 0 where the bucket is empty, else 1 + (leading zeros, mantissa)."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(shingles):
        copies = 1 << (TOP_LEVEL - at)
        if copies > 1:
            seeds = np.arange(copies, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            shingles = np.sort(mix64(shingles[:, None] + seeds).ravel())
        bucket = shingles >> np.uint64(64 - BUCKET_BITS)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rest = shingles[first] << np.uint64(BUCKET_BITS)
        zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 62).astype(np.uint64)
        mantissa = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
        out[bucket[first].astype(np.int64)] = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16) + 1
    return out


def chance_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that sets of n and m unrelated shingles are expected to agree in.

    A level of i leading zeros holds the smallest remainder with a chance that follows from the set's size; within it
    all mantissas are equally likely.
    """
    cut = 2.0 ** -np.arange(0, 64 - BUCKET_BITS)
    tail = lambda x: np.exp(-np.asarray(x, float)[:, None] * cut / BUCKETS)
    within = lambda x: np.diff(tail(x), axis=1)
    return BUCKETS * (within(n) * within(m)).sum(1) / 2.0**MANTISSA_BITS


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity from two register matrices, and the count of buckets that either set uses."""
    used = ((a | b) > 0).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    by_chance = chance_collisions(n, m)
    return np.clip((same - by_chance) / np.maximum(used - by_chance, 1), 0, 1), used


def signatures(docs: DataFrame, k: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set (null: no words), mark (a digest of the text itself), level, regs, and
    lower: the registers of the level below where a set of that level can still be similar enough, else null."""

    def run(batches):
        for batch in slices(batches):
            n, digest, at, regs, lower = [], [], [], [], []
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            for words in word_hashes(texts):
                found = shingle_set(words, k)
                n.append(len(found))
                own = level(len(found))
                at.append(own)
                digest.append(_digest(found.tobytes()) if len(found) else None)
                regs.append(registers(found, own).tobytes() if len(found) else None)
                lower.append(registers(found, own - 1).tobytes() if own and threshold * len(found) <= 100 << (own - 1) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array([_digest(t) for t in texts], pa.binary()), pa.array(at, pa.int32()), pa.array(regs, pa.binary()), pa.array(lower, pa.binary())], ["doc_id", "n_shingles", "digest", "mark", "level", "regs", "lower"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, mark binary, level int, regs binary, lower binary")


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """a, b, lo, hi: the corrected estimate of each pair's similarity, SLACK standard errors down and up.

    Pairs of sizes that cannot reach the threshold keep hi below it.
    """
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("level").alias(f"l{x}"), F.col("regs").alias(f"r{x}"), F.col("lower").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    level_ = F.least("la", "lb")
    on = lambda x: F.when(F.col(f"l{x}") == level_, F.col(f"r{x}")).otherwise(F.col(f"s{x}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            # Sets more than a level apart have no registers in common; their sizes alone dismiss them.
            met = np.array([x.is_valid and y.is_valid for x, y in zip(batch.column(4), batch.column(5), strict=True)])
            mat = lambda i: np.frombuffer(b"".join(x for x, ok in zip(batch.column(i).to_pylist(), met, strict=True) if ok), np.uint16).reshape(-1, BUCKETS)  # noqa: E731, B023
            na, nb = batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float)
            most = np.minimum(na, nb) / np.maximum(na, nb)
            lo, hi = np.zeros(len(na)), most.copy()
            if met.any():
                copies = 2.0 ** (TOP_LEVEL - np.array([level(int(x)) for x in np.minimum(na, nb)[met]]))
                near, used = estimate(mat(4), mat(5), na[met] * copies, nb[met] * copies)
                t = threshold / 100
                slack = SLACK * np.sqrt(np.maximum(t * (1 - t), near * (1 - near)) / np.maximum(used, 1))
                lo[met], hi[met] = np.maximum(near - slack, 0), np.minimum(near + slack, most[met])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lo), pa.array(hi)], ["a", "b", "lo", "hi"])

    return both.select("a", "b", "na", "nb", on("a").alias("ra"), on("b").alias("rb")).mapInArrow(run, "a long, b long, lo double, hi double")


def _across(open_: DataFrame, reps: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """u, v: the links among members around one centre that are in different components, one outside the largest.

    Every such pair meets in one task, in blocks of bounded size; what sizes, the distances to the centre and the
    registers leave possible is settled on whole shingle sets there, so that only links leave the task.
    """
    of = lambda n: F.pmod(F.xxhash64("rep", F.lit(13)), n).cast("int")
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    ys = F.transform(spread(F.col("bx")), lambda i: F.struct(i.alias("x"), of(F.col("by")).alias("y"), F.lit(False).alias("first")))
    xs = F.transform(spread(F.col("by")), lambda i: F.struct(of(F.col("bx")).alias("x"), i.alias("y"), F.lit(True).alias("first")))
    roles = F.when(F.col("apart"), F.concat(ys, xs)).otherwise(ys)
    full = open_.join(reps.select("rep", "level", "regs", "lower"), "rep").join(texts, "rep").select("center", F.explode(roles).alias("role"), "rep", "n", "root", "lo", "hi", "level", "regs", "lower", "blob")
    full = full.select("center", "role.x", "role.y", "role.first", "rep", "n", "root", "lo", "hi", "level", "regs", "lower", "blob")
    t, reach = threshold / 100, 1 - threshold / 100 + 1e-6

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        col = {c: group.column(c).to_numpy() for c in ("rep", "n", "root", "lo", "hi", "level")}
        own, lower, blobs, sets = group.column("regs").to_pylist(), group.column("lower").to_pylist(), group.column("blob"), {}
        open_frame = zstandard.ZstdDecompressor()

        def of_row(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(word_hashes([open_frame.decompress(blobs[i].as_py())])[0], k)
            return sets[i]

        none, links = bytes(2 * BUCKETS), []
        # Two rows meet on the smaller level; a row of the level above without registers there is too large to be met.
        mats = {lv: np.frombuffer(b"".join((o if v == lv else lo if v == lv + 1 else None) or none for o, lo, v in zip(own, lower, col["level"], strict=True)), np.uint16).reshape(-1, BUCKETS) for lv in set(col["level"].tolist())}
        first = group.column("first").to_numpy(zero_copy_only=False)
        x, y = np.flatnonzero(first), np.flatnonzero(~first)
        step = max(1, SIDE_BY_SIDE // max(1, len(y)))
        for at in range(0, len(x), step):
            part = x[at : at + step, None]
            ok = (col["root"][part] != col["root"][y]) & (100 * np.minimum(col["n"][part], col["n"][y]) >= threshold * np.maximum(col["n"][part], col["n"][y]))
            ok &= (col["lo"][part] - col["hi"][y] <= reach) & (col["lo"][y] - col["hi"][part] <= reach)
            i, j = np.nonzero(ok)
            i, j = part[i, 0], y[j]
            met = np.minimum(col["level"][i], col["level"][j])
            for lv in set(met.tolist()):
                p, q, copies = i[met == lv], j[met == lv], 2.0 ** (TOP_LEVEL - lv)
                near, used = estimate(mats[lv][p], mats[lv][q], col["n"][p] * copies, col["n"][q] * copies)
                keep = near + SLACK * np.sqrt(np.maximum(t * (1 - t), near * (1 - near)) / np.maximum(used, 1)) >= t
                for r, s in zip(p[keep].tolist(), q[keep].tolist(), strict=True):
                    common = len(np.intersect1d(of_row(r), of_row(s), assume_unique=True))
                    if 100 * common >= threshold * (len(sets[r]) + len(sets[s]) - common):
                        links.append((int(col["rep"][r]), int(col["rep"][s])))
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return full.groupBy("center", "x", "y").applyInArrow(run, "u long, v long")


def _marked(id_: Column) -> Column:
    """The bit of the filter that an id sets."""
    return F.pmod(F.xxhash64(id_, F.lit(17)), F.lit(1 << FILTER_BITS))


def _filter(ids: DataFrame) -> np.ndarray:
    """The filter over ids (least), as 2 ** FILTER_BITS / 8 bytes whatever the number of ids is. Only chunks reach the driver."""

    def run(group: pa.Table) -> pa.Table:
        bits, own = np.zeros(1 << CHUNK_BITS, np.uint8), group.column("bit").to_numpy()
        bits[own & ((1 << CHUNK_BITS) - 1)] = 1
        return pa.table({"chunk": pa.array([int(own[0]) >> CHUNK_BITS], pa.int32()), "bits": pa.array([zstandard.compress(np.packbits(bits, bitorder="little").tobytes())], pa.binary())})

    out = np.zeros((1 << (FILTER_BITS - CHUNK_BITS), 1 << (CHUNK_BITS - 3)), np.uint8)
    chunks = ids.select(_marked(F.col("least")).alias("bit")).distinct().withColumn("chunk", F.shiftright("bit", CHUNK_BITS)).groupBy("chunk").applyInArrow(run, "chunk int, bits binary")
    for chunk, bits in chunks.collect():
        out[chunk] = np.frombuffer(zstandard.decompress(bytes(bits)), np.uint8)
    return out.ravel()


def _packed(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep, blob: the texts of ids (rep, least, mark) as they travel to be compared: zstandard frames, about 0.4 of their size.

    A text is named by its document's id and its own digest; rows that repeat both are one before they travel.
    """
    wanted = _filter(ids)

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches):
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(((wanted[bit >> 3] >> (bit & 7)) & 1).astype(bool)))
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(t) for t in texts], pa.binary()), pa.array([press.compress(t) for t in texts], pa.binary())], ["least", "mark", "blob"])

    named = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).alias("text")).where("least is not null")
    sent = named.withColumn("bit", _marked(F.col("least"))).mapInArrow(run, "least long, mark binary, blob binary").dropDuplicates(["least", "mark"])
    return sent.join(ids, ["least", "mark"]).select("rep", "blob")


def _verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """a, b, common, whole: the sizes of the intersection and the union of the pairs' whole shingle sets."""
    side = lambda x: texts.select(F.col("rep").alias(x), F.col("blob").alias(f"t{x}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        open_, sets, held = zstandard.ZstdDecompressor(), OrderedDict(), 0
        for batch in slices(batches, 200):
            common, whole = [], []
            for ids, blobs in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), zip(batch.column(2), batch.column(3), strict=True), strict=True):
                found = []
                for doc, blob in zip(ids, blobs, strict=True):
                    if doc not in sets:
                        sets[doc] = shingle_set(word_hashes([open_.decompress(blob.as_py())])[0], k)
                        held += sets[doc].nbytes
                    sets.move_to_end(doc)
                    found.append(sets[doc])
                while held > REMEMBERED and len(sets) > 2:
                    held -= sets.popitem(last=False)[1].nbytes
                common.append(len(np.intersect1d(*found, assume_unique=True)))
                whole.append(len(found[0]) + len(found[1]) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(whole, pa.int64())], ["a", "b", "common", "whole"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, common long, whole long")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Two documents are linked where 100 * |intersection| >= threshold * |union| of their k-word shingle sets (words:
    runs without space or 0x09-0x0D, A-Z lower-cased; fewer than k words: the whole sequence is the one shingle).
    component_id is the smallest doc_id that links reach; kept marks the row whose own id that is.

    Null or wordless texts: n_shingles 0, linked with nothing, kept. Equal sets are one class before any pair is formed,
    so repeated texts cost nothing. Rows that repeat a doc_id are one document with several texts: each of them is compared,
    each row is returned, and all of them carry the same component_id. A null doc_id takes no part: component_id null, kept
    true. Empty table: empty result. Columns of docs other than the two named are not read. threshold: 50 to 100.
    """
    scratch = Scratch(docs.sparkSession)
    full = scratch.keep(signatures(docs, k, threshold, id_col, text_col), "sig")
    sig = scratch.keep(full.select("doc_id", "n_shingles", "digest"), "docs")
    live = full.where("digest is not null and doc_id is not null")
    one = lambda c: F.first(c).alias(c)  # noqa: E731  equal for equal digests
    classes = live.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("who"), F.first("n_shingles").alias("n"), one("level"), one("regs"), one("lower"))
    # A class is named by a number that holds from here on, because it is written; least is its smallest doc_id.
    reps = scratch.keep(classes.select("digest", F.monotonically_increasing_id().alias("rep"), F.col("who.doc_id").alias("least"), F.col("who.mark").alias("mark"), "n", "level", "regs", "lower"), "reps")
    scratch.drop(full)
    cut = lambda c, at: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(at, j, F.substring(c, j * (2 * BAND) + 1, F.lit(2 * BAND))))
    own, below = cut(F.col("regs"), F.col("level")), cut(F.col("lower"), F.col("level") - 1)
    keys = F.when(F.col("lower").isNull(), own).otherwise(F.concat(own, below))
    # n / (n + 1) under the threshold: sets so small are equal or not linked, and equal ones are one class already.
    rows = reps.where(100 * F.col("n") >= threshold * (F.col("n") + 1)).select("rep", F.explode(keys).alias("key"))
    # Aggregates that a hot key's rows meet are written first: a join of two plain exchanges is one that skew handling can split.
    shared = scratch.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    members = scratch.keep(rows.join(shared, "key"), "members")
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    centers = scratch.keep(members.join(weights, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("c")).select("key", (-F.col("c.rep")).alias("center")), "centers")
    pairs = members.join(centers, "key").where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    rough = scratch.keep(_estimated(pairs, reps, threshold), "rough")
    scratch.drop(shared, members, centers)
    ids = rough.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "least", "mark"), "rep")
    texts = scratch.keep(_packed(docs, ids, id_col, text_col), "texts")
    exact = _verified(rough.where(100 * F.col("hi") >= threshold - 1e-6), texts, k)
    sure, linked = F.col("common") / F.col("whole"), 100 * F.col("common") >= threshold * F.col("whole")
    stars = scratch.keep(rough.join(exact, ["a", "b"], "left").select(F.col("a").alias("center"), F.col("b").alias("rep"), F.coalesce(sure, "lo").alias("lo"), F.coalesce(sure, "hi").alias("hi"), F.coalesce(linked, F.lit(False)).alias("linked")), "stars")
    scratch.drop(rough)
    roots = scratch.keep(components(stars.where("linked").select(F.col("center").alias("u"), F.col("rep").alias("v")), scratch), "roots")
    # What the stars leave open: members around one centre in different components. The largest component is never paired with itself.
    around = stars.select("center", "rep", "lo", "hi").unionByName(stars.select("center", F.col("center").alias("rep"), F.lit(1.0).alias("lo"), F.lit(1.0).alias("hi")).distinct())
    told = scratch.keep(around.join(roots, around.rep == roots.node, "left").drop("node").join(reps.select("rep", "n"), "rep").select("center", "rep", "n", "lo", "hi", F.coalesce("root", "rep").alias("root")), "told")
    sizes = told.groupBy("center", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles"))
    blocks = lambda count, shingles: F.greatest(F.ceil(count / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    mixed = sizes.groupBy("center").agg(F.max(F.struct("count", "root", "shingles")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("count").alias("all"), F.sum("shingles").alias("total")).where("parts > 1")
    mixed = scratch.keep(mixed.select("center", F.col("main.root").alias("main"), blocks(F.col("all"), F.col("total")).alias("by"), blocks(F.col("all") - F.col("main.count"), F.col("total") - F.col("main.shingles")).alias("bx")), "mixed")
    # Few centres are told to everyone, so that a hot one's members need not meet in one task; many are joined, and skew handling splits the hot ones.
    few = mixed.count() <= FEW_CENTERS
    open_ = told.join(F.broadcast(mixed) if few else mixed, "center").select("center", "rep", "n", "root", (F.col("root") != F.col("main")).alias("apart"), "bx", "by", "lo", "hi")
    more = scratch.keep(_across(open_, reps, texts, k, threshold).distinct(), "more")
    scratch.drop(told, mixed, stars, texts)
    # The classes of one document's texts belong together.
    several = sig.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    named = sig.where("digest is not null").join(several, "doc_id").select("doc_id", "digest").distinct().join(reps.select("digest", "rep"), "digest").select("doc_id", "rep")
    same = scratch.keep(named.join(named.groupBy("doc_id").agg(F.min("rep").alias("u")), "doc_id").where("u <> rep").select("u", F.col("rep").alias("v")), "same")
    # The second pass joins whole components, so its graph is over roots.
    ties = more.unionByName(same)
    up = ties.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    tops = components(up, scratch).select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.unionByName(tops.select(F.col("root").alias("node"), "root")).distinct()
    final = known.join(tops, "root", "left").groupBy("node").agg(F.min(F.coalesce("top", "root")).alias("top"))
    placed = scratch.keep(reps.select("digest", "rep", "least").join(final, F.col("rep") == F.col("node"), "left").select("digest", "least", F.coalesce("top", "rep").alias("top")), "placed")
    scratch.drop(reps, roots, more, same)
    smallest = scratch.keep(placed.groupBy("top").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("classes")).where("classes > 1"), "smallest")
    to = placed.join(smallest, "top", "left").select("digest", F.coalesce("component", "least").alias("component"))
    out = sig.join(scratch.keep(to, "to"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
