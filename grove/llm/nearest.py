"""Approximate maximum inner product search: score-aware (anisotropic) product quantisation, four-bit scans, exact reranking.

A vector's offset from the sample's mean is coded with 16 centres a subspace, so that half a byte a subspace names it. Codes
and centres minimise the residual error with its part along the vector weighted up, for that part shifts the scores which
queries near the vector see. A query sums table entries over the codes, two subspaces to a byte. What the sums leave possible,
given how far each vector's code misses it, is scored exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.llm.base import Scratch, table

#: Dimensions of a subspace, centres of each, and the score threshold T (as a share of the norm) that sets the parallel weight.
SUBSPACE, CENTRES, THRESHOLD = 2, 16, 0.2
#: Rows that the fit samples, at most about so many.
FIT_ROWS = 8_192
#: Vectors of a block that is scanned at once, queries whose tables are held at once, and bytes of queries that one pass over
#: the vectors takes along: it is their only copy that every worker holds.
BLOCK_ROWS, SIDE_BY_SIDE, PASS_BYTES = 32_768, 64, 32 << 20
#: Survivors of a block's scan that are scored exactly: this many per neighbour asked for at least, and all whose sum may reach
#: those neighbours when codes miss by this many standard errors.
RERANK, SLACK = 2, 1.5


def usable(v: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


class Index:
    """The mean and the code books fitted on a sample."""

    def __init__(self, sample: np.ndarray, seed: int = 2):
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float32)
        self.dim = x.shape[1]
        self.pad = -self.dim % (2 * SUBSPACE)
        self.mean = x.mean(0)
        self.eta = max(1.0, (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        y, u = self._parts(x)
        self.books = np.stack([self._k_means(y[:, s], min(CENTRES, len(y)), rng) for s in range(y.shape[1])])
        if self.books.shape[1] < CENTRES:
            self.books = np.concatenate([self.books, np.repeat(self.books[:, :1], CENTRES - self.books.shape[1], 1)], 1)
        for _ in range(4):
            codes = self._codes(y, u)
            for s in range(y.shape[1]):
                self._refit(s, y, u, codes)

    @staticmethod
    def _k_means(x: np.ndarray, k: int, rng) -> np.ndarray:
        centres = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(8):
            near = np.concatenate([np.argmin((centres**2).sum(1) - 2 * (part @ centres.T), 1) for part in np.array_split(x, max(1, len(x) // 4096))])
            total = np.zeros_like(centres)
            np.add.at(total, near, x)
            n = np.bincount(near, minlength=k)
            centres[n > 0] = total[n > 0] / n[n > 0, None]
        return centres

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals and unit directions, by subspace."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return tuple(np.pad(a, ((0, 0), (0, self.pad))).reshape(len(x), -1, SUBSPACE) for a in (x - self.mean, unit))

    def _codes(self, y: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) (r . u)^2, r the residual that coding leaves."""
        n, m, _ = y.shape
        rows, codes = np.arange(n), np.stack([np.argmin(((y[:, s, None] - self.books[s]) ** 2).sum(2), 1) for s in range(m)], 1)
        along = np.einsum("nsd,nsd->n", y - np.stack([self.books[s][codes[:, s]] for s in range(m)], 1), u)
        for _ in range(2):
            for s in range(m):
                left = y[:, s, None] - self.books[s]
                own = np.einsum("nkd,nd->nk", left, u[:, s])
                others = along - own[rows, codes[:, s]]
                codes[:, s] = np.argmin((left**2).sum(2) + (self.eta - 1) * (others[:, None] + own) ** 2, 1)
                along = others + own[rows, codes[:, s]]
        return codes.astype(np.uint8)

    def _refit(self, s: int, y: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        """The subspace's centres that minimise the same loss for the given codes: one small linear system each."""
        m = y.shape[1]
        along = np.einsum("nsd,nsd->n", y - np.stack([self.books[t][codes[:, t]] for t in range(m)], 1), u)
        others = along - np.einsum("nd,nd->n", y[:, s] - self.books[s][codes[:, s]], u[:, s])
        w = np.eye(SUBSPACE, dtype=np.float32) + (self.eta - 1) * u[:, s, :, None] * u[:, s, None, :]
        b = np.einsum("nij,nj->ni", w, y[:, s]) + (self.eta - 1) * others[:, None] * u[:, s]
        for k in range(CENTRES):
            own = codes[:, s] == k
            if own.sum() >= SUBSPACE:
                self.books[s, k] = np.linalg.solve(w[own].sum(0) + 1e-6 * np.eye(SUBSPACE), b[own].sum(0))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, two to a byte, and the length of what each code misses."""
        packed, missed = [], []
        for part in np.array_split(x, max(1, len(x) // 4096)):
            y, u = self._parts(part.astype(np.float32))
            codes = self._codes(y, u)
            left = y - np.stack([self.books[s][codes[:, s]] for s in range(y.shape[1])], 1)
            packed.append(codes[:, ::2] | (codes[:, 1::2] << 4))
            missed.append(np.sqrt(np.einsum("nsd,nsd->n", left, left)))
        return np.concatenate(packed), np.concatenate(missed).astype(np.float32)

    def scan(self, q: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums of table entries in steps, codes by queries: they order a query's vectors by approximate product. And the step."""
        m = self.books.shape[0]
        wide = np.uint16 if 255 * m < 1 << 16 else np.uint32
        tables = np.einsum("qsd,skd->skq", np.pad(q, ((0, 0), (0, self.pad))).reshape(len(q), m, SUBSPACE), self.books)
        low = tables.min(1, keepdims=True)
        step = float(np.maximum((tables - low).max(), 1e-12) / 255)
        small = np.round((tables - low) / step).astype(wide)
        total, entry = np.zeros((len(packed), len(q)), wide), np.empty((len(packed), len(q)), wide)
        for j in range(m // 2):
            both = (small[2 * j + 1][:, None] + small[2 * j][None]).reshape(CENTRES * CENTRES, len(q))
            np.take(both, packed[:, j], axis=0, out=entry, mode="clip")
            total += entry
        return total, step


class Search:
    """The k best so far of a batch of queries, over the blocks that it is shown."""

    def __init__(self, index: Index, asks: np.ndarray, k: int):
        self.index, self.asks, self.k = index, asks, k
        self.score = np.full((len(asks), k), -np.inf)
        self.near = np.full((len(asks), k), np.iinfo(np.int64).max)
        self.exact = 0

    def show(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, missed: np.ndarray, own: np.ndarray) -> None:
        """ids, vectors, codes and misses of a block; own: the queries' ids, whose rows are no candidates."""
        for begin in range(0, len(self.asks), SIDE_BY_SIDE):
            q = self.asks[begin : begin + SIDE_BY_SIDE]
            sums, step = self.index.scan(q, codes)
            for i in range(len(q)):
                self._rank(begin + i, q[i], sums[:, i], step, ids, x, missed, own[begin + i])

    def _rank(self, at: int, q: np.ndarray, sums: np.ndarray, step: float, ids: np.ndarray, x: np.ndarray, missed: np.ndarray, own: int) -> None:
        least = RERANK * self.k + 1
        if len(ids) > least:
            # Rounding moves a sum by half a step an entry at most; the error of a code spreads over all directions.
            reach = (SLACK * np.sqrt(float(q @ q) / len(q)) / step) * missed + np.float32(0.5 * np.sqrt(self.index.books.shape[0]))
            top, sure = sums + reach, sums - reach
            floor = np.partition(sure, len(ids) - self.k - 1)[len(ids) - self.k - 1]
            found = np.flatnonzero(top >= floor)
            if len(found) < least:
                found = np.argpartition(top, len(ids) - least)[len(ids) - least :]
        else:
            found = np.arange(len(ids))
        found = found[ids[found] != own]
        self.exact += len(found)
        score = np.concatenate([self.score[at], np.einsum("rd,d->r", x[found], q)])
        near = np.concatenate([self.near[at], ids[found]])
        if len(score) > 8 * self.k:
            # Ties with the k-th stay in.
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, near = score[keep], near[keep]
        best = np.lexsort((near, -score))[: self.k]
        self.score[at], self.near[at] = score[best], near[best]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores of what was found."""
        ok = self.score > -np.inf
        return np.nonzero(ok)[0], self.near[ok], self.score[ok]


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def fit_index(vectors: DataFrame, n: int, rows: int = FIT_ROWS) -> Index | None:
    """vectors: n rows of vec_id, v. The sample: about `rows` rows by their ids' hash."""
    point = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = vectors.where(point < rows / max(n, 1)).orderBy("vec_id", "v").limit(2 * rows).toArrow() if n else None
    if picked is not None and not picked.num_rows:
        picked = vectors.orderBy("vec_id", "v").limit(1).toArrow()
    return Index(matrix(picked.column("v"))) if picked is not None else None


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest inner product found, ties to the smaller vec_id.

    vectors: vec_id, embedding; queries: the same, rows to search for; a query's own vec_id is no candidate for it.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length than
    most, null ids neither. Rows that repeat both id and vector are one. An id with several vectors has several candidates,
    and as a query one ranking, in which a candidate counts by its best score. Every vector is indexed; of equal ones only
    the k + 1 smallest ids can be among a query's k nearest, so only these are scanned. Vectors stay where they were
    written: each pass takes a bounded batch of queries to all of them, and only the k best of every part travel. Empty
    tables: empty result.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    clean = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    base = clean(vectors)
    size = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark = vectors.sparkSession
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Repeats are counted together before equal vectors meet.
    first = Window.partitionBy("v").orderBy("vec_id")
    scratch = Scratch(spark)
    each = base.where(F.size("v") == size["d"]).groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("rows"))
    base = scratch.keep(each.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).select("vec_id", "v"), "vectors")
    asked = scratch.keep(clean(queries).where(F.size("v") == size["d"]).distinct(), "queries")
    index = fit_index(base, base.count())

    def code(parts):
        for part in parts:
            if part.num_rows:
                codes, missed = index.encode(matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)], ["vec_id", "v", "code", "missed"])

    coded = scratch.keep(base.mapInArrow(code, f"vec_id long, v {kind}, code binary, missed float"), "coded")
    scratch.drop(base)
    rows = max(SIDE_BY_SIDE, PASS_BYTES // (8 * size["d"]))
    passes = max(1, -(-asked.count() // rows))
    batch_of = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(passes))
    found = None
    for n in range(passes):
        mine = asked.where(batch_of == n).orderBy("vec_id", "v").toArrow()
        if mine.num_rows:
            part = scratch.keep(coded.mapInArrow(_scan(index, matrix(mine.column("v")), mine.column("vec_id").to_numpy(), k), "query_id long, vec_id long, score double"), "found")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A candidate stands once for each pair of its vectors with the query's; of equal rankings from several query vectors the best counts.
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    several = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("vec_id").alias("query_id"))
    lone = found.join(several, "query_id", "left_anti")
    merged = found.join(several, "query_id", "left_semi").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return lone.unionByName(merged).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan(index: Index, asks: np.ndarray, own: np.ndarray, k: int):
    """The pass over a part of the coded vectors, block by block, for one batch of queries."""

    def run(parts):
        search, held, n = Search(index, asks, k), [], 0
        most = max(1024, min(BLOCK_ROWS, PASS_BYTES // (8 * asks.shape[1])))

        def flush() -> None:
            whole = pa.Table.from_batches(held).sort_by("vec_id")
            codes = np.frombuffer(b"".join(whole.column("code").to_pylist()), np.uint8).reshape(whole.num_rows, -1)
            search.show(whole.column("vec_id").to_numpy(), matrix(whole.column("v")), codes, whole.column("missed").to_numpy(), own)

        for part in parts:
            for at in range(0, part.num_rows, most):
                held.append(part.slice(at, most))
                n += held[-1].num_rows
                if n >= most:
                    flush()
                    held, n = [], 0
        if held:
            flush()
        place, near, score = search.best()
        for at in range(0, len(place), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(own[place[cut]], pa.int64()), pa.array(near[cut], pa.int64()), pa.array(score[cut], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
