"""What the corpus operators share: table reading, written intermediates, and word hashing.

Intermediates are Parquet tables below the folder that the cluster names in ``spark.checkpoint.dir``, so
that an executor's loss costs only the tasks it was running. A temporary folder is used only where that
setting is missing and all work happens on one machine, as in tests; a cluster without it is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the ASCII controls 0x09-0x0D, and nothing else.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a vectorised step handles at once; its temporaries take about sixty times as much.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='grove-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written intermediates of one call. ``keep`` writes and rereads, ``drop`` removes what nothing reads any more, and
    ``end`` removes all. What is left goes when the process ends, or when ``sweep`` is told that results were written."""

    live: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.kept, self.count = spark, f"{shared_dir(spark)}/grove-{uuid.uuid4().hex}", [], 0
        Scratch.live.append(self)

    def end(self) -> None:
        if self in Scratch.live:
            Scratch.live.remove(self)
            remove(self.spark, self.root)

    @staticmethod
    def sweep(*spared: Scratch) -> None:
        """Ends all but the spared ones: the frames built on them must have been written by now."""
        for one in [s for s in Scratch.live if s not in spared]:
            one.end()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path, self.count = f"{self.root}/{name}-{self.count}", self.count + 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *dfs: DataFrame) -> None:
        remove(self.spark, *[p for kept, p in self.kept if any(kept is d for d in dfs)])
        self.kept = [(kept, p) for kept, p in self.kept if not any(kept is d for d in dfs)]


@atexit.register
def _at_exit() -> None:
    for one in list(Scratch.live):
        try:
            one.end()
        except Exception:  # the session may be gone by then
            pass


def id_crc(col: str) -> Column:
    """crc32 of the id written as text, as the contracts' folds are defined."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def held_out(col: str = "doc_id", folds: int = 5) -> Column:
    """True for the held-out fold; a null id belongs to no fold and is never trained on."""
    return F.coalesce(id_crc(col) % F.lit(folds) == 0, F.lit(True))


def mix64(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser, a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(256, _BASE, np.uint64))


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.cumprod(np.full(n, _BASE, np.uint64))


def _hash_run(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a byte run, and each word's first byte's place. A-Z are lower-cased."""
    solid = ~_SPACE[buf]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    parts = _BYTE[_LOWER[buf[solid]]] * _powers(int(lens.max()))[within]
    return mix64(np.add.reduceat(parts, first) + lens.astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For every text the hashes of its words, in order. Long texts are cut at separators into bounded runs."""
    out: list[np.ndarray] = []
    at, group, held = 0, [], 0

    def flush() -> None:
        nonlocal group, held
        if group:
            buf = np.frombuffer(b" ".join(group), np.uint8)
            hashes, starts = _hash_run(buf)
            bounds = np.cumsum([len(t) + 1 for t in group])[:-1]
            out.extend(np.split(hashes, np.searchsorted(starts, bounds)))
        group, held = [], 0

    for t in texts:
        if len(t) > SLICE_BYTES:
            flush()
            runs, at = [], 0
            while at < len(t):
                end = min(len(t), at + SLICE_BYTES)
                while end < len(t) and not _SPACE[t[end]]:
                    end += 1
                runs.append(_hash_run(np.frombuffer(t[at:end], np.uint8))[0])
                at = end
            out.append(np.concatenate(runs))
            continue
        if held + len(t) > SLICE_BYTES:
            flush()
        group.append(t)
        held += len(t) + 1
    flush()
    return out


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; the whole sequence where it is shorter; nothing without words.

    Two different shingles of a pair of texts get one hash with a chance under 1e-10 even for texts of 20,000 words.
    """
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            mult = _powers(n)[:n] * np.uint64(0x9E3779B97F4A7C15)
            return mix64(np.add.reduce(words * mult, keepdims=True) + np.uint64(n * 0x1000003))
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += words[j : n - k + 1 + j] * _POWERS[j]
    return np.unique(mix64(h))


def as_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches, rows: int = 500):
    """The Arrow batches cut into ones of few rows, so that what a worker derives from them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
