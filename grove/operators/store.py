"""Tables written between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where all work happens on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='grove-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and no executor's loss undoes it.

    The rows that its joins and windows exchanged go from the disks as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grove-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds a finished table."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The finished table at path; made and written there if there is none. An unfinished one is written anew."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bucketed(df: DataFrame, path: str, step: Callable[[DataFrame], DataFrame], key: str, buckets: int) -> DataFrame:
    """step applied to each bucket of whole keys, a table a bucket; buckets that are finished are not done again.

    For steps whose windows go by key, so that a run that stopped goes on where it was."""
    spark = df.sparkSession
    of = F.pmod(F.xxhash64(key), F.lit(buckets))
    parts = [cached(spark, f"{path.rstrip('/')}/bucket={b}", lambda b=b: step(df.where(of == b))) for b in range(buckets)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
