"""What a run leaves beside its tables: a JSON report, a log of metrics, a bundle; and checks of result files as they stand."""

from __future__ import annotations

import csv
import json
import os
import time
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.sources import records


def write_report(report: dict, path: str) -> None:
    """A report (small, on the driver) as JSON text."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(report, out, indent=2, ensure_ascii=False, default=str)


def log_metrics(path: str, version: str, seed: int, metrics: dict[str, float]) -> None:
    """One row a metric (time, version, seed, metric, value) at the end of a CSV file, which gets its header when new."""
    new = not os.path.exists(path)
    with open(path, "a", newline="", encoding="utf-8") as out:
        rows = csv.writer(out)
        if new:
            rows.writerow(["time", "version", "seed", "metric", "value"])
        now = time.strftime("%Y-%m-%d %H:%M:%S")
        rows.writerows([now, version, seed, name, value] for name, value in metrics.items())


def bundle(paths: list[str], out: str) -> None:
    """Files and folders of local results in one zip archive, folders without their hidden and marker files."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in paths:
            if os.path.isfile(path):
                archive.write(path, os.path.basename(path))
                continue
            for folder, _, names in os.walk(path):
                for name in sorted(n for n in names if n[0] not in "._"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join(os.path.basename(path.rstrip("/")), os.path.relpath(full, path)))


def file_issues(spark: SparkSession, path: str, header: tuple[str, str] = records.MATCHES) -> DataFrame:
    """issue, n of a result file's lines: commas between columns, another header, lines without exactly two columns, repeated
    lines. A folder of part files counts as one file; blank lines are passed over."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    tabbed, comma = "\t".join(header), ",".join(header)
    first = F.startswith("value", F.lit(header[0]))
    body = lines.where(~first)
    found = {
        "columns are separated by commas, not tabs": lines.where(F.col("value") == comma),
        f"header must be {header[0]}<TAB>{header[1]}": lines.where(first & ~F.col("value").isin(tabbed, comma)),
        "lines without exactly two columns": body.where(F.size(F.split("value", "\t")) != 2),
        "repeated lines": body.groupBy("value").count().where("count > 1"),
    }
    out = lines.agg(F.lit("no header").alias("issue"), F.count_if(first).alias("n")).where("n = 0").select("issue", F.lit(1).cast("long").alias("n"))
    for issue, rows in found.items():
        out = out.unionByName(rows.agg(F.lit(issue).alias("issue"), F.count(F.lit(1)).alias("n")))
    return out.where("n > 0")


def validate_files(spark: SparkSession, matching: str, candidates: str | None, s1: DataFrame, recs: DataFrame) -> DataFrame:
    """issue, n of result files: their lines first; the lists only where the lines are sound."""
    paths = {matching: records.MATCHES} | ({candidates: records.CANDIDATES} if candidates else {})
    lines = None
    for path, header in paths.items():
        one = file_issues(spark, path, header)
        lines = one if lines is None else lines.unionByName(one)
    if not lines.where("issue <> 'repeated lines'").isEmpty():
        return lines.groupBy("issue").agg(F.sum("n").alias("n"))
    read = lambda path, header: records.read_tsv(spark, path, ", ".join(f"{c} string" for c in header))
    return lines.groupBy("issue").agg(F.sum("n").alias("n")).unionByName(records.validate(read(matching, records.MATCHES), read(candidates, records.CANDIDATES) if candidates else None, s1, recs))
