"""python -m grove synth|train|evaluate|resolve|index|match|validate: the library's jobs over tab-separated sources."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grove.plans import serving, training
from grove.sources import records, reports, synthetic


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grove", description=__doc__)
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name: str, *args: str) -> argparse.ArgumentParser:
        one = jobs.add_parser(name)
        for arg in args:
            one.add_argument(arg)
        return one

    s = job("synth", "out")
    s.add_argument("--entities", type=int, default=8000)
    s.add_argument("--seed", type=int, default=42)
    t = job("train", "data", "model", "--report")
    t.add_argument("--folds", type=int, default=2)
    t.add_argument("--trees", type=int, default=20)
    t.add_argument("--more", action="store_true", help="also legal-form, raw-name, address and vocabulary features")
    job("evaluate", "data", "model", "--report")
    job("resolve", "data", "model", "out")
    job("index", "data", "model", "out")
    m = job("match", "index", "name", "address", "country")
    m.add_argument("--top", type=int, default=5)
    job("validate", "data", "matching", "--candidates")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 where validate finds more than warnings. data: a prefix, see records.Dataset.load."""
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("grove").getOrCreate()
    if a.job == "synth":
        w = synthetic.synthesize(spark, synthetic.World(entities=a.entities, seed=a.seed))
        columns = [c.split()[0] for c in records.RAW.split(", ")]
        for n, df in ((1, w.s1), (2, w.recs.where("source = 2")), (3, w.recs.where("source = 3"))):
            records.write_tsv(df.select(*columns), f"{a.out}_source{n}.tsv")
        lists = records.id_lists(w.s1.select(F.col("entity_id").alias("s1")), w.truth)
        records.write_tsv(lists, f"{a.out}_ground_truth.tsv")
        return 0
    if a.job == "match":
        record = spark.createDataFrame([("query", a.name, a.address, a.country)], records.RAW)
        for row in serving.match(serving.Index.open(spark, a.index), record, a.top).orderBy("rank").collect():
            print(json.dumps(row.asDict(), ensure_ascii=False))
        return 0
    data = records.Dataset.load(spark, a.data, with_truth=a.job in ("train", "evaluate"))
    if a.job == "train":
        got = training.train(data.s1, data.recs, data.truth, a.folds, a.trees, more=a.more)
        got.matcher.save(a.model)
        if a.report:
            reports.write_report(got.report, a.report)
        print(json.dumps(got.report["final"]))
        return 0
    if a.job == "validate":
        issues = reports.validate_files(spark, a.matching, a.candidates, data.s1, data.recs).collect()
        for row in issues:
            print(f"{row['issue']}: {row['n']}")
        return int(any(not row["issue"].startswith("warning:") for row in issues))
    matcher = training.Matcher.load(a.model)
    if a.job == "evaluate":
        report = training.evaluate(matcher, data.s1, data.recs, data.truth)
        if a.report:
            reports.write_report(report, a.report)
        print(json.dumps(report["final"]))
    elif a.job == "resolve":
        done = training.apply(matcher, data.s1, data.recs)
        ids = data.s1.select(F.col("entity_id").alias("s1"))
        matches, candidates = records.result_tables(ids, done.matches, done.ready.featured)
        records.write_tsv(matches, f"{a.out}/matching_results.tsv")
        records.write_tsv(candidates, f"{a.out}/candidate_pairs.tsv")
    else:
        serving.build(a.out, matcher, data.s1, data.recs)
    return 0


if __name__ == "__main__":
    sys.exit(main())
