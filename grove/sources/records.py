"""Reading, checking and writing the record tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "entity_id string, business_name string, business_address string, country string"
MATCHES, CANDIDATES = ("source1_entity_id", "matched_entity_ids"), ("source1_entity_id", "candidate_entity_ids")


def read_tsv(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Tab-separated text without quoting; every column a string, missing ones empty."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="").fillna("")


def write_tsv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Unquoted tab-separated text below path: as many files as df has parts, or so many as asked for."""
    (df if files is None else df.repartition(files)).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="\u0000")


def check_source(df: DataFrame, n: int) -> DataFrame:
    """df, if its ids are unique and start with S<n>-; else ValueError."""
    found = df.agg(F.count_distinct("entity_id").alias("d"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("entity_id").startswith(f"S{n}-")).alias("bad")).first()
    if found["d"] != found["n"]:
        raise ValueError(f"source {n}: ids are not unique")
    if found["bad"]:
        raise ValueError(f"source {n}: {found['bad']} ids without prefix S{n}-")
    return df


def truth_pairs(lists: DataFrame, keep_singletons: bool = False) -> DataFrame:
    """(s1, rec) from comma lists; keep_singletons gives a reference entity without records one row with a null rec."""
    s1, ids = (F.col(c) for c in lists.columns[:2])
    each = F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(s1.alias("s1"), (F.explode_outer if keep_singletons else F.explode)(each).alias("rec")).distinct()


@dataclass
class Dataset:
    """s1: reference entities; recs: records with their source (2 or 3); truth: (s1, rec) or None."""

    s1: DataFrame
    recs: DataFrame
    truth: DataFrame | None = None
    name: str = ""

    @classmethod
    def from_frames(cls, s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame | None = None, name: str = "") -> Dataset:
        recs = s2.withColumn("source", F.lit(2).cast("byte")).unionByName(s3.withColumn("source", F.lit(3).cast("byte")))
        return cls(s1, recs, truth, name)

    @classmethod
    def load(cls, spark: SparkSession, prefix: str, with_truth: bool = True) -> Dataset:
        """<prefix>_source{1,2,3}.tsv and, if asked for, <prefix>_ground_truth.tsv."""
        s = [check_source(read_tsv(spark, f"{prefix}_source{n}.tsv"), n) for n in (1, 2, 3)]
        truth = truth_pairs(read_tsv(spark, f"{prefix}_ground_truth.tsv", "source1_entity_id string, matched_entity_ids string")) if with_truth else None
        return cls.from_frames(*s, truth, prefix.rsplit("/", 1)[-1])

    def stats(self) -> DataFrame:
        return source_stats(self.s1, self.recs)


def source_stats(s1: DataFrame, recs: DataFrame) -> DataFrame:
    """Rows of each source by country."""
    by = recs.groupBy("country").pivot("source", [2, 3]).count().select("country", F.col("2").alias("s2"), F.col("3").alias("s3"))
    return s1.groupBy("country").agg(F.count(F.lit(1)).alias("s1")).join(by, "country", "left").fillna(0)


def id_lists(s1_ids: DataFrame, pairs: DataFrame, columns: tuple[str, str] = MATCHES) -> DataFrame:
    """One row for every id of s1_ids (column s1): its sorted different records, joined by commas."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("rec")), ",").alias("ids"))
    return s1_ids.select("s1").distinct().join(lists, "s1", "left").select(F.col("s1").alias(columns[0]), F.coalesce("ids", F.lit("")).alias(columns[1]))


def result_tables(s1_ids: DataFrame, matches: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pair of result tables: matches and candidates (s1, rec) as lists of every id of s1_ids (column s1)."""
    return id_lists(s1_ids, matches), id_lists(s1_ids, candidates, CANDIDATES)


def _list_issues(label: str, lists: DataFrame, header: tuple[str, str], ids: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    if tuple(lists.columns) != header:
        return {f"{label}: header must be {header[0]}<TAB>{header[1]}": lists.sparkSession.range(1)}
    listed = lists.select(F.col(header[0]).alias("s1"))
    each = lists.select(F.col(header[0]).alias("s1"), F.explode(F.split(F.coalesce(header[1], F.lit("")), ",")).alias("rec")).where("rec <> ''")
    return {
        f"{label}: missing reference entities": ids.join(listed, "s1", "left_anti"),
        f"{label}: unknown reference entities": listed.join(ids, "s1", "left_anti").distinct(),
        f"{label}: repeated reference entities": listed.groupBy("s1").count().where("count > 1"),
        f"{label}: lists with repeated ids": each.groupBy("s1", "rec").count().where("count > 1").select("s1").distinct(),
        f"{label}: lists with ids that are not Source-2/3 records": each.where(~F.col("rec").rlike("^S[23]-")).select("s1").unionByName(each.join(known, "rec", "left_anti").select("s1")).distinct(),
    }


def validate(matching: DataFrame, candidates: DataFrame | None, s1: DataFrame, recs: DataFrame) -> DataFrame:
    """issue, n: what is wrong with the result tables; issues that start with 'warning:' do not fail them.

    Both tables are checked alike: header, ids, lists. That matches are candidates, and that no record is matched twice, is
    told as a warning, the former only where nothing else is wrong."""
    ids, known = s1.select(F.col("entity_id").alias("s1")).distinct(), recs.select(F.col("entity_id").alias("rec")).distinct()
    found = _list_issues("matching_results", matching, MATCHES, ids, known)
    if candidates is not None:
        found |= _list_issues("candidate_pairs", candidates, CANDIDATES, ids, known)
    out = None
    for issue, rows in found.items():
        one = rows.agg(F.lit(issue).alias("issue"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    out = out.where("n > 0")
    if any("header" in issue for issue in found):
        return out
    m = truth_pairs(matching)
    twice = m.groupBy("rec").count().where("count > 1").agg(F.lit("warning: records matched more than once").alias("issue"), F.count(F.lit(1)).alias("n"))
    if candidates is None:
        return out.unionByName(twice.where("n > 0"))
    apart = m.join(truth_pairs(candidates), ["s1", "rec"], "left_anti").select("s1").distinct().agg(F.lit("warning: lists of matches that are no candidates").alias("issue"), F.count(F.lit(1)).alias("n"))
    clean = out.agg(F.count(F.lit(1)).alias("issues")).where("issues = 0").drop("issues")
    return out.unionByName(twice.where("n > 0")).unionByName(apart.where("n > 0").join(clean.withColumn("one", F.lit(1)), F.lit(True)).drop("one"))
