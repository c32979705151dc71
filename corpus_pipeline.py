"""From documents to token ids: language ID, toxicity, near duplicates, mixing, encoding. Every stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.base import Scratch, held_out, table
from grove.llm.language import fit_dictionaries, identify_languages
from grove.llm.mixing import mixed
from grove.llm.near_dup import near_duplicates
from grove.llm.pieces import encode_documents
from grove.llm.toxicity import fit_grammar, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the dictionaries tell apart; null texts, texts without letters and ties go.

    Rows are judged alone: repeated rows and ids share a fate, an empty table stays empty, and null languages, sources and
    ids do not matter (a row without id is never learned from). Columns beyond those of documents go."""
    found = identify_languages(docs.select(*COLUMNS), fit_dictionaries(docs, ~held_out()), lang_col="_lang", score_col="_score", accept_col="_ok")
    return found.where("_ok").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score under 0.5: null and empty texts hold no clause and stay.

    Rows are judged alone, as in the stage before; labels of documents that are gone take no part."""
    grammar = fit_grammar(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score_toxicity(docs.select(*COLUMNS), grammar, score_col="_score").where("_score < 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of five-word-shingle similarity 0.8: that with the smallest id.

    Of rows that repeat the kept id the one with the smallest text stays (null first, then by the other columns). Texts
    without words are in no group and stay; so do rows without id, which cannot be told apart from one another."""
    ids = Scratch(spark).keep(near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "kept")
    rows = docs.select(*COLUMNS)
    lone = rows.join(ids.where("rows = 1").select("doc_id"), "doc_id", "left_semi")
    rest = [c for c in COLUMNS if c != "doc_id"]
    several = rows.join(ids.where("rows > 1").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in rest if c != "text"])).alias("one"))
    return lone.select(*COLUMNS).unionByName(several.select("doc_id", "one.*")).unionByName(rows.where(F.col("doc_id").isNull()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in the order of the mix; documents taken twice stand twice.

    A null source is one source; documents without words are in no mix; rows of one id are documents of their own."""
    return mixed(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip of every row. Null and empty texts have no ids; repeated rows have equal ones."""
    return encode_documents(docs)


STAGES = [("language ID", language_stage), ("toxicity", toxicity_stage), ("MinHash near-dedup", near_duplicate_stage), ("mixing sources to target weights", mixing_stage), ("SentencePiece encoding and decoding", encoding_stage)]
#: Compression, the learned grammar, register bands and piece lattices are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), None
    others = list(Scratch.live)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        # What a stage read and wrote on the way goes once its result is written.
        Scratch.sweep(*others)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
