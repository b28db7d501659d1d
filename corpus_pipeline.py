"""The corpus pipeline over `documents`: toxicity, near-duplicates, decontamination, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns a DataFrame with the columns of `documents` (the last one: packed pieces). Empty tables pass every stage; a stage's own
columns are named `__id` or not seen by the next, so further columns of documents may have any other name. run() writes each stage as Parquet in
the shared folder and reads it again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import new_path, written
from caseloom.llm.decontaminate import contaminated
from caseloom.llm.minhash import near_duplicates
from caseloom.llm.packing import packed
from caseloom.llm.secrets import redacted
from caseloom.llm.toxicity import fitted, held_out, score_column

#: Score from which a document is rejected.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxic score; the lexicon is learned from the labelled rows that are not held out. Null and empty texts score as texts without a match; rows are judged one by one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return docs.where(score_column(fitted(docs, labels))(F.col("text").cast("string")) < TOXIC)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with `__id`: the doc_id, or for a row without one a number of its own beyond all of them. Such rows are written, so that their numbers hold."""
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    bare = written(docs.where("doc_id is null").withColumn("__id", F.lit(top + 1) + F.monotonically_increasing_id()), "unnamed")
    return docs.where("doc_id is not null").withColumn("__id", F.col("doc_id").cast("long")).unionByName(bare)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: that of the smallest doc_id.

    Rows of one doc_id are one document, of which the first in the order of its columns stays; a row without doc_id is a
    document of its own, after all that have one. Null and empty texts are copies of nothing.
    """
    every, names = _numbered(docs), docs.columns
    gone = near_duplicates(every.select(F.col("__id").alias("doc_id"), "text"), shingle=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    stay = every.join(gone, "__id", "left_anti")
    twice = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).count().where("count > 1").select("__id"), "repeated")
    if twice.isEmpty():
        return stay.select(*names)
    first = stay.join(twice, "__id", "left_semi").groupBy("__id").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return stay.join(twice, "__id", "left_anti").select(*names).unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item's five-word shingles.

    Items of fewer words reject nothing, as clean documents hold such words by chance. All rows of a doc_id go if one does.
    """
    every = _numbered(docs)
    gone = contaminated(every.select(F.col("__id").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=False).select(F.col("doc_id").alias("__id")).distinct()
    return every.join(gone, "__id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark, with n_chars counted anew (null for a null text)."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of 1024; a null or empty text is its end id alone, repeated rows are packed as often as they occur."""
    return packed(docs, size=1024)


STAGES = [("toxicity", toxicity), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("secret scan", secrets), ("best-fit packing", packing)]
#: Learning, hashing and tokenising have no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '_')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
