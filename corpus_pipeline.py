"""A corpus pipeline of five stages, each one of the corpus operators.

Stages read what the stage before has written; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.llm import lang_id, mixing, ngram_join, packing, secret_scan
from loomrank.llm.common import cut, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: near-duplicates: five-word shingles, Jaccard of 0.8
SHINGLE, NUM, DEN = 5, 80, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told by a clear margin."""
    return lang_id.keep_accepted(docs.select(COLUMNS), lang_id.learn(docs.where(~lang_id.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each group of near copies.

    Rows with equal ids are one document: one of them stays, that with the
    greatest text. Rows without an id belong to no group and all stay.
    """
    docs = docs.select(COLUMNS)
    joined = cut(ngram_join.ngram_join(docs, SHINGLE, NUM, DEN).where("doc_id is not null").select("doc_id", "component_id"), "joined")
    gone = cut(joined.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    out = without(docs, "doc_id", gone).select(COLUMNS)
    often = cut(joined.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "often")
    if often.isEmpty():
        return out
    rest = F.struct(*[c for c in COLUMNS if c != "doc_id"])
    one = out.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(rest).alias("row")).select("doc_id", "row.*")
    return out.join(often, "doc_id", "left_anti").select(COLUMNS).unionByName(one.select(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hide secrets in texts; no document is dropped."""
    clean = secret_scan.redact(docs.select(COLUMNS), secret_scan.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics meet their targets.

    Rows with equal ids are drawn by one number; a row without an id is drawn by
    its content.
    """
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(*COLUMNS)).alias("draw_id"))
    chosen = mixing.mix(keyed, id_col="draw_id").where("selected").select(F.col("doc_id").alias("draw_id")).distinct()
    return keyed.join(chosen, "draw_id", "left_semi").select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents in training sequences."""
    return packing.best_fit(docs.select("doc_id", mixing.word_count(F.col("text")).alias("n_words")), "n_words")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("secrets", secrets),
    ("mixing", mix_sources),
    ("packing", packing_stage),
]
#: compression, a trained network and best-fit packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
