"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townledger.llm import decontam, langid, ngram_join, packing, toxicity
from townledger.llm.common import closed, opened, shared_dir, stored, table

#: Ids that a broadcast may hold; beyond, Spark joins by shuffle.
MAX_BROADCAST_IDS = 1_000_000

#: No SQL expresses the classifiers, so the pipeline is tested against brute force, stage by stage.
ORACLE_SQL = None


def _fits(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without a letter and those that no language is likelier than all others for go."""
    made = langid.identify(spark, closed(docs, "doc_id", "lang"))
    return opened(made.filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)), docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    model = toxicity.learn(spark, docs, table(spark, sf_dir, "labels"))
    return opened(toxicity.predict(closed(docs), model).filter(F.col("predicted") == 0), docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id; only where no member has an id, one without.

    Rows are told by a number of their own, so different texts under one id, and texts without an id, are each decided
    by their own group. Documents without a word are in no group and stay.
    """
    folder = shared_dir(spark)
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), f"{folder}/rows")
    made = ngram_join.join_ngrams(spark, rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    found = stored(made.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), f"{folder}/found")
    groups = stored(found.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group"), f"{folder}/groups")
    members = stored(found.join(_fits(groups), "group").join(rows.select("row", F.col("doc.doc_id").alias("id")), "row"), f"{folder}/members")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("first"))
    first = stored(first.select("group", F.col("first.row").alias("first")), f"{folder}/first")
    gone = stored(members.join(_fits(first), "group").filter(F.col("row") != F.col("first")).select("row"), f"{folder}/gone")
    return rows.join(_fits(gone), "row", "left_anti").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of the benchmark."""
    return decontam.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(spark, docs)


STAGES = [
    ("language ID", language),
    ("toxicity", clean),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"{folder}/{i}")
    return docs
