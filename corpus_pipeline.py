"""A corpus pipeline over the operators of ``tablewarden.llm``.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last keep the columns of
``documents``. Every stage decides by row, with or without a ``doc_id``, and of near copies one row stays; null
and empty texts pass through every stage and are packed as their end id alone; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import decontamination, near_join, packing, pii, toxicity
from tablewarden.llm.queries import vocabulary
from tablewarden.llm.shared import BROADCAST_BYTES, bytes_of, stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = toxicity.score(docs, model, keep=docs.columns)
    return judged.where("predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that n-gram Jaccard links connect, the one with the smallest id stays (rows without an id come
    last; of repeated rows one stays). A row whose set is empty stays."""
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    classes = near_join.near_classes(rows.select(F.col("__row").alias("doc_id"), "text")).where("n_shingles > 0")
    own = classes.select(F.col("doc_id").alias("__row"), "component_id").join(rows.select("__row", "doc_id"), "__row")
    members = stored(own, "near-members")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    stays = members.groupBy("component_id").agg(first.alias("first")).select("first.__row")
    gone = stored(members.join(stays, "__row", "left_anti").select("__row"), "near-gone")
    small = bytes_of(gone) <= BROADCAST_BYTES
    return rows.join(F.broadcast(gone) if small else gone, "__row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    judged = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns)
    return judged.where("not contaminated").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets; ``n_chars`` follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL has neither the tokenizer nor the fitted models; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
