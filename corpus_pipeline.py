"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixture, shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import _common as c
from pathloom.llm import decontam, langid, mixing, nearcopies, sharding


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; those without a letter or in none of the languages go.

    Nulls: a text that is null is rejected; other null columns are kept as they are.
    """
    return langid.known(docs, langid.train(docs, with_usual=True))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id; those without an id come last.

    Near copies have a Jaccard index of 0.8 or more over shingles of five words. Candidates are the texts that op9's
    SimHash links join and, as four bits do not reach all near copies, those that share a MinHash band; their whole
    sets are checked.
    """
    (key,) = c.fresh(docs, "kept_key")
    rows = docs.withColumn(key, nearcopies.row_key()).join(nearcopies.kept(docs).withColumnRenamed("key", key), key, "left_semi")
    # of rows of one id and text the least; an id has few rows
    return rows.groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, without the benchmark passages that they hold.

    A document with hits that stays loses its hit words, and ``n_chars`` is counted anew; any other row stays as it is.
    """
    (clean,) = c.fresh(docs, "clean")
    found = decontam.decontaminate(docs, c.table(spark, sf_dir, "benchmark"), clean=clean)
    hit = F.col("n_hit") > 0
    new = {"text": F.when(hit, F.col(clean)).otherwise(F.col("text")), "n_chars": F.when(hit, F.length(clean).cast("bigint")).otherwise(F.col("n_chars"))}
    return found.where(~F.col("contaminated")).select(*[new[x].alias(x) if x in new else F.col(x) for x in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources; a document is a row for each epoch that takes it."""
    return mixing.mix(docs, epoch_col=c.fresh(docs, "epoch")[0]).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slots and shards."""
    return sharding.shard(docs)


STAGES = [("language_id", identify), ("simhash_near_dedup", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Language ID and near-duplicates are beyond SQL. ``tests/llm/test_pipeline.py`` has the near copies against all pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read back."""
    docs = c.table(spark, sf_dir, "documents")
    base = f"{c.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
