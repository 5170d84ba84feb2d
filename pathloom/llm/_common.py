"""Helpers shared by the corpus operators: table access, shared checkpoints, unique column names."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark itself so that any file system that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that lost executors cost no recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own;
    on a cluster this fails, as executors on other machines would not see a folder of the driver's.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] == "local":
            named = tempfile.mkdtemp(prefix="checkpoints-")
        if not named:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nobody holds any more; it does so only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def labelled(docs: DataFrame, labels: DataFrame, conflict, *, id_col: str, text_col: str, label_col: str, rows_a_label: int) -> DataFrame:
    """(i, y, t): a bounded sample of labelled documents, of each label 0 and 1 the ``rows_a_label`` with the least hash of their id.

    Of an id's labels ``conflict`` (an aggregate) picks one, and of its documents the one with the least text counts, so
    repeated rows do not make the sample grow.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(conflict(label_col).cast("int").alias("y"))
    picked = [tuple(r) for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(rows_a_label).collect()]
    few = F.broadcast(docs.sparkSession.createDataFrame(picked, known.schema))
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(few, "i").groupBy("i", "y").agg(F.min("t").alias("t"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``df`` has, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def added(df: DataFrame, *drop: str, **kinds: str) -> T.StructType:
    """The schema of ``df`` without ``drop``, with a column of each kind appended."""
    out = T.StructType([f for f in df.schema.fields if f.name not in drop])
    for name, kind in kinds.items():
        out = out.add(name, T.DataType.fromDDL(kind))
    return out


def crc_rest(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``: the fold of a labelled row."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


LETTER_RUN = re.compile(r"[^\W\d_]+")
