"""Near copies by SimHash links and, beyond their radius, MinHash bands; an exact check by word shingles of each.

Texts whose SimHash fingerprints are joined by links within four bits, found by op9's ball hashing, are candidates of
one key. Their check is the Jaccard similarity of word shingles: a text is the set of its runs of five words (one of
fewer words is one run). Copies of similarity 0.8 are often more than four bits apart, and for these ``BANDS`` keys of
``ROWS`` MinHash values each are made of the set as well; texts that share a key are candidates, and two of similarity s
share one with probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.9997 at 0.8. Of the texts with one key, of either
kind, the first is compared with all others by their whole shingle sets; those that are not near copies of it go on to
a second round among themselves, and so a key of many near copies makes no pairs. The few that are left after it are
read key by key, each compared with those before it that were like none. In the end, of any two near copies that share
a key one at least is linked to a text before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c
from . import simhash

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 5
ROUNDS = 2
_RNG = np.random.default_rng(5)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; ASCII letters count as small, words are cut at ASCII blanks."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(simhash.LOWER).split()
    digest = xxhash.xxh64_intdigest
    runs = (b" ".join(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1) if ws else 0))
    return np.unique(np.fromiter((digest(r) for r in runs), np.uint64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index; 1 of two empty sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def keys(sigs: np.ndarray) -> list[int]:
    """The keys of a set, one a band."""
    if not len(sigs):
        return [0]
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(sigs), 512):  # in parts, so that a long text needs no more memory
        mixed = sigs[at : at + 512, None] * FACTORS + OFFSETS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def text_hash(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of id and text in the order of the ids, rows without an id last."""
    sign = F.lit(-(1 << 63)).cast("bigint")
    return F.concat(F.coalesce(F.lpad(F.hex(F.col(doc_id).cast("bigint").bitwiseXOR(sign)), 16, "0"), F.lit("null")), F.substring(text_hash(text), 1, 32))


def firsts(docs: DataFrame) -> DataFrame:
    """(n, key, size, fp, bands): of each text of ``docs`` (doc_id, text) the least key, the size of its set, its SimHash
    fingerprint, and its bands' keys.

    ``n`` numbers the texts in the order of their keys.
    """
    rows = docs.select(row_key().alias("key"), text_hash().alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets, prints = [shingles(t) for t in texts], np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.int64()), pa.array([keys(s) for s in sets], pa.list_(pa.int64()))], ["key", "h", "size", "fp", "bands"])

    made = rows.mapInArrow(run, "key string, h string, size bigint, fp bigint, bands array<bigint>")
    least = c.checkpointed(made.groupBy("h").agg(F.min("key").alias("key"), *(F.first(x).alias(x) for x in ("size", "fp", "bands"))).drop("h"))
    return c.checkpointed(least.orderBy("key").withColumn("n", F.monotonically_increasing_id()))


def linked(first: DataFrame) -> DataFrame:
    """(n, size, k): each text of ``first`` under the least of the fingerprints that SimHash links join its own to."""
    roots = simhash.components(simhash.links(first.select("fp").distinct())).withColumnRenamed("node", "fp")
    c.release(first.sparkSession)
    return first.join(roots, "fp", "left").select("n", "size", F.coalesce("root", "fp").alias("k"))


def checked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of numbers whose ``texts`` (n, text) have a Jaccard index of ``similarity`` or more."""
    both = pairs.join(texts.select(F.col("n").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("n").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, at, mine = [], None, np.zeros(0, np.uint64)
            for a, s, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if a != at:
                    at, mine = a, shingles(s)
                keep.append(likeness(mine, shingles(t)) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _several(left: DataFrame) -> DataFrame:
    """Those rows (n, size, k) of ``left`` whose key ``k`` others have too."""
    return c.checkpointed(left.join(left.groupBy("k").count().where("count > 1").select("k"), "k", "left_semi").select("n", "size", "k"))


def links(docs: DataFrame, first: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Checked pairs (a, b), a < b, of numbers of ``first``: in each round the least text of a key, SimHash's or a band's, with the others."""
    spark = docs.sparkSession
    left = _several(linked(first).unionByName(first.select("n", "size", F.explode("bands").alias("k"))))
    c.release(spark)
    # the texts of all that share a key, dealt once; rows of one id and text have one key
    wanted = first.select("n", "key").join(left.select("n").distinct(), "n", "left_semi")
    path = f"{spark.sparkContext.getCheckpointDir()}/texts-{uuid.uuid4().hex}"
    docs.select(row_key().alias("key"), "text").join(wanted, "key").dropDuplicates(["key", "n"]).select("n", "text").write.parquet(path)
    texts = spark.read.parquet(path)
    found = None
    for _ in range(ROUNDS):
        least = left.groupBy("k").agg(F.min(F.col("n")).alias("a"), F.min_by("size", "n").alias("a_size"))
        met = left.join(least, "k").where("n <> a")
        pairs = met.where(F.least("size", "a_size") >= similarity * F.greatest("size", "a_size")).select("a", F.col("n").alias("b")).distinct()
        some = c.checkpointed(checked(pairs, texts, similarity))
        found = some if found is None else found.unionByName(some)
        rest = met.join(some.select("a", F.col("b").alias("n")), ["a", "n"], "left_anti").select("n", "size", "k")
        left = _several(rest)
    return found.unionByName(_in_order(left, texts, similarity)).distinct()


def _in_order(left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of each text of a key to the first before it that it is like, of those that were like none."""
    rows = left.select("k", "n").join(texts, "n").repartition("k").sortWithinPartitions("k", "n").select("k", "n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, firsts_of = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for k, n, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != at:
                    at, firsts_of = k, []
                mine = shingles(text)
                like = next((m for m, sigs in firsts_of if min(len(sigs), len(mine)) >= similarity * max(len(sigs), len(mine)) and likeness(sigs, mine) >= similarity), None)
                if like is None:
                    firsts_of.append((n, mine))
                else:
                    out.append((like, n))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def kept(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The keys (of ``row_key``) of the documents that stay: of each group of texts joined by links the least."""
    docs = docs.select("doc_id", "text")
    first = firsts(docs)
    gone = simhash.components(links(docs, first, similarity)).where("node <> root").select(F.col("node").alias("n"))
    return first.select("n", "key").join(gone, "n", "left_anti").select("key")
