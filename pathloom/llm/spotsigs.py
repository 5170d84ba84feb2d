"""Document fingerprints by SpotSigs.

A signature is an anchor with the chain of the next content words (words that are no common words). Anchors are the
common words of some languages and, so that texts with few of them have signatures too, one other word in eight, by
hash. A document's fingerprint is the sorted list of its signatures' 32-bit hashes, in hex. Likeness is the
Jaccard index of the signature sets; op6 gives it for each text and its next, so it compares all of these.

``near_duplicates`` finds all pairs of different fingerprints with a likeness of 0.8 or more: sets are dealt by the
rarest of their signatures (prefix filter) and by partition of set length, and only survivors are compared. No query runs it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

#: Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """a an and are as at be been but by can for from had has have he her his i in is it its not of on or she that the
    their there they this to was we were which will with you
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für
    hat ich im ist mit nach nicht noch nur oder sich sie sind so um und vom von vor war wie wir zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous ont ou par pas
    pour plus qu que qui sa se ses son sur un une vous à été
    al como con cuando del el ella entre era esta este esto está fue ha hay la las lo los me mi muy más ni no nos o
    para pero por porque se ser si sin sobre su sus también te tiene todo un una uno y ya""".split()
)
WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.8


def signatures(text: str | None) -> np.ndarray:
    """Hashes of the text's signatures, sorted and distinct.

    A text in which no anchor is followed by a whole chain has its words as signatures, and one without words is a signature
    of itself. The empty text's set is empty.
    """
    if not text:
        return np.empty(0, np.uint32)
    ws = WORD.findall(text.lower())
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for w in ws:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
            if not crc32(w.encode("utf-8", "surrogatepass")) & 7:
                spots.append((w, len(content)))
    found = {f"{a} {content[k]} {content[k + 1]}" for a, k in spots if k + 1 < len(content)} or set(ws) or {text}
    return np.unique(np.fromiter((crc32(x.encode("utf-8", "surrogatepass")) for x in found), np.uint32, len(found)))


def to_hex(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets; 1 of two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first code points of the following one."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


#: Rows of a bucket of neighbouring ids, and most buckets.
BUCKET_ROWS, BUCKETS = 2_000, 65_536


def _bucket(doc_id, bounds: list[int]):
    """How many bounds the id reaches; looked up in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    whole = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    nested = F.transform(F.split(F.lit(";".join(",".join(map(str, r)) for r in rows)), ";"), lambda r: F.split(r, ",").cast("array<bigint>"))
    first = F.size(F.filter(whole([r[0] for r in rows]), lambda b: b <= doc_id))
    inner = F.size(F.filter(F.element_at(nested, first), lambda b: b <= doc_id))
    return F.coalesce(F.when(first == 0, F.lit(0)).otherwise((first - 1) * step + inner), F.lit(0))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, stands_in, doc_id, text), dealt and sorted so that each row is followed by the next by descending id.

    A bucket holds neighbouring ids; the first row of each is also, as ``stands_in``, the end of the bucket before it
    (the first of all: of the last). So texts are shuffled once, and a row a bucket twice.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.count()
    n = max(1, min(BUCKETS, total // BUCKET_ROWS))
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(cuts or []))
    marked = rows.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    tops = sorted(((r["bucket"], r["top"]) for r in rows.select("doc_id").withColumn("bucket", _bucket(F.col("doc_id"), bounds)).groupBy("bucket").agg(F.max("doc_id").alias("top")).collect() if r["top"] is not None), reverse=True)
    # at most BUCKETS rows: the top of each bucket and the bucket that it follows
    heads = docs.sparkSession.createDataFrame([(top, tops[k - 1][0]) for k, (_, top) in enumerate(tops)] or [(None, None)], "top bigint, follows bigint")
    sent = marked.join(F.broadcast(heads), F.col("doc_id") == F.col("top"), "left")
    once = F.struct(F.col("bucket").cast("bigint").alias("b"), F.lit(False).alias("s"))
    again = F.struct(F.col("follows").alias("b"), F.lit(True).alias("s"))
    dealt = sent.select("doc_id", "text", F.explode(F.when(F.col("follows").isNull(), F.array(once)).otherwise(F.array(once, again))).alias("at"))
    dealt = dealt.select(F.col("at.b").alias("bucket"), F.col("at.s").alias("stands_in"), "doc_id", "text", F.md5(F.col("text").cast("binary")).alias("tie"))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "stands_in", F.desc_nulls_last("doc_id"), "tie").drop("tie")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its fingerprint and that of its edited text, and likenesses.

    Null texts are empty. The next of the last row is the first; of a single row it is the row itself. Rows of one id
    follow one another in the order of their texts' MD5. Rows without an id come last.
    """
    rows = with_next(docs, id_col=id_col, text_col=text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = c.added(rows, "bucket", "stands_in", "text", n_chars="bigint", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double")

    def made(doc_id, text: str, sigs: np.ndarray, following: str, next_sigs: np.ndarray) -> tuple:
        new = edited(text, following)
        new_sigs = signatures(new)
        return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(sigs), to_hex(new_sigs), likeness(sigs, new_sigs), likeness(sigs, next_sigs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None  # the row that waits for its next, and its bucket's first
        bucket = None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        out: list[tuple] = []
        size = 0
        for batch in batches:
            for b, stands_in, doc_id, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held is not None and b != bucket:  # a bucket of rows without ids alone has no stand-in
                    out.append(made(*held, first[1], first[2]))
                    held = None
                if b != bucket:
                    bucket, first = b, None
                if stands_in and held is None:
                    continue
                sigs = signatures(text)
                if held is not None:
                    out.append(made(*held, text, sigs))
                held = None if stands_in else (doc_id, text, sigs)
                first = first or held
                size += len(text)
                if size > 4_000_000:
                    yield batch_of(out)
                    out, size = [], 0
        if held is not None:
            out.append(made(*held, first[1], first[2]))
        yield batch_of(out)

    return rows.mapInArrow(run, schema)


def near_duplicates(prints: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness) for all pairs a < b of different fingerprints whose Jaccard index is ``threshold`` or more.

    ``prints`` has a column ``fingerprint``; equal ones are one class. Set lengths are cut in partitions of ratio
    ``threshold``, so that a set can be like sets of its own and the next partition only; within these, sets meet on a
    signature among the rarest of both, as many as any like pair must share one of.
    """
    sets = prints.select("fingerprint").distinct().where("fingerprint <> ''").withColumn("n", (F.length("fingerprint") / 8).cast("int"))
    sigs = sets.select("fingerprint", "n", F.explode(F.expr("transform(sequence(0, n - 1), i -> substring(fingerprint, 8 * i + 1, 8))")).alias("sig"))
    counts = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = sigs.join(counts, "sig").withColumn("r", F.row_number().over(Window.partitionBy("fingerprint").orderBy("df", "sig")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    prefix = prefix.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)))).select("fingerprint", "n", "sig", "part")
    other = prefix.select(F.col("fingerprint").alias("f2"), F.col("n").alias("n2"), "sig", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    near = prefix.join(other, ["sig", "part"]).where((F.col("n2") * threshold <= F.col("n") + 1e-9) & (F.col("n") * threshold <= F.col("n2") + 1e-9) & (F.col("fingerprint") != F.col("f2")))
    pairs = near.select(F.least("fingerprint", "f2").alias("a"), F.greatest("fingerprint", "f2").alias("b")).distinct()
    cut = lambda x: F.expr(f"transform(sequence(0, cast(length({x}) / 8 as int) - 1), i -> substring({x}, 8 * i + 1, 8))")
    both = F.size(F.array_intersect(cut("a"), cut("b")))
    return pairs.withColumn("likeness", both / ((F.length("a") + F.length("b")) / 8 - both)).where(F.col("likeness") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprints of every document and its edited text."""
    return fingerprints(c.table(spark, sf_dir, "documents"))
