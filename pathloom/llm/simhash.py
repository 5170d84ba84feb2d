"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two fingerprints within the
radius (4) have a word between them that is within half the radius (2) of both, and two that share such a word are
within the radius by the triangle inequality. So each fingerprint emits every word within half the radius, and those
that share one are linked: exact links, as a star for each word, without pairs.

A fingerprint has 2081 such words, so a filter of the same kind comes first, and only fingerprints that may have a
partner emit them. The bits are cut in three parts; of two fingerprints within 4, some two parts together are within
2, so the fingerprints share a variant of these 42 or 43 bits with at most one bit flipped. A fingerprint that shares
none of its 132 variants has no partner.

Dense groups are contracted on the way. Of the fingerprints that share a variant of the filter, those within the radius
of the least are united with it at once; after that a word stands for the united groups that hold it, not for their
fingerprints, and links groups only. A word that one group holds alone links nothing, so a group of many near
copies makes links in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

SHINGLE, SEED, RADIUS = 4, 42, 4
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, unsigned; 0 for a text without words."""
    if not text:
        return 0
    raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
    # bytes.split() cuts at the six ASCII blanks: words are runs of anything else
    ws = raw.split()
    if not ws:
        return 0
    line = b" ".join(ws)
    if len(ws) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    counts = bit_counts(hashes)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the numbers have each of the 64 bits set; eight bits are summed at once, a byte of a word each."""
    rows = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    rows[: len(hashes)] = hashes
    rows, ones = rows.reshape(-1, 255), np.uint64(0x0101010101010101)
    sums = [(rows >> np.uint64(k) & ones).sum(1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64) for k in range(8)]
    return np.stack(sums, 1).ravel()


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fp", keep_text: bool = False) -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed 64-bit column; every row is kept."""
    docs = docs.select(*[x for x in docs.columns if x.lower() != out.lower()])
    gone = [] if keep_text else [text_col]
    schema = c.added(docs, *gone, **{out: "bigint"})
    at, places, names = docs.columns.index(text_col), [i for i, x in enumerate(docs.columns) if x not in gone], schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(found, pa.int64())], names)

    return docs.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(bits: range | list[int], radius: int) -> list[int]:
    """Every mask with at most ``radius`` of the bits set, as signed 64-bit numbers."""
    return [_signed(sum(1 << b for b in chosen)) for n in range(radius + 1) for chosen in combinations(bits, n)]


def _masks(spark: SparkSession, masks: list[int]):
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")


PARTS = (range(21), range(21, 42), range(42, 64))


def _shared(variants: DataFrame, node: str) -> DataFrame:
    """(node, a) for each word ``v`` of ``variants`` that several nodes have: all of them with the least; one shuffle."""
    # the join would add this filter below its own exchange, which then were not the same as the grouping's
    dealt = variants.where("v is not null").repartition("v")
    least = dealt.groupBy("v").agg(F.min(node).alias("a"), F.max(node).alias("z")).where("a <> z").select("v", "a")
    return dealt.join(least, "v").select(node, "a")


def suspects(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, a): the distinct fingerprints that share a variant of two parts with others, and the least of these."""
    spark = fps.sparkSession
    masks: list[int] = []
    kept = None  # the bits of the parts that a mask's place belongs to
    for left_out in PARTS:
        bits = [b for part in PARTS if part != left_out for b in part]
        keep = F.lit(_signed(sum(1 << b for b in bits)))
        masks += ball(bits, radius // 4)
        kept = (F.when if kept is None else kept.when)(F.col("k") < len(masks), keep)
    variants = fps.select("fp", F.posexplode(_masks(spark, masks)).alias("k", "m")).select("fp", F.col("fp").bitwiseAND(kept).bitwiseXOR(F.col("m")).alias("v"))
    # an inner join: a left semi join would be pushed below the exchange
    return _shared(variants, "fp").distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints, each within ``radius`` or between members of groups that are joined so.

    Two fingerprints are in one component of these links just if they are in one component of all pairs within
    the radius.
    """
    if radius != 4:
        raise ValueError("the filter's parts are made for a radius of four")
    spark = fps.sparkSession
    met = c.checkpointed(suspects(fps, radius))
    stars = components(met.where((F.col("fp") != F.col("a")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("a"))) <= radius)).select("a", F.col("fp").alias("b")))
    grouped = c.checkpointed(met.select("fp").distinct().join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    words = grouped.select("root", F.explode(_masks(spark, ball(range(64), radius // 2))).alias("m"), "fp").select("root", F.expr("fp ^ m").alias("v"))
    across = _shared(words, "root").where("root <> a").select("a", F.col("root").alias("b")).distinct()
    return grouped.where("root <> fp").select(F.col("root").alias("a"), F.col("fp").alias("b")).unionByName(across)


def components(edges: DataFrame, *, rounds: int = 200) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large and small stars.

    Each round is two shuffles of the links; a node's neighbours are never gathered, only their least is taken.
    """
    now = c.checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = c.checkpointed(small)
        # stars whose centres are nobody's leaf are the end
        if small.select("u").join(small.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() and small.groupBy("u").count().where("count > 1").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = small
    raise RuntimeError("the components did not settle")


#: Rows of one fingerprint beyond which its rows are dealt to several tasks.
HOT_ROWS = 20_000


def cluster(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: its id, fingerprint (16 hex digits) and component_id.

    A component holds the documents whose fingerprints are joined by chains of links; its id is the least
    document id in it. Texts that are null, empty or blank have fingerprint zero, and are linked like any others.
    Rows without an id are kept; a component of such rows alone has no id.
    """
    prints = c.checkpointed(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    each = c.checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    # nodes in the order of their least ids, those without an id last, so that a component's least node names it
    node = F.struct(F.col("first").isNull().alias("none"), F.coalesce("first", F.lit(0)).alias("first"), "fp").alias("node")
    nodes = each.select("fp", node)
    edges = links(each.select("fp"), radius)
    edges = edges.join(nodes.select(F.col("fp").alias("a"), F.col("node").alias("u")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("node").alias("v")), "b")
    roots = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    named = each.join(roots.select(F.col("node.fp").alias("fp"), "root"), "fp", "left").select("fp", "n", F.when(F.col("root").isNull(), F.col("first")).when(~F.col("root.none"), F.col("root.first")).alias("component_id"))
    # rows of a hot fingerprint go to as many tasks as they need; there are few such, of at least HOT_ROWS rows each
    parts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    hot = each.where(F.col("n") > HOT_ROWS).select("fp", parts.alias("parts"))
    dealt = prints.join(F.broadcast(hot), "fp", "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))).cast("int"))
    named = named.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HOT_ROWS, parts - 1).otherwise(F.lit(0)))))
    return dealt.join(named, ["fp", "part"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: fingerprint and component of every document."""
    return cluster(c.table(spark, sf_dir, "documents"))
