"""Benchmark decontamination: token windows of every document against a broadcast hash set of benchmark windows.

The hash set is a sorted array of the 64-bit hashes of all windows of the test items' normalised words, with the
place that each comes from. A document's windows of the same lengths are hashed by prefix sums over its bytes
and looked up, first in a bitmap; each hit is verified word by word against its item, so no result rests on a hash.

The set is cut in blocks of at most ``WINDOWS_A_BLOCK`` windows, so what is broadcast has a bound. One block is
looked up as the rows stream by. Of several, each has a pass of its own over the texts, whose hits are written to the
shared folder before its broadcast is destroyed; the hits of all passes are then joined to the rows by their texts' hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
#: For the bytes of UTF-8: A-Z to a-z, and a blank for each ASCII character that is no part of a word.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
WINDOW = 13
WINDOWS_A_BLOCK = 1_000_000
BITMAP_BITS = 22
#: Odd bases of the hashes of words (over bytes) and of windows (over words), and their inverses modulo 2 ** 64.
BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
INVERSES = [np.uint64(pow(int(x), -1, 1 << 64)) for x in BASES]


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text, runs of ``WORD`` in UTF-8; none of null."""
    return folded(text).split()


def folded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(FOLD) if text else b""


@dataclass
class Index:
    """Windows of some items: sorted hashes, and for each the place (word of ``held``) and item that it comes from."""

    held: list[list[bytes]]
    numbers: list[int]
    sizes: list[int]
    hashes: np.ndarray
    item: np.ndarray
    start: np.ndarray
    bitmap: np.ndarray


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of the values, whatever its place: prefix sums, moved back by the inverse of the base."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(BASES[k], len(values)), dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(INVERSES[k], len(values) + 1)[starts]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of folded bytes, and a hash of it."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 32
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    got = _runs(data.astype(np.uint64), starts, ends, 0)
    got ^= got >> np.uint64(29)
    return starts, ends, got * np.uint64(0xBF58476D1CE4E5B9) ^ (ends - starts).astype(np.uint64)


def window_hashes(of_words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words."""
    first = np.arange(len(of_words) - size + 1)
    return _runs(of_words, first, first + size, 1) if len(first) else np.zeros(0, np.uint64)


def index_of(items: list[tuple[int, list[bytes]]], size: int = WINDOW) -> Index:
    """The windows of some items, given as numbers and words; an item of fewer words than a window is one window."""
    found: list[tuple[np.ndarray, int]] = []
    sizes = set()
    for _, ws in items:
        n = min(size, len(ws))
        sizes.add(n)
        found.append((window_hashes(word_hashes(b" ".join(ws))[2], n) + np.uint64(n), n) if n else (np.zeros(0, np.uint64), 0))
    hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(found), dtype=np.int32), [len(h) for h, _ in found])
    start = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in found]) if found else np.zeros(0, np.int32)
    order = np.argsort(hashes, kind="stable")
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[hashes >> np.uint64(64 - BITMAP_BITS)] = True
    return Index([ws for _, ws in items], [n for n, _ in items], sorted(sizes - {0}), hashes[order], item[order], start[order], bitmap)


def scan(raw: bytes, index: Index) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words of the folded bytes, spans of words that windows cover (merged, in order), and the items these come from."""
    starts, ends, of_words = word_hashes(raw)
    found: list[tuple[int, int]] = []
    items: set[int] = set()
    for size in index.sizes:
        hashes = window_hashes(of_words, size) + np.uint64(size)
        likely = np.flatnonzero(index.bitmap[hashes >> np.uint64(64 - BITMAP_BITS)])
        if not len(likely):
            continue
        low = np.searchsorted(index.hashes, hashes[likely], "left")
        high = np.searchsorted(index.hashes, hashes[likely], "right")
        for at, i, j in zip(likely[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
            window = [raw[starts[k] : ends[k]] for k in range(at, at + size)]
            for place in range(i, j):
                k, first = int(index.item[place]), int(index.start[place])
                if index.held[k][first : first + size] == window:
                    found.append((at, at + size))
                    items.add(index.numbers[k])
    return len(starts), merged(found), items


def hits(ws: list[bytes], index: Index) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans of words covered by windows of the index (merged, in order), and the items that these come from."""
    return scan(b" ".join(ws), index)[1:]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stood between two words of a span goes too."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def _blocks(items: DataFrame, id_col: str, text_col: str, size: int, most: int) -> Iterator[tuple[list[str], Index]]:
    """Ids and index of one block of items after another, read one at a time; a block has ``most`` windows or one item."""
    names: list[str] = []
    held: list[tuple[int, list[bytes]]] = []
    windows = 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if row["i"] is None or not (ws := words(row["t"])):
            continue
        if held and windows + len(ws) > most:
            yield names, index_of(held, size)
            names, held, windows = [], [], 0
        held.append((len(names), ws))
        names.append(row["i"])
        windows += len(ws)
    if held:
        yield names, index_of(held, size)


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, windows_a_block: int = WINDOWS_A_BLOCK, clean: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    ``clean`` names a further column: the text without its hit words. Null and empty texts have no words and are
    clean; an item without words is in no document; items of one id count once, and one without an id not at all.
    Every row is kept, repeated ones too. Columns of ``docs`` that are named as the new ones are replaced.
    """
    context = docs.sparkSession.sparkContext
    new = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"} | ({clean: "string"} if clean else {})
    docs = docs.select(*[x for x in docs.columns if x.lower() not in {n.lower() for n in new}])
    passes = _blocks(items, item_id, item_text, window, windows_a_block)
    block, following = next(passes, ([], index_of([]))), next(passes, None)
    if following is None:
        sent = context.broadcast(block)
        return _finished(docs, text_col, new, keep_text, lambda raw, _: _named(raw, sent.value))
    key, spans_col, items_col = c.fresh(docs, "text_hash", "hit_spans", "hit_items")
    hashed = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    found = None
    while block is not None:
        sent = context.broadcast(block)
        some = c.checkpointed(_hit_texts(docs.select(F.col(text_col).alias("text")), sent).groupBy("h").agg(F.first("s").alias("s"), F.first("i").alias("i")))
        sent.destroy()
        found = some if found is None else found.unionByName(some)
        block, following = following, next(passes, None) if following else None
    # a row a block for each text
    found = found.groupBy("h").agg(F.flatten(F.collect_list("s")).alias(spans_col), F.array_distinct(F.flatten(F.collect_list("i"))).alias(items_col)).withColumnRenamed("h", key)
    joined = docs.withColumn(key, hashed).join(found, key, "left").drop(key)
    return _finished(joined, text_col, new, keep_text, lambda raw, old: (len(raw.split()), merged(list(zip(old[0][::2], old[0][1::2], strict=True))) if old[0] else [], set(old[1] or [])), spans_col, items_col)


def _named(raw: bytes, block: tuple[list[str], Index]) -> tuple[int, list[tuple[int, int]], set[str]]:
    n, spans, numbers = scan(raw, block[1])
    return n, spans, {block[0][k] for k in numbers}


def _hit_texts(texts: DataFrame, sent) -> DataFrame:
    """(h, s, i) for each row with hits: its text's hash, the spans one after the other, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                _, spans, names = _named(folded(text), sent.value)
                if spans:
                    out.append((hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), [x for s in spans for x in s], sorted(names)))
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["h", "s", "i"])

    return texts.mapInArrow(run, "h string, s array<bigint>, i array<string>")


def _finished(rows: DataFrame, text_col: str, new: dict[str, str], keep_text: bool, find, *old_cols: str) -> DataFrame:
    """``rows`` with the result columns; ``find`` gives words, spans and items of folded bytes and the ``old_cols``."""
    at, olds = rows.columns.index(text_col), [rows.columns.index(x) for x in old_cols]
    places = [k for k, x in enumerate(rows.columns) if x not in old_cols and (keep_text or x != text_col)]
    schema = T.StructType([rows.schema.fields[k] for k in places])
    for name, kind in new.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    names = schema.fieldNames()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()][: len(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1_000):  # few texts are strings of Python at a time
                batch = whole.slice(first, 1_000)
                out = []
                old = zip(*(batch.column(k).to_pylist() for k in olds), strict=True) if olds else ((),) * batch.num_rows
                for text, before in zip(batch.column(at).to_pylist(), old, strict=True):
                    n, spans, items = find(folded(text), before)
                    n_hit = sum(e - s for s, e in spans)
                    row = (n, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n)
                    out.append((*row, without(text, spans) if text else text) if len(new) > len(row) else row)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in places), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: hits of all benchmark windows in all documents."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, c.table(spark, sf_dir, "benchmark"), keep_text=False)


def sql() -> str:
    """The same in DuckDB's SQL: windows as joined words, compared at every place of every document."""
    fold = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {fold} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {fold} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i : i + least(len(ws), {WINDOW}) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT r, item, i, dw.n FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
hw AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) FROM h) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)"""
