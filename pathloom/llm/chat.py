"""Chat formatting of reply trees.

Messages name the message they reply to. Root-to-leaf paths come from iterative self-joins on identifiers and scores
alone: a join of the k-th round leads from each message to the one 2^k replies above it, and from the leaves the rounds
in reverse list every message of each path once. A tree of any depth takes as many rounds as its depth has bits.
Branches are ranked by their mean score, and each chosen path is formatted as one conversation.

A conversation is the formatted turns in order, so turns are formatted one by one. Steps and texts are dealt by tree
together, in the one shuffle that carries texts, and merged as sorted streams: no task holds a conversation in memory.

A turn is ``<|im_start|>role`` LF text ``<|im_end|>`` LF. Within roles and texts a backslash is doubled, and one is put
behind each ``<`` and ``[``, so that no control string (``<|im_end|>``, ``</s>``, ``[INST]`` ...) can stand in them; a
line feed in a role is written as a backslash and ``n``. Reading is left to right, so the escape is reversible.
The loss mask is the list of spans, in code points, of the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
LEARNT = "assistant"
#: Most characters of formatted turns in a batch that leaves a worker.
BATCH_CHARS = 8_000_000


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\)|([<\[])\\", lambda m: m[1] or m[2], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The conversation, and the starts and ends of the spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape_role(role)}\n"
        body = escape(text)
        if role == LEARNT:
            spans += [at + len(head), at + len(head) + len(body)]
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])|([<\[])\\", lambda m: ("\n" if m[1] == "n" else m[1]) if m[1] else m[2], role)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape_role(role), unescape(text)) for role, text in TURN.findall(formatted)]


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]):
    """Equality of columns; trees without an id are one tree."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def steps(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, back, score): every message of every root-to-leaf path, ``back`` replies above the leaf.

    ``messages`` has tree, node, parent and score. A message whose parent is null or missing is a root. Messages that
    reply to each other in a ring hang on no root and are in no path, nor are those below them. Repeated rows of a
    node count once, with the least parent and the greatest score. A null score counts as 0.
    """
    nodes = c.checkpointed(messages.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score")))
    above = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("score").alias("up_score"))
    ups = [c.checkpointed(nodes.join(above, _same(nodes, above, [("tree", "t"), ("parent", "n")])).where("parent is not null").select("tree", "node", F.col("parent").alias("up"), "up_score"))]
    # no path is longer than there are messages; what still leads up after so many rounds leads to a ring
    for _ in range(nodes.count().bit_length()):
        if ups[-1].isEmpty():
            break
        further = ups[-1].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("up_score").alias("s"))
        ups.append(c.checkpointed(ups[-1].join(further, _same(ups[-1], further, [("tree", "t"), ("up", "n")])).select("tree", "node", F.col("u").alias("up"), F.col("s").alias("up_score"))))
    parents = ups[0].select(F.col("tree").alias("t"), F.col("up").alias("n"))
    leaves = nodes.join(parents, _same(nodes, parents, [("tree", "t"), ("node", "n")]), "left_anti")
    rings = ups.pop().select(F.col("tree").alias("t"), F.col("node").alias("n"))
    out = leaves.join(rings, _same(leaves, rings, [("tree", "t"), ("node", "n")]), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("back"), "score")
    for k, up in reversed(list(enumerate(ups))):
        up = up.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up", "up_score")
        both = out.join(up, _same(out, up, [("tree", "t"), ("node", "n")]), "left")
        here = F.struct("node", "back", "score")
        there = F.struct(F.col("up").alias("node"), (F.col("back") + 2**k).alias("back"), F.col("up_score").alias("score"))
        out = both.select("tree", "leaf", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("e")).select("tree", "leaf", "e.*")
    return out


def format_turns_of(messages: DataFrame, texts: DataFrame, *, best: int | None = None) -> DataFrame:
    """Formatted turns of the chosen paths: tree, leaf, rank, back, nth, piece, loss_from, loss_to.

    ``messages`` has tree, node, parent and score, ``texts`` tree, node, role and text. The pieces of a conversation,
    greatest ``back`` first and of these least ``nth`` first, are the conversation; they come in this order, and those
    of a tree are in one partition. ``loss_from`` and ``loss_to`` bound a piece's part under the loss mask, or are
    null. Rank 1 is the branch of the best mean score, of equals the least leaf; ``best`` keeps that many of a tree,
    None all. Null roles and texts are empty. A node with several rows says them all, by role and text.
    """
    of_leaf = Window.partitionBy("tree", "leaf")
    chosen = steps(messages.select("tree", "node", "parent", F.col("score").cast("double").alias("score"))).repartition("tree").withColumn("mean", F.avg("score").over(of_leaf))
    chosen = chosen.withColumn("rank", F.dense_rank().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")).cast("bigint"))
    if best is not None:
        chosen = chosen.where(F.col("rank") <= best)
    said = texts.select("tree", "node", F.lit(0).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *[F.lit(None).cast("bigint").alias(x) for x in ("leaf", "rank", "back")])
    mixed = said.unionByName(chosen.select("tree", "node", F.lit(1).alias("kind"), *[F.lit(None).cast("string").alias(x) for x in ("role", "text")], "leaf", "rank", "back"))
    names = ["tree", "leaf", "rank", "back", "nth", "piece", "loss_from", "loss_to"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = None, []  # the node whose texts were last met, and its formatted turns
        for batch in batches:
            rows, chars = [], 0
            for tree, node, kind, role, text, leaf, rank, back in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at != (tree, node):
                    at, made = (tree, node), []
                if kind == 0:
                    made.append(format_turns([(role, text)]))
                    continue
                for nth, (piece, spans) in enumerate(made):
                    rows.append((tree, leaf, rank, back, nth, piece, *(spans or (None, None))))
                    chars += len(piece)
                    if chars > BATCH_CHARS:
                        yield _batch(rows, kinds, names)
                        rows, chars = [], 0
            if rows:
                yield _batch(rows, kinds, names)

    dealt = mixed.repartition("tree").sortWithinPartitions("tree", "node", "kind", "role", "text")
    pieces = dealt.mapInArrow(run, "tree bigint, leaf bigint, rank bigint, back bigint, nth bigint, piece string, loss_from bigint, loss_to bigint")
    # a tree is in one partition already
    return pieces.sortWithinPartitions("tree", "leaf", F.desc("back"), "nth")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """The rows of ``format_turns_of``, each with whether it begins a conversation."""
    before = None
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            yield row[:2] != before, row
            before = row[:2]


def format_trees(messages: DataFrame, *, best: int | None = None) -> DataFrame:
    """One conversation for each chosen path of ``messages`` (tree, node, parent, role, text, score).

    Result: tree, leaf, rank, formatted, loss_spans (starts and ends in turn); see ``format_turns_of``. Columns beside
    those named are not read. An empty table gives no rows.
    """
    names, kinds = ["tree", "leaf", "rank", "formatted", "loss_spans"], [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, spans, size, key = [], [], 0, None
        for begins, (tree, leaf, rank, _, _, piece, start, end) in _by_conversation(batches):
            if begins:
                if key:
                    yield _batch([(*key, "".join(parts), spans)], kinds, names)
                parts, spans, size, key = [], [], 0, (tree, leaf, rank)
            if start is not None:
                spans += [size + start, size + end]
            parts.append(piece)
            size += len(piece)
        if key:
            yield _batch([(*key, "".join(parts), spans)], kinds, names)

    return format_turns_of(messages, messages, best=best).mapInArrow(run, "tree bigint, leaf bigint, rank bigint, formatted string, loss_spans array<bigint>")


def chains(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Linear conversations (conv_id, turn, role, text) as trees: each turn replies to the one before it.

    Rows of one turn are one node. A null turn comes first.
    """
    named = turns.select(F.col("conv_id").alias("tree"), F.coalesce("turn", F.lit(-(2**63))).alias("node"), "role", "text")
    # ids alone; the distinct turns of a conversation are as many as its rows at most
    ids = named.select("tree", "node").distinct().withColumn("parent", F.lag("node").over(Window.partitionBy("tree").orderBy("node")))
    return ids.withColumn("score", F.lit(0.0)), named.select("tree", "node", "role", "text")


def digests(pieces: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the formatted turns and their loss spans, as a stream."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, began = [], False
        tree, n, chars, size, said, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for begins, (key, _, _, _, _, piece, start, end) in _by_conversation(batches):
            if begins:
                if began:
                    rows.append((tree, n, said.hexdigest(), chars, loss.hexdigest(), size))
                    if len(rows) == 10_000:
                        yield _batch(rows, kinds, names)
                        rows = []
                began, tree, n, chars, size, said, loss = True, key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text in read_turns(piece):
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            if start is not None:
                text = unescape(piece[start:end])
                loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(text)
            size += len(piece)
        if began:
            rows.append((tree, n, said.hexdigest(), chars, loss.hexdigest(), size))
        if rows:
            yield _batch(rows, kinds, names)

    return pieces.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every conversation, and one of control strings."""
    turns = c.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hostile).alias("text"))
    return digests(format_turns_of(*chains(turns.unionByName(extra))))
