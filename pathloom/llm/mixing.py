"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

The tree is domain, language, source. A token budget comes down from the root: at each level children share it by
their weights, none takes more than its subtree can supply (its tokens times the epochs allowed), and what a child
cannot take goes to its siblings, so only what a whole family cannot take is left to the family's own siblings.
A leaf with budget b and s tokens an epoch takes every document b div s times, and of the next epoch, in the order
of a seeded hash, the longest prefix with at most b mod s tokens.

The prefix of a leaf is found without sorting the leaf: its documents are dealt by hash into about as many buckets
as a bucket has rows, the buckets' sums tell the bucket in which the prefix ends, and only that one is sorted.
Texts are never shuffled; what is joined to the documents is one row a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

DOMAIN, LANG, SOURCE = "m_domain", "m_lang", "m_source"
LEAF = [DOMAIN, LANG, SOURCE]
#: Most leaves whose budgets are broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 50_000

#: The mixture of the registered query and of the pipeline; a child that isn't named weighs 1.
WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1, "*/en": 4, "*/de": 2, "*/fr": 2}
EPOCHS, SEED = 2, 7


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo 4, or ``other``."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(digits == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (F.when(digits == "", F.lit("0")).otherwise(digits).cast("bigint") % 4).cast("string")))


def tokens_of(text: Column) -> Column:
    """Words of a text: runs of characters other than blank, tab and line ends; 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("bigint")


def _weight(weights: dict[str, int], path: list[str]) -> Column:
    """The weight of the node at ``path``: by its full path, or with ``*`` for what stands above it, or 1."""
    if any(not 0 <= w <= 10_000 for w in weights.values()):
        raise ValueError("weights are whole numbers from 0 to 10000")
    if not weights:
        return F.lit(1).cast("bigint")
    known = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, int(w))])
    full = F.concat_ws("/", *path)
    starred = F.concat_ws("/", *[F.lit("*")] * (1 if len(path) > 1 else 0), path[-1])
    return F.coalesce(F.try_element_at(known, full), F.try_element_at(known, starred), F.lit(1)).cast("bigint")


def fill(nodes: DataFrame, parent: list[str], order: str, weight: str, capacity: str, budget: str, out: str) -> DataFrame:
    """``nodes`` with ``out``: the share of the parent's ``budget``, at most ``capacity``, by ``weight`` (whole numbers).

    Children are taken by capacity over weight; each that cannot take its share of what is left is filled, and the
    rest share the remainder. At most a token a child is lost to rounding.
    """
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = family.orderBy(F.col("_ratio"), F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    w, cap, b = F.col("_w"), F.col(capacity), F.col(budget)
    zero = F.lit(0).cast("bigint")
    rows = nodes.withColumn("_w", F.when(cap > 0, F.col(weight)).otherwise(zero)).withColumn("_ratio", F.when(w > 0, cap / w).otherwise(F.lit(0.0)))
    rows = rows.withColumn("_wb", F.coalesce(F.sum(w).over(before), zero)).withColumn("_cb", F.coalesce(F.sum(F.when(w > 0, cap).otherwise(zero)).over(before), zero)).withColumn("_wt", F.sum(w).over(family))
    rows = rows.withColumn("_full", (w > 0) & (cap * (F.col("_wt") - F.col("_wb")) <= w * (b - F.col("_cb"))))
    rows = rows.withColumn("_cf", F.sum(F.when(F.col("_full"), cap).otherwise(zero)).over(family)).withColumn("_wf", F.sum(F.when(F.col("_full"), w).otherwise(zero)).over(family))
    share = F.expr("(_w * (%s - _cf)) div nullif(_wt - _wf, 0)" % budget)
    return rows.withColumn(out, F.when(F.col("_full"), cap).when(w > 0, F.coalesce(share, zero)).otherwise(zero)).drop("_w", "_ratio", "_wb", "_cb", "_wt", "_full", "_cf", "_wf")


def budgets(leaves: DataFrame, weights: dict[str, int], epochs: int, total: int | None = None) -> DataFrame:
    """``leaves`` (the three names, supply, rows) with the budget of each; ``total`` tokens, or as many as there are."""
    root = Window.partitionBy(F.lit(0))
    rows = leaves.withColumn("capacity", F.col("supply") * epochs).withColumn("b0", F.lit(total).cast("bigint") if total is not None else F.sum("supply").over(root))
    for depth, name in enumerate(LEAF):
        family = LEAF[:depth]
        nodes = rows.groupBy(*LEAF[: depth + 1]).agg(F.sum("capacity").alias("cap"), F.max(f"b{depth}").alias(f"b{depth}"))
        nodes = fill(nodes.withColumn("weight", _weight(weights, LEAF[: depth + 1])), family, name, "weight", "cap", f"b{depth}", f"b{depth + 1}")
        rows = rows.join(nodes.select(*LEAF[: depth + 1], f"b{depth + 1}"), LEAF[: depth + 1])
    return rows.select(*LEAF, "supply", "rows", F.col("b3").alias("budget"))


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, *, weights: dict[str, int] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, total: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", epoch_col: str = "epoch") -> DataFrame:
    """The rows of ``docs`` that the mixture takes, each once for every epoch that it is in, with the epoch (from 0).

    Null languages and sources are leaves of their own, named ''. Rows of one id in one leaf are taken together.
    Null and empty texts have no tokens: they are taken in every full epoch, and in the last one where their place
    is within the prefix. An empty table gives no rows. A column named as ``epoch_col`` is replaced.
    """
    docs = docs.select(*[x for x in docs.columns if x.lower() != epoch_col.lower()])
    domain, lang, source, tokens, full, rest, n_buckets, h, bucket = c.fresh(docs, DOMAIN, LANG, SOURCE, "m_tokens", "m_full", "m_rest", "m_buckets", "m_hash", "m_bucket")
    placed = docs.withColumns({domain: domain_of(F.col(source_col)), lang: F.coalesce(F.col(lang_col), F.lit("")), source: F.coalesce(F.col(source_col), F.lit(""))})
    names = dict(zip(LEAF, (domain, lang, source), strict=True))
    sized = placed.select(F.col(id_col).alias("i"), *[F.col(v).alias(k) for k, v in names.items()], tokens_of(F.col(text_col)).alias("t"))
    leaves = c.checkpointed(sized.groupBy(*LEAF).agg(F.sum("t").alias("supply"), F.count(F.lit(1)).alias("rows")))
    plan = budgets(leaves, weights, epochs, total)
    plan = plan.select(*LEAF, F.expr("coalesce(budget div nullif(supply, 0), 0)").alias("full"), F.expr("coalesce(budget % nullif(supply, 0), 0)").alias("rest"), F.ceil(F.sqrt("rows")).cast("bigint").alias("buckets"))
    plan = c.checkpointed(plan)
    small = plan.count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda x: x)

    some = sized.join(hint(plan), LEAF).withColumn("h", _order(seed, F.col("full"), F.col("i"))).withColumn("k", _bucket("h", "buckets"))
    ends = c.checkpointed(some.groupBy(*LEAF, "k").agg(F.sum("t").alias("s"), F.max("rest").alias("rest")))
    run = Window.partitionBy(*LEAF).orderBy("k")
    # the first bucket whose sum passes the rest; there is none if the rest takes the whole leaf
    last = ends.withColumn("cum", F.sum("s").over(run)).where(F.col("cum") > F.col("rest")).groupBy(*LEAF).agg(F.min_by(F.struct("k", (F.col("cum") - F.col("s")).alias("before")), "k").alias("e")).select(*LEAF, "e.k", "e.before")
    inside = some.join(hint(last.withColumnRenamed("k", "end")), LEAF).where(F.col("k") == F.col("end")).groupBy(*LEAF, "h", "i").agg(F.sum("t").alias("t"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    inside = inside.withColumn("cum", F.sum("t").over(Window.partitionBy(*LEAF).orderBy("h"))).where(F.col("cum") + F.col("before") <= F.col("rest"))
    cut = inside.groupBy(*LEAF).agg(F.max("h").alias("cut"))
    final = c.checkpointed(plan.join(last, LEAF, "left").join(cut, LEAF, "left").select(*LEAF, "full", "buckets", F.col("k").alias("end"), "cut"))
    mine = final.select(*[F.col(k).alias(v) for k, v in names.items()], F.col("full").alias(full), F.col("buckets").alias(n_buckets), F.col("end").alias(rest), F.col("cut").alias(tokens))
    got = placed.join(hint(mine), list(names.values())).withColumn(h, _order(seed, F.col(full), F.col(id_col))).withColumn(bucket, _bucket(h, n_buckets))
    within = F.col(rest).isNull() | (F.col(bucket) < F.col(rest)) | ((F.col(bucket) == F.col(rest)) & F.coalesce(F.col(h) <= F.col(tokens), F.lit(False)))
    copies = F.col(full) + F.when(within, 1).otherwise(0)
    return got.where(copies > 0).select(*docs.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)).alias(epoch_col))


def _bucket(h: str, buckets: str) -> Column:
    return F.expr(f"shiftright(cast(conv(substr({h}, 1, 8), 16, 10) as bigint) * {buckets}, 32)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the documents of the mixture, by epoch."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "epoch")


def _sql_weight(path: str, starred: str) -> str:
    cases = " ".join(f"WHEN {path} = '{k}' THEN {w}" for k, w in WEIGHTS.items())
    stars = " ".join(f"WHEN '*/' || {starred} = '{k}' THEN {w}" for k, w in WEIGHTS.items() if k.startswith("*/"))
    return f"CASE {cases} {stars} ELSE 1 END"


def _sql_level(name: str, source: str, keys: list[str], budget: str) -> str:
    """One level of the budget as SQL: ``keys`` name the node, all but the last its parent."""
    parent, own = ", ".join(keys[:-1]) or "1", keys[-1]
    path = " || '/' || ".join(keys)
    starred = own if len(keys) > 1 else "'-'"
    return f"""{name}a AS (SELECT {", ".join(keys)}, sum(capacity)::BIGINT AS cap, max({budget}) AS b, CASE WHEN sum(capacity) > 0 THEN {_sql_weight(path, starred)} ELSE 0 END AS w FROM {source} GROUP BY {", ".join(keys)}),
{name}b AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY {parent} ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 0 END, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS wb,
  coalesce(sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER (PARTITION BY {parent} ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 0 END, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cb,
  (sum(w) OVER (PARTITION BY {parent}))::BIGINT AS wt FROM {name}a),
{name}c AS (SELECT *, w > 0 AND cap * (wt - wb) <= w * (b - cb) AS filled FROM {name}b),
{name}d AS (SELECT *, (sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY {parent}))::BIGINT AS cf, (sum(CASE WHEN filled THEN w ELSE 0 END) OVER (PARTITION BY {parent}))::BIGINT AS wf FROM {name}c),
{name} AS (SELECT {", ".join(keys)}, CASE WHEN filled THEN cap WHEN w > 0 THEN coalesce((w * (b - cf)) // nullif(wt - wf, 0), 0) ELSE 0 END AS {name}_b FROM {name}d)"""


def sql(documents: str = "documents", columns: str = "doc_id, epoch") -> str:
    """The mixture in DuckDB's SQL, without buckets: each leaf's last epoch is summed in full."""
    return f"""WITH m0 AS (SELECT *, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other' ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 4) END AS m_domain,
  coalesce(lang, '') AS m_lang, coalesce(source, '') AS m_source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS m_tokens FROM {documents}),
m1 AS (SELECT m_domain, m_lang, m_source, sum(m_tokens)::BIGINT AS supply, (sum(m_tokens) * {EPOCHS})::BIGINT AS capacity FROM m0 GROUP BY ALL),
m2 AS (SELECT *, (sum(supply) OVER ())::BIGINT AS b0 FROM m1),
{_sql_level("m3", "m2", ["m_domain"], "b0")},
m4 AS (SELECT * FROM m2 JOIN m3 USING (m_domain)),
{_sql_level("m5", "m4", ["m_domain", "m_lang"], "m3_b")},
m6 AS (SELECT * FROM m4 JOIN m5 USING (m_domain, m_lang)),
{_sql_level("m7", "m6", ["m_domain", "m_lang", "m_source"], "m5_b")},
m8 AS (SELECT m_domain, m_lang, m_source, coalesce(m7_b // nullif(supply, 0), 0) AS m_full, coalesce(m7_b % nullif(supply, 0), 0) AS m_rest FROM m6 JOIN m7 USING (m_domain, m_lang, m_source)),
m9 AS (SELECT *, md5('{SEED}:' || m_full || ':' || coalesce(doc_id::VARCHAR, '')) AS m_hash FROM m0 JOIN m8 USING (m_domain, m_lang, m_source)),
m10 AS (SELECT *, sum(m_tokens) OVER (PARTITION BY m_domain, m_lang, m_source ORDER BY m_hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m_cum FROM m9)
SELECT {columns} FROM (SELECT *, unnest(range(m_full + CASE WHEN m_cum <= m_rest THEN 1 ELSE 0 END))::BIGINT AS epoch FROM m10)"""
