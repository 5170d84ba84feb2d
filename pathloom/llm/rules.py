"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Small trees are grown on random halves of a bounded labelled sample of text statistics. Every path from a root to a
node is a rule, a conjunction of comparisons; lasso logistic regression gives most rules no weight. The rules that
keep one become column expressions over the statistics, which are expressions themselves, so whole texts are scored
without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Bound of the training sample, rows of each label.
SAMPLE_ROWS = 1_500
TREES, DEPTH, LEAF_ROWS, PENALTY = 40, 3, 10, 0.002
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, all finite numbers; a null text counts as an empty one."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / n
    words = F.split(F.lower(t), "[ \\n\\t\\r]+")
    lines = F.split(t, "\n")
    return {
        "log_chars": F.log(n),
        "word_chars": n / F.size(words),
        "letters": 1 - left("\\p{L}+"),
        "capitals": left("[^\\p{Lu}]+"),
        "digits": left("[^0-9]+"),
        "symbols": left("[\\p{L}\\p{N}\\s.,;:'\"()-]+"),
        "stops": left("[^.!?]+"),
        "new_words": F.size(F.array_distinct(words)) / F.size(words),
        "line_chars": n / F.size(lines),
        "new_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater, bound) each


@dataclass
class Model:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float


def _split(x: np.ndarray, y: np.ndarray, w: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """The statistic and bound that lower the squared error most."""
    best = None
    base = w.sum() and (w @ y) ** 2 / w.sum()
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, cw, cy = x[order, j], np.cumsum(w[order]), np.cumsum((w * y)[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at >= least - 1) & (at < len(v) - least)]
        if len(at):
            gain = cy[at] ** 2 / cw[at] + (cy[-1] - cy[at]) ** 2 / np.maximum(cw[-1] - cw[at], 1e-12) - base
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), j, float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


def _grow(x, y, w, depth: int, least: int, path: Rule, out: list[Rule]) -> None:
    found = _split(x, y, w, least) if depth and len(y) >= 2 * least else None
    if found:
        _, j, bound = found
        for greater in (False, True):
            side = (x[:, j] > bound) == greater
            rule = (*path, (j, greater, bound))
            out.append(rule)
            _grow(x[side], y[side], w[side], depth - 1, least, rule, out)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, greater, bound in rule:
        out &= (x[:, j] > bound) == greater
    return out


def fit(names: list[str], x: np.ndarray, y: np.ndarray, share: float | None = None, *, trees: int = TREES, depth: int = DEPTH, least: int = LEAF_ROWS, penalty: float = PENALTY, seed: int = 0) -> Model:
    """The model of statistics ``x`` and labels ``y`` (0 or 1); ``share`` is that of label 1 among all labelled rows."""
    share = float(y.mean()) if share is None and len(y) else share
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Model(names, [], [], math.log(p / (1 - p)))
    rng = np.random.default_rng(seed)
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    least = max(2, min(least, len(y) // 20))
    found: list[Rule] = []
    margin = np.full(len(y), math.log(share / (1 - share)))
    for _ in range(trees):
        some = rng.choice(len(y), max(2, len(y) // 2), replace=False)
        residual = y - 1 / (1 + np.exp(-margin))
        grown: list[Rule] = []
        _grow(x[some], residual[some], weight[some], depth, least, (), grown)
        if not grown:
            continue
        found += grown
        inner = {r[:-1] for r in grown}
        for rule in grown:
            if rule not in inner:  # a leaf
                held = _holds(x, rule)
                part = held[some]
                if part.any():
                    p = 1 / (1 + np.exp(-margin[some][part]))
                    step = (weight[some][part] @ residual[some][part]) / max(1e-6, weight[some][part] @ (p * (1 - p)))
                    margin[held] += 0.1 * float(np.clip(step, -4, 4))
    columns: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for rule in found:
        held = _holds(x, rule)
        if 0 < held.sum() < len(held):
            key = held.tobytes()
            if key not in columns or len(rule) < len(columns[key][0]):
                columns[key] = (rule, held)
    rules = [r for r, _ in columns.values()]
    a = np.stack([h for _, h in columns.values()], 1).astype(float) if rules else np.zeros((len(y), 0))
    beta, intercept = _lasso(a, y, weight / weight.sum(), penalty)
    kept = np.flatnonzero(beta)
    return Model(names, [rules[k] for k in kept], [float(beta[k]) for k in kept], intercept)


def _lasso(a: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression under an L1 penalty, by accelerated proximal steps."""
    full = np.c_[np.ones(len(y)), a]
    step = 4 / max(1e-9, np.linalg.eigvalsh((full * w[:, None]).T @ full)[-1])
    now = np.zeros(full.shape[1])
    ahead, t = now.copy(), 1.0
    for _ in range(rounds):
        grad = full.T @ (w * (1 / (1 + np.exp(-np.clip(full @ ahead, -40, 40))) - y))
        new = ahead - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - now)
        now, t = new, t_new
    return now[1:], float(now[0])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_a_label: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample of labelled rows, of each label those with the least hash of their id.

    Ids with several labels take the least; a null label is none; of several texts of an id the least counts. Without labels, or with one kind alone, the score
    is a constant.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    stats = statistics(F.col("t"))
    some = c.labelled(docs, labels, F.min, id_col=id_col, text_col=text_col, label_col=label_col, rows_a_label=rows_a_label)
    rows = sorted(some.select("y", "i", *[v.cast("double").alias(k) for k, v in stats.items()]).collect(), key=lambda r: (r["i"], tuple(r)))
    x = np.array([list(r)[2:] for r in rows]).reshape(-1, len(stats))
    total = sum(counts.values())
    return fit(list(stats), x, np.array([r["y"] for r in rows], float), counts.get(1, 0) / total if total else None)


def compiled(model: Model, stats: dict[str, Column]) -> Column:
    """The probability of label 1 as a column over columns of the model's statistics."""
    margin = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        holds = F.lit(True)
        for j, greater, bound in rule:
            value = stats[model.names[j]]
            holds = holds & ((value > bound) if greater else (value <= bound))
        margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-margin))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the probability of label 1 and 1 where it reaches ``threshold``, else 0.

    Null texts are scored as empty ones. Every row is kept; columns named as the new ones are replaced.
    """
    taken = {x.lower() for x in out}
    docs = docs.select(*[x for x in docs.columns if x.lower() not in taken])
    used = sorted({model.names[j] for rule in model.rules for j, _, _ in rule})
    names = dict(zip(used, c.fresh(docs, *[f"stat_{k}" for k in used]), strict=True))
    stats = statistics(F.col(text_col))
    rows = docs.select("*", *[stats[k].cast("double").alias(v) for k, v in names.items()])
    rows = rows.select(*docs.columns, compiled(model, {k: F.col(v) for k, v in names.items()}).alias(out[0]))
    return rows.select("*", F.when(F.col(out[0]) >= threshold, 1).otherwise(0).cast("int").alias(out[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the quality of every document, learnt from three folds of four."""
    docs, labels = c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels")
    model = train(docs, labels.where(c.crc_rest("doc_id", 4) != 2))
    return score(docs.select("doc_id", (c.crc_rest("doc_id", 4) == 2).alias("held_out"), "text"), model).drop("text")
