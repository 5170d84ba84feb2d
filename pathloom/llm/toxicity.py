"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Texts are cut in units: words without their marks, with digits as wild letters, and runs of single letters joined to one.
The kernel of two units counts the letter triples that both have as subsequences, with the gaps of each triple weighed
down by ``DECAY`` a letter, over both units' norms, so that an insult with letters inserted stays close to the insult.
The feature map of a unit is its kernel with some landmark units, whitened (Nyström); a linear support vector machine
on it separates insulting units. It also learns from virtual examples of insults: with any letters inserted, one
doubled, or one replaced by a wild letter.

Labels are of documents, so training is by multiple instances: a toxic document shares its weight among its units that
have letter runs typical of toxic documents. Clean documents bring their units that have such runs, units at random and,
in the second round, those that the machine of the first takes for insults. A text's odds depend on the positive margins
of its ``TOP`` worst units: one clear insult is enough, and several doubtful ones are, but length alone adds nothing.

A weighted sum of kernels with landmarks is linear in a unit's triples. So the trained machine is folded into one
table of a weight for each triple, and a unit is scored by looking up its triples: the same values as through the
landmarks, at the cost of its length. Units are single words: an insult of several harmless words is not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from sys import intern
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

#: Bound of the training sample: documents of each label, and distinct units of each of them, from its whole text.
SAMPLE_ROWS, SAMPLE_UNITS = 1_200, 4_000
LANDMARKS, DECAY, SPAN, ROUNDS = 300, 0.8, 6, 2
#: Bounds of the units that a machine is fitted on: those taken for insults, virtual examples of a quarter of these, units of
#: clean documents at random, and those that the round before took for insults; letters that have classes of their own.
POSITIVE, VIRTUAL, EVERYDAY, HARD, LETTERS = 1_200, 8, 2_500, 1_500, 60
#: How many times as often a letter run typical of toxic documents is in them as in clean ones.
TYPICAL = 4.0
#: Units of a text whose margins count.
TOP = 5
THRESHOLD = 0.3
#: What share of the clean documents flagged weighs as much as the same share of the toxic ones missed, times this;
#: and by how much a lower cut may be worse than the best.
CLEAN, NEARLY = 3.0, 0.03
#: Longest unit: longer ones are scored in overlapping pieces of this length.
UNIT = 24
#: Units whose scores a worker remembers.
MEMORY = 300_000
#: Bytes of the texts that a worker cuts in units at once; a longer text goes alone.
SLICE = 2_000_000
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
MARKS = re.compile(r"[\W_]+")
LONG = re.compile(r"(.)\1{2,}")
DIGIT = re.compile(r"\d")
#: The edge of a unit, and a letter that may stand for any.
EDGE, WILD = "^", "?"


def units(text: str | None) -> set[str]:
    """The units of a text."""
    if not text:
        return set()
    out: set[str] = set()
    run: list[str] = []
    for word in text.lower().split():
        # a word of one letter, with or without marks, may be a piece of a spaced-out one
        if len(word) <= 2 and (len(word) == 1 or not word.isalpha()):
            run.append(word)
            continue
        if run:
            if len(run) > 2:
                out.add("".join(run))
            run = []
        out.add(word)
    if len(run) > 2:
        out.add("".join(run))
    return out


def bare(unit: str) -> str:
    """The unit's letters, and its digits as ``WILD``; of a letter said three times or more in a row, two."""
    return LONG.sub(r"\1\1", unit if unit.isalpha() else DIGIT.sub(WILD, MARKS.sub("", unit)))


@dataclass
class Machine:
    """``table``: the weight of each triple of letter classes; ``odds``: the weights of a document's measures (``measures``)."""

    letters: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    shift: int = 0
    bias: float = 0.0
    odds: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -4.0]))


def norm(size: int) -> float:
    """The kernel's norm of a unit of so many letters, with edges, whose triples are all different."""
    return math.sqrt(sum(max(0, size + 2 - a - b) * DECAY ** (2 * (a + b - 2)) for a, b in GAPS))


NORMS = np.array([1.0, *(norm(n) for n in range(1, UNIT + 1))])


def _rows(words: list[str], letters: dict[str, int]) -> np.ndarray:
    """Letter classes of some words as one matrix; 0 fills up, 1 is the edge, 2 any letter without a class."""
    width = max(map(len, words)) + 2 + SPAN
    out = np.zeros((len(words), width), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w) + 2] = [1, *[letters.get(ch, 2) for ch in w], 1]
    return out


def _triples(rows: np.ndarray, shift: int) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of gaps: the triple that starts at each place (0: none), and its weight."""
    width = rows.shape[1] - SPAN
    first = rows[:, :width] << (2 * shift)
    for a, b in GAPS:
        second, third = rows[:, a : a + width], rows[:, a + b : a + b + width]
        yield np.where(third > 0, first | second << shift | third, 0), DECAY ** (a + b - 2)


def triple_weights(word: str) -> dict[str, float]:
    """The kernel's feature vector of a unit: the weight of each triple of its letters, edges included."""
    s, got = EDGE + word + EDGE, {}
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, min(len(s), i + SPAN)):
                key = s[i] + s[j] + s[k]
                got[key] = got.get(key, 0.0) + DECAY ** (k - i - 2)
    return got


def kernel_columns(words: list[str], marks: list[str], letters: dict[str, int], shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised kernels of words with landmarks (a row a word), the landmarks' unit vectors, and the triples of these columns."""
    def triples(some: list[str]) -> list[tuple[np.ndarray, float]]:
        return list(_triples(_rows(some, letters), shift))

    held = triples(marks)
    columns = np.unique(np.concatenate([t.ravel() for t, _ in held]))
    place = np.zeros(1 << (3 * shift), np.int32)
    place[columns] = np.arange(len(columns))  # column 0 is no triple

    def vectors(parts: list[tuple[np.ndarray, float]], n: int) -> np.ndarray:
        out = np.zeros(n * len(columns))
        for t, weight in parts:
            out += np.bincount((np.arange(n)[:, None] * len(columns) + place[t]).ravel(), minlength=len(out)) * weight
        out = out.reshape(n, -1)
        out[:, 0] = 0
        return out

    phi = vectors(held, len(marks))
    phi /= NORMS[[len(w) for w in marks]][:, None]
    rows = [vectors(triples(words[i : i + 100]), len(words[i : i + 100])) @ phi.T for i in range(0, len(words), 100)]
    return np.concatenate(rows) / NORMS[[len(w) for w in words]][:, None], phi, columns


def kernel(a: str, b: str) -> float:
    """The normalised kernel of two units, by its definition."""
    x, y = triple_weights(a), triple_weights(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / (norm(len(a)) * norm(len(b)))


def pieces(word: str) -> list[str]:
    """A word, or its overlapping pieces if it is longer than ``UNIT``."""
    return [word] if len(word) <= UNIT else [word[i : i + UNIT] for i in range(0, len(word) - UNIT // 2, UNIT // 2)]


def margins(machine: Machine, words: list[str]) -> np.ndarray:
    """The machine's margin of each word."""
    cut = [pieces(w) for w in words]
    flat = [p for ps in cut for p in ps]
    values = np.zeros(len(flat), np.float32)
    order = sorted(range(len(flat)), key=lambda i: len(flat[i]))
    for at in range(0, len(order), 4096):
        some = order[at : at + 4096]
        rows = _rows([flat[i] for i in some], machine.letters)
        total = np.zeros(len(some), np.float32)
        for triple, weight in _triples(rows, machine.shift):
            total += weight * np.take(machine.table, triple, mode="clip").sum(1)
        values[some] = total / NORMS[[len(flat[i]) for i in some]]
    firsts = np.cumsum([0, *map(len, cut)])[:-1]
    return np.maximum.reduceat(values, firsts) + machine.bias if len(flat) else values


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    full = np.c_[x, np.ones(len(y))]
    w = np.zeros(full.shape[1])
    reg = np.full(full.shape[1], ridge)
    reg[-1] = 1e-8
    for _ in range(rounds):
        inside = y * (full @ w) < 1
        a = full[inside] * weight[inside][:, None]
        new = np.linalg.solve(a.T @ full[inside] + np.diag(reg), a.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = w + (new - w)
    return w[:-1], float(w[-1])


def _runs_of(word: str) -> set[str]:
    """The letter runs (3 to 6 letters, edges count) of a unit."""
    s = EDGE + word[:UNIT] + EDGE
    return {s[i : i + n] for n in (3, 4, 5, 6) for i in range(len(s) - n + 1)}


def _speaking(bags: list[tuple[set[str], int]]) -> set[str]:
    """Units of toxic documents that have a letter run typical of toxic documents.

    A run is typical if it is in ``TYPICAL`` times as many of the toxic documents as of the clean, and more than chance
    explains: by its likelihood ratio, beyond what the best of so many runs would show.
    """
    numbers: dict[str, int] = {}
    held = {w: np.array([numbers.setdefault(r, len(numbers)) for r in _runs_of(w)], np.int32) for w in {w for words, _ in bags for w in words}}
    having = np.zeros((2, len(numbers)))
    for words, label in bags:
        having[label, np.unique(np.concatenate([held[w] for w in words]))] += 1
    clean, toxic = having
    share = sum(label for _, label in bags) / len(bags)
    some = toxic >= 3  # what is rarer can't pass the limit
    n, k = (toxic + clean)[some], toxic[some]
    ratio = 2 * (k * np.log(k / (n * share)) + np.where(n > k, (n - k) * np.log(np.maximum(n - k, 1) / (n * (1 - share))), 0.0))
    typical = np.zeros(len(numbers), bool)
    typical[some] = (ratio > 2 * math.log(max(2, np.count_nonzero(toxic))) + 4) & (k * (1 - share) >= TYPICAL * share * clean[some])
    return {w for words, label in bags if label for w in words if typical[held[w]].any()}


def fit(texts: list[str], labels: list[int], *, landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 0) -> Machine:
    """The machine of labelled texts."""
    return fit_bags([(bag(t), label) for t, label in zip(texts, labels, strict=True)], landmarks=landmarks, rounds=rounds, seed=seed)


def bag(text: str | None, most: int | None = None) -> set[str]:
    """The bare units of a whole text that have letters to compare; of more than ``most`` those with the least hash."""
    out = {b for u in units(text) if spoken(b := bare(u))}
    if most is None or len(out) <= most:
        return out
    return set(sorted(out, key=lambda w: (crc32(w.encode("utf-8", "surrogatepass")), w))[:most])


def spoken(word: str) -> bool:
    """Whether a bare unit has more than one letter."""
    return len(word) - word.count(WILD) > 1


def fit_bags(bags: list[tuple[set[str], int]], *, landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 0) -> Machine:
    """The machine of labelled texts, each as the set of its bare units."""
    bags = [(words, label) for words, label in bags if words]
    if len({label for _, label in bags}) < 2:
        return Machine()
    machine = _machine(bags, landmarks, rounds, seed)
    measured = np.array([measures(np.array(m)) for m in _unit_margins(machine, [words for words, _ in bags])])
    machine.odds = _calibrate(measured, np.array([label for _, label in bags]))
    return machine


def _unit_margins(machine: Machine, bags: list[set[str]]) -> list[list[float]]:
    """For each bag the margins of its units."""
    words = sorted(set().union(*bags)) if bags else []
    of = dict(zip(words, margins(machine, words).tolist(), strict=True))
    return [[of[w] for w in bag] for bag in bags]


def measures(margin: np.ndarray) -> np.ndarray:
    """What a document's odds depend on: its largest margin, and the evidence of its ``TOP`` largest together, if positive.

    Neither grows with a text's length unless it holds further units that the machine takes for insults.
    """
    top = np.sort(margin)[::-1][:TOP]
    return np.array([min(0.0, float(top[0])), float(np.clip(top, 0, 2).sum())])


def _machine(bags: list[tuple[set[str], int]], landmarks: int, rounds: int, seed: int) -> Machine:
    """The machine of some documents, without the weights of their measures."""
    counts = Counter(ch for words, _ in bags for w in words for ch in w)
    counts.pop(WILD, None)
    letters = {ch: k + 3 for k, (ch, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])}
    shift = (len(letters) + 2).bit_length()
    machine = Machine(letters, shift=shift)
    rng = np.random.default_rng(seed)
    speaking = _speaking(bags)
    in_clean = Counter(w for words, label in bags if not label for w in words)
    if not speaking:  # too few documents to tell: what is in toxic documents alone
        speaking = {w for words, label in bags if label for w in words} - in_clean.keys()
    if not speaking:
        return machine
    # a toxic document shares its weight among the units that speak for it
    often: Counter = Counter()
    for words, label in bags:
        if label and (some := words & speaking):
            often.update(dict.fromkeys(some, 1 / len(some)))
    positive = [w for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:POSITIVE]]
    # units like those that speak for toxicity count against it as often as clean documents have them
    shared = [w for w, _ in in_clean.most_common() if w in speaking][:HARD]
    negatives = sorted(in_clean.keys() - speaking)
    everyday = [negatives[i] for i in rng.permutation(len(negatives))[:EVERYDAY]]
    hard: list[str] = []
    virtual = [v for w in positive[: POSITIVE // 4] for v in _loosened(w[: UNIT - 1], rng, letters)]
    share = np.array([often[w] for w in positive])
    share = np.r_[share, np.repeat(share[: POSITIVE // 4], VIRTUAL) * (3 / VIRTUAL)]
    for k in range(rounds):
        negative = sorted({*everyday, *hard})
        marks = sorted({*_spread(positive, landmarks // 2), *_spread(virtual, landmarks // 4), *_spread([*hard[:200], *everyday], landmarks // 4)})
        words = [w[:UNIT] for w in [*positive, *virtual, *shared, *negative]]
        kernels, phi, columns = kernel_columns([*marks, *words], marks, letters, shift)
        value, vector = np.linalg.eigh(kernels[: len(marks)])
        some = value > 1e-4 * value[-1]
        whiten = vector[:, some] / np.sqrt(value[some])
        x = kernels[len(marks) :] @ whiten
        y = np.r_[np.ones(len(positive) + len(virtual)), -np.ones(len(shared) + len(negative))]
        against = np.array([in_clean[w] for w in shared])
        weight = np.r_[0.5 * np.r_[share, against] / (share.sum() + against.sum()), np.full(len(negative), 0.5 / len(negative))]
        w, bias = _svm(x, y, weight)
        table = np.zeros(1 << (3 * shift), np.float32)
        table[columns] = phi.T @ (whiten @ w)
        table[0] = 0
        machine = Machine(letters, table, shift, bias)
        if k + 1 < rounds:
            worst = margins(machine, negatives)
            hard = sorted({*hard, *(negatives[i] for i in np.argsort(-worst, kind="stable")[:HARD].tolist())})
    return machine


def _loosened(word: str, rng: np.random.Generator, letters: dict[str, int]) -> list[str]:
    """``VIRTUAL`` virtual examples of an insult: a letter doubled, two with a wild letter for one, any letters inserted."""
    some = list(letters) or [WILD]
    at = rng.integers(1, max(2, len(word)), VIRTUAL).tolist()
    wild = [word[:k] + WILD + word[k + 1 :] for k in at[1:3]]
    inserted = [word[:k] + some[int(rng.integers(len(some)))] + word[k:] for k in at[3:]]
    return [word[: at[0]] + word[at[0] - 1] + word[at[0] :], *wild, *inserted]


def _spread(words: list[str], n: int) -> list[str]:
    """Up to ``n`` of the words, in order, without those nearly the same as one before."""
    out: list[str] = []
    held: list[dict[str, float]] = []
    for w in dict.fromkeys(w[:UNIT] for w in words):
        if len(out) == n:
            break
        v = triple_weights(w)
        norm = math.sqrt(sum(x * x for x in v.values()))
        v = {k: x / norm for k, x in v.items()}
        if all(sum(x * h.get(k, 0.0) for k, x in v.items()) < 0.8 for h in held):
            out.append(w)
            held.append(v)
    return out


def _calibrate(x: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Weights of the log odds, the constant last, by Newton's method with a little smoothing."""
    target = np.where(truth > 0, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-2 * w)
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    # the least cut that parts toxic from clean documents nearly as well as the best gets the odds of the threshold: a
    # text with a single insult is rarer than one with several, and lies lower
    odds = x @ w
    cuts = np.unique(odds)
    over = lambda some: 1 - np.searchsorted(np.sort(some), cuts) / max(1, len(some))
    parted = over(odds[truth > 0]) - CLEAN * over(odds[truth <= 0])
    best = int(np.argmax(parted >= parted.max() - NEARLY))
    cut = (cuts[best] + cuts[best - 1]) / 2 if best else cuts[0]
    w[-1] += math.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return w


def scores(machine: Machine, texts: list[str | None], memory: dict[str, float]) -> np.ndarray:
    """The probability that each text is toxic; 0 without units. ``memory`` keeps margins of units from call to call."""
    bags = [units(t) for t in texts]
    new = [u for u in set().union(*bags) if u not in memory] if bags else []
    if new:
        if len(memory) + len(new) > MEMORY:
            memory.clear()
            new = list(set().union(*bags))
        words = [bare(u) for u in new]
        known = [i for i, w in enumerate(words) if spoken(w)]
        values = np.full(len(new), -np.inf)
        if known:
            values[known] = margins(machine, [words[i] for i in known])
        memory.update(zip(new, values.tolist(), strict=True))
    out = np.zeros(len(texts))
    for i, bag in enumerate(bags):
        some = np.fromiter(map(memory.__getitem__, bag), float, len(bag))
        some = some[np.isfinite(some)]
        if len(some):
            odds = float(np.clip(measures(some) @ machine.odds[:-1] + machine.odds[-1], -700, 700))
            out[i] = 1 / (1 + math.exp(-odds))
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_a_label: int = SAMPLE_ROWS, units_a_row: int = SAMPLE_UNITS) -> Machine:
    """The machine of a bounded sample of labelled rows, of each label those with the least hash of their id.

    Texts of any length count, each by at most ``units_a_row`` distinct units of the whole of it, cut out by the workers.
    Ids with several labels take the greatest; a null label is none; of several texts of an id the least counts. Without
    toxic or without clean rows every score is near 0.
    """
    some = c.labelled(docs, labels, F.max, id_col=id_col, text_col=text_col, label_col=label_col, rows_a_label=rows_a_label).where("t is not null").select("i", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [" ".join(sorted(bag(t, units_a_row))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(bags, pa.string())], ["i", "y", "bag"])

    rows = sorted(some.mapInArrow(run, c.added(some, "y", "t", y="bigint", bag="string")).collect(), key=lambda r: (r["i"], r["bag"]))
    # texts share most of their units, so each is held once
    return fit_bags([({intern(w) for w in r["bag"].split()}, int(r["y"])) for r in rows])


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts, in column ``at``, have ``SLICE`` bytes at most, or are one text."""
    first = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        if i > first and held + size > SLICE:
            yield batch.slice(first, i - first)
            first = i
            held = 0
        held += size
    yield batch.slice(first)


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", threshold: float = THRESHOLD, out: tuple[str, str] = ("score", "predicted"), keep_text: bool = True) -> DataFrame:
    """``docs`` with the probability that a text is toxic, and 1 where it reaches ``threshold``, else 0.

    Texts without units (null, empty, or of marks alone) score 0. Every row is kept; columns named as the new ones
    are replaced.
    """
    taken = {x.lower() for x in out}
    docs = docs.select(*[x for x in docs.columns if x.lower() not in taken])
    gone = [] if keep_text else [text_col]
    schema = c.added(docs, *gone, **dict(zip(out, ("double", "int"), strict=True)))
    at, places, names = docs.columns.index(text_col), [i for i, x in enumerate(docs.columns) if x not in gone], schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for whole in batches:
            for batch in _slices(whole, at):
                p = scores(machine, batch.column(at).to_pylist(), memory)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the toxicity of every document, learnt from three folds of four."""
    docs, labels = c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels")
    machine = train(docs, labels.where(c.crc_rest("doc_id", 4) != 2))
    return score(docs.select("doc_id", (c.crc_rest("doc_id", 4) == 2).alias("held_out"), "text"), machine, keep_text=False)
