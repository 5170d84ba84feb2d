"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is parsed
greedily against it: each phrase is the longest match that starts where the last one ended (a letter that the
sample lacks is a phrase of its own). A phrase costs log2(sample length) bits, so the bits a letter are the
cross-parsing entropy, and the language with the fewest normalised phrases wins.

Texts are folded to lower-case letters with one space for all else. Their blocks of ``BLOCK`` code points walk the
automata in step, as rows of numpy arrays, so a very long text costs no more a letter than a short one, and memory is
bounded by ``LANE_CHARS``. The count is that of a parse from end to end: a block is parsed again from the state in
which the one before it ends until no such state changes, which parses soon agree on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

#: Bounds of the training sample a language: documents, which are taken whole, and their code points in all.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 60_000
#: A text is foreign beyond so many times the phrases a letter usual for its language, and so many phrases more.
FOREIGN, SLACK = 2.0, 3.0
BLOCK = 256
#: Code points that are parsed at once (a longer text counts whole), and rows that are read at once.
LANE_CHARS, SLICE = 500_000, 512
#: Letters of a language up to which its transitions are one dense table.
DENSE = 128
SPACE, OTHER, PAD = 0, 1, -1
UNDETERMINED = "und"


class SuffixAutomaton:
    """States and transitions of the automaton that accepts every substring of ``codes``."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for code in codes:
            last = self._extend(last, code)

    def _extend(self, last: int, code: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and code not in nxt[p]:
            nxt[p][code] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][code]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and nxt[p].get(code) == q:
                    nxt[p][code] = clone
                    p = link[p]
        return new


class Parser:
    """One language's automaton. ``step`` takes every lane one letter on.

    Up to ``DENSE`` letters the transitions are a table over (state, letter), made from the sparse ones when first used
    in a process; beyond, letters are looked up among the sorted transitions, so every letter keeps a class of its own.
    """

    def __init__(self, codes: list[int]):
        automaton = SuffixAutomaton(codes)
        used = sorted(set(codes) | {OTHER})
        self.used = len(used)
        of = {code: k + 2 for k, code in enumerate(used)}  # 0: no letter of this language, 1: past the end of a text
        self.shift = (len(used) + 1).bit_length()
        self.local = np.zeros(used[-1] + 3, np.uint16 if len(used) < 1 << 15 else np.int32)  # of each letter class, moved by one; the last for those beyond
        self.local[0] = 1
        self.local[np.array(used) + 1] = np.arange(2, len(used) + 2)
        pairs = sorted((state << self.shift | of[code], to) for state, nexts in enumerate(automaton.next) for code, to in nexts.items())
        self.keys, self.to = np.array([k for k, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int32)
        self.start = len(automaton.next)  # a state without transitions: what comes next begins a phrase
        self.bits = float(np.log2(len(codes) + 1))
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """The language's own classes of letter classes."""
        return self.local[np.minimum(codes + 1, len(self.local) - 1)]

    def _roots(self) -> np.ndarray:
        """For each class the state that a phrase beginning with it is in."""
        out = np.full(1 << self.shift, self.start, np.int32)
        first = self.keys < 1 << self.shift
        out[self.keys[first]] = self.to[first]
        return out

    def walk(self, steps: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun by each lane (a column of ``steps``) from its ``state``, and the states at the end."""
        state, found = state.astype(np.int32), np.zeros(steps.shape[1], np.int32)
        if self.used > DENSE:
            roots = self._roots()
            for code in steps:
                key = state.astype(np.int64) << self.shift | code.astype(np.int64)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = self.keys[at] == key
                found += ~on & (code != 1)
                state = np.where(on, self.to[at], roots[code])
            return found, state
        if self._table is None:
            # states are held shifted, with a bit where a phrase begins
            table = np.tile((self._roots() << self.shift) + (1 << 30), self.start + 1).astype(np.int32)
            table[self.keys] = self.to << self.shift
            table[1 :: 1 << self.shift] = self.start << self.shift
            self._table = table
        state <<= self.shift
        step, take = np.empty(len(state), np.int32), self._table.take
        for code in steps:
            np.add(state, code, out=state)
            take(state, out=step, mode="clip")
            found += step >> 30
            np.bitwise_and(step, (1 << 30) - 1, out=state)
        return found, state >> self.shift


@dataclass
class Model:
    langs: list[str]
    letters: dict[int, int]
    parsers: list[Parser]
    usual: np.ndarray | None = None  # by language: the middle phrases a letter of its own texts, none of them learnt

    def __post_init__(self) -> None:
        self._classes: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_classes": None}

    @property
    def bits(self) -> np.ndarray:
        return np.array([p.bits for p in self.parsers])

    @property
    def classes(self) -> np.ndarray:
        """Letter class of every code point."""
        if self._classes is None:
            out = _alphabetic().astype(np.int32)
            out[list(self.letters)] = list(self.letters.values())
            self._classes = out
        return self._classes


@lru_cache(1)
def _alphabetic() -> np.ndarray:
    """``OTHER`` for each letter among the code points, ``SPACE`` for the rest."""
    return np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), OTHER, SPACE).astype(np.uint8)


def fold(text: str) -> str:
    """Lower case, with one space for each run of other characters than letters."""
    return " ".join(c.LETTER_RUN.findall(text.lower()))


def learn(samples: dict[str, str]) -> Model:
    """The model of ``samples``: folded text by language. Each letter of a sample has a class of its own."""
    langs = sorted(k for k, v in samples.items() if v)
    letters = {ord(ch): k + 2 for k, ch in enumerate(sorted({ch for lang in langs for ch in samples[lang]} - {" "}))}
    return Model(langs, letters, [Parser([letters.get(ord(ch), SPACE) for ch in samples[lang]]) for lang in langs])


def _encode(texts: list[str | None], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all texts, one after the other with single spaces for other characters, and each text's length."""
    lows = [(t or "").lower() + "\n" for t in texts]
    codes = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), np.uint32)
    got = classes[codes]
    ends = np.cumsum([len(t) for t in lows])
    blank = got == SPACE
    keep = np.ones(len(got), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[0] = not blank[0]
    keep[ends - 1] = False  # the line feeds between texts
    firsts = np.r_[0, ends[:-1]]
    keep[firsts] &= ~blank[firsts]
    kept, sizes = got[keep], np.add.reduceat(keep.astype(np.int64), firsts)
    last = (np.cumsum(sizes) - 1)[sizes > 0]
    trailing = kept[last] == SPACE
    sizes[np.flatnonzero(sizes > 0)[trailing]] -= 1
    return np.delete(kept, last[trailing]), sizes


def _lanes(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters cut in blocks (a row each, the last of a text filled up), and each block's text."""
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), blocks)
    ahead = np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner]  # blocks of the same text before this one
    lanes = np.full((len(owner), BLOCK), PAD, np.int32)
    lanes[np.arange(BLOCK, dtype=np.int32) < (sizes[owner] - ahead * BLOCK)[:, None]] = flat
    return lanes, owner


def _count(parser: Parser, lanes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Phrases of each of the ``n`` texts."""
    steps = parser.classes(lanes).T
    first = np.r_[True, owner[1:] != owner[:-1]]
    entry = np.full(len(owner), parser.start, np.int32)
    found, ends = np.zeros(len(owner), np.int64), entry.copy()
    todo = np.arange(len(owner))
    while len(todo):
        found[todo], ends[todo] = parser.walk(np.ascontiguousarray(steps[:, todo]), entry[todo])
        before = np.r_[parser.start, ends[:-1]].astype(np.int32)
        todo = np.flatnonzero(~first & (entry != before))
        entry[todo] = before[todo]
    return np.bincount(owner, found, n).astype(np.int64)


def phrases(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of each text by language, the length of its folded form, and whether it has a letter."""
    count, size, letter = np.zeros((len(texts), len(model.langs)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to] or "") <= LANE_CHARS):
            chars += len(texts[to] or "")
            to += 1
        flat, sizes = _encode(texts[at:to], model.classes)
        size[at:to] = sizes
        if len(flat):
            lanes, owner = _lanes(flat, sizes)
            letter[at:to] = np.bincount(owner, (lanes > SPACE).any(1), len(sizes)) > 0
            for k, parser in enumerate(model.parsers):
                count[at:to, k] = _count(parser, lanes, owner, len(sizes))
        at = to
    return count, size, letter


def judge(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability of it, and its bits a letter, for each text."""
    count, size, letter = phrases(texts, model)
    if not model.langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    cost = count * model.bits
    best = cost.argmin(1)
    least = cost.min(1)
    score = 1 / np.exp2(-np.minimum(cost - least[:, None], 1000)).sum(1)
    rate = least / np.maximum(size, 1)
    langs = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(best, letter, strict=True)]
    return langs, np.where(letter, score, 0.0), np.where(letter, rate, 0.0)


def usual_rates(texts: dict[str, list[str]]) -> np.ndarray:
    """By language (in order of name) the middle phrases a letter of its own texts, judged by what is learnt of others.

    Each half of the texts is judged by what is learnt of the other half, so no text is matched with itself; of a
    single text the halves are its first and second. The median does not follow odd texts among the labelled ones.
    """
    parts = {k: ([ts[0][: len(ts[0]) // 2]], [ts[0][len(ts[0]) // 2 :]]) if len(ts) == 1 else (ts[::2], ts[1::2]) for k, ts in texts.items()}
    rates: dict[str, list[float]] = {k: [] for k in sorted(texts)}
    for half in (0, 1):
        model = learn({k: " ".join(p[half]) for k, p in parts.items()})
        for k, lang in enumerate(model.langs):
            count, sizes, letter = phrases(parts[lang][1 - half], model)
            rates[lang] += (count[:, k] / np.maximum(sizes, 1))[letter].tolist()
    every = [r for rs in rates.values() for r in rs]
    return np.array([float(np.median(rs or every or [1.0])) for rs in rates.values()])


def foreign(texts: list[str | None], model: Model) -> np.ndarray:
    """Whether each text takes many more phrases than a text of that length takes in the best of the languages learnt.

    ``FOREIGN`` times as many and ``SLACK`` more, which count in texts of a few words alone. A text without a letter
    is foreign. The measure is of phrases, so it does not depend on the bits of one, which the sample's size sets.
    """
    count, size, letter = phrases(texts, model)
    if not model.langs:
        return np.ones(len(texts), bool)
    best = (count * model.bits).argmin(1)
    return ~letter | (count[np.arange(len(texts)), best] > FOREIGN * model.usual[best] * size + SLACK)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = SAMPLE_DOCS, chars_per_lang: int = SAMPLE_CHARS, with_usual: bool = False) -> Model:
    """The model of a bounded sample of the labelled rows of ``docs``: of each language those with the least hash of id and text.

    At most ``docs_per_lang`` different rows of a language are looked at; of these whole texts are taken, in order, that
    fit in ``chars_per_lang`` together, or the shortest alone. Repeated rows are looked at one by one and learnt from once. Null languages and
    texts and texts without a letter teach nothing. ``with_usual`` adds what ``foreign`` needs.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), F.length(text_col).alias("n"), F.col(text_col).alias("t"))
    order = Window.partitionBy("l").orderBy("h")
    picked: dict[str, list[tuple[int, int]]] = {}
    for row in rows.select("l", "h", "n").withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_per_lang).distinct().orderBy("l", "h").collect():
        picked.setdefault(row["l"], []).append((row["h"], row["n"]))
    wanted = []
    for lang, some in picked.items():
        left, fit = chars_per_lang, []
        for h, n in some:
            if n <= left:
                fit.append((lang, h))
                left -= n + 1
        wanted += fit or [(lang, min(some, key=lambda x: x[1])[0])]
    samples: dict[str, list[str]] = {}
    if wanted:
        # at most docs_per_lang rows a language, and of these at most chars_per_lang code points or one text
        few = F.broadcast(docs.sparkSession.createDataFrame(wanted, "l string, h bigint"))
        for row in rows.join(few, ["l", "h"]).groupBy("l", "h").agg(F.first("t").alias("t")).orderBy("l", "h").collect():
            samples.setdefault(row["l"], []).append(fold(row["t"]))
    model = learn({lang: " ".join(ts) for lang, ts in samples.items()})
    usual = usual_rates({k: ts for k, ts in samples.items() if k in model.langs}) if with_usual else None
    return replace(model, usual=usual)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``SLICE`` rows, so that few texts are strings of Python at a time."""
    return (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "bits"), keep_text: bool = True) -> DataFrame:
    """``docs`` with the language of each whole text, its probability (0 to 1) and its bits a letter.

    A null text and one without a letter get ``und``, 0 and 0; of languages that cost the same the first by name
    wins. Every row is kept, repeated ones too, with its other columns; columns named as in ``out`` are replaced.
    ``keep_text=False`` leaves the text itself out.
    """
    taken = {x.lower() for x in out}
    kept = docs.select(*[col for col in docs.columns if col.lower() not in taken])
    at = kept.columns.index(text_col)
    gone = [] if keep_text else [text_col]
    schema = c.added(kept, *gone, **dict(zip(out, ("string", "double", "double"), strict=True)))
    places = [i for i, col in enumerate(kept.columns) if col not in gone]
    names = schema.fieldNames()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a process reads it and makes its tables once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                langs, score, bits = judge(part.column(at).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], names)

    return kept.mapInArrow(run, schema)


def known(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Those rows of ``docs`` whose texts are not foreign to all languages of the model."""
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield part.filter(pa.array(~foreign(part.column(at).to_pylist(), sent.value)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the language of every document, learnt from two folds of three."""
    docs = c.table(spark, sf_dir, "documents")
    held = c.crc_rest("doc_id", 3) == 1
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model, keep_text=False)
