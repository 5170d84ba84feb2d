"""Held-out figures of op2's machine over the tables in a folder, by length and language: python tests/llm/toxicity_figures.py [folder].

Not a test: it prints, for labelled documents that training has not seen, how many clean ones are flagged and how many
toxic ones found, and the scores of insults with letters inserted or replaced.
"""

import os
import random
import sys
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from pathloom.llm import toxicity as t

INSULTS = "idiot stupid trash pathetic disgusting worthless clown loser scum moron".split()


def main(folder: str) -> None:
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["toxic"] is not None}
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    known = [d for d in docs if d["doc_id"] in labels and d["text"]]
    picked = [d for d in known if not held(d["doc_id"])]
    picked = [d for y in (0, 1) for d in [d for d in picked if labels[d["doc_id"]] == y][: t.SAMPLE_ROWS]]
    began = time.time()
    machine = t.fit_bags([(t.bag(d["text"], t.SAMPLE_UNITS), labels[d["doc_id"]]) for d in picked])
    print(f"{len(picked)} documents learnt from in {time.time() - began:.1f} s")
    tested = [d for d in known if held(d["doc_id"])]
    began = time.time()
    scores = t.scores(machine, [d["text"] for d in tested], {})
    print(f"{sum(len(d['text']) for d in tested)} characters scored in {time.time() - began:.1f} s")
    rows = defaultdict(lambda: np.zeros(4, int))
    for d, s in zip(tested, scores, strict=True):
        n = len(d["text"])
        for key in ("all", d["lang"] or "no language", "up to 2000" if n <= 2000 else "to 8000" if n <= 8000 else "beyond 8000"):
            y = labels[d["doc_id"]]
            rows[key] += [y == 0, y == 0 and s >= t.THRESHOLD, y == 1, y == 1 and s >= t.THRESHOLD]
    for key, (clean, flagged, toxic, found) in rows.items():
        print(f"{key:12} clean {clean:4}, flagged {flagged:4} ({flagged / max(1, clean):.3f}); toxic {toxic:4}, found {found:4} ({found / max(1, toxic):.3f})")
    rng = random.Random(5)
    plain = [d["text"] for d in known if labels[d["doc_id"]] == 0 and 100 < len(d["text"]) < 2000][:50]
    for name, change in (
        ("plain", lambda w: w),
        ("a letter inserted", lambda w: (lambda k: w[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[k:])(rng.randint(1, len(w) - 1))),
        ("x inserted", lambda w: (lambda k: w[:k] + "x" + w[k:])(rng.randint(1, len(w) - 1))),
        ("a letter by a digit", lambda w: (lambda k: w[:k] + rng.choice("0134579") + w[k + 1 :])(rng.randint(1, len(w) - 1))),
        ("a mark inserted", lambda w: (lambda k: w[:k] + rng.choice("_-.*") + w[k:])(rng.randint(1, len(w) - 1))),
        ("spaced out", " ".join),
        ("dotted", ".".join),
    ):
        texts = [p + " " + change(w) + " " + p[:200] for p in plain for w in INSULTS]
        print(f"{name:20} found {np.mean(t.scores(machine, texts, {}) >= t.THRESHOLD):.3f}")
    print({w: round(float(s), 3) for w, s in zip("idiot idxiot st_up1d m0ron stxupid morxon".split(), t.scores(machine, "idiot idxiot st_up1d m0ron stxupid morxon".split(), {}), strict=True)})


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
