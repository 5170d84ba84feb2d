import random

import pytest

from pathloom.llm import spotsigs


def test_near_duplicates_are_all_pairs(spark):
    rng = random.Random(11)
    sets = []
    for _ in range(12):
        base = [rng.getrandbits(32) for _ in range(rng.choice([1, 4, 20, 60]))]
        for gone in (0, 0, 1, 3, 9):
            kept = rng.sample(base, max(1, len(base) - gone)) + [rng.getrandbits(32) for _ in range(rng.choice([0, 0, 1, 4]))]
            sets.append(frozenset(kept))
    sets = sorted(set(sets), key=sorted)
    text = {s: "".join(f"{x:08x}" for x in sorted(s)) for s in sets}
    want = {(*sorted((text[a], text[b])), len(a & b) / len(a | b)) for i, a in enumerate(sets) for b in sets[:i] if 5 * len(a & b) >= 4 * len(a | b)}
    rows = [(t,) for t in [*text.values(), next(iter(text.values())), ""]]
    got = sorted(tuple(r) for r in spotsigs.near_duplicates(spark.createDataFrame(rows, "fingerprint string")).collect())
    assert want and [r[:2] for r in got] == [r[:2] for r in sorted(want)]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in sorted(want)])


def signatures_by_hand(text):
    import re
    from zlib import crc32

    ws = re.findall(r"[^\W_]+", text.lower())
    out = set()
    for i, w in enumerate(ws):
        if w in spotsigs.ANCHORS or crc32(w.encode()) % 8 == 0:
            chain = [x for x in ws[i + 1 :] if x not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                out.add(" ".join([w, *chain]))
    return {crc32(x.encode()) for x in out or set(ws) or {text}} if text else set()


def test_signatures_are_chains_after_anchors():
    rng = random.Random(5)
    some = ["the", "a", "und", "le", "de", *(f"word{k}" for k in range(20))]
    for _ in range(200):
        text = " ".join(rng.choice(some) for _ in range(rng.choice([0, 1, 2, 3, 8, 60]))) + rng.choice(["", " !", "."])
        assert set(spotsigs.signatures(text).tolist()) == signatures_by_hand(text)
    assert set(spotsigs.signatures("the cat sat").tolist()) == signatures_by_hand("the cat sat") and len(spotsigs.signatures("the cat sat")) <= 2
