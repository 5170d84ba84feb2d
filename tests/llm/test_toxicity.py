import random

import pyarrow as pa
from pyspark.sql import functions as F

from pathloom.llm import toxicity


def test_long_texts_are_learnt_from(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "in", "er", "on", "at", "ed"]) for _ in range(rng.randint(1, 4)))
    # every labelled document has over 8000 code points, and insults stand at its end
    texts = [" ".join(word() for _ in range(1500)) + (" you idiot" if k % 3 == 0 else "") for k in range(120)]
    assert min(map(len, texts)) > 8000
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)], "doc_id long, toxic int")
    rows = toxicity.score(docs.where(F.col("doc_id") >= 90), toxicity.train(docs, labels)).collect()
    assert {r.doc_id: r.predicted for r in rows} == {k: int(k % 3 == 0) for k in range(90, 120)}
    assert toxicity.bag("one two three two", 2) < toxicity.bag("one two three two")


def test_batches_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 10)
    for texts in ([], [None], ["a" * 50], ["", "abc", "é" * 4, None, "x" * 30, "b", "cd"]):
        parts = [part.column(0).to_pylist() for part in toxicity._slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), 0)]
        assert [t for part in parts for t in part] == texts
        assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part) <= 10 for part in parts)
