import random

import corpus_pipeline
from pathloom.llm import decontam, nearcopies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "src1", len(t or "")) for k, t in enumerate(texts)], DOCS)


def test_passages_of_the_benchmark_are_cut_out(spark, tmp_path):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(n))
    item = say(20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    head, tail = say(300), say(300)
    texts = [f"{head}, {item.upper()}. {tail}", item, head, None, ""]
    out = {r.doc_id: r for r in corpus_pipeline.decontaminate(spark, table(spark, texts), str(tmp_path)).collect()}
    assert sorted(out) == [0, 2, 3, 4]
    assert out[0].text == f"{head}, . {tail}" and out[0].n_chars == len(out[0].text)
    assert [out[k].text for k in (2, 3, 4)] == texts[2:] and out[2].n_chars == len(head)
    index = decontam.index_of([(0, decontam.words(item))])
    assert all(decontam.hits(decontam.words(r.text), index) == ([], set()) for r in out.values())


def jaccard(a, b):
    sets = [{" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4) if ws else 0)} for ws in ((x or "").lower().split() for x in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_of_near_copies_one_stays(spark):
    rng = random.Random(6)
    word = lambda: "w%d" % rng.randrange(5000)
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 60, 200]))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 6):
            new = list(base)
            for _ in range(edits):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new))
    texts += ["", None, texts[0].upper(), texts[7]]
    rows = [(k, t, "en", "src1", len(t or "")) for k, t in enumerate(texts)]
    # of one id different texts, and rows without an id
    rows += [(3, " ".join(word() for _ in range(50)), "en", "src1", 1), (None, texts[5], "en", "src1", 1), (None, "only here and nowhere else", "en", "src1", 1), rows[0]]
    out = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, DOCS), "").collect()
    stay = [tuple(r) for r in out]
    assert len(set(stay)) == len(stay) and set(stay) <= set(rows)
    assert not [1 for i, a in enumerate(stay) for b in stay[:i] if jaccard(a[1], b[1]) >= 0.8]
    # least keys of components of all near copies
    distinct = list({r[1] or "": r for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0), reverse=True)}.values())
    root = list(range(len(distinct)))
    find = lambda x: x if root[x] == x else find(root[x])
    order = lambda k: (distinct[k][0] is None, distinct[k][0] or 0)
    for i in range(len(distinct)):
        for j in range(i):
            if jaccard(distinct[i][1], distinct[j][1]) >= 0.8 and find(i) != find(j):
                low, high = sorted((find(i), find(j)), key=order)
                root[high] = low
    assert len(stay) >= len({find(k) for k in range(len(distinct))})
    assert {distinct[find(k)][:2] for k in range(len(distinct))} <= {r[:2] for r in stay}
    assert (3, rows[-4][1]) in {r[:2] for r in stay} and (None, "only here and nowhere else") in {r[:2] for r in stay}
    assert nearcopies.likeness(nearcopies.shingles(texts[0]), nearcopies.shingles(texts[1])) == jaccard(texts[0], texts[1])


def test_simhash_links_near_copies_that_share_no_band(spark):
    rng = random.Random(4225)  # one of few whose near copies share no band's key
    base = ["w%d" % rng.randrange(5000) for _ in range(45)] + ["so"] * 15
    near = [*base[:20], "x", *base[21:]]
    filled = [[*(f"{name}{k}" for k in range(45)), *["so"] * 400] for name in "uv"]  # of one fingerprint, but unlike
    texts = [" ".join(ws) for ws in (base, near, *filled)]
    apart = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
    bands = [set(nearcopies.keys(nearcopies.shingles(t))) for t in texts]
    assert 0 < apart(*texts[:2]) <= simhash.RADIUS and jaccard(*texts[:2]) >= 0.8 and not bands[0] & bands[1]
    assert apart(*texts[2:]) == 0 and jaccard(*texts[2:]) < 0.8
    out = corpus_pipeline.deduplicate(spark, table(spark, texts), "").collect()
    assert sorted(r.doc_id for r in out) == [0, 2, 3]


def test_foreign_and_junk_texts_go(spark):
    rng = random.Random(7)
    words = {
        "en": "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all she they were my are me one their so an said them we who would been will no when there if more out up into do any your what has man could other than our some very time upon about may its only now like little then can should made did us such great before must two these see know over much down after first mr good men".split(),
        "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wir unter wenn kann schon doch ihre gegen vom können jahr wieder zwei uns keine alle".split(),
    }
    junk = {
        "pl": "litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił dziś piękność twą w całej ozdobie widzę i opisuję bo tęsknię po tobie",
        "fi": "mieleni minun tekevi aivoni ajattelevi lähteäni laulamahan saaani sanelemahan sukuvirttä suoltamahan lajivirttä laulamahan sanat suussani sulavat",
        "ru": "мой дядя самых честных правил когда не в шутку занемог",
        "letters": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)),
        "consonants": "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(300)),
    }
    for docs_a_lang, length in ((40, 200), (8, 100)):  # samples of over and under 4095 letters reject alike
        rows = [(lang, " ".join(rng.choice(ws) for _ in range(length))) for lang, ws in words.items() for _ in range(docs_a_lang)]
        clean = [*rows, (None, "the man"), (None, "und der"), *((None, " ".join(rng.choice(ws) for _ in range(12))) for ws in words.values() for _ in range(10))]
        odd = [(None, x) for x in [*junk.values(), None, "", "123 !"]]
        frame = spark.createDataFrame([(k, t, lang, "src1", len(t or "")) for k, (lang, t) in enumerate([*clean, *odd])], DOCS)
        stay = {r.doc_id for r in corpus_pipeline.identify(spark, frame, "").collect()}
        assert sorted(stay ^ set(range(len(clean)))) == []
