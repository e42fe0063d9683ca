"""Language ID and quality: parses against brute force, accuracy on held-out rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factweave.llm import langid, quality

from .helpers import frame

DATA = "/root/testdata/sf0.01"
FR = "le la les un une de des que qui pour avec dans sur est sont était chanson rivière montagne été forêt où".split()
EN = "the of and to in is that for with was on are this from which river mountain summer forest where singing".split()


def texts(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def phrases(x, sample, block=langid.BLOCK):
    """Greedy longest matches; a symbol that the sample lacks ends a phrase and is none itself at a phrase's start."""
    total = 0
    for b in range(0, len(x), block):
        y, phrase = x[b : b + block], b""
        for i in range(len(y)):
            c = y[i : i + 1]
            if phrase + c in sample:
                phrase += c
            else:
                total += 1
                phrase = c if c in sample else b""
        total += 1
    return total


def test_parses():
    rng = random.Random(2)
    model = [("en", 5, (texts(rng, EN, 80) + " ").encode()), ("fr", 9, (texts(rng, FR, 80) + " ").encode())]
    p = langid.CrossParser(model)
    some = [texts(rng, EN, 30), texts(rng, FR, 700), "QUE LES ÉTÉS", "zzz qqq", "12 34 !!", "", "é", texts(rng, EN + FR, 40)]
    names, score, rate = p.predict(pa.array(some))
    assert names[0] == "en" and names[1] == "fr" and names[2] == "fr" and names[4] == names[5] == "und"
    for t, r in zip(some, rate, strict=True):
        x = langid.symbols(np.frombuffer(t.encode(), np.uint8))
        x = x[langid.squeezed(x, np.zeros(1, np.int64))].tobytes()
        if x:
            assert round(r * len(x)) == min(phrases(x, s) for _, _, s in model)
    assert ((0 <= score) & (score <= 1)).all()


def test_automaton_knows_all_substrings():
    s = [1, 2, 1, 1, 2, 3]
    states = langid.SuffixAutomaton(s).next
    every = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for q in [(1, 2, 3), (1, 1, 2, 3), (2, 2), (3, 1), (4,), (1, 2, 1, 1, 2, 3)]:
        state = 0
        for c in q:
            state = None if state is None else states[state].get(c)
        assert (state is not None) == (q in every)


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = langid.crc_bucket(F.col("doc_id"), 3) == 1
    got = langid.identify(docs, langid.train(docs, ~held)).join(docs.select("doc_id", "lang"), "doc_id").filter(held)
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(1, None, "en"), (2, "", None), (3, "12 !", "fr"), (4, "the of and", None)]
    none = {r.doc_id: r for r in langid.identify(frame(spark, rows, schema), langid.train(frame(spark, [], schema), F.lit(True))).collect()}
    assert {r.lang_pred for r in none.values()} == {"und"}
    model = langid.train(frame(spark, [(9, "the of and to in", "en")], schema), F.lit(True))
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, rows, schema), model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en"}
    kept = langid.keep_identified(frame(spark, rows, schema), model)
    assert [(r.doc_id, r.lang) for r in kept.collect()] == [(4, "en")] and kept.columns == frame(spark, rows, schema).columns


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    held = langid.crc_bucket(F.col("doc_id"), 4) == 2
    got = quality.score(docs, quality.train(docs, labels, ~held)).join(labels, "doc_id").filter(held)
    right = got.filter((F.col("score") >= quality.THRESHOLD) == (F.col("quality") == 1)).count()
    assert right >= 0.95 * got.count()


def test_scores_against_the_sizes_themselves(spark):
    """Every score follows from compressing the whole text twice, as the model says, done here by hand."""
    import zstandard

    rng = random.Random(4)
    good = [" ".join(rng.choice(EN) for _ in range(rng.randint(30, 200))) for _ in range(60)]
    bad = ["### ".join(rng.choice(FR) for _ in range(rng.randint(30, 200))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, "long " + " ".join(rng.choice(EN) for _ in range(30_000))), (901, None), (902, "é"), (900, "long again")]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    docs = frame(spark, rows)
    m = quality.train(docs, labels, F.col("doc_id") % 5 != 0)
    assert m.slope > 0 and quality.train(docs, labels, F.col("doc_id") % 5 != 0) == m
    made = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=m.level, write_content_size=False, write_checksum=False, write_dict_id=False) for d in m.dictionaries]
    got = quality.score(docs, m).collect()
    assert len(got) == len(rows)
    texts = sorted((i, t or "") for i, t in rows)
    want = []
    for i, t in texts:
        b = t.encode()
        g, o = (sum(len(c.compress(b[k : k + quality.BLOCK])) for k in range(0, len(b), quality.BLOCK)) for c in made)
        x = (o - g) / len(b) if b else 0.0
        want.append((i, round(1 / (1 + np.exp(-(m.intercept + m.slope * x))), 9)))
    assert sorted((r.doc_id, round(r.score, 9)) for r in got) == sorted(want)
    held = [r for r in got if r.doc_id < 120 and r.doc_id % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id < 60) for r in held) >= 0.9 * len(held)


def test_quality_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "good text here"), (3, "good text here")])
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    got = quality.score(docs, none).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1
    one = quality.train(docs, spark.createDataFrame([(3, 1), (None, 0), (2, None)], "doc_id long, quality int"), F.lit(True))
    assert quality.score(docs, one).count() == 4
    assert quality.score(frame(spark, []), one).count() == 0


def test_logistic():
    x = np.array([[-2.0], [-1.0], [1.0], [2.0], [-1.5], [1.5]])
    y = np.array([0.0, 0.0, 1.0, 1.0, 1.0, 0.0])
    w = quality.logistic(x, y)
    p = 1 / (1 + np.exp(-(w[0] + x[:, 0] * w[1])))
    assert abs((p - y).sum()) < 1e-3
    assert zlib.crc32(b"12") % 4 in range(4)
