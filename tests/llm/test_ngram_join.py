import re

from factweave.llm import ngram_join
from factweave.llm.components import components

from .helpers import corpus, frame


def sets(rows):
    out = {}
    for doc, text in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(rows):
    s = sets(rows)
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            common = len(s[a] & s[b])
            if a < b and common and 100 * common >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s[d]), find(d)) for d in s}


def run(spark, rows, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, rows), **kw).collect()}


def test_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_frequent_shingles_last(spark):
    rows = corpus(3)
    assert run(spark, rows, often=2, frequent_df=2) == brute(rows)


def test_shuffle_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = corpus(5)
    assert run(spark, rows) == brute(rows)


def test_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((100 - i, " ".join(words)))
        for k in range(3):
            words[(i * 17 + k) % 200] = f"x{i}{k}"
    assert run(spark, rows) == brute(rows)


def test_nothing(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None), (2, ""), (None, "a b c d e f")]) == {1: (0, 1), 2: (0, 2), None: (2, None)}


def test_every_row_is_a_document(spark):
    text, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    rows = [(5, text), (5, "something else of its own here"), (5, text), (3, near), (None, text), (None, "no id and no link at all"), (9, "no id and no link at all")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.ngram_join(frame(spark, rows)).collect())
    assert got == sorted([("5", 56, "3"), ("5", 2, "5"), ("5", 56, "3"), ("3", 55, "3"), ("None", 56, "3"), ("None", 3, "9"), ("9", 3, "9")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (52, 51), (60, 60)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 52: 50}
