import hashlib
import random

import numpy as np

from factweave.llm import suffix_dedup, suffixes

from .helpers import corpus, frame


def brute(rows, length=suffix_dedup.LENGTH):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans, i = [], 0
        while i < len(b):
            if gone[i]:
                j = i
                while j < len(b) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out[doc] = (len(b), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def run(spark, rows):
    got = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
    return {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got}


def test_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_many_spans_of_one_minimiser_go_by_whole_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_SPANS", 2)
    rows = corpus(2)
    assert run(spark, rows) == brute(rows)


def test_long_texts_in_blocks(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 * suffix_dedup.BLOCK))
    rows = [(1, long), (2, long[1000:200_000]), (3, "x" + long[-300_000:] + long[:5000]), (4, "z" * 700_000)]
    assert run(spark, rows) == brute(rows)


def test_hot_strings_in_slices():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 3 * suffix_dedup.BLOCK).astype(np.uint8)
    hot = np.zeros(4000, suffix_dedup._WANT)
    hot["lo"] = np.sort(rng.integers(0, len(data) - 200, len(hot)))
    hot["doc"], hot["n"] = 7, rng.integers(1, 60, len(hot))
    got = []
    for b in suffix_dedup._strings(data, hot, hot["lo"].astype(np.int64), 5):
        got += [(k, *r) for k, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for r in suffix_dedup.unpack([x], suffix_dedup._STRING).tolist()]
    assert len(got) == hot["n"].sum()
    whole = suffix_dedup.Hashes(data)
    for key, h, doc, start in got:
        assert doc == 7 and key == h % 5
    start = np.array([g[3] for g in got])
    assert (whole.of(start, start + suffix_dedup.LENGTH) == np.array([g[1] for g in got], np.uint64)).all()
    assert sorted(start.tolist()) == sorted(int(a) + k for a, n in zip(hot["lo"], hot["n"]) for k in range(n))


def test_empty_table_and_missing_ids(spark):
    assert run(spark, []) == {}
    rows = [(None, "a" * 300), (1, "a" * 300)]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_are_documents_of_their_own(spark):
    rng = random.Random(2)
    other = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(1, "a" * 300), (1, "b" * 300), (None, "c" * 200), (None, "c" * 200), (None, None), (0, other), (2, other + "q")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, len(bytes(r.kept))) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    # "a" * 300 keeps its first string of 100 bytes, as every other start repeats it one byte on
    assert got == sorted([(False, 1, 300, 1), (False, 1, 300, 1), (True, 0, 200, 0), (True, 0, 200, 1), (True, 0, 0, 0), (False, 0, 300, 300), (False, 2, 301, 1)])


def test_query(spark, tmp_path):
    from factweave.llm.queries import op1_suffix_dedup

    rows = corpus(3)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_suffix_dedup(spark, str(tmp_path)).collect()}
    want = {d: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for d, (n, spans, kept) in brute(rows).items()}
    assert got == want


def test_suffix_array_orders_all_suffixes():
    rng = random.Random(0)
    for k in range(200):
        s = np.array([rng.choice([0, 1, 2, 3][: 2 + k % 3]) for _ in range(rng.randint(1, 60))], np.int16)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        sa = suffixes.suffix_array(s, 100)
        assert sa.tolist() == want
        plcp = suffixes.common_prefixes(s.astype(np.uint8) + 1, sa, 20)
        for a, b in zip(want[1:], want):
            n = 0
            while n < 20 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert plcp[a] == n
