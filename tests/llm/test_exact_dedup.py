import hashlib
import re

from factweave.llm import exact_dedup

from .helpers import corpus, frame


def brute(rows):
    groups = {}
    for doc, text in rows:
        t = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), doc))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, doc in members:
            out[doc] = (keep, len(members), doc == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def run(spark, rows, **kw):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(frame(spark, rows), **kw).collect()}


def test_brute_force(spark):
    rows = corpus() + [(1000, "a b"), (1001, "a\tb "), (1002, "ab")]
    assert run(spark, rows) == brute(rows)


def test_buckets_that_do_not_fit_are_split(spark):
    rows = corpus()
    assert run(spark, rows, memory_bytes=1000) == brute(rows)


def test_grace_recursion(tmp_path):
    records = [(hashlib.sha256(c).digest(), c, 3, i, 1) for i, c in enumerate([b"a", b"b", b"a", b"c", b"b"] * 50)]
    got = sorted(exact_dedup.grace(iter(records), 300, str(tmp_path)))
    assert [(k, n) for _, k, n in sorted(got, key=lambda r: r[1])] == [(0, 100), (1, 100), (3, 50)]
    assert not list(tmp_path.iterdir())


def test_one_row_of_a_group_stays(spark):
    rows = [(None, None), (None, ""), (1, " "), (1, " "), (1, "x y"), (1, "xy"), (None, "x  y"), (2, "only"), (None, "alone")]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert sorted((len(g), g[0].group_size, sum(r.kept for r in g), {r.keep_id for r in g}) for g in by.values() if len(g) > 1) == [(3, 3, 1, {None}), (4, 4, 1, {1})]
    assert all(g[0].kept for g in by.values() if len(g) == 1)


def test_empty(spark):
    assert run(spark, []) == {}
