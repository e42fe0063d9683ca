"""Repeated passages of fewer than three lines, against brute force."""

import random

from factweave.llm import line_dedup

from .helpers import frame, prose


def test_long_runs_of_one_and_two_lines(spark):
    rng = random.Random(11)
    long, half, other, short = prose(rng, 60), prose(rng, 30), prose(rng, 25), prose(rng, 20)
    rows = [(1, long), (2, f"own words\n\n{long}\nmore words"), (3, long), (4, f"{half}\n{other}"), (5, f"a b\n{half}\n{other}\nc"), (6, half), (7, short), (8, short), (9, f"{long}\n{long}"), (10, None)]
    rows += [(20 + i, "\n".join(rng.choice([long, half, other, short, prose(rng, 49), prose(rng, 50)]) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    texts = {i: [x for x in (t or "").split("\n") if x] for i, t in rows}
    places = [(i, p) for i in sorted(texts) for p in range(len(texts[i]))]
    gone = {i: set() for i in texts}
    for k, (i, p) in enumerate(places):
        for j, q in places[:k]:
            n = 0
            while p + n < len(texts[i]) and q + n < len(texts[j]) and texts[i][p + n] == texts[j][q + n]:
                n += 1
            if n >= 3 or sum(len(x.split()) for x in texts[i][p : p + n]) >= 50:
                gone[i] |= set(range(p, p + n))
    for i, t in rows:
        assert got[i].n_removed == len(gone[i])
    assert [got[i].kept_text for i in (2, 3, 5, 6, 8, 9)] == ["own words\n\nmore words", "", "a b\nc", half, short, ""]
