"""Whole licence files and licences wrapped over lines of longer texts."""

import random
import re
import textwrap

from factweave.llm import licenses

from .helpers import frame, prose


def grams(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def test_whole_files_and_wrapped_headers(spark):
    rng = random.Random(2)
    full = licenses.all_templates()
    around = lambda: "\n".join(prose(rng, 9) for _ in range(40))
    wrapped = textwrap.fill(licenses.TEMPLATES["Apache-2.0 header"], 60)
    opening = textwrap.fill(licenses.TEMPLATES["MIT"], 50)
    rows = [(k, f"The License\n\nCopyright (c) 2020 A. Person\n\n{full[n + ' text']}") for k, n in enumerate(licenses.FULL)]
    rows += [(100, f"{around()}\n{wrapped}\n{around()}"), (101, f"{around()}\n{opening}\n{around()}"), (102, around())]
    rows += [(103, f"{around()}\n{full['BSD-3-Clause text']}\n{around()}\n{wrapped}"), (104, "Released under\nthe MIT License."), (105, None)]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    for k, n in enumerate(licenses.FULL):
        assert got[k].text_license == f"{n} text" and f"{n} text" in got[k].licenses.split("; ")
    assert got[0].best_dice > 0.95
    assert "Apache-2.0 header" in got[100].licenses and got[100].text_license is None
    assert got[101].licenses == "MIT" and got[101].best_dice == 1.0
    assert (got[102].licenses, got[102].best_dice) == ("", None) and (got[105].licenses, got[105].best_dice) == ("", None)
    assert "BSD-3-Clause text" in got[103].licenses and "BSD-2" not in got[103].licenses and "Apache-2.0 header" in got[103].licenses
    assert got[104].licenses == "MIT notice"


def test_runs_against_every_window(spark):
    """The best coefficient of any line, run of lines or whole text, with one template."""
    rng = random.Random(7)
    template = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = template.split() + ["x", "y"]
    rows = []
    for i in range(60):
        w = template.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        text = [rng.choice(words) for _ in range(rng.randrange(9))] + w + [rng.choice(words) for _ in range(rng.randrange(9))]
        rows.append((i, "".join(x + rng.choice([" ", " ", "\n", "\n\n"]) for x in text)))
    want = grams(template)
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows), templates={"T": template}).collect()}
    for doc, text in rows:
        lines = text.split("\n")
        units = [grams(" ".join(lines[i : j + 1])) for i in range(len(lines)) for j in range(i, len(lines))]
        best = max((2 * len(u & want) / (len(u) + len(want)) for u in units), default=0)
        assert got[doc].best_dice == (round(best, 6) if best >= licenses.THRESHOLD else None)
    assert sum(r.best_dice is not None for r in got.values()) > 10
