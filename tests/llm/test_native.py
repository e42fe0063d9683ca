"""Licence scan, Order MinHash, line dedup and mixing against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from factweave.llm import fingerprints, licenses, line_dedup, mixing

from .helpers import corpus, frame, prose


def chain(*parts):
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True) if abs(p) >= 0 and isinstance(p, int) else p, seed)
    return seed


def chain_int(h, occurrence):
    """A long, then an int (hashed as four bytes)."""
    seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest(occurrence.to_bytes(4, "little"), seed)


def signature(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    if not w:
        return []
    k = fingerprints.K
    if len(w) < k or len(text) > fingerprints.LONG_WORDS * len(w):
        w = list(text)
    grams = [w[i : i + k] for i in range(max(len(w) - k, 0) + 1)]
    seen, items = Counter(), []
    first = sorted((chain(*g) >> 27, i) for i, g in enumerate(grams))
    for h, i in first:
        items.append((chain_int(h, seen[h]) >> 27, i))
        seen[h] += 1
    slots = defaultdict(list)
    for h, i in sorted(items):
        slots[h >> (37 - fingerprints.SLOT_BITS)].append((h, i))
    out = []
    for s in sorted(slots):
        two = sorted(slots[s][:2], key=lambda x: x[1])
        out.append(s << 32 | chain(*[h for h, _ in two]) >> 32)
    return out


def test_signatures(spark):
    rows = [(i, t) for i, t in corpus() if t] + [(3000, "ab cd"), (3001, "日本語のテキスト🙂" * 30), (3002, "x"), (3003, "w " * 4 + "y" * 500)]
    for r in fingerprints.order_minhash(frame(spark, rows)).collect():
        assert list(r.sig) == signature(r.text)


def test_edit_report(spark):
    rows = corpus() + [(2000, "abc"), (2001, "xyz")]
    got = {r.doc_id: r for r in fingerprints.edit_report(frame(spark, rows)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        t, a = text or "", after or ""
        n = len(t)
        edited = t[: n - n // 2] + a[: n // 2]
        assert got[doc].n_chars == n
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
    same = defaultdict(set)
    for doc, text in rows:
        same[text or ""].add(got[doc].fingerprint)
    assert all(len(s) == 1 for s in same.values())
    assert fingerprints.edit_report(frame(spark, [])).count() == 0
    one = fingerprints.edit_report(frame(spark, [(7, "a b c d e f g h")])).first()
    assert one.near_next == 1.0


def near(a, b):
    """Share of the slots used by either signature in which both agree."""
    used = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(used) if used else 1.0


def test_likeness_against_brute_force(spark):
    rows = sorted(corpus(4)) + [(4000, "ab cd"), (4001, "日本語のテキスト" * 9)]
    got = {r.doc_id: r for r in fingerprints.edit_report(frame(spark, rows)).collect()}
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, a = text or "", after or ""
        edited = t[: len(t) - len(t) // 2] + a[: len(t) // 2]
        assert got[doc].fingerprint == " ".join(f"{x:x}" for x in signature(t))
        assert got[doc].near_edited == near(signature(t), signature(edited)) and got[doc].near_next == near(signature(t), signature(a))


def test_every_row_has_one_report(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "one two three four five six"), (None, None), (0, "x y z x y z")]
    got = fingerprints.edit_report(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    assert next(r for r in got if r.doc_id == 0).near_next == 0.0
    # rows without an id come last; the last row's next is the first, so one of theirs is edited with its beginning
    ends = {hashlib.sha256(e.encode()).hexdigest() for e in ("one two three " + "x y z x y z"[:14], "")}
    assert any(r.doc_id is None and r.edited_sha256 in ends for r in got)


def dice(unit, grams):
    w = re.findall("[a-z0-9]+", unit.lower())
    a = {f"{x} {y}" for x, y in zip(w, w[1:])}
    best = None
    for name in sorted(grams):
        if a:
            d = 2 * len(a & set(grams[name])) / (len(a) + len(grams[name]))
            if d >= licenses.THRESHOLD and (best is None or d > best[0]):
                best = (d, name)
    return best


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = corpus() + [(2000, "intro\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0"), (2001, mit.replace("software", "Software!!")), (2002, mit.replace("Software", "thing") + " and more words here"), (2003, "released under the mit license")]
    grams = {n: licenses.template_bigrams(t) for n, t in licenses.TEMPLATES.items()}
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    for doc, text in rows:
        t = text or ""
        hits = [h for h in (dice(line, grams) for line in t.split("\n")) if h]
        whole = dice(t, grams)
        every = hits + ([whole] if whole else [])
        assert got[doc].n_hits == len(hits)
        assert got[doc].licenses == "; ".join(sorted({n for _, n in every}))
        assert got[doc].text_license == (whole[1] if whole else None)
        assert got[doc].best_dice == (round(max(d for d, _ in every), 6) if every else None)


def test_line_dedup(spark):
    import random

    rng = random.Random(4)
    lines = [prose(rng, 6) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.7 else ["", "  "][i % 2] for _ in range(rng.randint(0, 14)))) for i in range(40)] + [(50, None), (51, "")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    seen = set()
    for doc, text in sorted(rows):
        split = (text or "").split("\n")
        at = [i for i, x in enumerate(split) if x.strip()]
        bare = [" ".join(split[i].split()) for i in at]
        gone = set()
        for i in range(len(bare) - line_dedup.WINDOW + 1):
            w = tuple(bare[i : i + line_dedup.WINDOW])
            if w in seen:
                gone |= set(range(i, i + line_dedup.WINDOW))
            seen.add(w)
        drop = {at[i] for i in gone}
        assert got[doc].n_lines == len(bare) and got[doc].n_removed == len(gone)
        assert got[doc].n_runs == sum(1 for i in gone if i - 1 not in gone)
        assert got[doc].kept_text == "\n".join(x for i, x in enumerate(split) if i not in drop)


def fill(sizes, weights, most):
    """The excess over the caps is shared again until none is above."""
    total = sum(sizes)
    targets, capped = {}, set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        targets = {i: most * sizes[i] if i in capped else left * weights[i] / w for i in range(len(sizes))}
        over = {i for i in targets if i not in capped and targets[i] > most * sizes[i]}
        if not over:
            return targets
        capped |= over


def test_mixing(spark):
    import random

    rng = random.Random(8)
    names = ["a", "b", "B", "é", None]
    rows = [(i, prose(rng, rng.randint(1, 120)) if i % 40 else None, names[min(rng.randrange(9), 4)]) for i in range(600)]
    df = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    order = sorted({s for s in source.values() if s is not None}) + [None]
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sizes = [sum(size[i] for i in size if source[i] == s) for s in order]
    targets = fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    taken = defaultdict(int)
    for r in got:
        k = order.index(source[r.doc_id])
        assert r.size == size[r.doc_id] and r.source_size == sizes[k] and math.isclose(r.target, targets[k], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[k] += r.taken
    for k in targets:
        assert abs(taken[k] - targets[k]) <= max(10, 0.01 * targets[k])
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(got) == sorted(again)


def test_rates_are_exponential_in_size(spark):
    rows = [(i, " ".join("w" * 1 for _ in range(1 + i % 50)), "ab"[i % 3 == 0]) for i in range(600)]
    got = [r for r in mixing.mix(frame(spark, rows, "doc_id long, text string, source string")).collect() if r.rate < 3]
    by = defaultdict(dict)
    for r in got:
        by[r.source_size][r.size] = math.log(r.rate)
    for rates in by.values():
        slopes = {round(v / k, 6) for k, v in rates.items()}
        assert max(slopes) - min(slopes) < 1e-5


def test_nothing_to_mix(spark):
    assert mixing.mix(frame(spark, [], "doc_id long, text string, source string")).count() == 0
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0
    assert licenses.license_scan(frame(spark, [])).count() == 0
    one = mixing.mix(frame(spark, [(1, None, None)], "doc_id long, text string, source string")).first()
    assert (one.size, one.target, one.taken) == (0, 0.0, 0)
    assert frame(spark, [(1, None)]).select(F.lit(1)).count() == 1
