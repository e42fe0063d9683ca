"""Registered queries over whole tables, against brute force."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from factweave import queries as Q
from factweave.operators import graph as G


def test_fragment_scores_reads_all_of_lineitem(spark, tmp_path):
    rng = random.Random(3)
    suppliers = [2, 3, 61, 62, 63, 66, 150, 153, 900]
    rows = [(rng.choice(suppliers), rng.randint(1, 12), rng.choice([1.0, 30.0, 50.0])) for _ in range(90)]
    rows += [(s, 100 + i, 2.0) for i in range(3) for s in (66, 153, 900)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = defaultdict(set)
    for s, p, _ in rows:
        parts[s].add(p)
    df = Counter(p for ps in parts.values() for p in ps)
    expected = {}
    for a in parts:
        for b in parts:
            if f"s{a}" < f"s{b}" and (a % 3 == 0) == (b % 3 == 0):
                shares = [1 / df[p] for p in parts[a] & parts[b]]
                rare = sum(x >= 0.25 for x in shares)
                if sum(shares) >= 0.30 and (a % 3 or rare >= 2 or sum(shares) >= 0.75):
                    expected[f"s{a}", f"s{b}"] = ("organisation" if a % 3 else "personne", round(sum(shares), 6), rare)
    got = {(r.a, r.b): (r.fam, r.score, r.rares) for r in Q.fragment_scores(spark, str(tmp_path)).collect()}
    assert got == expected and ("s153", "s66") in got


def test_ordered_union_takes_whole_lists(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 60) * 10.0, rng.randint(1, 30)) for i in range(130)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, day int")
    df.selectExpr("o_orderkey", "o_totalprice", "timestamp'2020-01-01' + make_dt_interval(day) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    expected = {i: (0, k + 1) for k, (i, _, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    got = Q.ordered_union(spark, str(tmp_path)).collect()
    assert len(got) == 130 and {r.fait_id: (r.prio, r.pos) for r in got} == expected
    by_day = G.ranked(df, F.asc("day"), F.desc("o_orderkey")).collect()
    assert {r.o_orderkey: r.pos for r in by_day} == {i: k + 1 for k, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[2], -r[0])))}


def test_entry_without_the_optional_part(monkeypatch):
    import __spark_entry__ as entry

    real = entry.importlib.import_module

    def missing(name, *args):
        if name == "factweave.llm.queries":
            raise ModuleNotFoundError(name)
        return real(name, *args)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert set(entry.queries()) == set(Q.QUERIES) and set(entry.oracle_sql()) <= set(Q.QUERIES)
    assert len(Q.ORACLE) > 75
