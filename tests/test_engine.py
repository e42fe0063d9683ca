"""The write rules, consolidation, reading, inference and rendering on small worlds."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators import extraction as X
from factweave.operators import graph as G
from factweave.operators import maintenance as M
from factweave.operators import models as L
from factweave.operators import promotion as P
from factweave.operators import rendering as R
from factweave.operators import resolution as E
from factweave.operators import scoring as S
from factweave.operators import writing as W
from factweave.plans import ontology as O
from factweave.sources import store
from factweave.streaming import fold

SCHEMA = "claim_seq long, op string, sujet string, predicat string, objet string, source_id string, date_obs timestamp, date_validite string, date_fin string, type_sujet string, type_objet string, cible long"


def day(s):
    return datetime.strptime(s, "%Y-%m-%d")


def claims(spark, rows):
    """(op, sujet, predicat, objet, source, day[, validity[, end[, target]]])"""
    full = []
    for i, r in enumerate(rows):
        op, s, p, o, src, d, *more = r
        val, end, target = [*more, None, None, None][:3]
        full.append((i + 1, op, s, p, o, src, day(d), val, end, None, None, target))
    return spark.createDataFrame(full, SCHEMA)


def facts(spark, rows):
    return {r.fait_id: r for r in W.write_facts(claims(spark, rows), O.specification(spark)).collect()}


def test_corroboration_repetition_and_liar(spark):
    f = facts(spark, [
        ("assert", "Zentra", "siege_de", "Lyon", "a", "2026-01-01"),
        ("assert", "zentra", "siege_de", "LYON", "b", "2026-01-02"),
        ("assert", "Zentra", "siege_de", "Lyon", "a", "2026-01-03"),
        ("assert", "Orbix", "siege_de", "Paris", "x", "2026-01-01"),
        ("assert", "Orbix", "siege_de", "Paris", "x", "2026-01-05"),
    ])
    assert f[1].certitude == pytest.approx(0.75) and f[1].force == pytest.approx(0.55)
    assert f[4].certitude == pytest.approx(0.55) and len(f[4].provenance) == 1
    assert f[1].derniere_confirmation == day("2026-01-03")


def test_dated_newer_value_closes(spark):
    f = facts(spark, [
        ("assert", "Ville", "maire_de", "Anne", "a", "2020-01-01"),
        ("assert", "Ville", "maire_de", "Bob", "b", "2026-05-01", "2026-03"),
        ("assert", "Ville", "maire_de", "Anne", "c", "2026-06-01"),
    ])
    assert f[1].statut == "clos" and f[1].valide_jusqua == day("2026-03-01")
    assert f[2].statut == "courant"
    # a value that was closed is corroborated, not opened again
    assert f[1].certitude == pytest.approx(0.75)


def test_conflicts_dispute(spark):
    f = facts(spark, [
        ("assert", "A", "maire_de", "X", "a", "2026-01-01"),
        ("assert", "A", "maire_de", "X", "b", "2026-01-02"),
        ("assert", "A", "maire_de", "Y", "liar", "2026-02-01"),
        ("assert", "B", "maire_de", "X", "a", "2026-01-01"),
        ("assert", "B", "maire_de", "Y", "b", "2026-02-01"),
    ])
    assert f[1].statut == f[3].statut == "disputé" and f[1].certitude == pytest.approx(0.65)
    assert f[4].statut == f[5].statut == "disputé" and f[4].certitude == pytest.approx(0.55)


def test_multi_valued_and_reflexive(spark):
    f = facts(spark, [
        ("assert", "A", "produit", "x", "a", "2026-01-01"),
        ("assert", "A", "produit", "y", "a", "2026-01-01"),
        ("assert", "Zoé", "parent_de", "zoe", "a", "2026-01-01"),
        ("assert", "A", "verbe_brut", "z", "a", "2026-01-01"),
    ])
    assert sorted(f) == [1, 2, 4] and {x.statut for x in f.values()} == {"courant"}


def test_edits_need_sources_and_dates(spark):
    rows = [
        ("assert", "A", "maire_de", "X", "a", "2026-01-01"),
        ("close", "A", "maire_de", "X", None, "2026-02-01", None, "2026-02"),
        ("close", "A", "maire_de", "X", "b", "2026-02-01"),
        ("contest", "A", "maire_de", "X", None, "2026-02-01"),
        ("contest", "A", "maire_de", "X", "b", "2026-02-01"),
        ("access", "A", "maire_de", "X", None, "2026-02-02"),
        ("close", "A", "maire_de", "X", "b", "2026-02-01", None, "2026-02", 1),
        ("close", "A", "maire_de", "Q", "b", "2026-02-01", None, "2026-02"),
        ("corroborate", "A", "maire_de", "X", "c", "2026-02-05"),
    ]
    rep = {r.claim_seq: r.action for r in W.write_report(claims(spark, rows), O.specification(spark)).collect()}
    assert rep[2] == "refus_sans_source" and rep[3] == "refus_sans_date" and rep[4] == "refus_sans_source"
    assert rep[5] == "contest" and rep[6] == "access" and rep[7] == "close" and rep[8] == "fait_inconnu" and rep[9] == "corroboration"
    f = facts(spark, rows)[1]
    assert f.statut == "clos" and f.valide_jusqua == day("2026-02-01") and f.compteur_acces == 1 and len(f.provenance) == 4


def test_intervals_and_negations(spark):
    f = facts(spark, [
        ("closed_interval", "A", "travaille_pour", "Corp", "a", "2026-01-01", "1990", "1995"),
        ("assert", "B", "travaille_pour", "Corp", "a", "2026-01-01"),
        ("negate", "B", "travaille_pour", "Other", "b", "2026-03-01"),
        ("negate", "C", "travaille_pour", "Corp", "b", "2026-03-01"),
        ("assert", "D", "produit", "x", "a", "2026-01-01"),
        ("negate", "D", "produit", "y", "a", "2026-02-01"),
    ])
    assert f[1].statut == "clos" and f[1].valide_de == day("1990-01-01") and f[1].valide_jusqua == day("1995-01-01")
    assert f[2].statut == "clos" and f[2].valide_jusqua == day("2026-03-01")
    assert f[5].statut == "courant" and sorted(f) == [1, 2, 5]


class Plain:
    """An independent restatement of the rules for one key, for random logs."""

    def __init__(self, functional):
        self.f, self.functional = [], functional

    def claim(self, seq, value, src, seen, valid):
        for x in self.f:
            if x["v"] == value:
                if src in x["all"]:
                    x["force"] = min(0.99, x["force"] + 0.05)
                else:
                    x["c"] = min(0.95, x["c"] + 0.2)
                    x["all"].add(src)
                    x["rep"].add(src)
                    if len(x["rep"]) < 2:
                        x["c"] = min(x["c"], 0.6)
                    if x["s"] == "disputé" and x["c"] >= 0.6 and len(x["rep"]) >= 2:
                        x["s"] = "courant"
                return
        new = {"id": seq, "v": value, "c": 0.55, "force": 0.5, "de": valid or seen, "s": "courant", "all": {src}, "rep": {src}, "end": None}
        live = [x for x in self.f if x["s"] in ("courant", "disputé")]
        if self.functional and live:
            top = live[0]
            for x in live:
                if x["de"] > top["de"]:
                    top = x
            if valid and valid > top["de"] and (src not in top["all"] or top["c"] < 0.6):
                top["s"], top["end"] = "clos", valid
            else:
                if top["c"] >= 0.6 and len(top["all"]) >= 2:
                    top["c"] = max(0.0, top["c"] - 0.1)
                top["s"] = new["s"] = "disputé"
        self.f.append(new)


@pytest.mark.parametrize("predicate", ["maire_de", "produit"])
def test_random_logs(spark, predicate):
    rng = random.Random(predicate)
    rows, keys = [], {}
    for i in range(600):
        s, v, src = f"e{rng.randrange(12)}", f"val{rng.randrange(4)}", f"s{rng.randrange(4)}"
        seen = day("2026-01-01") + timedelta(days=i)
        valid = day(f"20{rng.randrange(10, 40)}-01-01") if rng.random() < 0.5 else None
        rows.append((i + 1, "assert", s, predicate, v, src, seen, valid and valid.strftime("%Y"), None, None, None, None))
        keys.setdefault(s, Plain(predicate == "maire_de")).claim(i + 1, v, src, seen, valid)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.fait_id: (r.statut, round(r.certitude, 9), round(r.force, 9), r.valide_jusqua) for r in W.write_facts(df, O.specification(spark)).collect()}
    want = {x["id"]: (x["s"], round(x["c"], 9), round(x["force"], 9), x["end"]) for k in keys.values() for x in k.f}
    assert got == want


def test_consolidation(spark):
    spec = O.specification(spark)
    rows = [("assert", "A", "prix_de", "10", "a", "2026-01-01"), ("assert", "B", "date_naissance_de", "1980", "a", "2020-01-01")]
    rows += [("assert", "C", "maire_de", "X", s, "2026-01-01") for s in "abc"] + [("access", "C", "maire_de", "X", None, "2026-01-02")] * 5
    f = W.write_facts(claims(spark, rows), spec)
    got = {r.sujet: r for r in M.consolidate(f, spec, F.lit("2027-06-01").cast("timestamp")).collect()}
    assert got["B"].certitude == pytest.approx(0.55) and got["B"].statut == "dormant" and got["B"].statut_avant == "courant"
    assert got["A"].certitude == pytest.approx(0.55 * 0.5 ** (516 / 45))
    assert got["C"].noyau and got["C"].statut == "courant" and got["C"].certitude >= 0.55
    awake = {r.sujet: r.statut for r in M.recompute_dormancy(M.consolidate(f, spec, F.lit("2026-01-02").cast("timestamp"))).collect()}
    assert awake == {"A": "courant", "B": "dormant", "C": "courant"}


def test_normal_forms(spark):
    rows = [("M. Vasseur",), ("Le Louvre",), ("U.S.A.",), ("William M. Calder",), ("Le",), ("Société  Générale",), ("Jean-Pierre",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(T.norm_name(F.col("x"))).collect()]
    assert got == ["vasseur", "louvre", "usa", "william m calder", "le", "generale", "jean pierre", ""]
    v = spark.createDataFrame([("Éàü  œuvre!",)], "x string").select(T.norm_value(F.col("x")), T.norm_statement(F.lit("L’Été"))).first()
    assert list(v) == ["eau œuvre", "l'ete"]
    d = spark.range(1).select(*[F.date_format(T.parse_date(F.lit(x)), "yyyy-MM-dd") for x in ("2026-05-03", "2026-5", "2026", "98x", "")]).first()
    assert list(d) == ["2026-05-03", "2026-05-01", "2026-01-01", None, None]
    assert spark.range(1).select(T.distinct_homonyms(F.lit("william calder"), F.lit("william calder iii")), T.distinct_homonyms(F.lit("calder"), F.lit("calder iii")), T.is_pronoun(F.lit(" Celui-ci. ")), T.brevity_penalty(F.lit("sg"), F.lit("societe"))).first()[:] == (True, False, True, 0.12)


def test_extraction_rules(spark):
    grid = '<think>hm</think> voici {"faits":[%s]} fin'
    rows = [
        (1, "Anne est entrée chez Corp", grid % '{"sujet":"Corp","predicat":"travaille_pour","objet":"Anne","type_e_sujet":"entreprise","type_e_objet":"personne"}'),
        (2, "il a fondé la maison en 1973", grid % '{"sujet":"il","predicat":"a_fonde","objet":"Maison"}'),
        (3, "Zentra fondée", grid % '{"sujet":"Zentra","predicat":"a_fonde","objet":"1973"}'),
        (4, "Zentra", grid % '{"sujet":"Zentra","predicat":"~Diriger","objet":"Lea"},{"sujet":"V","predicat":"~rapatrier","objet":"W"},{"sujet":"V","predicat":"inconnu","objet":"W"}'),
        (5, "elle a quitté le groupe", grid % '{"sujet":"Lea","predicat":"appartient_a","objet":"CAC"}'),
        (6, "président de 1990 à 1995", grid % '{"sujet":"Lea","predicat":"pdg_de","objet":"Bob"}'),
        (7, "rien", "pas de json"),
    ]
    st = spark.createDataFrame(rows, "id int, texte string, reponse string")
    got = X.derive(X.finalise(X.grids(st), O.specification(spark))).orderBy("id", "pos").collect()
    assert [(r.id, r.sujet, r.predicat, r.objet, r.op) for r in got] == [
        (1, "Anne", "travaille_pour", "Corp", "assert"), (3, "Zentra", "date_fondation_de", "1973", "assert"), (4, "Zentra", "dirige", "Lea", "assert"),
        (4, "V", "rapatrier", "W", "assert"), (5, "Lea", "appartient_a", "CAC", "negate"), (6, "Lea", "dirige", "Bob", "closed_interval"),
    ]
    assert (got[-1].date_debut, got[-1].date_fin) == ("1990", "1995")
    one = X.finalise(X.grids(spark.createDataFrame([(1, "x", '{"sujet":"Lea","predicat":"travaille_pour","objet":"Corp"}'), (2, "x", "rien")], "id int, texte string, reponse string"), several=False), O.specification(spark))
    assert [(r.id, r.pos, r.sujet, r.objet) for r in one.collect()] == [(1, 0, "Lea", "Corp")]
    twice = spark.createDataFrame([(1, 0, "Léa", "dirige", "Corp"), (1, 1, "lea", "dirige", "corp"), (1, 2, "lea", "possede", "corp")], "id int, pos int, sujet string, predicat string, objet string")
    assert [r.pos for r in X.distinct_facts(twice, ["id"]).orderBy("pos").collect()] == [0, 2]


def test_models(spark):
    tries = lambda p, system, t: "no" if t < 0.6 else f'x {{"p": "{p}{system}"}} y'
    q = spark.createDataFrame([("q",), ("q",), ("z",)], "invite string")
    assert sorted(r.reponse for r in L.answered(q, tries, system="s").collect()) == ['{"p": "qs"}', '{"p": "qs"}', '{"p": "zs"}']
    assert {r.reponse for r in L.answered(q, lambda *_: "never", as_json=True).collect()} == {"{}"}
    assert {r.reponse for r in L.answered(q, lambda p, s, t: f"<think>a</think> {p}! ", as_json=False).collect()} == {"q!", "z!"}
    e = L.embedded(spark.createDataFrame([("ab",), (None,), ("",)], "t string"), lambda t: [float(len(t)), 0.0], "t").collect()
    assert [r.embedding for r in e] == [[1.0, 0.0], None, None]
    said = lambda a: spark.range(1).select(L.antecedent(F.lit(a), F.lit("Hier Ada Martin"), F.lit("elle part"))).first()[0]
    assert said('{"statut":"Résolu","entite":"Ada Martin"}') == "Ada Martin" and said('{"statut":"resolu","entite":"Bob Hill"}') is None
    assert said('{"statut":"ambigu","entite":"Ada Martin"}') is None and said('{"statut":"resolu","entite":"elle"}') is None and said("{}") is None
    rows = spark.createDataFrame([(1, '{"verdicts":[{"id":"7","verdict":"utilise"},{"id":"x","verdict":"UTILISE"},{"id":"8","verdict":"?"}]}'), (2, "rien")], "qid int, reponse string")
    assert sorted((r.qid, r.id, r.verdict) for r in L.verdicts_of(rows, ["UTILISE"], "NON_UTILISE").collect()) == [(1, 7, "UTILISE"), (1, 8, "NON_UTILISE")]
    judged = spark.createDataFrame([(1, "q", "r", [(7, "a"), (8, "b")]), (2, "q", "r", [])], "qid int, question string, reponse string, souvenirs array<struct<id:long,contenu:string>>")
    judge = lambda p, s, t: '{"verdicts":[{"id":8,"verdict":"UTILISE"},{"id":9,"verdict":"UTILISE"},{"id":7,"verdict":"NON_UTILISE"}]}'
    assert [tuple(r) for r in L.used(judged, judge).collect()] == [(1, 8)]
    p = spark.range(1).select(L.responder_prompt("A", F.lit("q"), F.lit("b")), L.responder_prompt("B", F.lit("q"), F.lit("b"))).first()
    assert p[0] == "q" and p[1].startswith("Informations :\nb")


def test_inference(spark):
    spec = O.specification(spark)
    schema = "fait_id long, predicat string, sujet_key string, objet_key string, statut string, certitude double, valide_jusqua timestamp"
    rows = [(1, "travaille_pour", "ada", "zentra", "courant", 0.75, None), (2, "dirige", "zentra", "paul", "disputé", 0.6, None), (3, "parent_de", "a", "b", "courant", 0.9, None), (4, "parent_de", "b", "c", "clos", 0.9, day("2020-01-01")), (5, "connait", "b", "d", "courant", 0.9, None)]
    got = {r.predicat: r for r in G.compose(spark.createDataFrame(rows, schema), spec).collect()}
    assert set(got) == {"a_pour_patron", "grand_parent"}
    p, g = got["a_pour_patron"], got["grand_parent"]
    assert (p.src, p.dst, p.statut, p.certitude, p.actif, p.f1, p.f2) == ("ada", "paul", "disputé", 0.6, True, 1, 2)
    assert (g.src, g.dst, g.statut, g.actif, g.valide_jusqua) == ("a", "c", "clos", False, day("2020-01-01"))
    s = spark.range(1).select(G.inferred_label(F.lit("clos")), G.inferred_sentence(F.lit("a_pour_patron"), F.lit("Ada"), F.lit("Léo"), F.lit("courant"))).first()
    assert list(s) == ["inféré (périmé)", "le patron de Ada est Léo"]


@pytest.mark.parametrize("small", [0, 1000])
def test_importance_matches_dense(spark, monkeypatch, small):
    import numpy as np

    monkeypatch.setattr(G, "SMALL_GRAPH", small)

    rng = random.Random(1)
    n = 12
    ents = [(f"e{i}", ["personne", "x"][i % 2]) for i in range(n)]
    rows = []
    for i in range(25):
        a, b = rng.randrange(n - 2), rng.randrange(n - 2)
        if a != b:
            rows.append((f"e{a}", f"e{b}", rng.choice([0.4, 0.9]), rng.choice([0.01, 0.5, 0.9]), [(f"s{rng.randrange(3)}",)]))
    f = spark.createDataFrame(rows, "sujet_key string, objet_key string, poids double, certitude double, provenance array<struct<source_id:string>>")
    got = {r.ent: r.importance for r in G.importance(spark.createDataFrame(ents, "ent string, type string"), f, {"personne": 1.0}, rounds=4).collect()}
    deg, src, a = np.zeros(n), [set() for _ in range(n)], np.zeros((n, n))
    for s, o, w, c, prov in rows:
        i, j = int(s[1:]), int(o[1:])
        deg[i] += 1
        deg[j] += 1
        src[i].add(prov[0][0])
        a[i, j] += w * max(0.05, c)
        a[j, i] += w * max(0.05, c)
    seed = 0.3 * deg / deg.max() + 0.4 * np.array([len(x) for x in src]) / max(len(x) for x in src) + 0.3 * np.array([1.0 if i % 2 == 0 else 0.3 for i in range(n)])
    seed /= seed.sum()
    m = np.column_stack([a[:, j] / a[:, j].sum() if a[:, j].sum() > 0 else seed for j in range(n)])
    pr = seed.copy()
    for _ in range(4):
        pr = 0.85 * m @ pr + 0.15 * seed
        pr /= pr.sum()
    for i in range(n):
        assert got[f"e{i}"] == pytest.approx(pr[i] / pr.max(), abs=1e-9)


def test_resolution_and_merging(spark):
    unit = lambda *v: [float(x / sum(y * y for y in v) ** 0.5) for x in v]
    names = [(1, "Société Zentra", "entreprise", unit(1, 0, 0, 0)), (2, "zentra", None, unit(0, 1, 0, 0)), (3, "Zentra Group", "banque", unit(0, 0, 1, 0)), (4, "Zentra", "ville", unit(0, 0, 0, 1)), (5, "Acme Works", "entreprise", unit(0.2, 0.1, 1, 0.9)), (6, "Akme Workz", "entreprise", unit(0.2, 0.1, 1, 0.92)), (7, "Other Thing", "film", unit(0.2, 0.1, 1, 0.9))]
    df = spark.createDataFrame(names, "id long, nom string, type string, embedding array<double>")
    got = {r.id: r.ent for r in E.resolve(df).collect()}
    assert got[2] == 1 and got[4] == 1 and got[3] == 1 and got[6] == 5 and got[7] == 7
    merged = {r.id: r.leader for r in E.merge_entities(df.filter("id >= 5")).collect()}
    assert merged == {5: 5, 6: 5, 7: 7}
    neigh = [("a", "vx"), ("b", "vx"), ("a", "vy"), ("b", "vy"), ("c", "vx"), ("d", "vz"), ("e", "vz")]
    ents = [("a", "individu"), ("b", "homme"), ("c", "femme"), ("d", "banque"), ("e", "club")]
    r = {x.id: x.leader for x in E.reunite(spark.createDataFrame(neigh, "ent string, nk string"), spark.createDataFrame(ents, "ent string, type string")).collect()}
    assert r == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d"}
    refs = spark.createDataFrame([(1, "calder", "homme"), (2, "smith", None)], "rid int, name string, type string")
    e = spark.createDataFrame([("x", "william calder", "personne"), ("y", "calder hall", "ville"), ("z", "a smith", None), ("w", "b smith", None)], "ent string, name string, type string")
    assert [tuple(x) for x in E.distant_reference(refs, e).collect()] == [(1, "x")]


def test_typology(spark):
    links = [(1, "a", "b", True, True), (2, "b", "a", True, False), (3, "a", "c", False, False), (4, "b", "c", True, False), (5, "d", "a", False, False)]
    got = {r.lid: r for r in G.typology(spark.createDataFrame(links, "lid int, a string, b string, dated boolean, occurrence boolean")).collect()}
    assert [got[i].s1s2 for i in range(1, 6)] == ["ÉPHÉMÈRE", "DURABLE", "DURABLE", "DURABLE", "ÉPHÉMÈRE"]
    assert got[1].s1 == "DURABLE" and got[1].recip_first == "DURABLE" and got[4].naive_date == "ÉPHÉMÈRE" and got[3].deg_sujet == 3


def test_rendering(spark):
    spec = O.specification(spark)
    rows = [("assert", "Ville", "maire_de", "Anne", "a", "2020-01-01"), ("assert", "Ville", "maire_de", "Bob", "b", "2026-05-01", "2026-03"), ("assert", "Cap", "maire_de", "X", "a", "2026-01-01"), ("assert", "Cap", "maire_de", "Y", "b", "2026-02-01")]
    f = W.write_facts(claims(spark, rows), spec).withColumn("pos", F.col("fait_id"))
    lines = [r.ligne for r in R.epistemic_lines(f, O.template_table(spark)).orderBy("grp", "pos").collect()]
    assert lines == [
        "• [CLOS — n'est plus valable depuis 2026-03] Anne était le maire de Ville (de 2020-01 à 2026-03).",
        "• [ACTUEL — incertain, 1 source, dernière confirmation 2026-05] Le maire de Ville est Bob — à revérifier.",
        "• [DISPUTÉ — non tranché] Le maire de Cap : « X » (source a, 2026-01) VS « Y » (source b, 2026-02)",
    ]
    assert f.orderBy("fait_id").select(R.one_liner()).first()[0] == "#1 maire_de(Ville)=Anne | F0.50 C0.55 [clos]"


def test_promotion(spark):
    cols = "fait_id long, predicat string, sujet_key string, objet_key string, valeur_key string, statut string, statut_avant string, certitude double, force double, importance double, compteur_acces long, valide_de timestamp, valide_jusqua timestamp, dernier_acces timestamp, provenance array<struct<source_id:string,date:timestamp,type:string>>"
    d = day("2025-01-01")
    row = lambda i, p, s, v, st, de=d, end=None, c=0.5: (i, p, s, None, v, st, "courant", c, 0.1, 0.0, 0, de, end, d, [("a", d, "rapport")])
    f = spark.createDataFrame([row(1, "produit", "e", "vx", "dormant"), row(2, "produit", "e", "vy", "courant"), row(3, "maire_de", "e", "vz", "dormant"), row(4, "produit", "e", "vw", "dormant", end=d), row(5, "produit", "q", "vx", "dormant")], cols)
    spec = O.specification(spark).select("predicat", "fonctionnel")
    chosen = P.promotable(f, f.filter("fait_id = 2").select("fait_id"), spec)
    assert [r.fait_id for r in chosen.collect()] == [1]
    up = {r.fait_id: r for r in P.promote(f, chosen, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert up[1].statut == "promu" and up[1].force == pytest.approx(0.15) and up[3].statut == "dormant"


def test_scores(spark):
    v = lambda a, st, q=False: spark.range(1).select(S.verdict(F.lit(a), F.lit(st), F.lit("Est-elle qualifiée ?" if q is True else q or None))).first()[0]
    assert v("Elle a quitté le CAC 40", "absent") == "OK" and v("Elle fait partie du CAC", "absent") == "FAUX" and v("Je ne sais pas", "absent") == "REFUS"
    assert v("", "present") == "VIDE" and v("Oui, bien sûr", "present") == "OK" and v("pas qualifié", "present", True) == "FAUX" and v("bla", "present") == "AUTRE"
    assert v("Seule une source non vérifiée le dit : incertain", "incertain") == "OK" and v("Oui l Italie est qualifiée", "incertain") == "FAUX" and v("je ne sais pas", "incertain") == "REFUS"
    assert v("Le CAC vaut environ 8020", "reserve") == "FAUX" and v("8020 fin novembre", "reserve") == "OK" and v("bla", "reserve") == "AUTRE" and v("8 020 points", "historique") == "OK"
    listed = "Quelles sociétés sont entrées au CAC en 2025 ?"
    assert v("Euronext et Eiffage sont entrées", "present", listed) == "OK" and v("Euronext", "present", listed) == "AUTRE" and v("aucune entrée", "present", listed) == "REFUS"
    assert v("no_reply NotSpecified", "absent") == "VIDE" and v("oui", "inconnu") == "AUTRE"
    s = spark.range(1).select(S.strictly_right(F.lit("c'est Bob, avant c'était Anne"), F.lit("Bob"), F.lit("Anne")), S.strictly_right(F.lit("Bob ou Anne"), F.lit("bob"), F.lit("anne"))).first()
    assert list(s) == [True, False]
    assert S.first_crossing(spark.createDataFrame([(60, 0.2), (120, 0.5), (240, 0.6)], "h int, y double"), "h", "y", F.lit(0.4)).first()[0] == 120


def test_snapshots_and_stream(spark, tmp_path):
    spec = O.specification(spark)
    rows = claims(spark, [("assert", "A", "maire_de", "X", "a", "2026-01-01"), ("assert", "A", "maire_de", "X", "b", "2026-01-02"), ("assert", "B", "maire_de", "Y", "a", "2026-01-01"), ("assert", "A", "maire_de", "Z", "c", "2026-03-01", "2026-02")])
    root, log, src = (str(tmp_path / x) for x in ("facts", "log", "in"))
    rows.filter("claim_seq <= 2").write.parquet(src)
    q = fold.stream_claims(spark.readStream.schema(rows.schema).parquet(src), spec, log, root, str(tmp_path / "ck"))
    q.awaitTermination(120)
    rows.filter("claim_seq > 2").write.mode("append").parquet(src)
    q = fold.stream_claims(spark.readStream.schema(rows.schema).parquet(src), spec, log, root, str(tmp_path / "ck"))
    q.awaitTermination(120)
    pick = lambda df: sorted((r.fait_id, r.statut, round(r.certitude, 9)) for r in df.collect())
    assert store.versions(spark, root) == [0, 1]
    assert pick(store.load_buckets(spark, root)) == pick(W.write_facts(rows, spec))
    assert len(pick(store.load_buckets(spark, root, 0))) == 1
    # the second batch touched two subjects and wrote no more
    assert len(pick(store.load_snapshot(spark, root, 1))) <= 3
    store.save_memories(spark.createDataFrame([(1, 0.123456, [1.0])], "id int, confiance double, embedding array<double>"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().confiance == 0.1235
    store.save_report(spark.range(3), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 3
    rows.select("claim_seq", "op", "sujet").write.json(str(tmp_path / "j"))
    assert store.read_claims(spark, str(tmp_path / "j")).filter("sujet = 'A'").count() == 3
    assert store.load_snapshot(spark, str(tmp_path / "none")) is None
