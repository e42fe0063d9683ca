from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factweave import api
from factweave.operators import writing as W
from factweave.plans import ontology as O

from .test_engine import claims


def test_reading_and_editing(spark):
    spec, tpl = O.specification(spark), O.template_table(spark)
    rows = [
        ("assert", "Ada Martin", "travaille_pour", "Zentra", "a", "2026-01-01"), ("assert", "Zentra", "dirige", "Paul Roy", "b", "2026-01-02"),
        ("assert", "Zentra", "siege_de", "Lyon", "a", "2026-01-03"), ("assert", "Orbix", "siege_de", "Paris", "a", "2026-01-04"),
    ]
    f = W.write_facts(claims(spark, rows), spec).withColumn("embedding", F.array(F.col("fait_id").cast("double"), F.lit(0.0)))
    lines, read = api.context(f, spec, tpl, "Où travaille Ada Martin ?", [1.0, 0.0], grammar=True)
    text = [r.ligne for r in lines.collect()]
    assert text[0].startswith("• [ACTUEL — incertain, 1 source, dernière confirmation 2026-01] Ada Martin travaille pour Zentra")
    assert any("INFÉRÉ" in x and "#1 et #2" in x and "le patron de ada martin est paul roy" in x for x in text)
    assert [r.fait_id for r in read.collect()] == [1]
    log = api.accesses(f, read, 5, datetime(2026, 2, 1))
    again = W.write_facts(claims(spark, rows).unionByName(log), spec).filter("fait_id = 1").first()
    assert again.compteur_acces == 1 and again.force == pytest.approx(0.55)
    assert {r.fait_id for r in api.inspect(f, "Zentra").collect()} == {1, 2, 3} and api.inspect(f, 4).first().objet == "Paris"
    assert api.listing(f).count() == 4
    assert {r.vers for r in api.traverse(f, "Zentra").collect()} == {"ada martin", "paul roy"}
    assert api.traverse(f, "Ada Martin", 2).count() == 3
    with pytest.raises(ValueError):
        api.link(spark, spec, 9, "A", "dirige", "B", "", datetime(2026, 1, 1))
    with pytest.raises(ValueError):
        api.link(spark, spec, 9, "A", "inconnu", "B", "s", datetime(2026, 1, 1))
    with pytest.raises(ValueError):
        api.claim(spark, 9, "close", "A", "dirige", "B", "s", datetime(2026, 1, 1))
    assert api.link(spark, spec, 9, "A", "dirige", "B", "s", datetime(2026, 1, 1)).count() == 1


def test_statements_become_facts_and_answers(spark, tmp_path):
    spec, tpl = O.specification(spark), O.template_table(spark)

    def model(prompt, system, temperature):
        if prompt.startswith("Énoncé"):
            who = "Elle" if "Elle" in prompt else "M. Martin" if "M. Martin" in prompt else "Ada Martin"
            where = "Orbix" if "Orbix" in prompt else "Zentra"
            fact = f'{{"sujet":"{who}","predicat":"travaille_pour","objet":"{where}","type_e_sujet":"personne","type_e_objet":"entreprise"}}'
            return "pas encore" if temperature == 0 else f'{{"faits":[{fact},{fact}]}}'
        if "pronom" in prompt:
            return '{"statut":"resolu","entite":"Ada Martin"}' if "Ada Martin" in prompt else '{"statut":"aucun"}'
        if "UTILISE" in prompt:
            return '{"verdicts":[{"id":"1000","verdict":"UTILISE"}]}'
        return "<think>voyons</think> Chez Zentra."

    day = datetime(2026, 1, 1)
    rows = [(1, 1, "Ada Martin travaille pour Zentra depuis 2015.", "a", day), (1, 2, "Elle travaille pour Zentra.", "b", day), (1, 3, "Qui est-ce ?", "b", day), (2, 4, "Elle travaille pour Orbix.", "c", day)]
    st = spark.createDataFrame(rows, "stream long, seq long, texte string, source_id string, date_obs timestamp")
    log = api.write_statements(st, spec, model, gated=True)
    got = sorted((r.claim_seq, r.op, r.sujet, r.objet, r.source_id, r.date_validite) for r in log.collect())
    assert got == [(1000, "assert", "Ada Martin", "Zentra", "a", "2015"), (2000, "assert", "Ada Martin", "Zentra", "b", None)]
    facts = W.write_facts(log, spec)
    assert [(r.fait_id, r.certitude) for r in facts.collect()] == [(1000, 0.75)]
    known = spark.createDataFrame([(1, "Ada Martin", "personne")], "ent long, nom string, type string")
    more = spark.createDataFrame([(3, 5, "M. Martin a quitté Zentra.", "d", day)], st.schema)
    ents = facts.withColumn("sujet_key", F.lit(1).cast("long")).withColumn("objet_key", F.lit(None).cast("long"))
    left = api.write_statements(more, spec, model, facts=ents, entities=known).collect()
    assert [(r.claim_seq, r.op, r.sujet) for r in left] == [(5000, "negate", "Ada Martin")]
    answer, claims_ = api.read(facts, spec, tpl, "Où travaille Ada Martin ?", model, 9000, day, grammar=True)
    a = answer.first()
    assert a.reponse == "Chez Zentra." and a.bloc.startswith("• [ACTUEL — sûr, 2 sources")
    assert sorted((r.claim_seq, r.op, r.cible) for r in claims_.collect()) == [(9000, "access", 1000), (9001, "use", 1000)]
    again = W.write_more(facts, claims_, spec).first()
    assert again.compteur_acces == 1 and again.force == pytest.approx(0.6)


def test_promotion_hook_and_store(spark, tmp_path):
    from factweave.sources import store

    spec = O.specification(spark)
    f = W.write_facts(claims(spark, [("assert", "A", "produit", "x", "a", "2020-01-01"), ("assert", "A", "produit", "y", "a", "2026-01-01")]), spec)
    f = f.withColumns({"statut": F.when(F.col("fait_id") == 1, "dormant").otherwise("courant"), "force": F.when(F.col("fait_id") == 1, 0.01).otherwise(0.5)})
    up = {r.fait_id: r.statut for r in api.promoted(f, f.filter("fait_id = 2").select("fait_id"), spec, F.lit("2026-01-02").cast("timestamp")).collect()}
    assert up == {1: "promu", 2: "courant"}
    root = str(tmp_path / "s")
    assert api.health(spark, root).first().faits == 0
    store.save_buckets(f.withColumn("bucket", F.lit(3)), root, 0)
    assert tuple(api.health(spark, root).first()) == (2, 1)
    api.reset(spark, root)
    assert store.versions(spark, root) == []
