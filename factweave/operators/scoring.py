"""Mechanical evaluation (survey A11-A23, V8r, V9r, P11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import answer_text, strip_accents


def completeness_purity(truth: DataFrame, answered: DataFrame, by: str, item: str) -> DataFrame:
    """Per ``by``: completeness, purity and their harmonic mean, of distinct items."""
    t = truth.select(by, item).distinct().withColumn("t", F.lit(1))
    r = answered.select(by, item).distinct().withColumn("r", F.lit(1))
    j = t.join(r, [by, item], "full")
    g = j.groupBy(by).agg(F.count_if(F.col("t").isNotNull() & F.col("r").isNotNull()).alias("pert"), F.count("t").alias("truth"), F.count("r").alias("ret"))
    c = F.when(F.col("truth") > 0, F.col("pert") / F.col("truth")).otherwise(0.0)
    p = F.when(F.col("ret") > 0, F.col("pert") / F.col("ret")).otherwise(0.0)
    return g.select(by, "truth", "ret", "pert", c.alias("completude"), p.alias("purete"), F.when(c + p > 0, 2 * c * p / (c + p)).otherwise(0.0).alias("f_mesure"))


def recall_at(ranked: DataFrame, by: str, score: str, item: str, relevant: str, k: int) -> DataFrame:
    """Recall at k and precision at the number of relevant ones."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    n = F.sum(F.col(relevant).cast("int")).over(Window.partitionBy(by))
    r = ranked.select(by, F.col(relevant).cast("int").alias("rel"), rank.alias("rank"), n.alias("n"))
    g = r.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias("at_k"), F.sum(F.when(F.col("rank") <= F.col("n"), F.col("rel")).otherwise(0)).alias("at_n"))
    return g.select(by, F.when(F.col("n") > 0, F.col("at_k") / F.col("n")).otherwise(0.0).alias("recall"), F.when(F.col("n") > 0, F.col("at_n") / F.col("n")).otherwise(0.0).alias("precision"))


def confusion(rows: DataFrame, truth: Column, predicted: Column, by: list[str] = ()) -> DataFrame:
    """A13."""
    n = lambda c: F.count_if(c)
    g = rows.groupBy(*by) if by else rows.groupBy()
    return g.agg(n(truth & predicted).alias("tp"), n(~truth & predicted).alias("fp"), n(~truth & ~predicted).alias("tn"), n(truth & ~predicted).alias("fn"), F.avg((truth == predicted).cast("int")).alias("exactitude"))


def accuracy_by(rows: DataFrame, by: list[str], ok: Column) -> DataFrame:
    """A14, A15 (with ok a verdict's test), A18."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ok.cast("int")).alias("taux"))


def attribution(questions: DataFrame) -> DataFrame:
    """Wrong answers: the extractor's if the entity or value was never stored, else the memory's."""
    return questions.filter("NOT ok").withColumn("faute", F.when(F.col("entite_stockee") & F.col("valeur_stockee"), "memoire").otherwise("extracteur"))


def first_crossing(curve: DataFrame, x: str, y: str, reference: Column) -> DataFrame:
    """The smallest x whose y exceeds the reference."""
    return curve.filter(F.col(y) > reference).agg(F.min(x).alias(x))


# What tells an old value as past.
PAST = ["etait", "jusqu", "ancien", "plus le", "auparavant", "avant", "precedent", "anciennement", "fut ", "remplac", "quitt", "succed", "n est plus"]


def strictly_right(answer: Column, right: Column, old: Column) -> Column:
    """V9r: the right value is there, and the old one (null or equal: none) is absent or told as past."""
    a, new, was = answer_text(answer), answer_text(right), answer_text(old)
    return a.contains(new) & (old.isNull() | (was == new) | ~a.contains(was) | says(a, PAST))


def recall_truth(questions: DataFrame, facts: DataFrame, kinds: DataFrame) -> DataFrame:
    """V10r: (qid, fid) of the facts that should come to mind for each question.

    ``facts``: fid, sujet, predicat, objet, profil, clos; ``kinds``: nom, type of entities; ``questions``: qid, type and,
    null or empty where it does not matter, predicat, valeur, ancre, predicats, profils, types_entite, statut. T1 asks
    for current facts with a value; T2 for the facts of an entity, by predicate and by the type of the other end; T3 and
    T3b for facts by predicate, profile and status. All joins are on equal columns.
    """
    f = facts.withColumns({"valeur_n": answer_text(F.col("objet")), "statut_f": F.when(F.col("clos"), "clos").otherwise("courant")})
    any_of = lambda c, x: (F.coalesce(F.size(c), F.lit(0)) <= 0) | F.array_contains(c, x)
    t1 = questions.filter("type = 'T1'").select("qid", "predicat", answer_text(F.col("valeur")).alias("valeur_n")).join(f.filter("NOT clos"), ["predicat", "valeur_n"]).select("qid", "fid")
    ends = f.select("fid", "predicat", F.col("sujet").alias("ancre"), F.col("objet").alias("nom")).union(f.filter("sujet != objet").select("fid", "predicat", "objet", "sujet"))
    t2 = questions.filter("type = 'T2'").select("qid", "ancre", "predicats", "types_entite").join(ends, "ancre").join(kinds, "nom", "left")
    wanted = (F.coalesce(F.size("types_entite"), F.lit(0)) <= 0) | F.coalesce(F.array_contains("types_entite", F.col("type")), F.lit(False))
    t2 = t2.filter(any_of(F.col("predicats"), F.col("predicat")) & wanted).select("qid", "fid")
    t3 = questions.filter("type IN ('T3', 'T3b')").select("qid", F.explode_outer("predicats").alias("predicat"), "profils", "statut")
    t3 = t3.select("qid", "predicat", F.explode_outer("profils").alias("profil"), F.col("statut").alias("statut_f"))
    # a question that leaves something open meets every predicate, profile or status that the facts have
    for c in ("predicat", "profil", "statut_f"):
        open_ones = t3.filter(F.col(c).isNull()).drop(c).withColumn("_", F.lit(0)).join(f.select(c).distinct().withColumn("_", F.lit(0)), "_").drop("_")
        t3 = t3.filter(F.col(c).isNotNull()).unionByName(open_ones)
    t3 = t3.join(f, ["predicat", "profil", "statut_f"]).select("qid", "fid").distinct()
    return t1.unionByName(t2).unionByName(t3)


# What marks an answer as saying absence, presence, denial and affirmation of a qualification, refusal.
ABSENCE = [
    "nappartient plus", "plus partie", "ne fait plus", "nest plus", "est sortie", "a quitte", "quitte le cac", "quittee", "faisait partie", "etait", "[clos", "clos le",
    "no longer", "was part", "not part", "ne fait pas partie", "nest pas dans", "hors de", "retire", "sortie de l", "sortie du cac", "nappartient pas", "ne figure plus",
    "a ete retire", "exited", "plus dans l", "plus membre", "ne fait partie",
]
PRESENCE = [
    "fait partie", "fait toujours partie", "est inclus", "inclus dans", "est membre", "est dans le cac", "est bien dans", "is part", "part of", "currently part",
    "toujours dans", "encore dans", "est presente dans", "figure dans", "est cotee au cac", "appartient a cac", "appartient au cac", "est dans l indice", "indeed part",
]
NOT_QUALIFIED = [
    "not yet qualified", "has not qualified", "nest pas qualifie", "pas encore qualifie", "pas qualifie", "not qualified", "ne sest pas qualifie", "na pas qualifie",
    "nest pas encore", "non qualifie",
]
QUALIFIED = ["est qualifie", "qualifiee pour", "qualifie pour", "is qualified", "has qualified", "participe", "appartient a coupe", "oui"]
REFUSAL = [
    "ne sais pas", "pas d information", "ne dispose", "aucune information", "je ne peux pas", "pas de donnee", "nai pas", "ne connais pas", "pas en mesure", "no record",
    "ne contient", "does not list", "pas de record", "no companies", "aucune societe", "aucune entree",
]
DOUBTED = [
    "revérifier", "reverifier", "incertain", "non confirm", "une seule source", "pas sur", "il sagirait", "conditionnel", "non verifie", "unverified", "unreliable", "blogx",
    "verify with", "not confirmed", "serait", "speculative", "a reverifier", "nest pas encore", "pas officiellement", "nappartient pas",
]
ASSERTED = ["oui l italie est qualifiee", "italie est qualifiee pour", "est bien qualifiee", "est qualifiee pour la coupe"]
RESERVED = [
    "revérifier", "reverifier", "ne sais pas", "ne dispose", "pas de valeur", "novembre", "valait", "a jour", "incertain", "actualis", "ne peux pas", "derniere valeur connue", "2025",
]
ENTERING = ["entre", "integr", "rejoint", "nouvelle"]
ENTRANTS = ["euronext", "eiffage"]
STILL_WORTH = r"(vaut|est de|cote|s'?etablit a|atteint|est a)\s*(environ\s*)?8\s?0?20"
WORTH = r"8\s?0?20"
LOG_NOISE = [
    r"au caractere c:\\[^\n]*?\w+\.ps1:\d+ : \d+", r"\bno_reply\b|\bnotspecified\b|\bremoteexception\b",
    r"stages=workspace:.*?attempt-dispatch:\d+ms@\d+ms", r"\bcategoryinfo\b.*|\bfullyqualifiederrorid\b.*",
]


def says(a: Column, marks: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: a.contains(m))


def spoken(answer: Column) -> Column:
    """An answer as it is classified: no accents, lower case, single spaces, without what a shell leaves in a log."""
    a = F.regexp_replace(strip_accents(F.coalesce(answer, F.lit(""))), r"\s+", " ")
    for noise in LOG_NOISE:
        a = F.regexp_replace(a, noise, " ")
    return F.trim(F.regexp_replace(a, r"\s+", " "))


def verdict(answer: Column, expected: Column, question: Column) -> Column:
    """V8r: OK, FAUX, REFUS, AUTRE or VIDE, for the expected statuses absent, incertain, present, reserve, historique.

    The rules of a status are tried in order. What "present" asks for depends on the question: a qualification, the
    list of entrants, else membership. Any other status gives AUTRE; a null question counts as empty.
    """
    a, q = spoken(answer), strip_accents(F.coalesce(question, F.lit("")))
    silent = F.when(says(a, REFUSAL), "REFUS").otherwise("AUTRE")
    rules = {
        "absent": F.when(says(a, ABSENCE), "OK").when(says(a, PRESENCE), "FAUX").otherwise(silent),
        "incertain": F.when(says(a, NOT_QUALIFIED) | says(a, DOUBTED), "OK").when(says(a, ASSERTED), "FAUX").otherwise(silent),
        "reserve": F.when(a.rlike(STILL_WORTH), "FAUX").when(says(a, RESERVED), "OK").otherwise("AUTRE"),
        "historique": F.when(a.rlike(WORTH), "OK").otherwise(silent),
        "present": F.when(
            q.contains("coupe") | q.contains("qualifie"), F.when(says(a, NOT_QUALIFIED), "FAUX").when(says(a, QUALIFIED), "OK").otherwise(silent)
        )
        .when(
            q.contains("entrees au cac"),
            F.when(says(a, REFUSAL), "REFUS").when(F.forall(F.array(*map(F.lit, ENTRANTS)), lambda m: a.contains(m)) & says(a, ENTERING), "OK").otherwise("AUTRE"),
        )
        .otherwise(F.when(says(a, ABSENCE), "FAUX").when(says(a, PRESENCE) | F.left(a, F.lit(20)).contains("oui"), "OK").otherwise(silent)),
    }
    out = F.when(a == "", "VIDE")
    for status, rule in rules.items():
        out = out.when(expected == status, rule)
    return out.otherwise("AUTRE")


def verdict_counts(rows: DataFrame, by: str, verdict_col: str = "verdict") -> DataFrame:
    """How often each verdict by configuration, and the share of right ones."""
    n = {v.lower(): F.count_if(F.col(verdict_col) == v) for v in ("OK", "FAUX", "REFUS", "AUTRE", "VIDE")}
    return rows.groupBy(by).agg(*[c.alias(k) for k, c in n.items()], (n["ok"] / F.count("*")).alias("part_ok"))


def monthly_confidence(memories: DataFrame, day: str, true: str, confidence: str) -> DataFrame:
    """The mean confidence of true and of stale memories, by month."""
    g = memories.groupBy(F.date_format(day, "yyyy-MM").alias("mois"), F.col(true).alias("vrai"))
    return g.agg(F.count("*").alias("n"), F.avg(confidence).alias("confiance"))


def false_forgets(memories: DataFrame, threshold: float) -> DataFrame:
    """True memories that are archived or below the threshold of archiving. ``memories``: vrai, statut, confiance."""
    lost = F.col("vrai") & ((F.col("statut") == "archive") | (F.col("confiance") < threshold))
    return memories.agg(F.count_if(lost).alias("faux_oublis"), F.count_if(F.col("vrai")).alias("vrais"))


def liars_resisted(facts: DataFrame, planted: DataFrame) -> DataFrame:
    """Planted lies (sujet_key, predicat, vrai, faux: value keys) against which the true fact holds: it is stored,
    and the lie is not or has no greater certainty. Of several facts of a value the first counts."""
    f = facts.groupBy("sujet_key", "predicat", "valeur_key").agg(F.min_by("certitude", "fait_id").alias("c"))
    keys = ["sujet_key", "predicat"]
    true = f.select(*keys, F.col("valeur_key").alias("vrai"), F.col("c").alias("c_vrai"))
    false = f.select(*keys, F.col("valeur_key").alias("faux"), F.col("c").alias("c_faux"))
    j = planted.join(true, [*keys, "vrai"], "left").join(false, [*keys, "faux"], "left")
    holds = F.col("c_vrai").isNotNull() & (F.col("c_faux").isNull() | (F.col("c_vrai") >= F.col("c_faux")))
    return j.select(*planted.columns, holds.alias("resiste"))


def catastrophes(verdicts: DataFrame) -> DataFrame:
    """Stale memories that were confirmed and true ones that were contradicted. ``verdicts``: id, nature (périmé,
    actuel, stable), verdict."""
    v, nature = F.col("verdict"), F.col("nature")
    wrong = ((v == "CONFIRME") & (nature == "périmé")) | ((v == "CONTREDIT") & nature.isin("actuel", "stable"))
    return verdicts.groupBy("nature").agg(F.count_if(wrong).alias("catastrophes"), F.count("*").alias("n"))


def mute_facts(questions: DataFrame) -> DataFrame:
    """Wrong answers by whose fault they are (P11); the memory's are its mute facts."""
    return attribution(questions).groupBy("faute").agg(F.count("*").alias("n"))


#: What marks a refusal in an answer that is not normalised further.
REFUSED = ["pas d'info", "ne dispose", "aucun", "pas trouv", "ne sais", "souvenir concernant", "ne peux pas", "ne peux répondre", "pas en mesure"]


def faithful(answer: Column, wanted: Column, tells: Column) -> Column:
    """struct<fidele, refus>: the answer holds all of ``wanted`` (an array, lower case) and tells it as ``tells``
    says: present (no refusal), past (in the imperfect), any, or absent (a refusal is the faithful answer)."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    refused = says(low, REFUSED)
    has = F.forall(wanted, lambda w: low.contains(w))
    ok = F.when(tells == "absent", refused).when(tells == "present", has & ~refused).when(tells == "past", has & strip_accents(low).contains("etait")).otherwise(has)
    return F.struct(ok.alias("fidele"), refused.alias("refus"))


def evaluation_sample(facts: DataFrame, n: int, seed: int, id_col: str = "fid", changed: str = "change") -> DataFrame:
    """About half changed and half stable facts, ``n`` in all, the same for the same seed. The order is by a hash of
    seed and id, so any number of facts is drawn from without gathering them."""
    rank = F.xxhash64(F.lit(seed), F.col(id_col))
    order = Window.partitionBy(changed).orderBy("rang", id_col)
    top = facts.withColumn("rang", rank)
    halves = [top.filter(F.col(changed)).orderBy("rang", id_col).limit(n // 2), top.filter(~F.col(changed)).orderBy("rang", id_col).limit(n)]
    both = halves[0].unionByName(halves[1]).withColumn("nth", F.row_number().over(order))
    k = F.count_if(F.col(changed)).over(Window.partitionBy())
    return both.withColumn("k", k).filter(F.col(changed) | (F.col("nth") <= n - F.col("k"))).select(*facts.columns, "rang").orderBy("rang").drop("rang")


def status_scores(truth: DataFrame, answered: DataFrame, stale: DataFrame, by: str, item: str) -> DataFrame:
    """A11 with statuses: of the right items, how many are told in the right tense, and how often something that is over
    is told as present. ``truth``: by, item, statut; ``answered``: by, item, statut; ``stale``: item, of all questions."""
    a = answered.dropDuplicates([by, item]).withColumnRenamed("statut", "dit").join(truth.dropDuplicates([by, item]), [by, item], "left")
    a = a.join(stale.select(item).distinct().withColumn("clos", F.lit(True)), item, "left")
    known = F.col("statut").isNotNull()
    false = F.col("dit").eqNullSafe("present") & F.when(known, F.col("statut") == "imparfait").otherwise(F.coalesce("clos", F.lit(False)))
    return a.groupBy(by).agg(F.count_if(known).alias("statut_total"), F.count_if(known & (F.col("dit") == F.col("statut"))).alias("statut_ok"), F.count_if(false).alias("statut_faux"))


def macro_average(scores: DataFrame) -> DataFrame:
    """The mean over all questions of the scores that ``completeness_purity`` gives to each."""
    return scores.agg(*[F.avg(c).alias(c) for c in ("completude", "purete", "f_mesure")])
