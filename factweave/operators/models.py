"""Steps that ask an injected model, and what is kept of its answers (survey S7, S9, I14-I16, I19, V6r, V7r).

A model is a function of (prompt, system prompt, temperature); an embedding one of a text. Both run in executors, on the
rows that need them, a distinct question once. Every answer is checked against rows before it counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.plans.ontology import with_specification

from .resolution import distant_reference

Model = Callable[[str, str, float], str]
Asking = Callable[[DataFrame], DataFrame]

# Temperatures of the tries of a JSON answer; titles that announce a family name; words that begin a
# description or name a relation; candidates that a model is shown for a reference, and facts of each.
TRIES = [0.0, 0.3, 0.6]
REFERENCE_TITLES = ["m", "mr", "mme", "mlle", "monsieur", "madame", "mademoiselle", "dr", "pr", "me", "sieur"]
DESCRIPTIONS = [
    "le ", "la ", "l'", "les ", "mon ", "ma ", "mes ", "ton ", "ta ", "tes ", "son ", "sa ", "ses ", "notre ", "nos ", "votre ", "vos ", "leur ", "leurs ",
]
RELATIONS = [
    "papa", "maman", "pere", "mere", "fils", "fille", "frere", "soeur", "oncle", "tante", "mari", "femme", "epoux", "epouse", "voisin", "voisine", "patron", "patronne",
    "chef", "cousin", "cousine", "grand-pere", "grand-mere", "beau-pere", "belle-mere",
]
CANDIDATES, ATTESTED = 12, 3
VERDICTS = ["CONFIRME", "CONTREDIT", "NON_UTILISE", "INCERTAIN"]


def as_object(answer: str | None) -> dict | None:
    """The JSON object of an answer, if need be what is between its outermost braces; null if there is none."""
    text = (answer or "").rsplit("</think>", 1)[-1].strip()
    for body in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            found = json.loads(body)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def ask_json(model: Model, prompt: str, system: str = "") -> str:
    """The JSON object of the first try that gives one, each try at a higher temperature; '{}' if none does."""
    for t in TRIES:
        found = as_object(model(prompt, system, t))
        if found is not None:
            return json.dumps(found, ensure_ascii=False)
    return "{}"


def _with_column(rows: DataFrame, name: str, kind: str, make: Callable[[pd.DataFrame], list]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: pd.Series(make(pdf), index=pdf.index, dtype=object)})

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, `{name}` {kind}")


def answered(rows: DataFrame, model: Model, prompt_col: str = "invite", out_col: str = "reponse", system: str = "", as_json: bool = True) -> DataFrame:
    """A model's answer to every row's prompt: JSON as ``ask_json`` says, or free text at temperature 0 without the
    model's reasoning. A distinct prompt of a batch is asked once; an error of the model fails the task."""

    def make(pdf: pd.DataFrame) -> list:
        once: dict[str, str] = {}
        for p in pdf[prompt_col]:
            if p not in once:
                once[p] = ask_json(model, p, system) if as_json else (model(p, system, 0.0) or "").rsplit("</think>", 1)[-1].strip()
        return [once[p] for p in pdf[prompt_col]]

    return _with_column(rows, out_col, "string", make)


def embedded(rows: DataFrame, embed: Callable[[str], list[float]], text_col: str, out_col: str = "embedding") -> DataFrame:
    """Unit vectors of texts, a distinct text of a batch once; null for a null text and for one without direction."""

    def make(pdf: pd.DataFrame) -> list:
        once: dict = {None: None}
        for t in pdf[text_col]:
            if t not in once:
                v = np.asarray(embed(t), np.float32)
                size = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
                once[t] = (v / np.float32(size)).tolist() if size > 0 else None
        return [once[t] for t in pdf[text_col]]

    return _with_column(rows, out_col, "array<float>", make)


# ---- references ----


def _significant(name: Column) -> Column:
    """Words of three letters or more of a name in the form of statements."""
    return F.filter(F.regexp_extract_all(T.norm_statement(name), F.lit(T.any_of(r"\w+")), F.lit(0)), lambda t: F.length(t) >= 3)


def antecedent(answer: Column, context: Column, text: Column) -> Column:
    """I16: the name in a model's answer {statut, entite}, if it is resolved, no pronoun, and said in the context or text."""
    found = F.from_json(answer, "statut string, entite string")
    name = F.trim(found["entite"])
    said = T.norm_statement(F.concat_ws(" ", context, text))
    words = _significant(name)
    ok = (F.trim(T.norm_statement(found["statut"])) == "resolu") & (name != "") & ~T.is_pronoun(name) & (F.size(words) > 0) & F.forall(words, lambda w: said.contains(w))
    return F.when(ok, name)


def local_coreference(model: Model, system: str = "", context_col: str = "contexte", text_col: str = "texte") -> Asking:
    """I16 as a step of ``extraction.finalise``: a pronoun as subject or object becomes the named antecedent that the model
    finds in the sentences before; what is not found stays a pronoun. Rows without context are left alone."""

    def step(rows: DataFrame) -> DataFrame:
        out = rows
        for end, role in (("sujet", "sujet"), ("objet", "objet")):
            asks = F.coalesce((F.col(context_col) != "") & T.is_pronoun(F.col(end)), F.lit(False))
            prompt = F.format_string("CONTEXTE :\n%s\n\nPHRASE : « %s »\n\nLe pronom « %s » (position " + role + ") renvoie à quelle entité nommée ?", context_col, text_col, end)
            out = out.withColumn("_asks", asks)
            plain = out.filter("NOT _asks").drop("_asks")
            asked = answered(out.filter("_asks").drop("_asks").withColumn("_invite", prompt), model, "_invite", "_reponse", system)
            name = F.coalesce(antecedent(F.col("_reponse"), F.col(context_col), F.col(text_col)), F.col(end))
            out = plain.unionByName(asked.withColumn(end, name).drop("_invite", "_reponse"))
        return out

    return step


def ranked_candidates(refs: DataFrame, entities: DataFrame, facts: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """A10: (rid, ent, nom, rang): entities that a reference (rid, name, type) can mean, those with most facts first.

    ``entities``: ent, nom, name (normalised), type. With a type of a known family only entities of that family count,
    and none of the reference's own name. The ``most`` best of a family are ranked once, not once a reference.
    """
    inc = facts.select(F.col("sujet_key").alias("ent"), "fait_id").union(facts.filter("objet_key IS NOT NULL").select("objet_key", "fait_id")).distinct()
    e = entities.join(inc.groupBy("ent").agg(F.count("*").alias("n")), "ent", "left").select("ent", "nom", "name", T.family(F.col("type")).alias("fam"), F.coalesce("n", F.lit(0)).alias("n"))
    # one more than are shown, as the reference's own name does not count
    best = lambda part: F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("n"), "ent"))
    top = e.filter("fam IS NOT NULL").withColumn("k", best(["fam"])).filter(F.col("k") <= most + 1).unionByName(e.orderBy(F.desc("n"), "ent").limit(most + 1).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "ent"))).withColumn("fam", F.lit("*")))
    r = refs.select("rid", F.col("name").alias("own"), F.coalesce(T.family(F.col("type")), F.lit("*")).alias("fam"))
    j = r.join(top, "fam").filter("name != own").withColumn("rang", F.row_number().over(Window.partitionBy("rid").orderBy("k")))
    return j.filter(F.col("rang") <= most).select("rid", "ent", "nom", "rang")


def distant_references(refs: DataFrame, entities: DataFrame, facts: DataFrame, model: Model | None = None, system: str = "") -> DataFrame:
    """(rid, ent) of references (rid, ref, type) that stand for exactly one known entity.

    A reference is resolved once however often it occurs: equal ones (text and type) share a question. A title and a
    family name mean the one entity of a compatible family whose name has all of its words; a description or a word of
    kinship is put to the model with the best candidates, and its answer counts if it is one of them. Anything else
    stays as it is. ``entities``: ent, nom, type.
    """
    once = refs.groupBy("ref", "type").agg(F.min("rid").alias("rid0"))
    low = F.trim(T.norm_statement(F.col("ref")))
    words = F.split(low, r"\s+")
    head = F.regexp_replace(F.get(words, F.lit(0)), r"\.", "")
    once = once.withColumns({"low": low, "words": words, "titled": head.isin(REFERENCE_TITLES)})
    family_name = F.filter(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda w: F.length(w) >= 3)
    named = once.filter("titled").select(F.col("rid0").alias("rid"), F.array_join(family_name, " ").alias("name"), "type").filter("name != ''")
    known = entities.select("ent", "nom", F.trim(T.norm_statement(F.col("nom"))).alias("name"), "type")
    by_name = distant_reference(named, known)
    found = by_name.select("rid", "ent")
    if model is not None:
        describes = F.col("low").isNotNull() & (F.exists(F.array(*map(F.lit, DESCRIPTIONS)), lambda d: F.startswith(F.col("low"), d)) | F.get("words", F.lit(0)).isin(RELATIONS))
        asked = once.filter(~F.col("titled") & describes).select(F.col("rid0").alias("rid"), F.col("low").alias("name"), "type", "ref")
        shown = ranked_candidates(asked, known, facts)
        about = facts.withColumn("k", F.row_number().over(Window.partitionBy("sujet_key").orderBy("fait_id"))).filter(F.col("k") <= ATTESTED)
        about = about.groupBy(F.col("sujet_key").alias("ent")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fait_id", F.concat("predicat", F.lit("="), "objet").alias("x")))), lambda s: s["x"]), ", ").alias("about"))
        line = F.concat(F.col("rang").cast("string"), F.lit(". "), "nom", F.lit(" — "), F.coalesce("about", F.lit("peu attesté")))
        menu = shown.join(about, "ent", "left").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rang", line.alias("line")))).alias("menu"))
        prompts = asked.join(menu, "rid").select("rid", F.concat(F.lit("RÉFÉRENCE : « "), "ref", F.lit(" »\n\nENTITÉS CONNUES :\n"), F.array_join("menu.line", "\n"), F.lit("\n\nÀ qui renvoie la référence, de façon unique et certaine ?")).alias("invite"))
        said = F.from_json("reponse", "statut string, entite string")
        told = answered(prompts, model, system=system).select("rid", F.trim(said["entite"]).alias("nom"), F.trim(T.norm_statement(said["statut"])).alias("statut")).filter("statut = 'resolu'")
        found = found.unionByName(told.join(shown, ["rid", "nom"]).select("rid", "ent").dropDuplicates(["rid"]))
    same = F.col("o.ref").eqNullSafe(F.col("r.ref")) & F.col("o.type").eqNullSafe(F.col("r.type"))
    every = refs.alias("r").join(once.select("ref", "type", "rid0").alias("o"), same).select("r.rid", "rid0")
    return every.join(found.withColumnRenamed("rid", "rid0"), "rid0").select("rid", "ent")


# ---- judges ----

_VERDICTS = "verdicts array<struct<id:string,verdict:string,justification:string>>"


def verdicts_of(rows: DataFrame, allowed: list[str], otherwise: str, answer_col: str = "reponse") -> DataFrame:
    """One row for each verdict in a judge's answer: (columns of ``rows`` but the answer, id, verdict, justification).

    A verdict without a whole number as id is left out, one that is not ``allowed`` becomes ``otherwise``; of several
    for one id the last counts.
    """
    keep = [c for c in rows.columns if c != answer_col]
    v = rows.withColumn("v", F.from_json(answer_col, _VERDICTS)["verdicts"]).select(*keep, F.posexplode("v").alias("pos", "v"))
    said = F.trim(F.upper(F.coalesce("v.verdict", F.lit(""))))
    v = v.select(*keep, "pos", F.expr("try_cast(trim(v.id) AS bigint)").alias("id"), F.when(said.isin(allowed), said).otherwise(otherwise).alias("verdict"), F.trim(F.coalesce("v.justification", F.lit(""))).alias("justification"))
    return v.filter("id IS NOT NULL").groupBy(*keep, "id").agg(F.max_by(F.struct("verdict", "justification"), "pos").alias("x")).select(*keep, "id", "x.verdict", "x.justification")


def judge_prompt(question: Column, answer: Column, memories: Column, confidence: bool = True) -> Column:
    """V6r: what a judge is asked. ``memories``: array<struct<id, contenu, confiance, confirme>>."""

    def line(m):
        day = F.date_format(m["confirme"], "yyyy-MM-dd")
        meta = F.format_string("confiance %.2f, màj %s", m["confiance"], day) if confidence else F.concat(F.lit("màj "), day)
        return F.concat(F.lit("#"), m["id"].cast("string"), F.lit(" ("), meta, F.lit(") : "), m["contenu"])

    lines = F.array_join(F.transform(memories, line), "\n")
    return F.concat(F.lit("QUESTION : "), question, F.lit("\n\nRÉPONSE FOURNIE : "), answer, F.lit("\n\nSOUVENIRS À VÉRIFIER :\n"), lines, F.lit("\n\nRends ton verdict pour chaque souvenir, en JSON strict."))


def conflict_beats_usage(memories: DataFrame, conflicts: DataFrame, usages: DataFrame, by: str = "qid") -> DataFrame:
    """V6r, the split judge: a memory (by, id) that conflicts is contradicted, else one that was used is confirmed, else
    it was not used. ``conflicts``, ``usages``: (by, id, verdict); a memory without a verdict is neither."""
    c = conflicts.select(by, "id", F.col("verdict").alias("conflit"))
    u = usages.select(by, "id", F.col("verdict").alias("usage"))
    j = memories.select(by, "id").join(c, [by, "id"], "left").join(u, [by, "id"], "left")
    j = j.withColumns({"conflit": F.coalesce("conflit", F.lit("RAS")), "usage": F.coalesce("usage", F.lit("NON_UTILISE"))})
    v = F.when(F.col("conflit") == "CONTREDIT", "CONTREDIT").when(F.col("usage") == "UTILISE", "CONFIRME").otherwise("NON_UTILISE")
    return j.withColumn("verdict", v)


def usage_prompt(question: Column, answer: Column, memories: Column) -> Column:
    """Which of the memories (array<struct<id, contenu>>) an answer used."""
    lines = F.array_join(F.transform(memories, lambda m: F.concat(F.lit("#"), m["id"].cast("string"), F.lit(" : "), m["contenu"])), "\n")
    return F.concat(F.lit("QUESTION : "), question, F.lit("\n\nRÉPONSE : "), answer, F.lit("\n\nSOUVENIRS :\n"), lines, F.lit("\n\nPour CHAQUE souvenir, réponds UTILISE ou NON_UTILISE, en JSON strict."))


def used(rows: DataFrame, model: Model, system: str = "") -> DataFrame:
    """(qid, id) of the memories that a judge finds used. ``rows``: qid, question, reponse, souvenirs."""
    asked = rows.filter(F.size("souvenirs") > 0).select("qid", usage_prompt(F.col("question"), F.col("reponse"), F.col("souvenirs")).alias("invite"), F.col("souvenirs.id").alias("ids"))
    said = verdicts_of(answered(asked, model, out_col="juge", system=system).drop("invite"), ["UTILISE", "NON_UTILISE"], "NON_UTILISE", "juge")
    return said.filter((F.col("verdict") == "UTILISE") & F.array_contains("ids", F.col("id"))).select("qid", "id")


def responder_prompt(kind: str, question: Column, block: Column) -> Column:
    """V7r: the prompt of a responder: A (the model alone), B (plain lines), C (lines with date and confidence, or, as
    C_verbal, with a word of doubt); ``block``: the lines that ``rendering.memory_block`` makes."""
    if kind == "A":
        return question
    title = {"B": "Informations", "C": "Souvenirs", "C_verbal": "Souvenirs"}[kind]
    return F.concat(F.lit(f"{title} :\n"), block, F.lit("\n\nQuestion : "), question, F.lit("\nRéponse :"))
