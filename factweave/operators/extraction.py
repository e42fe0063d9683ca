"""From a model's grid to a claim: the deterministic floors and rules (survey T16-T23, I9, I10, I17, S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as T

from .graph import first_of
from .models import Asking

GRID = "struct<sujet:string,predicat:string,objet:string,type_e_sujet:string,type_e_objet:string,polarite:string,modalite:string,temporalite:string,date_debut:string,date_fin:string>"
# Fixed values.
MODALITIES = ["accompli", "projete", "rapporte", "nie_rapporte"]
TEMPORALITIES = ["courant", "debut_seul", "fin_seule", "intervalle_ferme", "occurrence", "sans_date"]


def grids(statements: DataFrame, answer_col: str = "reponse", several: bool = True) -> DataFrame:
    """The JSON answer of a model, one row per fact (pos); reasoning and text around the object are dropped.

    ``several``: the answer lists facts under "faits" (what is no list gives no fact); otherwise it is one fact's grid.
    """
    raw = T.without_reasoning(F.col(answer_col))
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    if several:
        return statements.select("*", F.posexplode(F.from_json(body, f"faits array<{GRID}>")["faits"]).alias("pos", "grille"))
    return statements.withColumns({"pos": F.lit(0), "grille": F.from_json(body, GRID)}).filter("grille IS NOT NULL")


def distinct_facts(axes: DataFrame, by: list[str]) -> DataFrame:
    """Of the facts of a statement (``by``, pos) that are equal by their normal forms the first."""
    keys = {"_s": T.norm_statement(F.col("sujet")), "_o": T.norm_statement(F.col("objet"))}
    return first_of(axes.withColumns(keys), [*by, "_s", "predicat", "_o"], ["pos"]).drop("_s", "_o")


def finalise(rows: DataFrame, spec: DataFrame, text_col: str = "texte", coreference: Asking | None = None) -> DataFrame:
    """T22 on rows with ``grille``: the axes; grids without a known predicate, a subject or an object go, as do pronouns
    that ``coreference`` (see ``models.local_coreference``) does not replace by a name."""
    g = lambda n: F.col("grille")[n]
    text = F.col(text_col)
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    known = spec.select(F.col("predicat").alias("k"), "type_sujet", "type_objet")
    low = lambda n: F.trim(T.norm_statement(F.coalesce(g(n), F.lit(""))))
    r = rows.withColumns({
        "s": blank(g("sujet")), "o": blank(g("objet")), "p": blank(g("predicat")),
        "polarite": F.when((low("polarite") == "niee") | (T.polarity_floor(text) == "niee"), "niee").otherwise("affirmee"),
        "modalite": F.when(T.modality_floor(text).isNotNull(), "projete").when(low("modalite").isin(MODALITIES), low("modalite")).otherwise("accompli"),
        "tf": T.temporality_floor(text), "suite": T.goes_on(text),
        "t0": F.when(low("temporalite").isin(TEMPORALITIES), low("temporalite")).otherwise("sans_date"),
    })
    r = r.withColumns({
        "date_debut": F.coalesce(F.col("tf.start"), T.null_string(g("date_debut"))),
        "date_fin": F.when(~F.col("suite"), F.coalesce(F.col("tf.end"), T.null_string(g("date_fin")))),
        "temporalite": F.when(F.col("suite"), "courant").otherwise(F.coalesce(F.col("tf.form"), F.col("t0"))),
        "verbe": F.when(F.col("p").startswith("~"), F.trim(T.norm_statement(F.expr("substring(p, 2)")))),
    })
    r = r.withColumn("p", F.coalesce(T.lookup(T.RAW_VERBS, F.col("verbe")), F.col("verbe"), F.col("p")))
    # a raw verb that is no predicate stays as it is; a plain predicate has to be known
    r = r.join(F.broadcast(known.select("k").withColumn("connu", F.lit(True))), F.col("p") == F.col("k"), "left").drop("k")
    r = r.filter(F.col("s").isNotNull() & F.col("o").isNotNull() & (F.col("connu") | (F.col("verbe").isNotNull() & (F.col("p") != ""))))
    canon = F.coalesce(T.lookup(T.CANONICAL, F.col("p")), F.col("p"))
    r = r.withColumn("predicat", F.when(F.col("connu"), T.rerouted(canon, F.col("o"))).otherwise(F.col("p")))
    r = r.join(F.broadcast(known), F.col("predicat") == F.col("k"), "left")
    swap = F.coalesce(F.col("connu") & T.swapped(g("type_e_sujet"), g("type_e_objet"), F.col("type_sujet"), F.col("type_objet")), F.lit(False))
    r = r.withColumn("swap", swap)
    pick = lambda a, b: F.when(F.col("swap"), b).otherwise(a)
    kind = lambda c: F.when(c != "", T.norm_statement(c))
    out = r.select(
        *[c for c in rows.columns if c != "grille"],
        pick(F.col("s"), F.col("o")).alias("sujet"), "predicat", pick(F.col("o"), F.col("s")).alias("objet"),
        kind(pick(g("type_e_sujet"), g("type_e_objet"))).alias("type_sujet"), kind(pick(g("type_e_objet"), g("type_e_sujet"))).alias("type_objet"),
        "polarite", "modalite", "temporalite", "date_debut", "date_fin",
    )
    if coreference is not None:
        out = coreference(out)
    return out.filter(~T.is_pronoun(F.col("sujet")) & ~T.is_pronoun(F.col("objet")))


def derive(axes: DataFrame) -> DataFrame:
    """What to do with each fact, and the operation of the claim log that does it."""
    action = (
        F.when(F.col("modalite") != "accompli", "RIEN").when(F.col("polarite") == "niee", "CLOTURE_NIEE")
        .when(F.col("temporalite").isin("intervalle_ferme", "fin_seule"), "FAIT_CLOS").otherwise("COURANT")
    )
    op = F.when(F.col("action") == "CLOTURE_NIEE", "negate").when(F.col("action") == "FAIT_CLOS", "closed_interval").when(F.col("action") == "COURANT", "assert")
    return axes.withColumn("action", action).withColumn("op", op)


def trailing_context(statements: DataFrame, size: int = 3) -> DataFrame:
    """Each statement with the ``size`` before it in its stream (stream, seq, texte)."""
    w = Window.partitionBy("stream").orderBy("seq").rowsBetween(-size, -1)
    return statements.withColumn("contexte", F.array_join(F.collect_list("texte").over(w), "\n"))
