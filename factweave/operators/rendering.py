"""Facts as text: one-liners, epistemic lines, memory lines (survey T27, A9, V1r-V5r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.plans.ontology import said, sentence

from .writing import CERT_SURE, n_sources


# Fixed values below: the wording of the lines.
def month(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("?"))


def one_liner(f: str = "") -> Column:
    """T27."""
    c = lambda n: F.col(f + n)
    return F.format_string("#%d %s(%s)=%s | F%.2f C%.2f [%s]", c("fait_id"), c("predicat"), c("sujet"), c("objet"), c("force"), c("certitude"), c("statut"))


def epistemic_lines(facts: DataFrame, templates: DataFrame, promoted: bool = False) -> DataFrame:
    """V1r, A9: (grp, pos, ligne). Facts keep their order (``pos``); disputed ones are one line a subject and predicate,
    after all others, in order of first appearance."""
    f = facts.join(F.broadcast(templates), "predicat", "left").withColumn("sujet_nom", F.coalesce("sujet", F.lit("?")))
    n = n_sources(F.col("provenance"))
    src = F.when(n < 2, "1 source").otherwise(F.concat(n.cast("string"), F.lit(" sources")))
    conf, since, until = month(F.col("derniere_confirmation")), month(F.col("valide_de")), month(F.col("valide_jusqua"))
    effective = F.when(F.col("statut") == "dormant", F.col("statut_avant")).otherwise(F.col("statut"))
    now, past = sentence(F.lit(False)), sentence(F.lit(True))
    line = F.when(effective == "clos", F.concat(F.lit("• [CLOS — n'est plus valable depuis "), until, F.lit("] "), past, F.lit(" (de "), since, F.lit(" à "), until, F.lit(").")))
    if promoted:
        line = line.when(effective == "promu", F.concat(F.lit("• [PROMU — dormant redevenu pertinent, "), src, F.lit(", dernière confirmation "), conf, F.lit("] "), now, F.lit(".")))
    line = line.when(F.col("certitude") >= CERT_SURE, F.concat(F.lit("• [ACTUEL — sûr, "), src, F.lit(", confirmé "), conf, F.lit("] "), now, F.lit("."))).otherwise(
        F.concat(F.lit("• [ACTUEL — incertain, "), src, F.lit(", dernière confirmation "), conf, F.lit("] "), now, F.lit(" — à revérifier."))
    )
    plain = f.filter("statut != 'disputé'").select(F.lit(0).alias("grp"), "pos", line.alias("ligne"))
    part = F.concat(F.lit("« "), F.col("objet"), F.lit(" » (source "), F.coalesce(F.get(F.col("provenance.source_id"), F.lit(0)), F.lit("?")), F.lit(", "), since, F.lit(")"))
    d = f.filter("statut = 'disputé'").groupBy("sujet_key", "predicat").agg(
        F.min("pos").alias("pos"), F.first("sujet_nom").alias("sujet_nom"), F.first("grp").alias("tpl"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))), lambda x: x["p"]), " VS ").alias("parts"),
    )
    title = said(F.coalesce("tpl", F.lit("{s}")), F.col("sujet_nom"), F.lit(""))
    disputed = d.select(F.lit(1).alias("grp"), "pos", F.concat(F.lit("• [DISPUTÉ — non tranché] "), title, F.lit(" : "), "parts").alias("ligne"))
    return plain.unionByName(disputed)


def memory_line(text: Column, confidence: Column, confirmed: Column, mode: str = "verbal", doubt: float = 0.25) -> Column:
    """V5r: the first generation's lines: with the number, plain, or with a word of doubt."""
    dated = F.concat(F.lit("- "), text, F.lit(" (confirmé "), F.date_format(confirmed, "yyyy-MM-dd"))
    if mode == "numeric":
        return F.concat(dated, F.format_string(", confiance %.2f)", confidence))
    if mode == "plain":
        return F.concat(F.lit("- "), text)
    return F.concat(dated, F.when(confidence < doubt, ", à confirmer)").otherwise(")"))


def memory_block(memories: DataFrame, by: str, order: list, mode: str = "verbal") -> DataFrame:
    """V5r, V7r: (by, bloc): the lines of the memories found for each question, in order. ``mode``: numeric (with the
    confidence), plain, or verbal. ``memories``: by, id, contenu, confiance, confirme, and the columns of ``order``."""
    text, conf, seen = F.col("contenu"), F.col("confiance"), F.col("confirme")
    line = memory_line(text, conf, seen, mode)
    if mode == "numeric":
        line = F.concat(F.lit("[#"), F.col("id").cast("string"), F.format_string(" | confiance %.2f", conf), F.lit(" | màj "), F.date_format(seen, "yyyy-MM-dd"), F.lit("] "), text)
    g = memories.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("ligne")))).alias("x"))
    return g.select(by, F.array_join("x.ligne", "\n").alias("bloc"))


def write_summary(report: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_seq, action, faits): what a write did, with a line for each fact that it touched, in its order."""
    lines = facts.select("fait_id", one_liner().alias("ligne"))
    touched = report.select("claim_seq", F.posexplode("touches").alias("pos", "fait_id")).join(lines, "fait_id")
    told = touched.groupBy("claim_seq").agg(F.array_sort(F.collect_list(F.struct("pos", "ligne"))).alias("x"))
    return report.select("claim_seq", "action").join(told.select("claim_seq", F.col("x.ligne").alias("faits")), "claim_seq", "left").withColumn("faits", F.coalesce("faits", F.array().cast("array<string>")))


def inferred_line(f1: Column, f2: Column, phrase: Column) -> Column:
    """V2r."""
    return F.concat(F.lit("• [INFÉRÉ — DÉDUCTION, jamais un fait observé · en reliant #"), f1.cast("string"), F.lit(" et #"), f2.cast("string"), F.lit("] il semblerait que "), F.lower(phrase), F.lit("."))
