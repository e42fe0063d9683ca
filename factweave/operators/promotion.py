"""Retroactive promotion of dormant facts that a new fact makes relevant (survey N11-N13), once an epoch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dot, fanout
from .writing import CERT_SURE, FORCE_CAP, FORCE_DORMANT, FORCE_GAIN, n_sources

# Fixed values.
SIMILAR = 0.60
ACTIVE = ("courant", "disputé", "promu")


def candidates(facts: DataFrame, triggers: DataFrame, cap: int = 64) -> DataFrame:
    """Rows of ``facts`` that are dormant, in the bounded neighbourhood of a trigger, and relevant to it, once each.

    ``triggers``: fait_id of new facts. Relevant: the same predicate, or linking both ends, or (with an ``embedding``
    column) similar by ``SIMILAR``.
    """
    has_vec = "embedding" in facts.columns
    vec = ["embedding"] if has_vec else []
    t = facts.join(triggers, "fait_id", "left_semi").select(F.col("fait_id").alias("tid"), F.col("predicat").alias("tp"), F.col("sujet_key").alias("ts"), F.col("objet_key").alias("to"), *[F.col(c).alias("tv") for c in vec])
    ends = t.withColumn("ent", F.explode(F.array_compact(F.array("ts", "to"))))
    near = ends.join(fanout(facts, cap).select("ent", "fait_id"), "ent").drop("ent").distinct()
    c = near.join(facts.filter("statut = 'dormant'").select("fait_id", "predicat", "sujet_key", "objet_key", *vec), "fait_id").filter("fait_id != tid")
    pair = F.array_sort(F.array("ts", "to")) == F.array_sort(F.array("sujet_key", "objet_key"))
    relevant = (F.col("predicat") == F.col("tp")) | F.coalesce(F.col("to").isNotNull() & F.col("objet_key").isNotNull() & pair, F.lit(False))
    if has_vec:
        relevant = relevant | (dot(F.col("embedding"), F.col("tv")) >= SIMILAR)
    return facts.join(c.filter(relevant).select("fait_id").distinct(), "fait_id", "left_semi")


def promotable(facts: DataFrame, triggers: DataFrame, functional: DataFrame, cap: int = 64) -> DataFrame:
    """(fait_id): the candidates that pass the guardrails (N12). ``functional``: predicat, fonctionnel.

    A fact with an end never passes, one of a multi-valued predicate always. Of a functional key the candidates are
    taken in order of creation: one fails if another value of the key is active and at least as recent, or sure and of
    two sources; one that passes is active for those after it. So a key's candidates are folded by one task, which holds
    one date for each value that has passed.
    """
    c = candidates(facts, triggers, cap).filter("valide_jusqua IS NULL").join(F.broadcast(functional.select("predicat", "fonctionnel")), "predicat", "left")
    c = c.withColumn("ns", n_sources(F.col("provenance"))).select("fait_id", "sujet_key", "predicat", "valeur_key", "valide_de", "certitude", "ns", F.coalesce("fonctionnel", F.lit(False)).alias("fonctionnel"))
    free = c.filter("NOT fonctionnel").select("fait_id")
    active = facts.filter(F.col("statut").isin(*ACTIVE)).select("sujet_key", "predicat", F.col("valeur_key").alias("vk"), F.col("valide_de").alias("vd"), "certitude", n_sources(F.col("provenance")).alias("ns"))
    bound = c.filter("fonctionnel")
    blocked = bound.drop("certitude", "ns").join(active, ["sujet_key", "predicat"]).filter("vk != valeur_key AND (vd >= valide_de OR (certitude >= 0.6 AND ns >= 2))").select("fait_id")
    left = bound.join(blocked, "fait_id", "left_anti")
    taken = left.repartition("sujet_key", "predicat").sortWithinPartitions("sujet_key", "predicat", "fait_id").mapInPandas(_guarded, "fait_id long")
    return free.unionByName(taken)


def _guarded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of functional keys in order: those that no value promoted before them blocks."""
    now, up = None, {}
    for pdf in batches:
        out = []
        for fid, subject, predicate, value, start, certainty, n, _ in pdf.itertuples(index=False):
            if (subject, predicate) != now:
                now, up = (subject, predicate), {}
            if any(v != value and (since >= start or sure) for v, (since, sure) in up.items()):
                continue
            sure = certainty >= CERT_SURE and n >= 2
            before = up.get(value)
            up[value] = (start, sure) if before is None else (max(before[0], start), sure or before[1])
            out.append(fid)
        yield pd.DataFrame({"fait_id": pd.Series(out, dtype="int64")})


def promote(facts: DataFrame, chosen: DataFrame, when, beta: float = 0.0) -> DataFrame:
    """Access, force at least at the line of dormancy, status promu."""
    f = facts.join(chosen.select("fait_id", F.lit(True).alias("up")), "fait_id", "left")
    up = F.coalesce("up", F.lit(False))
    line = FORCE_DORMANT * (1 - beta * F.col("importance"))
    return f.withColumns({
        "force": F.when(up, F.greatest(F.least(F.lit(FORCE_CAP), F.col("force") + FORCE_GAIN), line)).otherwise(F.col("force")),
        "compteur_acces": F.col("compteur_acces") + F.when(up, 1).otherwise(0),
        "dernier_acces": F.when(up, when).otherwise(F.col("dernier_acces")),
        "statut": F.when(up, "promu").otherwise(F.col("statut")),
        "statut_avant": F.when(up, F.lit(None)).otherwise(F.col("statut_avant")),
    }).select(*facts.columns)
