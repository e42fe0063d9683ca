"""Consolidation: decay, core, floor, dormancy, learned volatility (survey C1-C9, A3, A4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.plans.ontology import HALF_LIFE, with_specification

from .graph import checkpointed
from .resolution import spread
from .vectors import vector_pairs
from .writing import CERT_LIAR, FORCE_DORMANT, n_sources

# Fixed values.
FORCE_HALF_LIFE, CORE_FACTOR, CORE_SOURCES, CORE_ACCESSES, PROTECTED_SOURCES, FLOOR = 240.0, 2.0, 3, 5, 3, 0.55
DORMANCY_BETA = 0.9
LEARN_K, LEARN_MIN, LEARN_MIN_CLOSED, LEARN_REF, LEARN_HALF_RATE, LEARN_FLOOR, NEVER = 30.0, 12, 3, 730.0, 0.10, 20.0, 1e6


def days(later: Column, earlier: Column) -> Column:
    later, earlier = (c.cast("timestamp") for c in (later, earlier))
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400e6


def halved(value: Column, elapsed: Column, half_life: Column) -> Column:
    return F.when(elapsed > 0, value * F.pow(F.lit(0.5), elapsed / half_life)).otherwise(value)


def decay(facts: DataFrame, spec: DataFrame, as_of: Column, learned: DataFrame | None = None) -> DataFrame:
    """Both axes; the cap on single sources again where the predicate decays."""
    columns = facts.columns
    f = with_specification(facts, spec.select("predicat", "fonctionnel", "volatilite", "objet_entite", "poids", "demivie"))
    if learned is not None:
        f = f.join(F.broadcast(learned.select("predicat", "confiance", "dv")), "predicat", "left")
        f = f.withColumn("demivie", F.when(F.col("confiance") > 0, F.col("dv")).otherwise(F.col("demivie")))
    fac = F.when(F.col("noyau"), CORE_FACTOR).otherwise(1.0)
    cert = halved(F.col("certitude"), days(as_of, F.col("derniere_confirmation")), F.col("demivie") * fac)
    cert = F.when(n_sources(F.col("provenance")) < 2, F.least(cert, F.lit(CERT_LIAR))).otherwise(cert)
    f = f.withColumns({
        "force": halved(F.col("force"), days(as_of, F.col("dernier_acces")), FORCE_HALF_LIFE * fac),
        "certitude": F.when(F.col("demivie").isNull(), F.col("certitude")).otherwise(cert),
    })
    return f.select(*columns)


def core(facts: DataFrame) -> DataFrame:
    """C2."""
    return facts.withColumn("noyau", F.col("noyau") | ((n_sources(F.col("provenance")) >= CORE_SOURCES) & (F.col("compteur_acces") >= CORE_ACCESSES)))


def floor(facts: DataFrame) -> DataFrame:
    """C3."""
    return facts.withColumn("certitude", F.when(n_sources(F.col("provenance")) >= 2, F.greatest("certitude", F.lit(FLOOR))).otherwise(F.col("certitude")))


def dormancy(facts: DataFrame, beta: float = 0.0) -> DataFrame:
    """C4: weak facts sleep and remember their status, unless protected."""
    weak = (F.col("force") < FORCE_DORMANT * (1 - beta * F.col("importance"))) & (F.col("statut") != "dormant")
    sleeps = weak & ~(F.col("noyau") | (n_sources(F.col("provenance")) >= PROTECTED_SOURCES))
    return facts.withColumns({"statut_avant": F.when(sleeps, F.col("statut")).otherwise(F.col("statut_avant")), "statut": F.when(sleeps, "dormant").otherwise(F.col("statut"))})


def decay_and_sleep(facts: DataFrame, spec: DataFrame, as_of: Column, beta: float = 0.0) -> DataFrame:
    """C1, then C4."""
    return dormancy(decay(facts, spec, as_of), beta)


def recompute_dormancy(facts: DataFrame, beta: float = 0.0) -> DataFrame:
    """All wake, then C4 anew."""
    asleep = F.col("statut") == "dormant"
    awake = facts.withColumns({"statut": F.when(asleep, F.coalesce("statut_avant", F.lit("courant"))).otherwise(F.col("statut")), "statut_avant": F.when(asleep, F.lit(None)).otherwise(F.col("statut_avant"))})
    return dormancy(awake, beta)


def learned_volatility(facts: DataFrame, spec: DataFrame) -> DataFrame:
    """A3: per predicate the observed rate of closing, mixed with the prior by how much was seen."""
    a = facts.filter("statut != 'disputé'").groupBy("predicat").agg(F.count("*").alias("n_occ"), F.count_if(F.col("statut") == "clos").alias("n_clos"))
    a = with_specification(a, spec.select("predicat", "fonctionnel", "volatilite", "objet_entite", "poids", "demivie"))
    rate = F.col("n_clos") / F.col("n_occ")
    seen = F.greatest(F.lit(LEARN_FLOOR), LEARN_REF * F.pow(F.lit(0.5), rate / LEARN_HALF_RATE))
    w = F.when((F.col("n_occ") < LEARN_MIN) | (F.col("n_clos") < LEARN_MIN_CLOSED), 0.0).otherwise(F.col("n_occ") / (F.col("n_occ") + LEARN_K))
    mixed = (1 - w) * F.coalesce("demivie", F.lit(NEVER)) + w * seen
    return a.select(
        "predicat", "n_occ", "n_clos",
        F.bround(rate, 3).alias("taux"), F.bround(w, 2).alias("confiance"), F.bround(seen, 1).alias("obs_dv"),
        F.when(mixed < NEVER * 0.5, F.bround(mixed, 1)).alias("dv"),
        F.when(w >= 0.6, "appris").when(w >= 0.15, "mixte").otherwise("supposition").alias("etiquette"),
    )


def _wide(x: Column, n: int, left: bool = True) -> Column:
    """At least ``n`` characters, with blanks before or after; never cut."""
    return F.when(F.length(x) >= n, x).otherwise(F.lpad(x, n, " ") if left else F.rpad(x, n, " "))


def volatility_lines(learned: DataFrame, spec: DataFrame) -> DataFrame:
    """A4: (predicat, n_clos, ligne): what was learnt, as text, for reading in the order of closings (most first)."""
    l = with_specification(learned, spec.select("predicat", "fonctionnel", "volatilite", "objet_entite", "poids", "demivie"))
    span = lambda c: F.when(c.isNull(), "immuable").otherwise(F.format_string("%.0fj", F.bround(c, 0)))
    parts = [_wide(F.col("predicat"), 18, left=False), _wide(F.col("volatilite"), 9), _wide(span(F.col("demivie")), 8), _wide(F.format_string("%.0f%%", F.bround(F.col("taux") * 100, 0)), 5)]
    counts = [_wide(F.col(c).cast("string"), 3) for c in ("n_occ", "n_clos")]
    line = F.format_string("%s prior=%s(%s) taux=%s n_obs=%s clos=%s conf=%.2f → demi-vie=%s [%s]", *parts, *counts, "confiance", _wide(span(F.col("dv")), 8), "etiquette")
    return l.select("predicat", "n_clos", line.alias("ligne")).orderBy(F.desc("n_clos"), "predicat")


def due(events: DataFrame, every: int = 20, order: str = "seq") -> DataFrame:
    """The periodic trigger: ``epoque`` numbers the epochs of ``every`` events; an epoch's last event (``consolide``) is
    followed by a consolidation. ``order`` numbers the events from 1 without gaps, as a log does."""
    nth = F.col(order)
    return events.withColumns({"epoque": F.floor((nth - 1) / every).cast("long"), "consolide": nth % every == 0})


def consolidate(facts: DataFrame, spec: DataFrame, as_of: Column, learn: bool = False, merges: list[Callable] = (), before_dormancy: list[Callable] = (), beta: float = 0.0) -> DataFrame:
    """Stages in order: learning, decay, core, merges, floor, hooks (importance), dormancy."""
    f = core(decay(facts, spec, as_of, learned_volatility(facts, spec) if learn else None))
    for stage in merges:
        f = stage(f)
    f = floor(f)
    for stage in before_dormancy:
        f = stage(f)
    return dormancy(f, beta)


# The flat store of the first generation: verdicts, erosion, archive (C7-C9). Fixed values.
V1_START, V1_CAP, V1_CONFIRM, V1_CONTRADICT, V1_HALF_LIFE, V1_ARCHIVE, V1_SAME = 0.6, 0.99, 0.10, 0.25, 30.0, 0.15, 0.95


def v1_verdict(confidence: Column, verdict: Column) -> Column:
    return F.when(verdict == "CONFIRME", F.least(F.lit(V1_CAP), confidence + V1_CONFIRM)).when(verdict == "CONTREDIT", F.greatest(F.lit(0.0), confidence - V1_CONTRADICT)).otherwise(confidence)


def v1_erosion(memories: DataFrame, as_of: Column, half_life: float = V1_HALF_LIFE) -> DataFrame:
    """Idempotent: the date of erosion moves along."""
    e = days(as_of, F.col("derniere_erosion"))
    return memories.withColumns({"confiance": halved(F.col("confiance"), e, F.lit(half_life)), "derniere_erosion": F.greatest("derniere_erosion", as_of)})


def v1_archive(memories: DataFrame, threshold: float = V1_ARCHIVE) -> DataFrame:
    return memories.withColumn("statut", F.when(F.col("confiance") < threshold, "archive").otherwise(F.col("statut")))


def v1_merge(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """C9's fusion of active memories (id, confiance, confirme, statut) that are near (a, b: a < b, of active ones).

    Ids in order meet the later ones that are still active: of the two the surer stays, then the one confirmed later,
    then the smaller id; the other goes to the archive. A memory that loses goes on meeting the rest of its list, as the
    order of the pairs is fixed when it begins. Components of pairs are folded apart, each by one task.
    """
    live = memories.filter("statut = 'actif'").select("id", "confiance", "confirme")
    side = lambda k: live.select(F.col("id").alias(k), F.col("confiance").alias(f"c_{k}"), F.col("confirme").alias(f"d_{k}"))
    p = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    later = (F.col("c_b") > F.col("c_a")) | ((F.col("c_b") == F.col("c_a")) & (F.col("d_b") > F.col("d_a")))
    p = checkpointed(p.select("a", "b", later.alias("second")))
    rows = p.join(spread(p.select("a", "b")).withColumnRenamed("id", "a"), "a").select("root", "a", "b", "second")
    rows = rows.repartition("root").sortWithinPartitions("root", "a", "b")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gone, first, begun = None, set(), None, False
        for pdf in batches:
            out = []
            for root, a, b, second in pdf.itertuples(index=False):
                if root != now:
                    now, gone, first = root, set(), None
                if a != first:
                    first, begun = a, a not in gone
                if begun and b not in gone:
                    lost, kept = (a, b) if second else (b, a)
                    if lost not in gone:
                        out.append((lost, kept))
                    gone.add(lost)
            yield pd.DataFrame(out, columns=["id", "garde"])

    lost = rows.mapInPandas(fold, "id long, garde long")
    j = memories.join(lost, "id", "left")
    return j.withColumn("statut", F.when(F.col("garde").isNotNull(), "archive").otherwise(F.col("statut"))).select(*memories.columns, "garde")


def v1_consolidate(memories: DataFrame, threshold: float = V1_SAME, archive: float = V1_ARCHIVE) -> DataFrame:
    """The fusion of near memories (``embedding``), then the archive of weak active ones. ``garde``: the memory that
    one lost against."""
    near = vector_pairs(memories.filter("statut = 'actif'"), threshold).select("a", "b")
    merged = v1_merge(memories, near)
    return merged.withColumn("statut", F.when((F.col("statut") == "actif") & (F.col("confiance") < archive), "archive").otherwise(F.col("statut")))


def half_life_of(volatility: Column) -> Column:
    """T26."""
    return F.create_map(*[F.lit(x) for kv in HALF_LIFE.items() for x in kv])[volatility]
