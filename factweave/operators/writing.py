"""The write fold: an ordered log of claims becomes the facts of each (subject, predicate) (survey I1-I13, I18).

Claims are dealt by key and sorted within partitions; one pass then folds each key in claim order. A task holds the
facts of one key at a time, never the claims of a key, so a key with many claims streams through. A fact's id is the
``claim_seq`` of the claim that made it, which keeps the order of creation without a global counter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import norm_name, norm_value, parse_date
from factweave.plans.ontology import with_specification

# Force and certainty.
FORCE_INIT, FORCE_GAIN, FORCE_CAP, FORCE_DORMANT = 0.5, 0.05, 0.99, 0.15
CERT_INIT, CERT_GAIN, CERT_CAP, CERT_LIAR, CERT_DISPUTE, CERT_SURE = 0.55, 0.20, 0.95, 0.60, 0.10, 0.6

#: Columns of a claim; all but claim_seq, op, sujet, predicat, source_id and date_obs may be absent.
CLAIM = {
    "claim_seq": "long", "op": "string", "sujet": "string", "predicat": "string", "objet": "string", "source_id": "string",
    "date_obs": "timestamp", "date_validite": "string", "date_fin": "string", "type_sujet": "string", "type_objet": "string", "cible": "long",
}

FACTS = (
    "fait_id long, sujet_key string, sujet string, predicat string, objet string, objet_key string, valeur_key string, force double, certitude double, "
    "provenance array<struct<source_id:string,date:timestamp,type:string>>, valide_de timestamp, valide_jusqua timestamp, date_creation timestamp, "
    "dernier_acces timestamp, derniere_confirmation timestamp, derniere_contradiction timestamp, statut string, statut_avant string, compteur_acces long, "
    "noyau boolean, importance double, type_sujet string, type_objet string"
)
REPORT = "claim_seq long, action string, touches array<long>"


def _moment(x):
    return x.to_pydatetime() if isinstance(x, pd.Timestamp) else x


@dataclass
class Fact:
    fait_id: int
    objet: str
    valeur_key: str
    valide_de: datetime
    seen: datetime
    source: str
    statut: str
    force: float = FORCE_INIT
    certitude: float = CERT_INIT
    valide_jusqua: datetime | None = None
    contradiction: datetime | None = None
    avant: str | None = None
    acces: int = 0
    noyau: bool = False
    importance: float = 0.0
    provenance: list = field(default_factory=list)

    def __post_init__(self):
        self.provenance = [(self.source, self.seen, "rapport")]
        self.creation = self.dernier_acces = self.confirmation = self.seen
        self.cap()

    @classmethod
    def stored(cls, x: dict) -> Fact:
        """A fact as it was written, whatever consolidation, merging or promotion has made of it since."""
        f = cls(x["fait_id"], x["objet"], x["valeur_key"], x["valide_de"], x["date_creation"], "", x["statut"])
        f.force, f.certitude, f.valide_jusqua, f.contradiction = x["force"], x["certitude"], x["valide_jusqua"], x["derniere_contradiction"]
        f.avant, f.acces, f.noyau, f.importance = x["statut_avant"], x["compteur_acces"], x["noyau"], x["importance"]
        f.dernier_acces, f.confirmation = x["dernier_acces"], x["derniere_confirmation"]
        f.provenance = [(p["source_id"], _moment(p["date"]), p["type"]) for p in x["provenance"]]
        return f

    def reports(self) -> int:
        return len({s for s, _, t in self.provenance if t == "rapport"})

    def sources(self) -> set:
        return {s for s, _, _ in self.provenance}

    def cap(self) -> None:
        if self.reports() < 2:
            self.certitude = min(self.certitude, CERT_LIAR)


class Key:
    """The facts of one subject and predicate, in order of creation."""

    def __init__(self, functional: bool):
        self.functional = functional
        self.facts: dict[int, Fact] = {}

    def claim(self, seq, obj, value, source, seen, explicit) -> tuple[str, list[Fact]]:
        start = explicit or seen
        same = next((f for f in self.facts.values() if f.valeur_key == value), None)
        if same is not None:
            same.confirmation = seen
            if source in same.sources():
                same.force = min(FORCE_CAP, same.force + FORCE_GAIN)
                return "repetition", [same]
            same.certitude = min(CERT_CAP, same.certitude + CERT_GAIN)
            same.provenance.append((source, seen, "rapport"))
            same.cap()
            if same.statut == "disputé" and same.certitude >= CERT_SURE and same.reports() >= 2:
                same.statut = "courant"
                return "corroboration_courant", [same]
            return "corroboration", [same]
        active = [f for f in self.facts.values() if f.statut in ("courant", "disputé")] if self.functional else []
        if not active:
            return ("creation" if self.functional else "ajout"), [self._add(seq, obj, value, source, seen, start, "courant")]
        held = max(active, key=lambda f: f.valide_de)
        others = held.sources()
        held.contradiction = seen
        newer = explicit is not None and explicit > held.valide_de
        if newer and (source not in others or held.certitude < CERT_SURE):
            held.valide_jusqua, held.statut = start, "clos"
            return "cloture", [held, self._add(seq, obj, value, source, seen, start, "courant")]
        corroborated = held.certitude >= CERT_SURE and len(others) >= 2
        held.statut = "disputé"
        if corroborated:
            held.certitude = max(0.0, held.certitude - CERT_DISPUTE)
        return ("dispute_corrobore" if corroborated else "dispute"), [held, self._add(seq, obj, value, source, seen, start, "disputé")]

    def _add(self, seq, obj, value, source, seen, start, statut) -> Fact:
        f = self.facts[seq] = Fact(seq, obj, value, start, seen, source, statut)
        return f

    def close(self, f: Fact, source, end) -> None:
        f.valide_jusqua, f.statut, f.contradiction = end, "clos", end
        f.provenance.append((source, end, "cloture"))

    def contest(self, f: Fact, source, seen) -> None:
        f.statut, f.contradiction = "disputé", seen
        f.certitude = max(0.0, f.certitude - CERT_DISPUTE)
        f.provenance.append((source, seen, "contestation"))

    def access(self, f: Fact, seen) -> None:
        f.dernier_acces = seen
        f.force = min(FORCE_CAP, f.force + FORCE_GAIN)
        f.acces += 1
        if f.statut == "dormant" and f.force >= FORCE_DORMANT:
            f.statut, f.avant = f.avant or "courant", None

    def negated(self, value) -> Fact | None:
        active = [f for f in self.facts.values() if f.statut in ("courant", "disputé")]
        hit = next((f for f in active if f.valeur_key == value), None)
        return hit or (active[0] if self.functional and len(active) == 1 else None)

    def apply(self, r) -> tuple[str, list[int]]:
        """One claim row -> (action, facts touched)."""
        op = r.op
        if op in ("assert", "closed_interval"):
            if r.reflexif:
                return "rejet_autoreferentiel", []
            seen = r.date_obs
            if op == "closed_interval" and r.explicit is not None:
                seen = r.explicit
            action, touched = self.claim(r.claim_seq, r.objet, r.valeur_key, r.source_id, seen, r.explicit)
            if op == "closed_interval":
                self.close(touched[-1], r.source_id, r.end if r.end is not None else r.date_obs)
                action = "fait_clos"
            return action, [f.fait_id for f in touched]
        if op == "negate":
            f = self.negated(r.valeur_key)
            if f is None:
                return "fin_orpheline", []
            self.close(f, r.source_id, r.date_obs)
            return "cloture_polarite", [f.fait_id]
        f = self.facts.get(r.cible) if r.cible is not None else next((x for x in self.facts.values() if x.valeur_key == r.valeur_key), None)
        if f is None:
            return "fait_inconnu", []
        if op == "access":
            self.access(f, r.date_obs)
        elif op == "use":  # a judge found that an answer used it
            f.force = min(FORCE_CAP, f.force + FORCE_GAIN)
        elif not r.source_id:
            return "refus_sans_source", []
        elif op == "close":
            end = r.end if r.end is not None else r.explicit
            if end is None:
                return "refus_sans_date", []
            self.close(f, r.source_id, end)
        elif op == "contest":
            self.contest(f, r.source_id, r.date_obs)
        elif op == "corroborate":
            return self.claim(r.claim_seq, f.objet, f.valeur_key, r.source_id, r.date_obs, None)[0], [f.fait_id]
        else:
            return "operation_inconnue", []
        return op, [f.fait_id]


#: Operations that mention entities; all others only look names up.
WRITES = ("assert", "closed_interval")


def _resolved(c: DataFrame, resolved: DataFrame, column: str) -> DataFrame:
    """Names of a column by what they resolve to: key ``{column}_key`` and the entity's name. A claim that only looks up
    finds no name that comes later in the log, and then no fact."""
    r = resolved.select(F.col("name").alias("_n"), F.col("id").alias("_at"), F.col("ent_name").alias("_key"), F.col("ent_nom").alias("_nom"))
    j = c.withColumn("_n", norm_name(F.col(column))).join(r, "_n", "left")
    known = F.col("_key").isNotNull() & (F.col("op").isin(*WRITES) | (F.col("_at") <= F.col("claim_seq") * 2))
    return j.withColumns({f"{column}_key": F.when(known, F.col("_key")).otherwise(F.concat(F.lit("? "), F.col("_n"))), f"{column}_nom": F.when(known, F.col("_nom")).otherwise(F.col(column))}).drop("_n", "_at", "_key", "_nom")


def prepared(claims: DataFrame, spec: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Claims with keys, dates and the predicate's kind. Missing columns are null.

    Without ``resolved`` names are equal if their normal forms are. With it (see ``resolution.resolve_names``) a name
    stands for its entity: keys are the normal forms of the entity's own name, and facts carry that name.
    """
    c = claims.select(*[(F.col(n) if n in claims.columns else F.lit(None)).cast(t).alias(n) for n, t in CLAIM.items()])
    c = with_specification(c.filter("claim_seq IS NOT NULL"), spec.select("predicat", "fonctionnel", "volatilite", "objet_entite", "poids", "demivie"))
    if resolved is None:
        c = c.withColumns({"sujet_key": norm_name(F.col("sujet")), "objet_key": norm_name(F.col("objet"))})
    else:
        c = _resolved(_resolved(c, resolved, "sujet"), resolved, "objet")
        c = c.withColumns({"sujet": F.col("sujet_nom"), "objet": F.when(F.col("objet_entite"), F.col("objet_nom")).otherwise(F.col("objet"))})
    return c.select(
        *CLAIM,
        "fonctionnel",
        "sujet_key",
        F.when(F.col("objet_entite"), F.col("objet_key")).alias("objet_key"),
        F.when(F.col("objet_entite"), F.concat(F.lit("e"), "objet_key")).otherwise(F.concat(F.lit("v"), norm_value(F.col("objet")))).alias("valeur_key"),
        F.coalesce(F.col("objet_entite") & (F.col("objet_key") == F.col("sujet_key")), F.lit(False)).alias("reflexif"),
        parse_date(F.col("date_validite")).alias("explicit"),
        parse_date(F.col("date_fin")).alias("end"),
    )


class _Row:
    __slots__ = ("claim_seq", "op", "objet", "source_id", "date_obs", "cible", "valeur_key", "reflexif", "explicit", "end")


#: Columns of a fact that a row carries when the fold goes on from stored facts.
STORED = ("fait_id", "objet", "valeur_key", "valide_de", "date_creation", "statut", "force", "certitude", "valide_jusqua", "derniere_contradiction", "statut_avant", "compteur_acces", "noyau", "importance", "dernier_acces", "derniere_confirmation")


def _rows(pdf: pd.DataFrame):
    cols = {}
    for c in ["sujet_key", "predicat", "sujet", "objet_key", "type_sujet", "type_objet", "fonctionnel", "stored", *_Row.__slots__]:
        v = pdf[c].astype(object).where(pdf[c].notna(), None) if c != "stored" else pdf[c] if c in pdf else [None] * len(pdf)
        cols[c] = [_moment(x) for x in v]
    return zip(*cols.values(), strict=True)


def _walk(batches: Iterator[pd.DataFrame], done, report=None):
    """Fold rows sorted by key, stored facts before claims, and claim_seq; ``done(ident, key)`` gets every finished key."""
    now, key, meta = None, None, {}
    for pdf in batches:
        for subject_key, predicate, subject, obj_key, type_s, type_o, functional, stored, *rest in _rows(pdf):
            if (subject_key, predicate) != now:
                if key is not None:
                    done(now, key, meta)
                now, key, meta = (subject_key, predicate), Key(bool(functional)), {"sujet": subject, "type_sujet": type_s, "keys": {}}
            r = _Row()
            for n, v in zip(_Row.__slots__, rest, strict=True):
                setattr(r, n, v)
            r.claim_seq = int(r.claim_seq)
            r.cible = None if r.cible is None else int(r.cible)
            meta["keys"].setdefault(r.valeur_key, (obj_key, type_o))
            meta["type_sujet"] = meta["type_sujet"] or type_s
            if stored is not None:
                x = {c: _moment(stored[c]) if stored[c] is not None and stored[c] is not pd.NaT else None for c in STORED}
                key.facts[r.claim_seq] = Fact.stored(x | {"provenance": stored["provenance"]})
                continue
            key.functional = bool(functional)
            action, touched = key.apply(r)
            if report is not None:
                report.append((r.claim_seq, action, touched))
        if report is not None and len(report) > 5000:
            yield report[:]
            report.clear()
        if report is None:
            yield None
    if key is not None:
        done(now, key, meta)
    if report:
        yield report


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []

    def done(ident, key: Key, meta):
        for f in key.facts.values():
            obj_key, type_o = meta["keys"].get(f.valeur_key, (None, None))
            prov = [{"source_id": s, "date": d, "type": t} for s, d, t in f.provenance]
            out.append((f.fait_id, ident[0], meta["sujet"], ident[1], f.objet, obj_key, f.valeur_key, f.force, f.certitude, prov, f.valide_de, f.valide_jusqua, f.creation, f.dernier_acces, f.confirmation, f.contradiction, f.statut, f.avant, f.acces, f.noyau, f.importance, meta["type_sujet"], type_o))

    names = [c.split()[0] for c in FACTS.replace("array<struct<source_id:string,date:timestamp,type:string>>", "x").split(", ")]
    for _ in _walk(batches, done):
        if len(out) >= 5000:
            yield pd.DataFrame(out, columns=names)
            out.clear()
    if out:
        yield pd.DataFrame(out, columns=names)


def _reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _walk(batches, lambda *_: None, []):
        if rows:
            yield pd.DataFrame(rows, columns=["claim_seq", "action", "touches"])


def _ordered(claims: DataFrame, spec: DataFrame, resolved: DataFrame | None) -> DataFrame:
    rows = prepared(claims, spec, resolved).filter("sujet_key IS NOT NULL AND predicat IS NOT NULL AND date_obs IS NOT NULL")
    return rows.repartition("sujet_key", "predicat").sortWithinPartitions("sujet_key", "predicat", "claim_seq")


def write_facts(claims: DataFrame, spec: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """The facts after all claims. Claims without a key, an order or an observation date are left out. ``resolved``:
    what names stand for, see ``prepared``."""
    return _ordered(claims, spec, resolved).mapInPandas(_facts, FACTS)


def write_more(facts: DataFrame, claims: DataFrame, spec: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """The facts after further claims, from the facts as they are stored: what consolidation, merges and promotions have
    made of them stays. Only keys that a claim names are folded; a key's stored facts come before its claims."""
    new = prepared(claims, spec, resolved).filter("sujet_key IS NOT NULL AND predicat IS NOT NULL AND date_obs IS NOT NULL")
    keys = new.select("sujet_key", "predicat").distinct()
    kind = new.select("sujet_key", "predicat", "fonctionnel").dropDuplicates(["sujet_key", "predicat"])
    old = facts.join(kind, ["sujet_key", "predicat"]).withColumns({"stored": F.struct(*STORED, "provenance"), "claim_seq": F.col("fait_id")})
    blank = {c: F.lit(None).cast(t) for c, t in dict(new.dtypes).items() if c not in old.columns}
    rows = new.withColumns({"stored": F.lit(None).cast(old.schema["stored"].dataType), "is_claim": F.lit(1)})
    rows = rows.unionByName(old.withColumns(blank | {"is_claim": F.lit(0)}).select(*rows.columns))
    folded = rows.repartition("sujet_key", "predicat").sortWithinPartitions("sujet_key", "predicat", "is_claim", "claim_seq").mapInPandas(_facts, FACTS)
    return facts.join(keys, ["sujet_key", "predicat"], "left_anti").select(*folded.columns).unionByName(folded)


def write_report(claims: DataFrame, spec: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Per claim the action taken and the facts touched."""
    return _ordered(claims, spec, resolved).mapInPandas(_reports, REPORT)


def n_sources(provenance):
    """A1: distinct sources among the reports of a provenance array."""
    return F.size(F.array_distinct(F.transform(F.filter(provenance, lambda p: p["type"] == "rapport"), lambda p: p["source_id"])))
