"""The memory as functions of tables: write, link, edit, read, look around (survey S4, S5, I6-I8, P5, N1, V3r, V4r).

Nothing here mutates: writes return claims to append to the log, reads return rows and, where the reference would
strengthen what was read, the access claims to append.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators import extraction as X
from factweave.operators import graph as G
from factweave.operators import models as L
from factweave.operators import promotion as P
from factweave.operators import rendering as R
from factweave.operators.writing import CLAIM, n_sources
from factweave.sources.store import load_buckets

_SCHEMA = ", ".join(f"{n} {t}" for n, t in CLAIM.items())


def claim(spark: SparkSession, seq: int, op: str, subject: str, predicate: str, obj: str | None, source: str | None, seen: datetime, **more) -> DataFrame:
    """One row for the log. Linking and editing need a source, closing a date too."""
    if op in ("assert", "close", "contest", "corroborate") and not source:
        raise ValueError("a source is needed")
    if op == "close" and not (more.get("date_fin") or more.get("date_validite")):
        raise ValueError("closing needs a date")
    row = {"claim_seq": seq, "op": op, "sujet": subject, "predicat": predicate, "objet": obj, "source_id": source, "date_obs": seen, **more}
    return spark.createDataFrame([tuple(row.get(c) for c in CLAIM)], _SCHEMA)


def link(spark: SparkSession, spec: DataFrame, seq: int, subject: str, predicate: str, obj: str, source: str, seen: datetime, **more) -> DataFrame:
    """A sourced link with a known predicate."""
    if not spec.filter(F.col("predicat") == predicate).limit(1).count():
        raise ValueError(f"unknown predicate {predicate}")
    return claim(spark, seq, "assert", subject, predicate, obj, source, seen, **more)


def inspect(facts: DataFrame, ref: int | str) -> DataFrame:
    """P5: a fact by id, or all facts that touch an entity by name."""
    if isinstance(ref, int):
        return facts.filter(F.col("fait_id") == ref)
    name = T.norm_name(F.lit(ref))
    return facts.filter((F.col("sujet_key") == name) | (F.col("objet_key") == name)).orderBy("fait_id")


def listing(facts: DataFrame) -> DataFrame:
    """All facts with their status before sleep, by subject and predicate."""
    status = F.when(F.col("statut") == "dormant", F.coalesce("statut_avant", F.lit("courant"))).otherwise(F.col("statut"))
    sources = F.array_sort(F.array_distinct("provenance.source_id"))
    return facts.select("fait_id", "sujet", "predicat", "objet", "statut", status.alias("statut_effectif"), "force", "certitude", n_sources(F.col("provenance")).alias("n_sources"), sources.alias("sources"), "valide_de", "valide_jusqua").orderBy("sujet", "predicat", "fait_id")


def traverse(facts: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """The links of an entity, and with depth 2 those of its neighbours."""
    every = G.neighbours(facts)
    near = every.filter(F.col("ent") == T.norm_name(F.lit(name)))
    if depth < 2:
        return near
    return near.unionByName(every.join(near.select(F.col("vers").alias("ent")).distinct(), "ent", "left_semi")).distinct()


def retrieve(facts: DataFrame, question: str, vector: list[float] | None = None) -> DataFrame:
    """(fait_id, prio, pos): facts of named entities first, then the nearest, then what a walk adds."""
    spark = facts.sparkSession
    q = spark.createDataFrame([(0, question)], "qid int, t string").select("qid", T.norm_name(F.col("t")).alias("text"))
    ends = facts.select(F.col("sujet_key").alias("ent")).union(facts.filter("objet_key IS NOT NULL").select("objet_key")).distinct()
    named = G.recognised(ends.withColumn("name", F.col("ent")), q).select("ent")
    known = G.incidence(facts).join(named, "ent", "left_semi").select("fait_id").distinct().withColumn("pos", F.col("fait_id"))
    parts = [known]
    similarity: Column = F.lit(0.0)
    if vector is not None and "embedding" in facts.columns:
        query = F.array(*[F.lit(float(x)) for x in vector])
        similarity = G.dot(F.col("embedding"), query)
        n = n_sources(F.col("provenance"))
        penalty = F.when(F.col("statut") == "dormant", G.sleep_penalty(n)).otherwise(0.0)
        bonus = F.when(F.col("mentioned"), G.ENTITY_BONUS).otherwise(0.0)
        m = G.recallable(facts).join(named.select(F.col("ent").alias("sujet_key"), F.lit(True).alias("m")), "sujet_key", "left").withColumn("mentioned", F.coalesce("m", F.lit(False)))
        top = G.vector_topk(m, query, extra=G.W_FORCE * F.col("force") - penalty + bonus)
        parts.append(top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "fait_id"))).select("fait_id", "pos"))
    seeds = parts[0].select("fait_id")
    for p in parts[1:]:
        seeds = seeds.union(p.select("fait_id"))
    far = facts.join(G.walk(facts, seeds), "fait_id", "left_semi").withColumn("sim", similarity).orderBy(F.desc("sim"), "fait_id").limit(G.WALK)
    parts.append(far.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("sim"), "fait_id"))).select("fait_id", "pos"))
    return G.ordered_union(parts)


def context(facts: DataFrame, spec: DataFrame, templates: DataFrame, question: str, vector: list[float] | None = None, grammar: bool = False) -> tuple[DataFrame, DataFrame]:
    """V4r: (lines in order, ids read). Inference sees the whole pool; focus keeps ten observed facts; only inferences
    that name something of the question are shown."""
    pool = G.checkpointed(retrieve(facts, question, vector).join(facts, "fait_id").withColumn("rang", F.col("prio") * 1_000_000_000_000 + F.col("pos")).drop("prio", "pos"))
    qname = T.norm_name(F.lit(question))
    named = pool.withColumns({"pos": F.col("rang"), "sujet_nom": F.col("sujet_key"), "objet_nom": F.coalesce("objet_key", T.norm_name(F.col("objet")))})
    kept = G.focus(named, qname)
    rows = pool.join(kept, "fait_id").withColumn("pos", -F.col("score").cast("long") * 1_000_000_000_000_000 + F.col("rang"))
    lines = R.epistemic_lines(rows, templates)
    if grammar:
        inferred = G.compose(pool, spec)
        q = T.tokens(qname)
        shown = inferred.filter("actif").filter(F.arrays_overlap(T.tokens(F.col("src")), q) | F.arrays_overlap(T.tokens(F.col("dst")), q))
        text = R.inferred_line(F.col("f1"), F.col("f2"), G.inferred_sentence(F.col("predicat"), F.col("src"), F.col("dst"), F.col("statut")))
        lines = lines.unionByName(shown.select(F.lit(2).alias("grp"), F.col("f1").alias("pos"), text.alias("ligne")))
    return lines.orderBy("grp", "pos"), kept.select("fait_id")


def accesses(facts: DataFrame, read: DataFrame, seq: int, seen: datetime) -> DataFrame:
    """I18 for what was read: claims for the log, numbered from ``seq`` (reads are a handful of facts)."""
    r = facts.join(read, "fait_id", "left_semi").select("sujet", "predicat", "objet", F.col("fait_id").alias("cible"))
    r = r.withColumns({"claim_seq": F.lit(seq) + F.row_number().over(Window.orderBy("cible")) - 1, "op": F.lit("access"), "date_obs": F.lit(seen)})
    return r.select(*[(F.col(c) if c in r.columns else F.lit(None)).cast(t).alias(c) for c, t in CLAIM.items()])


# ---- whole paths ----


def extracted(statements: DataFrame, spec: DataFrame, model: L.Model, system: str = "", several: bool = True) -> DataFrame:
    """The axes of the facts that statements (stream, seq, texte, and any other columns) state, one row a fact.

    The model reads each statement by itself; pronouns are looked for in the three statements before it in its stream,
    whether or not they state anything. Of equal facts of a statement the first counts.
    """
    ask = "Extrais TOUS les faits distincts, en JSON strict." if several else "Remplis la grille en JSON strict."
    s = X.trailing_context(statements)
    s = L.answered(s.withColumn("invite", F.concat(F.lit("Énoncé : « "), "texte", F.lit(f" »\n\n{ask}"))), model, system=system)
    axes = X.finalise(X.grids(s.drop("invite"), several=several).drop("reponse"), spec, coreference=L.local_coreference(model))
    return X.distinct_facts(axes, ["stream", "seq"])


def referred(axes: DataFrame, spec: DataFrame, entities: DataFrame, facts: DataFrame, model: L.Model | None = None) -> DataFrame:
    """``axes`` with references to known entities (ent, nom, type) replaced by their names: subjects, and objects
    where the predicate's object is an entity. Who it is, never what is said: nothing else changes."""
    is_entity = spec.filter("objet_entite").select("predicat", F.lit(True).alias("_e"))
    a = axes.join(F.broadcast(is_entity), "predicat", "left")
    ends = a.select(F.col("sujet").alias("ref"), F.col("type_sujet").alias("type")).union(a.filter("_e").select("objet", "type_objet")).distinct()
    ends = G.checkpointed(ends.withColumn("rid", F.xxhash64("ref", "type")))
    names = L.distant_references(ends, entities, facts, model).join(entities.select("ent", "nom"), "ent").select("rid", "nom")
    for end, when in (("sujet", F.lit(True)), ("objet", F.coalesce("_e", F.lit(False)))):
        a = a.withColumn("_r", F.when(when, F.xxhash64(end, f"type_{end}"))).join(names.select(F.col("rid").alias("_r"), F.col("nom").alias("_n")), "_r", "left")
        a = a.withColumn(end, F.coalesce("_n", end)).drop("_r", "_n")
    return a.select(*axes.columns)


def written(axes: DataFrame, source: Column, seen: Column, order: Column) -> DataFrame:
    """Axes to claims of the log. ``order``: a number for each statement; a statement may state a thousand facts."""
    d = X.derive(axes).filter("op IS NOT NULL")
    made = {
        "claim_seq": order.cast("long") * 1000 + F.col("pos"), "source_id": source, "date_obs": seen, "date_validite": F.col("date_debut"),
        "date_fin": F.col("date_fin"), "cible": F.lit(None),
    }
    return d.withColumns(made).select(*[F.col(c).cast(t).alias(c) for c, t in CLAIM.items()])


def write_statements(statements: DataFrame, spec: DataFrame, model: L.Model, system: str = "", gated: bool = False, facts: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Statements (stream, seq, texte, source_id, date_obs) to claims in the order of ``seq``, which numbers
    them across streams. ``gated``: messages that the gate does not let through as facts or text state nothing.
    ``facts``, ``entities``: what is known, for distant references; without them references stay as they are."""
    axes = extracted(statements, spec, model, system)
    if gated:
        axes = axes.filter(T.gate(F.col("texte")) != "ignorer")
    if facts is not None and entities is not None:
        axes = referred(axes, spec, entities, facts, model)
    return written(axes, F.col("source_id"), F.col("date_obs"), F.col("seq"))


def promoted(facts: DataFrame, triggers: DataFrame, spec: DataFrame, when: Column, beta: float = 0.0) -> DataFrame:
    """I8's hook: ``facts`` after the promotions that new facts (triggers: fait_id) bring about."""
    chosen = P.promotable(facts, triggers, spec.select("predicat", "fonctionnel"))
    return P.promote(facts, G.checkpointed(chosen), when, beta)


def read(facts: DataFrame, spec: DataFrame, templates: DataFrame, question: str, model: L.Model, seq: int, seen: datetime, vector: list[float] | None = None, grammar: bool = False, system: str = "", judge: str = "") -> tuple[DataFrame, DataFrame]:
    """V3r: (answer: qid, reponse, bloc; claims for the log): retrieve, render, ask, and let the usage judge say which
    facts the answer used. Facts that were read are accessed, those that were used gain force (I18, I19)."""
    spark = facts.sparkSession
    pool = G.checkpointed(retrieve(facts, question, vector).join(facts, "fait_id").withColumn("pos", F.col("prio") * 1_000_000_000_000 + F.col("pos")).drop("prio"))
    lines = R.epistemic_lines(pool, templates)
    if grammar:
        shown = G.compose(pool, spec).filter("actif")
        told = R.inferred_line(F.col("f1"), F.col("f2"), G.inferred_sentence(F.col("predicat"), F.col("src"), F.col("dst"), F.col("statut")))
        lines = lines.unionByName(shown.select(F.lit(2).alias("grp"), F.col("f1").alias("pos"), told.alias("ligne")))
    block = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "pos", "ligne"))), lambda x: x["ligne"]), "\n").alias("bloc"))
    asked = block.select(F.lit(0).alias("qid"), "bloc", L.responder_prompt("C", F.lit(question), F.col("bloc")).alias("invite"))
    answer = G.checkpointed(L.answered(asked, model, system=system, as_json=False).select("qid", "bloc", "reponse"))
    told = pool.select(F.struct(F.col("fait_id").alias("id"), F.concat_ws(" ", "sujet", "predicat", "objet").alias("contenu")).alias("m")).agg(F.array_sort(F.collect_list("m")).alias("souvenirs"))
    used = G.checkpointed(L.used(answer.join(told).select("qid", F.lit(question).alias("question"), "reponse", "souvenirs"), model, judge).select(F.col("id").alias("fait_id")))
    log = accesses(facts, pool.select("fait_id"), seq, seen)
    more = accesses(facts, used, seq + pool.count(), seen).withColumn("op", F.lit("use"))
    return answer, log.unionByName(more)


def history_claims(truth: DataFrame, reconfirmed: datetime, second: Column | None = None, perishable: Column | None = None) -> DataFrame:
    """The log of a history of facts (sujet, predicat, objet, source_id, valide_de, clore_a: dates as text).

    Facts come in the order in which they began. Each is told by its source and by a second one; if it has an end its
    source closes it then, else, unless it is ``perishable``, its source tells it again on the day ``reconfirmed``.
    """
    second = F.concat("source_id", F.lit("-bis")) if second is None else second
    perishable = F.lit(False) if perishable is None else perishable
    r = G.ranked(truth, F.asc("valide_de"), F.asc("sujet"), F.asc("predicat"), F.asc("objet"))
    began, over = T.parse_date(F.col("valide_de")), F.col("clore_a").isNotNull()

    def told(nth, op, source, seen, valid, end):
        return F.struct(F.lit(nth).alias("nth"), F.lit(op).alias("op"), source.alias("source_id"), seen.alias("date_obs"), valid.alias("date_validite"), end.alias("date_fin"))

    none, valid = F.lit(None).cast("string"), F.col("valide_de")
    claims = F.array(
        told(0, "assert", F.col("source_id"), began, valid, none),
        told(1, "assert", second, began, valid, none),
        F.when(over, told(2, "close", F.col("source_id"), T.parse_date(F.col("clore_a")), none, F.col("clore_a"))),
        F.when(~over & ~perishable, told(2, "assert", F.col("source_id"), F.lit(reconfirmed), valid, none)),
    )
    c = r.select((F.col("pos") * 4).alias("first"), "sujet", "predicat", "objet", F.explode(F.array_compact(claims)).alias("c")).select("first", "sujet", "predicat", "objet", "c.*")
    c = c.withColumn("claim_seq", F.col("first") + F.col("nth"))
    return c.select(*[(F.col(n) if n in c.columns else F.lit(None)).cast(t).alias(n) for n, t in CLAIM.items()])


def reset(spark: SparkSession, root: str) -> None:
    """Forget everything that is stored under a folder of snapshots."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def health(spark: SparkSession, root: str) -> DataFrame:
    """How many facts there are, and about how many subjects, in the newest version."""
    facts = load_buckets(spark, root)
    if facts is None:
        return spark.createDataFrame([(0, 0)], "faits long, entites long")
    return facts.agg(F.count("*").alias("faits"), F.count_distinct("sujet_key").alias("entites"))
