"""Reading the fact graph: neighbours, walks, recognition, ranking, typology, importance, inference (survey P, K, U, N)."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import tokens

# Fixed values.
W_SIM, W_FORCE, W_IMPORTANCE, ENTITY_BONUS, SLEEP_BASE, SLEEP_BETA, SLEEP_MIN = 1.0, 0.5, 0.6, 0.30, 0.30, 3.0, 0.05
TOP_K, WALK, INFERRED, FOCUS, FANOUT, CANDIDATES = 8, 6, 6, 10, 64, 12
DAMPING, ALPHA, ROUNDS, SEED_DEGREE, SEED_SOURCES, SEED_CATEGORY, OTHER_CATEGORY = 0.85, 0.7, 40, 0.3, 0.4, 0.3, 0.3
RULES = [("parent_de", "o", "parent_de", "s", "grand_parent"), ("travaille_pour", "o", "pdg_de", "s", "a_pour_patron"), ("travaille_pour", "o", "dirige", "s", "a_pour_patron")]
#: Entities (and an eighth of the edges) up to which a ranking runs on the driver instead of a job a round.
SMALL_GRAPH = 100_000
RANK = {"courant": 0, "dormant": 1, "disputé": 2, "clos": 3}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the session's checkpoint folder; a temporary one only where all runs in one process."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(path)
    return df.checkpoint()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(items: DataFrame, query: Column, k: int = TOP_K, id_col: str = "fait_id", vec_col: str = "embedding", extra: Column | None = None) -> DataFrame:
    """K1: score = similarity + extra; ties by id; one ordered cut of k rows."""
    score = W_SIM * dot(F.col(vec_col), query) + (extra if extra is not None else F.lit(0.0))
    return items.withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)


def v1_topk(memories: DataFrame, query: Column, k: int = 5) -> DataFrame:
    """K7: the active memories nearest to a query (id, embedding, statut), ties by id."""
    return memories.filter("statut = 'actif'").withColumn("score", dot(F.col("embedding"), query)).orderBy(F.desc("score"), "id").limit(k)


def prototype_score(kind: str, similarity: Column, force: Column, importance: Column, named_subject: Column) -> Column:
    """K8: the scorers of the prototypes: ``v2`` similarity weighted by force; ``v2_entity`` with the bonus of a named
    subject; ``v3`` and ``v3_importance`` sums of similarity, force, that bonus and, in the last, importance."""
    bonus = F.when(named_subject, ENTITY_BONUS).otherwise(0.0)
    if kind in ("v2", "v2_entity"):
        weighted = similarity * (0.5 + 0.5 * force)
        return weighted if kind == "v2" else weighted + bonus
    total = W_SIM * similarity + W_FORCE * force + bonus
    return total + W_IMPORTANCE * importance if kind == "v3_importance" else total


# Fixed value: what recognition adds in the recall bench.
RECOGNISED = 5.0


def bench_rank(rows: DataFrame, mode: str, by: str = "qid", id_col: str = "fait_id") -> DataFrame:
    """K9: facts of each question in the order of a bench mode (``rang`` from 1). ``rows``: by, fait_id, sim, force,
    importance, statut, reconnu, sujet_nomme.

    ``inerte``: similarity alone, of all facts. ``porte``: with force and the bonuses of a named subject and of
    recognition; dormant facts only if they are recognised. ``axe``, ``axe_retr``: with importance as well.
    """
    if mode not in ("inerte", "porte", "axe", "axe_retr"):
        raise ValueError(f"unknown mode {mode}")
    score = F.col("sim")
    if mode != "inerte":
        rows = rows.filter((F.col("statut") != "dormant") | F.col("reconnu"))
        kind = "v3" if mode == "porte" else "v3_importance"
        score = prototype_score(kind, F.col("sim"), F.col("force"), F.col("importance"), F.col("sujet_nomme")) + F.when(F.col("reconnu"), RECOGNISED).otherwise(0.0)
    return rows.withColumn("score", score).withColumn("rang", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), id_col)))


def sleep_penalty(n_src: Column) -> Column:
    """K2."""
    return F.greatest(F.lit(SLEEP_MIN), SLEEP_BASE / (1 + SLEEP_BETA * F.greatest(n_src - 1, F.lit(0))))


def named(name_tokens: Column, question_tokens: Column, lenient: bool = True) -> Column:
    """All tokens, or the first and last Latin ones of three letters or more, are in the question."""
    strict = (F.size(name_tokens) > 0) & (F.size(F.array_except(name_tokens, question_tokens)) == 0)
    if not lenient:
        return strict
    latin = F.filter(name_tokens, lambda t: (F.length(t) >= 3) & t.rlike("^[a-z]+$"))
    return strict | ((F.size(latin) > 0) & F.array_contains(question_tokens, F.get(latin, F.lit(0))) & F.array_contains(question_tokens, F.get(latin, F.size(latin) - 1)))


def recognised(entities: DataFrame, questions: DataFrame, lenient: bool = True) -> DataFrame:
    """N3's entities: (qid, ent) for entities (ent, name: normalised) named by questions (qid, text: normalised).

    Candidates share the name's first or last Latin token, or its first token, with the question: an equi-join on
    tokens, not all pairs.
    """
    e = entities.select("ent", tokens(F.col("name")).alias("nt")).filter(F.size("nt") > 0)
    latin = F.filter("nt", lambda t: (F.length(t) >= 3) & t.rlike("^[a-z]+$"))
    e = e.withColumn("tok", F.explode(F.array_distinct(F.array_compact(F.array(F.get("nt", F.lit(0)), F.get(latin, F.lit(0)))))))
    q = questions.select("qid", F.array_distinct(tokens(F.col("text"))).alias("qt")).withColumn("tok", F.explode("qt"))
    return e.join(q, "tok").filter(named(F.col("nt"), F.col("qt"), lenient)).select("qid", "ent").distinct()


def valid_at(rows: DataFrame, when: Column) -> DataFrame:
    """P10: what held at a moment: begun by then and not over (``valide_jusqua`` null: open; the end is not included)."""
    return rows.filter((F.col("valide_de") <= when) & (F.col("valide_jusqua").isNull() | (when < F.col("valide_jusqua"))))


def with_name(rows: DataFrame, names: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with the name of the entity in ``key`` as ``out``, "?" for one that is not known. ``names``: ent, nom."""
    n = names.select(F.col("ent").alias(key), F.col("nom").alias(out))
    return rows.join(n, key, "left").withColumn(out, F.coalesce(out, F.lit("?")))


def recallable(facts: DataFrame, graded: bool = True) -> DataFrame:
    """The facts that free recall can bring up: current and disputed ones, and with graded dormancy dormant ones."""
    return facts.filter(F.col("statut").isin(*["courant", "disputé"], *(["dormant"] if graded else [])))


def incidence(facts: DataFrame) -> DataFrame:
    """(ent, fait_id, role, other): a fact at each of its ends that is an entity."""
    s = facts.select(F.col("sujet_key").alias("ent"), "fait_id", F.lit("s").alias("role"), F.col("objet_key").alias("other"))
    o = facts.filter("objet_key IS NOT NULL").select(F.col("objet_key").alias("ent"), "fait_id", F.lit("o").alias("role"), F.col("sujet_key").alias("other"))
    return s.unionByName(o)


def walk(facts: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Ids of the facts within ``hops`` of the seeds' entities, without the seeds (fait_id).

    A level is one join of the incidence with the frontier and one with the facts met; levels are joined into one
    column of distances at the end, so nothing is compared with what was seen before.
    """
    inc = checkpointed(incidence(facts).select("ent", "fait_id"))
    known = seeds.select("fait_id").distinct()
    met = known.withColumn("hop", F.lit(0))
    level = known
    for hop in range(1, hops + 1):
        frontier = inc.join(level, "fait_id", "left_semi").select("ent").distinct()
        level = checkpointed(inc.join(frontier, "ent", "left_semi").select("fait_id").distinct())
        met = met.union(level.withColumn("hop", F.lit(hop)))
    return met.groupBy("fait_id").agg(F.min("hop").alias("hop")).filter("hop > 0").select("fait_id")


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each entity. ``edges``: a, b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    return both.groupBy(F.col("a").alias("ent")).agg(F.count("*").alias("degre"))


def neighbours(facts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Each entity's links with direction, status and the neighbour's degree."""
    inc = incidence(facts).filter("other IS NOT NULL").join(facts.select("fait_id", "predicat", "statut"), "fait_id")
    deg = degrees(facts.select(F.col("sujet_key").alias("a"), F.col("objet_key").alias("b")))
    return inc.join(deg.withColumnRenamed("ent", "other"), "other", "left").select("ent", "fait_id", F.when(F.col("role") == "s", "sortant").otherwise("entrant").alias("sens"), "predicat", F.col("other").alias("vers"), "statut", "degre")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``pos``, the place of each in the whole order from 1; sorted by ranges, so no task holds all rows."""
    part = checkpointed(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    pos = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return part.join(F.broadcast(before), "part").withColumn("pos", pos).drop("part", "before")


def ordered_union(parts: list[DataFrame], key: str = "fait_id") -> DataFrame:
    """Rows (key, pos) of several lists, the first list that has a key wins."""
    every = None
    for i, p in enumerate(parts):
        p = p.select(key, F.col("pos").cast("long").alias("pos"), F.lit(i).alias("prio"))
        every = p if every is None else every.unionByName(p)
    best = every.groupBy(key).agg(F.min(F.struct("prio", "pos")).alias("first"))
    return best.select(key, F.col("first.prio").alias("prio"), F.col("first.pos").alias("pos"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; a window that keeps one row is limited within partitions first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def fanout(facts: DataFrame, cap: int = FANOUT) -> DataFrame:
    """K6: at most ``cap`` facts of each entity, lowest ids first (this limit is the feature)."""
    w = Window.partitionBy("ent").orderBy("fait_id")
    return incidence(facts).select("ent", "fait_id").distinct().withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap)


def focus(facts: DataFrame, question: Column, most: int = FOCUS) -> DataFrame:
    """K5 on rows (fait_id, pos, sujet_nom, objet_nom, statut, statut_avant): on-topic facts, the named subject first."""
    q = tokens(question)
    s, o = (F.arrays_overlap(tokens(F.col(c)), q) for c in ("sujet_nom", "objet_nom"))
    closed = (F.col("statut") == "clos") | F.coalesce(F.col("statut_avant") == "clos", F.lit(False))
    scored = facts.withColumns({"on": F.coalesce(s | o, F.lit(False)), "score": F.when(s, 2).otherwise(0) + F.when(closed & s, 1).otherwise(0)})
    kept = scored.filter("on").orderBy(F.desc("score"), "pos").limit(most)
    spare = scored.orderBy("pos").limit(most).join(kept.select("fait_id").limit(1).withColumn("any", F.lit(1)).groupBy().agg(F.count("*").alias("n")), F.lit(True)).filter("n = 0").drop("n")
    return kept.unionByName(spare).select("fait_id", "score")


def typology(links: DataFrame) -> DataFrame:
    """N6, N7 on links (lid, a, b, dated, occurrence): features and the nature of a link in five modes."""
    deg = degrees(links)
    ds, do = (deg.select(F.col("ent").alias(c), F.col("degre").alias(f"deg_{c}")) for c in ("a", "b"))
    # a link whose reverse exists under another id: direct links are grouped, so no pair of links is made twice
    back = links.groupBy(F.col("b").alias("a"), F.col("a").alias("b")).agg(F.count("*").alias("n_back"), F.min("lid").alias("one"))
    f = links.join(ds, "a", "left").join(do, "b", "left").join(back, ["a", "b"], "left")
    recip = F.coalesce((F.col("n_back") > 1) | ((F.col("n_back") == 1) & (F.col("one") != F.col("lid"))), F.lit(False))
    f = f.select("lid", F.coalesce("deg_a", F.lit(0)).alias("deg_sujet"), F.coalesce("deg_b", F.lit(0)).alias("deg_objet"), recip.alias("reciproque"), "dated", "occurrence")
    lasting, passing = F.lit("DURABLE"), F.lit("ÉPHÉMÈRE")
    linked = F.when(F.least("deg_sujet", "deg_objet") >= 2, lasting).otherwise(passing)
    occ, rec = F.col("occurrence"), F.col("reciproque")
    return f.withColumns({
        "s1": linked,
        "s2": F.when(occ, passing).when(rec, lasting).otherwise(passing),
        "s1s2": F.when(occ, passing).when(rec, lasting).otherwise(linked),
        "recip_first": F.when(rec, lasting).otherwise(passing),
        "naive_date": F.when(F.col("dated"), passing).when(rec, lasting).otherwise(passing),
    })


# Fixed value: lasting predicates that no structure shows, as they have no reverse and no date.
DECLARED = ["dirige", "appartient_a", "possede", "travaille_pour"]


def declared(predicate: Column, nature: Column) -> Column:
    """Links of the declared predicates last, whatever their structure says; the others are as predicted."""
    return F.when(predicate.isin(DECLARED), "DURABLE").otherwise(nature)


def _small_rank(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """The same rounds on arrays, for a graph whose size was checked: a job a round costs more than its numbers."""
    import numpy as np
    import pandas as pd

    spark = nodes.sparkSession
    n, e = nodes.toPandas(), edges.toPandas()
    if not len(n):
        return spark.createDataFrame([], "ent string, importance double")
    at = pd.Series(np.arange(len(n)), index=n["ent"])
    a, b, p = at.loc[e["a"]].to_numpy(), at.loc[e["b"]].to_numpy(), e["p"].to_numpy(float)
    seed, linked = n["seed"].to_numpy(float), n["linked"].to_numpy(bool)
    pr = seed.copy()
    for _ in range(rounds):
        pr = DAMPING * (np.bincount(b, p * pr[a], len(n)) + pr[~linked].sum() * seed) + (1 - DAMPING) * seed
    return spark.createDataFrame(pd.DataFrame({"ent": n["ent"], "importance": pr / pr.max()}), "ent string, importance double")


def importance(entities: DataFrame, facts: DataFrame, category_bonus: dict[str, float], rounds: int = ROUNDS) -> DataFrame:
    """Weighted PageRank on the symmetric entity graph; (ent, importance), largest 1.

    ``entities``: ent, type; ``facts``: sujet_key, objet_key, poids, certitude, provenance. Each round is one join and
    one aggregation on the aggregated edges; the mass of entities without links goes back to the seed. Graphs of at
    most ``SMALL_GRAPH`` entities take the same rounds on the driver.
    """
    deg = incidence(facts.withColumn("fait_id", F.monotonically_increasing_id())).groupBy("ent").agg(F.count("*").alias("deg"))
    src = facts.select(F.col("sujet_key").alias("ent"), F.explode("provenance.source_id").alias("s")).groupBy("ent").agg(F.count_distinct("s").alias("src"))
    bonus = F.create_map(*[F.lit(x) for kv in category_bonus.items() for x in kv])[F.col("type")] if category_bonus else F.lit(None)
    n = entities.join(deg, "ent", "left").join(src, "ent", "left").fillna(0, ["deg", "src"])
    top = n.agg(F.greatest(F.max("deg"), F.lit(1)).alias("md"), F.greatest(F.max("src"), F.lit(1)).alias("ms"))
    n = n.join(F.broadcast(top)).select("ent", (SEED_DEGREE * F.col("deg") / F.col("md") + SEED_SOURCES * F.col("src") / F.col("ms") + SEED_CATEGORY * F.coalesce(bonus, F.lit(OTHER_CATEGORY))).alias("seed"))
    n = n.join(F.broadcast(n.agg(F.sum("seed").alias("all")))).select("ent", (F.col("seed") / F.col("all")).alias("seed"))
    w = F.col("poids") * F.greatest(F.lit(0.05), F.col("certitude"))
    e = facts.filter("objet_key IS NOT NULL").select(F.col("sujet_key").alias("a"), F.col("objet_key").alias("b"), w.alias("w"))
    e = e.join(entities.select(F.col("ent").alias("a")), "a", "left_semi").join(entities.select(F.col("ent").alias("b")), "b", "left_semi")
    e = e.select("a", "b", "w").union(e.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    out = e.groupBy("a").agg(F.sum("w").alias("col"))
    e = checkpointed(e.join(out, "a").select("a", "b", (F.col("w") / F.col("col")).alias("p")))
    n = checkpointed(n.join(out.select(F.col("a").alias("ent"), F.lit(True).alias("linked")), "ent", "left").select("ent", "seed", F.coalesce("linked", F.lit(False)).alias("linked")))
    if n.limit(SMALL_GRAPH + 1).count() <= SMALL_GRAPH and e.limit(8 * SMALL_GRAPH + 1).count() <= 8 * SMALL_GRAPH:
        return _small_rank(n, e, rounds)
    pr = n.select("ent", F.col("seed").alias("pr"))
    for i in range(rounds):
        got = e.join(pr, e["a"] == pr["ent"]).groupBy(F.col("b").alias("ent")).agg(F.sum(F.col("p") * F.col("pr")).alias("got"))
        loose = n.filter("NOT linked").join(pr, "ent").agg(F.coalesce(F.sum("pr"), F.lit(0.0)).alias("loose"))
        pr = n.join(got, "ent", "left").join(F.broadcast(loose)).select("ent", (DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("seed")) + (1 - DAMPING) * F.col("seed")).alias("pr"))
        if i % 4 == 3:
            pr = checkpointed(pr)
    most = pr.agg(F.max("pr").alias("m"))
    return pr.join(F.broadcast(most)).select("ent", (F.col("pr") / F.col("m")).alias("importance"))


def fact_importance(weight: Column, imp_s: Column, imp_o: Column) -> Column:
    """N5."""
    return weight * F.pow(F.greatest(F.coalesce(imp_s, F.lit(0.0)), F.coalesce(imp_o, F.lit(0.0))), F.lit(ALPHA))


def compose(facts: DataFrame, spec: DataFrame, rules: list[tuple] = RULES, most: int | None = INFERRED, group: list[str] = ()) -> DataFrame:
    """Two facts that meet in an entity, by a whitelist and a gate on the pivot's type.

    Rows: (predicat, src, dst, statut, certitude, valide_jusqua, f1, f2, actif); the first derivation of each
    (predicat, src, dst); active first, then by certainty, at most ``most`` (per ``group`` of a pool column, if any).
    """
    spark = facts.sparkSession
    kind = spec.select("predicat", "objet_entite", "type_sujet", "type_objet")
    keep = ["fait_id", "predicat", "statut", "certitude", "valide_jusqua"]
    f = facts.filter("objet_key IS NOT NULL").select(*group, *keep, "sujet_key", "objet_key").join(F.broadcast(kind), "predicat").filter("objet_entite")
    ends = F.explode(F.array(
        F.struct(F.col("sujet_key").alias("ent"), F.lit("s").alias("role"), F.col("objet_key").alias("other"), F.col("type_sujet").alias("t")),
        F.struct(F.col("objet_key").alias("ent"), F.lit("o").alias("role"), F.col("sujet_key").alias("other"), F.col("type_objet").alias("t")),
    ))
    inc = f.select(*group, *keep, ends.alias("x")).select(*group, *keep, "x.*")
    rule = F.broadcast(spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "p1 string, r1 string, p2 string, r2 string, rel string, rule int"))
    one = inc.select(*group, "ent", *[F.col(c).alias(f"{c}_1") for c in [*keep, "role", "other", "t"]])
    two = inc.select(*group, "ent", *[F.col(c).alias(f"{c}_2") for c in [*keep, "role", "other", "t"]])
    one = one.join(rule, (F.col("predicat_1") == F.col("p1")) & (F.col("role_1") == F.col("r1")))
    j = one.join(two, [*group, "ent"]).filter("predicat_2 = p2 AND role_2 = r2 AND fait_id_1 != fait_id_2")
    j = j.filter("t_1 = t_2 AND other_1 != other_2 AND other_1 != ent AND other_2 != ent")
    rank = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col(c)], F.lit(0))
    r1, r2 = rank("statut_1"), rank("statut_2")
    out = j.select(
        *group, F.col("rel").alias("predicat"), F.col("other_1").alias("src"), F.col("other_2").alias("dst"),
        F.when(r1 >= r2, F.col("statut_1")).otherwise(F.col("statut_2")).alias("statut"),
        F.least("certitude_1", "certitude_2").alias("certitude"), F.least("valide_jusqua_1", "valide_jusqua_2").alias("valide_jusqua"),
        F.col("fait_id_1").alias("f1"), F.col("fait_id_2").alias("f2"), (F.greatest(r1, r2) < 3).alias("actif"),
    )
    out = first_of(out, [*group, "predicat", "src", "dst"], ["f1", "f2"])
    if most is None:
        return out
    order = [F.desc("actif"), F.desc("certitude"), "f1", "f2"]
    if not group:
        return out.orderBy(*order).limit(most)
    w = Window.partitionBy(*group).orderBy(*order)
    return out.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")


def inferred_label(status: Column) -> Column:
    """T29."""
    suffix = F.when(status == "clos", " (périmé)").when(status == "disputé", " (disputé)").when(status == "dormant", " (dormant)").otherwise("")
    return F.concat(F.lit("inféré"), suffix)


def inferred_sentence(predicate: Column, s: Column, o: Column, status: Column) -> Column:
    """V2r's sentence."""
    closed = status == "clos"
    return (
        F.when(predicate == "grand_parent", F.concat_ws(" ", s, F.when(closed, "était").otherwise("est"), F.lit("grand-parent de"), o))
        .when(predicate == "a_pour_patron", F.concat_ws(" ", F.lit("le patron de"), s, F.when(closed, "était").otherwise("est"), o))
        .otherwise(F.concat_ws(" → ", s, o))
    )
