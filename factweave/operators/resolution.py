"""Entity resolution, merging of duplicates, reunion of fragments (survey R1-R6, J9-J11).

The greedy folds run per connected component of candidate links, in order: links only ever join names of one component,
so folding components apart equals the sequential pass. Candidates come from equi-joins on normal forms, tokens and
shared neighbours, and from the cells of ``vectors``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import brevity_penalty, distinct_homonyms, family, norm_name, tokens, types_compatible
from factweave.plans.ontology import with_specification

from .graph import checkpointed, dot
from .vectors import vector_pairs

# Fixed values.
SAME, DOUBT, MERGE, REUNION, RARE, PERSON_MIN, PERSON_STRONG = 0.85, 0.75, 0.95, 0.30, 0.25, 2, 0.75


def spread(edges: DataFrame) -> DataFrame:
    """Components (id, root) of edges (a, b) by minimum propagation with pointer jumping, until nothing changes; empty
    for no edges."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label["id"] == near["a"]).select("id", "root", F.least("root", "near").alias("to"))
        jump = label.select(F.col("id").alias("to"), F.col("root").alias("far"))
        new = checkpointed(step.join(jump, "to", "left").select("id", "root", F.least("to", F.coalesce("far", "to")).alias("new")))
        label = new.select("id", F.col("new").alias("root"))
        if not new.filter("root != new").limit(1).count():
            return label


def leaders(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Greedy leader clustering: ids in order; a leader absorbs every later id linked with it that is still free.

    ``pairs``: a < b, links; ``ids``: id. Returns (id, leader). A component's links are folded by one task.
    """
    comp = spread(pairs).withColumnRenamed("id", "a")
    grouped = pairs.join(comp, "a").repartition("root").sortWithinPartitions("root", "a", "b").select("root", "a", "b")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken = None, {}
        for pdf in batches:
            out = []
            for root, a, b in pdf.itertuples(index=False):
                if root != now:
                    now, taken = root, {}
                if a not in taken and b not in taken:
                    taken[b] = a
                    out.append((b, a))
            yield pd.DataFrame(out, columns=["id", "leader"])

    kind = pairs.schema["a"].dataType.simpleString()
    absorbed = grouped.mapInPandas(fold, f"id {kind}, leader {kind}")
    return ids.join(absorbed, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """Entities (id, type, embedding) -> (id, leader)."""
    kind = entities.select("id", "type")
    p = vector_pairs(entities, MERGE).join(kind.select(F.col("id").alias("a"), F.col("type").alias("ta")), "a").join(kind.select(F.col("id").alias("b"), F.col("type").alias("tb")), "b")
    return leaders(p.filter(types_compatible(F.col("ta"), F.col("tb"))).select("a", "b"), entities.select("id"))


#: A neighbour of more entities than this is a hub: its pairs are not formed, it only adds to the scores of others.
HUB = 1000


def _weighted(neigh: DataFrame, entities: DataFrame) -> DataFrame:
    """(ent, fam, nk, df): the neighbours that another entity has too, of entities with a known family."""
    n = neigh.select("ent", "nk").distinct()
    df = n.groupBy("nk").agg(F.count("*").alias("df")).filter("df > 1")
    fam = entities.select("ent", family(F.col("type")).alias("fam")).filter("fam IS NOT NULL")
    return n.join(df, "nk").join(fam, "ent").select("ent", "fam", "nk", "df")


def _leading(x: DataFrame, reach: float) -> DataFrame:
    """Of each entity's neighbours, rare first, those before the rest that together weigh less than ``reach``: what two
    entities with that much in common share includes a leading neighbour of each."""
    rest = Window.partitionBy("ent").orderBy(F.desc("df"), F.desc("nk")).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("rest", F.sum(1 / F.col("df")).over(rest)).filter(F.col("rest") >= reach - 1e-9).drop("rest")


def fragment_scores(neigh: DataFrame, entities: DataFrame, hub: int = HUB) -> DataFrame:
    """(ent, nk) -> pairs of one known family with the sum of 1/df over shared neighbours, if they qualify.

    ``entities``: ent, type. Pairs meet at neighbours of at most ``hub`` entities, so their number is linear in the
    rows. Hubs count too: two entities that share nothing but hubs meet if a leading hub of both can still reach the
    threshold, and what hubs add to a pair is taken from the hubs of its two entities.
    """
    x = checkpointed(_weighted(neigh, entities))
    light = x.filter(F.col("df") <= hub)
    a, b = (light.select(F.col("ent").alias(c), "nk", "fam", "df") for c in ("a", "b"))
    inner = lambda nk: (nk != F.concat(F.lit("e"), F.col("a"))) & (nk != F.concat(F.lit("e"), F.col("b")))
    p = a.join(b.drop("df"), ["nk", "fam"]).filter((F.col("a") < F.col("b")) & inner(F.col("nk")))
    s = p.groupBy("a", "b", "fam").agg(F.sum(1 / F.col("df")).alias("score"), F.count_if(1 / F.col("df") >= RARE).alias("rares"))
    hubs = x.filter(F.col("df") > hub)
    if hubs.limit(1).count():
        lead = _leading(hubs, REUNION).select("ent", "nk", "fam")
        c, d = (lead.select(F.col("ent").alias(k), "nk", "fam") for k in ("a", "b"))
        only = c.join(d, ["nk", "fam"]).filter("a < b").select("a", "b", "fam").distinct().join(s.select("a", "b"), ["a", "b"], "left_anti")
        s = s.unionByName(only.withColumns({"score": F.lit(0.0), "rares": F.lit(0).cast("long")}))
        of = hubs.groupBy("ent").agg(F.collect_list(F.struct("nk", "df")).alias("hubs"))
        s = s.join(of.select(F.col("ent").alias("a"), F.col("hubs").alias("ha")), "a", "left").join(of.select(F.col("ent").alias("b"), F.col("hubs").alias("hb")), "b", "left")
        common = F.filter(F.array_intersect("ha", "hb"), lambda h: inner(h["nk"]))
        more = F.aggregate(F.transform(common, lambda h: 1 / h["df"]), F.lit(0.0), lambda t, w: t + w)
        s = s.select("a", "b", "fam", (F.col("score") + F.coalesce(more, F.lit(0.0))).alias("score"), "rares")
    return s.filter((F.col("score") >= REUNION) & ((F.col("fam") != "personne") | (F.col("rares") >= PERSON_MIN) | (F.col("score") >= PERSON_STRONG)))


def reunite(neigh: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, leader, score, decisifs): entities in order absorb later ones of their family whose neighbours they share.

    An entity that has absorbed another has its neighbours too from then on, so it can absorb entities with which it
    shared nothing at first. Entities whose shared neighbours weigh less than the threshold in all can do neither;
    the others meet in components of neighbours that lead one of them (see ``_leading``), which are folded apart.
    ``decisifs``: the rare neighbours (1/df of ``RARE`` or more) that the two had in common.
    """
    x = checkpointed(_weighted(neigh, entities))
    able = x.groupBy("ent").agg(F.sum(1 / F.col("df")).alias("w")).filter(F.col("w") >= REUNION - 1e-9).select("ent")
    x = checkpointed(x.join(able, "ent", "left_semi"))
    active = _leading(x, REUNION).select("nk", "fam").distinct()
    at = F.struct(F.lit("n").alias("kind"), F.concat_ws(" ", "fam", "nk").alias("key"))
    edges = x.join(active, ["nk", "fam"]).select(F.struct(F.lit("e").alias("kind"), F.col("ent").cast("string").alias("key")).alias("a"), at.alias("b"))
    comp = spread(edges).filter("id.kind = 'e'").select(F.col("id.key").alias("key"), "root")
    kind = neigh.schema["ent"].dataType.simpleString()
    sets = x.groupBy("ent", "fam").agg(F.sort_array(F.collect_list(F.struct("nk", "df"))).alias("nks"))
    rows = sets.join(comp, sets["ent"].cast("string") == comp["key"]).select("root", "ent", "fam", F.col("nks.nk").alias("nks"), F.col("nks.df").alias("dfs"))
    rows = rows.withColumn("root", F.to_json("root")).repartition("root").sortWithinPartitions("root", "ent")

    def absorbed(members):
        """members: (ent, fam, {nk: df}) in order."""
        holders: dict = {}
        for k, (_, fam, nks) in enumerate(members):
            for nk in nks:
                holders.setdefault((fam, nk), []).append(k)
        free = [True] * len(members)
        for i, (ent, fam, own) in enumerate(members):
            if not free[i]:
                continue
            has, seen = {}, set()
            ahead: list[int] = []

            def grow(nks, after):
                for nk, df in nks.items():
                    if nk not in has:
                        has[nk] = df
                        for j in holders[(fam, nk)]:
                            if j > after and j not in seen:
                                seen.add(j)
                                heapq.heappush(ahead, j)

            grow(own, i)
            while ahead:
                j = heapq.heappop(ahead)
                other, _, theirs = members[j]
                if not free[j]:
                    continue
                ends = {f"e{ent}", f"e{other}"}
                common = sorted(nk for nk in theirs if nk in has and nk not in ends)
                score = sum(1.0 / theirs[nk] for nk in common)
                rare = [nk for nk in common if 1.0 / theirs[nk] >= RARE]
                if score >= REUNION and (fam != "personne" or len(rare) >= PERSON_MIN or score >= PERSON_STRONG):
                    free[j] = False
                    yield other, ent, score, rare
                    grow(theirs, j)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, members = None, []
        for pdf in batches:
            for root, ent, fam, nks, dfs in pdf.itertuples(index=False):
                if root != now and members:
                    yield pd.DataFrame(list(absorbed(members)), columns=["id", "leader", "score", "decisifs"])
                    members = []
                now = root
                members.append((ent, fam, dict(zip(nks, dfs, strict=True))))
        if members:
            yield pd.DataFrame(list(absorbed(members)), columns=["id", "leader", "score", "decisifs"])

    gone = rows.mapInPandas(fold, f"id {kind}, leader {kind}, score double, decisifs array<string>")
    ids = entities.select(F.col("ent").alias("id"))
    return ids.join(gone, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"), "score", "decisifs")


def reassign(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Repoint subjects and objects. ``mapping``: id, leader."""
    s = mapping.select(F.col("id").alias("sujet_key"), F.col("leader").alias("ls"))
    o = mapping.select(F.col("id").alias("objet_key"), F.col("leader").alias("lo"))
    j = facts.join(s, "sujet_key", "left").join(o, "objet_key", "left")
    return j.withColumns({"sujet_key": F.coalesce("ls", "sujet_key"), "objet_key": F.coalesce("lo", "objet_key")}).select(*facts.columns)


def distinct_names(names: DataFrame) -> DataFrame:
    """One row for each normal form among mentions (id, nom, type, embedding): its first mention (``id``, ``nom``,
    ``type``, ``embedding``) and the first that gives a type (``typed_at``, ``typed``). A form resolves once: whatever
    its first mention joins has it as a name from then on, so later mentions are equal names."""
    n = names.withColumn("name", norm_name(F.col("nom")))
    first = F.min_by(F.struct("id", "nom", "type", "embedding"), "id")
    typed = F.min(F.when(F.col("type").isNotNull(), F.struct(F.col("id").alias("at"), F.col("type").alias("kind"))))
    g = n.groupBy("name").agg(first.alias("f"), typed.alias("t"))
    return g.select("name", "f.*", F.col("t.at").alias("typed_at"), F.col("t.kind").alias("typed"))


def candidate_links(first: DataFrame) -> DataFrame:
    """J4 between distinct names: (a, b, how, sim, homonyme, malus), a before b: one's tokens are all among the other's
    (``contenu``), or their vectors are near enough to be journalled (``vecteur``). Types are left to the fold, as an
    entity's type can be given by a later mention. Containment is joined on the rarest token of the shorter name."""
    n = first.select("id", "name", "embedding").withColumn("nt", F.array_distinct(tokens(F.col("name"))))
    t = n.select("id", "nt", F.explode("nt").alias("tok"))
    df = t.groupBy("tok").agg(F.count("*").alias("df"))
    rare = t.join(df, "tok").groupBy("id").agg(F.min(F.struct("df", "tok")).alias("r"), F.first("nt").alias("small")).select(F.col("id").alias("i"), F.col("r.tok").alias("tok"), "small")
    inside = rare.join(t.select(F.col("id").alias("j"), "tok", F.col("nt").alias("large")), "tok").filter((F.col("i") != F.col("j")) & (F.size(F.array_except("small", "large")) == 0))
    inside = inside.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.lit("contenu").alias("how"), F.lit(1.0).alias("sim")).distinct()
    near = vector_pairs(n.filter("embedding IS NOT NULL"), DOUBT, strict=False).select("a", "b", F.lit("vecteur").alias("how"), "sim")
    na, nb = (n.select(F.col("id").alias(k), F.col("name").alias(f"n{k}")) for k in ("a", "b"))
    p = inside.unionByName(near).join(na, "a").join(nb, "b")
    return p.select("a", "b", "how", "sim", distinct_homonyms(F.col("na"), F.col("nb")).alias("homonyme"), brevity_penalty(F.col("na"), F.col("nb")).alias("malus"))


class _Resolution:
    """The entities of one component, as its names are met in order."""

    def __init__(self):
        self.of: dict[int, int] = {}  # name -> entity
        self.kind: dict[int, tuple] = {}  # entity -> (type, family)

    def give(self, ent: int, kind: tuple) -> None:
        if self.kind.get(ent, (None, None))[0] is None and kind[0] is not None:
            self.kind[ent] = kind

    def fits(self, ent: int, kind: tuple) -> bool:
        mine = self.kind.get(ent, (None, None))[1]
        return mine is None or kind[1] is None or mine == kind[1]

    def meet(self, name: int, kind: tuple, links: list[tuple]) -> tuple[int, str, int | None, float | None]:
        """(entity, how, the nearest entity that was left alone, its similarity). links: (a, how, sim, homonym, malus)."""
        held = sorted({self.of[a] for a, how, *_ in links if how == "contenu"})
        ent = next((e for e in held if self.fits(e, kind)), None)
        how, near, sim = "alias/tokens", None, None
        if ent is None:
            # the nearest of all entities, by their own names; only then is it looked at more closely
            own = [(-s, a, homonym, malus) for a, h, s, homonym, malus in links if h == "vecteur" and self.of[a] == a]
            if own:
                s, a, homonym, malus = min(own)
                if self.fits(a, kind) and not homonym and -s - malus >= SAME:
                    ent, how, sim = a, "embedding", -s
                else:
                    near, sim = a, -s
        if ent is None:
            ent, how = name, "création"
        self.of[name] = ent
        self.give(ent, kind)
        return ent, how, near, sim


def resolve_names(names: DataFrame) -> DataFrame:
    """R1 on distinct names: (name, id, nom, ent, ent_name, ent_nom, how, proche, sim).

    ``names``: mentions (id in order, nom, type, embedding or null). ``ent`` is the id of the mention that made the
    entity. A name joins the oldest entity one of whose names holds its tokens or the reverse, if types allow; else the
    nearest entity, if that is near enough, of a compatible type and no homonym; else it is an entity. ``proche``: the
    nearest entity of a name that was made an entity although it is close to another (the journal of doubtful cases).
    Events of a component (first mentions, and the first type given to a name) are folded in order by one task.
    """
    first = checkpointed(distinct_names(names))
    links = checkpointed(candidate_links(first))
    comp = spread(links.select("a", "b")).select(F.col("id").alias("n"), "root")
    there = first.join(comp, F.col("id") == F.col("n")).select("root", "id", "type", "typed_at", "typed")
    link = F.struct("a", "how", "sim", "homonyme", "malus")
    listed = links.groupBy(F.col("b").alias("id")).agg(F.sort_array(F.collect_list(link)).alias("links"))
    met = there.join(listed, "id", "left").select("root", F.col("id").alias("at"), "id", "type", "links")
    given = there.filter("typed_at > id").select("root", F.col("typed_at").alias("at"), "id", F.col("typed").alias("type"), F.lit(None).cast(met.schema["links"].dataType).alias("links"))
    events = met.unionByName(given).withColumn("fam", family(F.col("type"))).repartition("root").sortWithinPartitions("root", "at", "id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, _Resolution()
        for pdf in batches:
            out = []
            for root, _, name, kind, links, fam in pdf[["root", "at", "id", "type", "links", "fam"]].itertuples(index=False):
                if root != now:
                    now, state = root, _Resolution()
                if name in state.of:
                    state.give(state.of[name], (kind, fam))
                else:
                    found = [] if links is None else [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in links]
                    out.append((name, *state.meet(name, (kind, fam), found)))
            yield pd.DataFrame(out, columns=["id", "ent", "how", "proche", "sim"]).astype({"proche": "Int64"})

    done = events.mapInPandas(fold, "id long, ent long, how string, proche long, sim double")
    out = first.select("name", "id", "nom").join(done, "id", "left").withColumns({"ent": F.coalesce("ent", "id"), "how": F.coalesce("how", F.lit("création"))})
    own = first.select(F.col("id").alias("ent"), F.col("name").alias("ent_name"), F.col("nom").alias("ent_nom"))
    return out.join(own, "ent").select("name", "id", "nom", "ent", "ent_name", "ent_nom", "how", "proche", "sim")


def resolve(names: DataFrame) -> DataFrame:
    """(id, ent, how) of every mention: the first of a name as ``resolve_names`` says, later ones are equal names."""
    known = resolve_names(names).select("name", F.col("id").alias("first"), "ent", "how")
    n = names.select("id", norm_name(F.col("nom")).alias("name"))
    return n.join(known, "name").select("id", "ent", F.when(F.col("id") == F.col("first"), F.col("how")).otherwise("exact").alias("how"))


def aliases(resolved: DataFrame) -> DataFrame:
    """(ent, nom, alias): an entity's name and the other names that it has, in the order in which they came."""
    other = F.when(F.col("name") != F.col("ent_name"), F.struct("id", "nom"))
    g = resolved.groupBy("ent").agg(F.first("ent_nom").alias("nom"), F.array_sort(F.collect_list(other)).alias("a"))
    return g.select("ent", "nom", F.col("a.nom").alias("alias"))


def find_entity(wanted: DataFrame, resolved: DataFrame) -> DataFrame:
    """(nom, ent, ent_nom) of names to look up (nom): the entity that has the name or alias, null for none."""
    w = wanted.select("nom", norm_name(F.col("nom")).alias("name"))
    return w.join(resolved.select("name", "ent", "ent_nom"), "name", "left").select("nom", "ent", "ent_nom")


def mentions(claims: DataFrame, spec: DataFrame, embed: DataFrame | None = None) -> DataFrame:
    """The names that claims mention in writing order (id, nom, type, embedding): a subject, then the object if it is an
    entity; claims that only look names up mention none. ``embed``: (nom, embedding)."""
    c = with_specification(claims.filter(F.col("op").isin("assert", "closed_interval")), spec.select("predicat", "fonctionnel", "volatilite", "objet_entite", "poids", "demivie"))
    pick = lambda k: F.col(k) if k in claims.columns else F.lit(None).cast("string")
    s = c.select((F.col("claim_seq") * 2).alias("id"), F.col("sujet").alias("nom"), pick("type_sujet").alias("type"))
    o = c.filter("objet_entite").select((F.col("claim_seq") * 2 + 1).alias("id"), F.col("objet").alias("nom"), pick("type_objet").alias("type"))
    m = s.unionByName(o).filter("nom IS NOT NULL")
    return m.withColumn("embedding", F.lit(None).cast("array<float>")) if embed is None else m.join(embed.select("nom", "embedding"), "nom", "left").select("id", "nom", "type", "embedding")


def first_type(mentions: DataFrame) -> DataFrame:
    """R2: the first type given to each entity, and whether others conflict. ``mentions``: ent, seq, type."""
    t = mentions.filter("type IS NOT NULL")
    g = t.groupBy("ent").agg(F.min(F.struct("seq", "type")).alias("f"), F.count_distinct("type").alias("n"))
    return g.select("ent", F.col("f.type").alias("type"), (F.col("n") > 1).alias("conflit"))


def distant_reference(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(rid, ent) where exactly one entity holds all tokens of the reference, of its family if that is known.

    ``refs``: rid, name (normalised), type; ``entities``: ent, name, type.
    """
    r = refs.select("rid", F.array_distinct(tokens(F.col("name"))).alias("rt"), F.col("type").alias("tr"))
    e = entities.select("ent", F.array_distinct(tokens(F.col("name"))).alias("et"), F.col("type").alias("te"))
    hit = r.withColumn("tok", F.get("rt", F.lit(0))).join(e.withColumn("tok", F.explode("et")), "tok").filter(F.size(F.array_except("rt", "et")) == 0).filter(family(F.col("tr")).isNull() | (family(F.col("tr")) == family(F.col("te"))))
    return hit.groupBy("rid").agg(F.count_distinct("ent").alias("n"), F.min("ent").alias("ent")).filter("n = 1").select("rid", "ent")


def similarity(a: Column, b: Column) -> Column:
    return dot(a, b)
