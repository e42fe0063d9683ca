"""Further registered queries: resolution, maintenance, ranking, judges and evaluation, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave import api
from factweave.functions import text as T
from factweave.operators import extraction as X
from factweave.operators import graph as G
from factweave.operators import maintenance as M
from factweave.operators import models as L
from factweave.operators import promotion as P
from factweave.operators import rendering as R
from factweave.operators import resolution as E
from factweave.operators import scoring as S
from factweave.operators import writing as W
from factweave.plans import ontology as O
from factweave.queries import _FOLD, query, table


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


# ---- resolution and merging ----


def order_names(spark, d):
    """Claims that name a customer in three ways: with a title, plainly, and with a word more."""
    o = table(spark, d, "orders")
    name = F.concat(_pick(["M. ", "", ""], F.col("o_orderkey")), F.lit("Cust K"), F.col("o_custkey").cast("string"), _pick(["", "", " Paris"], F.col("o_orderkey")))
    seq = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 10_000_000_000 + F.col("o_orderkey")
    return o.select(
        seq.alias("claim_seq"), F.lit("assert").alias("op"), name.alias("sujet"), F.lit("produit").alias("predicat"), F.col("o_orderpriority").alias("objet"),
        F.col("o_orderstatus").alias("source_id"), F.col("o_orderdate").alias("date_obs"),
    )


@query("""
WITH c AS (SELECT epoch(date_trunc('day', o_orderdate))::BIGINT // 86400 * 10000000000 + o_orderkey AS seq, o_custkey AS k, o_orderpriority AS v, o_orderstatus AS src FROM orders),
n AS (SELECT k, min(seq) AS first FROM c GROUP BY 1), x AS (SELECT k, CASE first % 3 WHEN 0 THEN 'M. ' ELSE '' END || 'Cust K' || k || CASE (first % 10000000000) % 3 WHEN 2 THEN ' Paris' ELSE '' END AS nom, first % 10000000000 AS ok FROM n),
y AS (SELECT k, CASE ok % 3 WHEN 0 THEN 'M. Cust K' || k WHEN 1 THEN 'Cust K' || k ELSE 'Cust K' || k || ' Paris' END AS sujet FROM x)
SELECT min(seq) AS fait_id, sujet, v AS objet, count(DISTINCT src) AS n_sources, round(least(0.99, 0.5 + 0.05 * (count(*) - count(DISTINCT src))), 6) AS force,
  round(least(0.95, 0.55 + 0.20 * (count(DISTINCT src) - 1)), 6) AS certitude FROM c JOIN y USING (k) GROUP BY k, sujet, v""")
def resolved_facts(spark, d):
    """Names resolved in order of mention, then the write fold on entities."""
    claims, spec = order_names(spark, d), O.specification(spark)
    f = W.write_facts(claims, spec, E.resolve_names(E.mentions(claims, spec)))
    return f.select("fait_id", "sujet", "objet", W.n_sources(F.col("provenance")).cast("long").alias("n_sources"), F.round("force", 6).alias("force"), F.round("certitude", 6).alias("certitude"))


@query("""
WITH c AS (SELECT epoch(date_trunc('day', o_orderdate))::BIGINT // 86400 * 10000000000 + o_orderkey AS seq, o_custkey AS k, o_orderkey % 3 AS form FROM orders),
f AS (SELECT k, form, min(seq) AS seq FROM c GROUP BY 1, 2), g AS (SELECT k, CASE WHEN form = 2 THEN 1 ELSE 0 END AS long, min(seq) AS seq FROM f GROUP BY 1, 2)
SELECT min(seq) * 2 AS ent, count(*) - 1 AS n_alias FROM g GROUP BY k""")
def entity_aliases(spark, d):
    """Entities and how many other names they have (a title makes no other name)."""
    claims = order_names(spark, d)
    a = E.aliases(E.resolve_names(E.mentions(claims, O.specification(spark))))
    return a.select("ent", F.size("alias").cast("long").alias("n_alias"))


@query("""
WITH c AS (SELECT epoch(date_trunc('day', o_orderdate))::BIGINT // 86400 * 10000000000 + o_orderkey AS seq, o_custkey AS k, o_orderkey % 3 AS form FROM orders),
e AS (SELECT k, min(seq) * 2 AS ent, max(CASE WHEN form < 2 THEN 1 ELSE 0 END) AS short FROM c GROUP BY 1)
SELECT c_custkey, CASE WHEN short = 1 THEN ent END AS ent FROM customer LEFT JOIN e ON k = c_custkey""")
def entity_lookup(spark, d):
    """Entities by name or alias, with a title before it."""
    claims = order_names(spark, d)
    known = E.resolve_names(E.mentions(claims, O.specification(spark)))
    wanted = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Mme Cust K"), F.col("c_custkey").cast("string")).alias("nom"))
    return wanted.join(E.find_entity(wanted.select("nom").distinct(), known), "nom").select("c_custkey", "ent")


@query("""SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_custkey // 3) AS leader, count(*) OVER (PARTITION BY c_custkey // 3) > 1 AND c_custkey <> min(c_custkey) OVER (PARTITION BY c_custkey // 3) AS absorbe FROM customer""")
def reunited(spark, d):
    """Fragments that share a neighbour of three."""
    c = table(spark, d, "customer")
    neigh = c.select(F.col("c_custkey").alias("ent"), F.concat(F.lit("v"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("nk"))
    r = E.reunite(neigh, c.select(F.col("c_custkey").alias("ent"), F.lit("banque").alias("type")))
    return r.select("id", "leader", F.col("score").isNotNull().alias("absorbe"))


@query("""
WITH f AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderdate AS de, o_orderpriority AS v FROM orders), l AS (SELECT k, max(id) AS last FROM f GROUP BY 1),
c AS (SELECT f.*, max(CASE WHEN id = last THEN v END) OVER (PARTITION BY f.k) AS lv, max(CASE WHEN id = last THEN de END) OVER (PARTITION BY f.k) AS ld, last FROM f JOIN l USING (k)),
d AS (SELECT * FROM c WHERE id <> last AND (v = lv OR de > ld)), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM d),
w AS (SELECT id FROM r a WHERE n = 1) SELECT id AS fait_id FROM w""")
def promotable_first(spark, d):
    """Per customer the first dormant fact of a functional key that its newest fact brings back."""
    o = table(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    f = o.join(last, "o_custkey").select(
        F.col("o_orderkey").alias("fait_id"), F.lit("maire_de").alias("predicat"), F.concat(F.lit("c"), "o_custkey").alias("sujet_key"), F.lit(None).cast("string").alias("objet_key"),
        F.concat(F.lit("v"), "o_orderpriority").alias("valeur_key"), F.when(F.col("o_orderkey") == F.col("last"), "courant").otherwise("dormant").alias("statut"), F.lit(0.5).alias("certitude"),
        F.array(F.struct(F.lit("s").alias("source_id"), F.col("o_orderdate").alias("date"), F.lit("rapport").alias("type"))).alias("provenance"),
        F.col("o_orderdate").alias("valide_de"), F.lit(None).cast("timestamp").alias("valide_jusqua"),
    )
    ok = P.promotable(f, last.select(F.col("last").alias("fait_id")), O.specification(spark).select("predicat", "fonctionnel"))
    who = f.select("fait_id", "sujet_key")
    return ok.join(who, "fait_id").groupBy("sujet_key").agg(F.min("fait_id").alias("fait_id")).select("fait_id")


# ---- maintenance ----


@query("""
WITH a AS (SELECT o_orderpriority AS predicat, count(*) AS n_occ, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_clos FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT predicat, n_clos FROM a""")
def volatility_dump(spark, d):
    """A4: the lines about what was learnt begin with the predicate and tell its closings."""
    status = F.when(F.col("o_orderstatus") == "F", "clos").when(F.col("o_orderstatus") == "P", "disputé").otherwise("courant")
    facts = table(spark, d, "orders").select(F.col("o_orderpriority").alias("predicat"), status.alias("statut"))
    spec = O.specification(spark)
    lines = M.volatility_lines(M.learned_volatility(facts, spec), spec)
    told = r"^(.*?) +prior=.* clos= *(\d+) "
    return lines.select(F.regexp_extract("ligne", told, 1).alias("predicat"), F.regexp_extract("ligne", told, 2).cast("long").alias("n_clos"))


@query("""
WITH m AS (SELECT o_orderkey AS id, (o_orderkey % 97) / 100.0 AS c, o_orderdate AS confirme FROM orders),
p AS (SELECT a.id AS a, b.id AS b, (b.c > a.c OR (b.c = a.c AND b.confirme > a.confirme)) AS second FROM m a JOIN m b ON b.id = a.id + 1 WHERE a.id % 2 = 0)
SELECT id, CASE WHEN g.garde IS NOT NULL THEN 'archive' ELSE 'actif' END AS statut, garde FROM m LEFT JOIN (SELECT CASE WHEN second THEN a ELSE b END AS lost, CASE WHEN second THEN b ELSE a END AS garde FROM p) g ON g.lost = id""")
def v1_merged(spark, d):
    """Fusion of near memories, given the near ones."""
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 97) / 100).alias("confiance"), F.col("o_orderdate").alias("confirme"), F.lit("actif").alias("statut"))
    pairs = m.filter("id % 2 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return M.v1_merge(m, pairs).select("id", "statut", "garde")


@query("SELECT event_id, (event_id - 1) // 20 AS epoque, event_id % 20 = 0 AS consolide FROM events WHERE event_id > 0")
def consolidation_epochs(spark, d):
    """2.12: when the periodic trigger fires, every 20 events."""
    e = table(spark, d, "events").filter("event_id > 0").select(F.col("event_id").alias("seq"))
    return M.due(e).select(F.col("seq").alias("event_id"), "epoque", "consolide")


# ---- ranking ----


_SIM = "list_sum(list_transform(list_zip(embedding, q), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


@query(f"""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, {_SIM} AS sim FROM embeddings, q WHERE vec_id % 4 <> 1) SELECT id, round(sim, 6) AS score FROM s ORDER BY sim DESC, id LIMIT 5""")
def v1_top5(spark, d):
    """K7."""
    e = table(spark, d, "embeddings")
    q = [float(x) for x in e.filter("vec_id = 0").first()["embedding"]]
    m = e.select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 4 == 1, "archive").otherwise("actif").alias("statut"))
    return G.v1_topk(m, F.array(*map(F.lit, q))).select("id", F.round("score", 6).alias("score"))


@query("""
WITH x AS (SELECT o_orderkey, (o_orderkey % 101) / 101.0 AS sim, (o_orderkey % 7) / 7.0 AS f, (o_orderkey % 5) / 5.0 AS i, o_orderkey % 11 = 0 AS n FROM orders)
SELECT o_orderkey, round(sim * (0.5 + 0.5 * f), 6) AS v2, round(sim * (0.5 + 0.5 * f) + CASE WHEN n THEN 0.3 ELSE 0 END, 6) AS v2_entity,
  round(sim + 0.5 * f + CASE WHEN n THEN 0.3 ELSE 0 END, 6) AS v3, round(sim + 0.5 * f + 0.6 * i + CASE WHEN n THEN 0.3 ELSE 0 END, 6) AS v3_importance FROM x""")
def prototype_scores(spark, d):
    """K8."""
    k = F.col("o_orderkey")
    args = ((k % 101) / 101, (k % 7) / 7, (k % 5) / 5, k % 11 == 0)
    return table(spark, d, "orders").select("o_orderkey", *[F.round(G.prototype_score(kind, *args), 6).alias(kind) for kind in ("v2", "v2_entity", "v3", "v3_importance")])


def _bench_sql(mode: str) -> str:
    extra = {"inerte": "", "porte": " + 0.5 * f + CASE WHEN n THEN 0.3 ELSE 0 END + CASE WHEN r THEN 5 ELSE 0 END"}.get(mode, " + 0.5 * f + 0.6 * i + CASE WHEN n THEN 0.3 ELSE 0 END + CASE WHEN r THEN 5 ELSE 0 END")
    keep = "" if mode == "inerte" else " WHERE st <> 'dormant' OR r"
    return f"SELECT '{mode}' AS mode, q, o_orderkey, row_number() OVER (PARTITION BY q ORDER BY sim{extra} DESC, o_orderkey) AS rang FROM x{keep}"


@query("""
WITH x AS (SELECT o_orderkey, o_orderpriority AS q, (o_orderkey % 128) / 128.0::DOUBLE AS sim, (o_orderkey % 8) / 8.0::DOUBLE AS f, (o_orderkey % 4) / 4.0::DOUBLE AS i, o_orderkey % 11 = 0 AS n, o_orderkey % 13 = 0 AS r, CASE WHEN o_orderkey % 3 = 0 THEN 'dormant' ELSE 'courant' END AS st FROM orders)
""" + " UNION ALL ".join(_bench_sql(m) for m in ("inerte", "porte", "axe")))  # fmt: skip
def bench_modes(spark, d):
    """K9."""
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(
        k.alias("fait_id"), F.col("o_orderpriority").alias("q"), ((k % 128) / 128).alias("sim"), ((k % 8) / 8).alias("force"), ((k % 4) / 4).alias("importance"), (k % 11 == 0).alias("sujet_nomme"),
        (k % 13 == 0).alias("reconnu"), F.when(k % 3 == 0, "dormant").otherwise("courant").alias("statut"),
    )
    out = None
    for mode in ("inerte", "porte", "axe"):
        part = G.bench_rank(x, mode, "q").select(F.lit(mode).alias("mode"), "q", F.col("fait_id").alias("o_orderkey"), "rang")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH l AS (SELECT s_suppkey AS lid, ['dirige', 'ami_de', 'possede', 'a_visite'][(s_suppkey % 4) + 1] AS predicat, s_suppkey % 3 = 0 AS durable FROM supplier)
SELECT lid, CASE WHEN predicat IN ('dirige', 'possede') OR durable THEN 'DURABLE' ELSE 'ÉPHÉMÈRE' END AS nature FROM l""")
def declared_links(spark, d):
    """N8."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lid"), _pick(["dirige", "ami_de", "possede", "a_visite"], F.col("s_suppkey")).alias("predicat"), F.when(F.col("s_suppkey") % 3 == 0, "DURABLE").otherwise("ÉPHÉMÈRE").alias("n"))
    return s.select("lid", G.declared(F.col("predicat"), F.col("n")).alias("nature"))


@query("""
WITH e AS (SELECT c_custkey AS ent, 'c ' || c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'personne' WHEN 1 THEN 'lieu' END AS fam FROM customer),
n AS (SELECT ent, name, fam, count(o_orderkey) AS n FROM e LEFT JOIN orders ON o_custkey = ent GROUP BY 1, 2, 3), r AS (SELECT rid, own, fam FROM (VALUES (1, 'c 3', 'personne'), (2, 'x', 'lieu'), (3, 'x', NULL), (4, 'c 1', NULL)) v(rid, own, fam))
SELECT rid, ent, row_number() OVER (PARTITION BY rid ORDER BY n DESC, ent) AS rang FROM r JOIN n ON name <> own AND (r.fam IS NULL OR r.fam = n.fam) QUALIFY rang <= 12""")
def ranked_candidates(spark, d):
    """A10: the twelve best attested entities that a reference can mean."""
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("ent"), F.concat(F.lit("c "), "c_custkey").alias("name"), F.concat(F.lit("C "), "c_custkey").alias("nom"), F.when(F.col("c_custkey") % 3 == 0, "homme").when(F.col("c_custkey") % 3 == 1, "ville").alias("type"))
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("fait_id"), F.col("o_custkey").alias("sujet_key"), F.lit(None).cast("long").alias("objet_key"))
    refs = spark.createDataFrame([(1, "c 3", "femme"), (2, "x", "fleuve"), (3, "x", "nation"), (4, "c 1", None)], "rid int, name string, type string")
    return L.ranked_candidates(refs, e, f).select("rid", "ent", "rang")


# ---- rendering and judges ----


@query(_FOLD + "SELECT CASE WHEN action IN ('cloture', 'dispute', 'dispute_corrobore') THEN 2 ELSE 1 END AS lignes, action, count(*) AS n FROM s WHERE n > 0 GROUP BY 1, 2")
def write_summaries(spark, d):
    """How many lines a write's summary has, by action."""
    from factweave.queries import PRIORITY, priority_claims

    claims, spec = priority_claims(spark, d), O.specification(spark, [PRIORITY])
    s = R.write_summary(W.write_report(claims, spec), W.write_facts(claims, spec))
    return s.groupBy(F.size("faits").alias("lignes"), "action").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, string_agg('[#' || o_orderkey || ' | confiance ' || printf('%.2f', (o_orderkey % 100) / 100.0) || ' | màj ' || strftime(o_orderdate, '%Y-%m-%d') || '] ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS bloc FROM orders GROUP BY 1""")
def memory_blocks(spark, d):
    """V5r, V7r: the lines of a question's memories, with numbers."""
    m = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("contenu"), ((F.col("o_orderkey") % 100) / 100).alias("confiance"), F.col("o_orderdate").alias("confirme"))
    return R.memory_block(m, "o_custkey", ["id"], "numeric")


@query("""
SELECT o_custkey AS qid, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'CONTREDIT' WHEN o_orderkey % 2 = 0 THEN 'CONFIRME' ELSE 'NON_UTILISE' END AS verdict FROM orders""")
def split_judge(spark, d):
    """V6r: two judges' JSON answers (composed here), conflict beats usage."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"))

    def said(rows, verdict):
        one = F.format_string('{"id":"%d","verdict":"%s"}', F.col("id"), verdict)
        answer = rows.groupBy("qid").agg(F.concat(F.lit('{"verdicts":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("reponse"))
        return answer

    conflicts = L.verdicts_of(said(o.filter("id % 7 != 1"), F.when(F.col("id") % 5 == 0, "contredit").otherwise("peut-être")), ["CONTREDIT", "RAS"], "RAS")
    usages = L.verdicts_of(said(o, F.when(F.col("id") % 2 == 0, " utilise ").otherwise("NON_UTILISE")), ["UTILISE", "NON_UTILISE"], "NON_UTILISE")
    lost = o.filter("id % 7 = 1 AND id % 5 = 0").select("qid", "id", F.lit("CONTREDIT").alias("verdict"))
    return L.conflict_beats_usage(o, conflicts.select("qid", "id", "verdict").unionByName(lost), usages).select("qid", "id", "verdict")


@query("""
SELECT conv_id, turn, 'personne' AS type_sujet, 'Nom ' || conv_id AS sujet, 'Ville ' || turn AS objet FROM conversations WHERE turn % 2 = 0""")
def single_grids(spark, d):
    """One fact's grid in an answer; answers without an object give no fact."""
    c = table(spark, d, "conversations").filter("turn % 2 = 0 OR turn % 3 = 0")
    grid = F.format_string('<think>x</think> {"sujet":"Nom %d","predicat":"travaille_pour","objet":"Ville %d","type_e_sujet":"personne"}', "conv_id", "turn")
    c = c.select("conv_id", "turn", F.lit("texte").alias("texte"), F.when(F.col("turn") % 2 == 0, grid).otherwise("rien").alias("reponse"))
    return X.finalise(X.grids(c, several=False).drop("reponse"), O.specification(spark)).select("conv_id", "turn", "type_sujet", "sujet", "objet")


# ---- evaluation ----


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F' AND (o_orderkey % 100 < 15 OR o_orderkey % 10 = 0)) AS faux_oublis, count(*) FILTER (WHERE o_orderstatus = 'F') AS vrais FROM orders")
def false_forgets(spark, d):
    """A17."""
    k = F.col("o_orderkey")
    m = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("vrai"), F.when(k % 10 == 0, "archive").otherwise("actif").alias("statut"), ((k % 100) / 100).alias("confiance"))
    return S.false_forgets(m, 0.15)


@query("""
WITH f AS (SELECT o_custkey AS k, o_orderpriority AS v, arg_min((o_orderkey % 100) / 100.0, o_orderkey) AS c FROM orders GROUP BY 1, 2)
SELECT c_custkey, t.c IS NOT NULL AND (l.c IS NULL OR t.c >= l.c) AS resiste FROM customer LEFT JOIN f t ON t.k = c_custkey AND t.v = '1-URGENT' LEFT JOIN f l ON l.k = c_custkey AND l.v = '5-LOW'""")
def liars_resisted(spark, d):
    """A18."""
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("sujet_key"), F.lit("p").alias("predicat"), F.col("o_orderpriority").alias("valeur_key"), F.col("o_orderkey").alias("fait_id"), ((F.col("o_orderkey") % 100) / 100).alias("certitude"))
    planted = table(spark, d, "customer").select(F.col("c_custkey").alias("sujet_key"), F.lit("p").alias("predicat"), F.lit("1-URGENT").alias("vrai"), F.lit("5-LOW").alias("faux"))
    return S.liars_resisted(f, planted).select(F.col("sujet_key").alias("c_custkey"), "resiste")


@query("""
WITH v AS (SELECT ['périmé', 'actuel', 'stable'][(o_orderkey % 3) + 1] AS nature, ['CONFIRME', 'CONTREDIT', 'NON_UTILISE', 'INCERTAIN'][(o_orderkey % 4) + 1] AS verdict FROM orders)
SELECT nature, count(*) FILTER (WHERE (verdict = 'CONFIRME' AND nature = 'périmé') OR (verdict = 'CONTREDIT' AND nature <> 'périmé')) AS catastrophes, count(*) AS n FROM v GROUP BY 1""")
def catastrophes(spark, d):
    """A19."""
    k = F.col("o_orderkey")
    return S.catastrophes(table(spark, d, "orders").select(_pick(["périmé", "actuel", "stable"], k).alias("nature"), _pick(L.VERDICTS[:2] + ["NON_UTILISE", "INCERTAIN"], k).alias("verdict")))


@query("SELECT CASE WHEN o_custkey % 10 = 0 THEN 'extracteur' ELSE 'memoire' END AS faute, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def mute_facts(spark, d):
    """A20."""
    q = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("ok"), (F.col("o_custkey") % 10 != 0).alias("entite_stockee"), F.lit(True).alias("valeur_stockee"))
    return S.mute_facts(q)


@query("""
WITH x AS (SELECT c_custkey, ['Karel était le chef', 'Lyon et Brest se contredisent', 'Je ne dispose d''aucune donnée', 'C''est Sora'][(c_custkey % 4) + 1] AS r, ['past', 'any', 'absent', 'present'][(c_custkey // 4 % 4) + 1] AS t FROM customer),
y AS (SELECT c_custkey, t, lower(r) AS l, contains(lower(r), 'ne dispose') OR contains(lower(r), 'aucun') AS refus, CASE c_custkey % 4 WHEN 1 THEN contains(lower(r), 'lyon') AND contains(lower(r), 'brest') WHEN 0 THEN contains(lower(r), 'karel') ELSE contains(lower(r), 'sora') END AS has FROM x)
SELECT c_custkey, refus, CASE t WHEN 'absent' THEN refus WHEN 'present' THEN has AND NOT refus WHEN 'past' THEN has AND contains(strip_accents(l), 'etait') ELSE has END AS fidele FROM y""")
def faithful_answers(spark, d):
    """A21."""
    k = F.col("c_custkey")
    r = _pick(["Karel était le chef", "Lyon et Brest se contredisent", "Je ne dispose d'aucune donnée", "C'est Sora"], k)
    wanted = F.when(k % 4 == 1, F.array(F.lit("lyon"), F.lit("brest"))).when(k % 4 == 0, F.array(F.lit("karel"))).otherwise(F.array(F.lit("sora")))
    f = table(spark, d, "customer").select("c_custkey", S.faithful(r, wanted, _pick(["past", "any", "absent", "present"], F.floor(k / 4))).alias("f"))
    return f.select("c_custkey", "f.refus", "f.fidele")


@query("SELECT count(*) FILTER (WHERE c_custkey % 5 = 0) >= 20 AS assez, 20 AS changes, 20 AS stables FROM customer")
def evaluation_sample(spark, d):
    """Forty questions, half about what has changed."""
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("fid"), (F.col("c_custkey") % 5 == 0).alias("change"))
    return S.evaluation_sample(f, 40, 42).agg(F.count_if("change").alias("n"), F.count_if(~F.col("change")).alias("m")).select((F.col("n") == 20).alias("assez"), F.col("n").cast("int").alias("changes"), F.col("m").cast("int").alias("stables"))


@query("""
WITH t AS (SELECT DISTINCT o_orderpriority AS q, o_custkey AS item FROM orders WHERE o_totalprice > 200000), r AS (SELECT DISTINCT o_orderpriority AS q, o_custkey AS item FROM orders WHERE o_orderstatus = 'F'),
g AS (SELECT q, (SELECT count(*) FROM t WHERE t.q = p.q) AS truth, (SELECT count(*) FROM r WHERE r.q = p.q) AS ret, (SELECT count(*) FROM t JOIN r USING (q, item) WHERE t.q = p.q) AS pert FROM (SELECT DISTINCT o_orderpriority AS q FROM orders) p),
c AS (SELECT pert / truth AS c, pert / ret AS p FROM g) SELECT round(avg(c), 6) AS completude, round(avg(p), 6) AS purete, round(avg(2 * c * p / (c + p)), 6) AS f_mesure FROM c""")
def macro_scores(spark, d):
    """The mean over questions."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("q"), F.col("o_custkey").alias("item"), "o_totalprice", "o_orderstatus")
    s = S.macro_average(S.completeness_purity(o.filter("o_totalprice > 200000"), o.filter("o_orderstatus = 'F'"), "q", "item"))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("""
WITH t AS (SELECT o_orderpriority AS q, o_orderkey AS item, CASE WHEN o_orderstatus = 'F' THEN 'imparfait' ELSE 'present' END AS st FROM orders WHERE o_orderkey % 3 <> 0), a AS (SELECT o_orderpriority AS q, o_orderkey AS item, CASE WHEN o_orderkey % 2 = 0 THEN 'present' ELSE 'imparfait' END AS dit, o_orderstatus = 'F' AS clos FROM orders)
SELECT a.q, count(t.st) AS statut_total, count(*) FILTER (WHERE st = dit) AS statut_ok, count(*) FILTER (WHERE dit = 'present' AND CASE WHEN st IS NOT NULL THEN st = 'imparfait' ELSE clos END) AS statut_faux FROM a LEFT JOIN t USING (q, item) GROUP BY 1""")
def status_scores(spark, d):
    """The tense in which right items are told."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("q"), F.col("o_orderkey").alias("item"), (F.col("o_orderstatus") == "F").alias("clos"))
    truth = o.filter("item % 3 != 0").withColumn("statut", F.when(F.col("clos"), "imparfait").otherwise("present")).drop("clos")
    answered = o.withColumn("statut", F.when(F.col("item") % 2 == 0, "present").otherwise("imparfait")).drop("clos")
    return S.status_scores(truth, answered, o.filter("clos").select("item"), "q", "item")


@query("""
WITH f AS (SELECT o_orderkey AS fid, 'c' || o_custkey AS sujet, ['profession_de', 'pdg_de', 'nom_de'][(o_orderkey % 3) + 1] AS predicat, o_orderpriority AS objet, ['P1', 'P2'][(o_orderkey % 2) + 1] AS profil, o_orderstatus = 'F' AS clos FROM orders)
SELECT 'q1' AS qid, fid FROM f WHERE predicat = 'profession_de' AND objet = '2-HIGH' AND NOT clos UNION ALL SELECT 'q2', fid FROM f WHERE sujet = 'c7' UNION ALL SELECT 'q3', fid FROM f WHERE sujet = 'c9' AND predicat IN ('pdg_de', 'nom_de')
UNION ALL SELECT 'q4', fid FROM f WHERE predicat = 'nom_de' AND profil = 'P1' UNION ALL SELECT 'q5', fid FROM f WHERE predicat = 'pdg_de' AND profil = 'P1' AND NOT clos UNION ALL SELECT 'q6', fid FROM f WHERE profil = 'P2' UNION ALL SELECT 'q7', fid FROM f WHERE objet = '5-LOW' AND predicat = 'pdg_de'""")
def recall_truth(spark, d):
    """V10r."""
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select(
        k.alias("fid"), F.concat(F.lit("c"), "o_custkey").alias("sujet"), _pick(["profession_de", "pdg_de", "nom_de"], k).alias("predicat"), F.col("o_orderpriority").alias("objet"), _pick(["P1", "P2"], k).alias("profil"), (F.col("o_orderstatus") == "F").alias("clos")
    )
    kinds = f.select(F.col("sujet").alias("nom")).distinct().withColumn("type", F.lit("personne"))
    schema = "qid string, type string, predicat string, valeur string, ancre string, predicats array<string>, profils array<string>, types_entite array<string>, statut string"
    rows = [
        ("q1", "T1", "profession_de", "2-High", None, None, None, None, None), ("q2", "T2", None, None, "c7", None, None, None, None), ("q3", "T2", None, None, "c9", ["pdg_de", "nom_de"], None, None, None),
        ("q4", "T3", None, None, None, ["nom_de"], ["P1"], None, None), ("q5", "T3", None, None, None, ["pdg_de"], ["P1"], None, "courant"), ("q6", "T3b", None, None, None, None, ["P2"], None, None),
        ("q7", "T2", None, None, "5-LOW", ["pdg_de"], None, ["personne"], None),
    ]
    return S.recall_truth(spark.createDataFrame(rows, schema), f, kinds)


@query("""SELECT o_custkey, min(CASE WHEN c > 0.5 THEN o_orderkey END) AS premier FROM (SELECT o_custkey, o_orderkey, (o_orderkey % 100) / 100.0 AS c FROM orders) GROUP BY 1 HAVING min(CASE WHEN c > 0.5 THEN o_orderkey END) IS NOT NULL""")
def first_crossings(spark, d):
    """A23, for many curves: the first point above a reference."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", ((F.col("o_orderkey") % 100) / 100).alias("c"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.filter("c > 0.5").withColumn("n", F.row_number().over(w)).filter("n = 1").select("o_custkey", F.col("o_orderkey").alias("premier"))


@query("""
WITH x AS (SELECT c_custkey, ['C''est Bob, avant Anne', 'Bob ou Anne', 'Anne', 'Bob'][(c_custkey % 4) + 1] AS r FROM customer)
SELECT c_custkey, contains(lower(r), 'bob') AND (NOT contains(lower(r), 'anne') OR contains(lower(r), 'avant')) AS ok FROM x""")
def strict_answers(spark, d):
    """V9r."""
    r = _pick(["C'est Bob, avant Anne", "Bob ou Anne", "Anne", "Bob"], F.col("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", S.strictly_right(r, F.lit("Bob"), F.lit("Anne")).alias("ok"))


@query("SELECT o_custkey % 7 AS categorie, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS taux FROM orders GROUP BY 1")
def accuracy_by_category(spark, d):
    """A14."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("categorie"), (F.col("o_orderstatus") == "F").alias("ok"))
    return S.accuracy_by(o, ["categorie"], F.col("ok"))


@query("SELECT c_custkey, 'Réponse ' || (c_custkey % 3) AS reponse FROM customer")
def model_answers(spark, d):
    """An injected model, which gives nothing that parses on its first try."""

    def model(prompt: str, system: str, temperature: float) -> str:
        return "hm" if temperature == 0 else '<think>…</think> voici {"r": "Réponse ' + prompt[-1] + '"} fin'

    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("question "), F.col("c_custkey") % 3).alias("invite"))
    return L.answered(c, model).select("c_custkey", F.get_json_object("reponse", "$.r").alias("reponse"))


@query("SELECT c_custkey, round(CAST((c_custkey % 5) + 1 AS DOUBLE) / sqrt(((c_custkey % 5) + 1) * ((c_custkey % 5) + 1) + 4.0), 5) AS x, 1.0 AS norme FROM customer")
def embedded_names(spark, d):
    """An injected embedding, made of unit length."""
    c = table(spark, d, "customer").select("c_custkey", F.lpad((F.col("c_custkey") % 5).cast("string"), 2, "0").alias("t"))
    e = L.embedded(c, lambda t: [float(t[-1]) + 1, 2.0], "t")
    return e.select("c_custkey", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("x"), F.round(G.dot(F.col("embedding"), F.col("embedding")), 5).alias("norme"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Ada Martin' ELSE 'Lea' END AS sujet FROM conversations WHERE turn % 4 <> 2")
def coreferences(spark, d):
    """I16: a pronoun becomes the antecedent that a model finds, if the text has it."""

    def model(prompt: str, system: str, temperature: float) -> str:
        return '{"statut": "résolu", "entite": "Ada Martin"}'

    t = F.col("turn")
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(t % 4 == 2, "Il faisait froid.").otherwise("Hier Ada Martin est venue.").alias("contexte"), F.lit("Elle dirige Zentra.").alias("texte"), F.lit(0).alias("pos"),
        F.from_json(F.format_string('{"sujet":"%s","predicat":"travaille_pour","objet":"Zentra"}', F.when(t % 2 == 0, "elle").otherwise("Lea")), X.GRID).alias("grille"),
    )
    return X.finalise(rows, O.specification(spark), coreference=L.local_coreference(model)).select("conv_id", "turn", "sujet")


@query("SELECT rid, ent FROM (VALUES (1, 1), (2, 1), (4, 2), (6, 2)) v(rid, ent)")
def distant_references(spark, d):
    """References that stand for one known entity."""

    def model(prompt: str, system: str, temperature: float) -> str:
        return '{"statut": "resolu", "entite": "Orbix Hall"}' if "Orbix Hall" in prompt else '{"statut": "ambigu"}'

    ents = spark.createDataFrame([(1, "William Calder", "personne"), (2, "Orbix Hall", "lieu"), (3, "A Smith", "personne"), (4, "B Smith", "personne")], "ent long, nom string, type string")
    facts = spark.createDataFrame([(1, 2, "siege_de", "Lyon", None)], "fait_id long, sujet_key long, predicat string, objet string, objet_key long")
    refs = spark.createDataFrame([(1, "M. Calder", "homme"), (2, "M. Calder", "homme"), (3, "Mme Smith", "femme"), (4, "le grand hall", "ville"), (5, "Bertrand Sorel", "homme"), (6, "l'usine", None)], "rid long, ref string, type string")
    return L.distant_references(refs, ents, facts, model).select(F.col("rid").cast("int").alias("rid"), F.col("ent").cast("int").alias("ent"))


@query("SELECT T AS gate, count(*) AS n FROM (SELECT CASE WHEN length(trim(text)) = 0 THEN 'ignorer' WHEN length(trim(text)) > 600 THEN 'texte' WHEN suffix(trim(text), '?') THEN 'ignorer' ELSE 'fait' END AS T FROM conversations) GROUP BY 1")
def gate_counts(spark, d):
    """S11, by class."""
    return table(spark, d, "conversations").groupBy(T.gate(F.col("text")).alias("gate")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT o_custkey AS k, strftime(min(o_orderdate), '%Y-%m') AS de, CASE WHEN o_custkey % 3 = 0 THEN '2001-05' END AS fin FROM orders GROUP BY 1)
SELECT 'club' || k AS sujet, de, CASE WHEN fin IS NULL THEN 'courant' ELSE 'clos' END AS statut, CASE WHEN fin IS NULL THEN NULL ELSE TIMESTAMP '2001-05-01' END AS valide_jusqua, 0.75 AS certitude,
  CASE WHEN fin IS NULL AND k % 5 <> 0 THEN 0.55 ELSE 0.5 END AS force, 2 AS n_sources FROM t""")
def ingested_history(spark, d):
    """A history of facts to a log, and what is stored of it."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("valide_de"))
    truth = o.select(
        F.concat(F.lit("club"), "o_custkey").alias("sujet"), F.lit("appartient_a").alias("predicat"), F.lit("Ligue").alias("objet"), F.lit("src").alias("source_id"), "valide_de",
        F.when(F.col("o_custkey") % 3 == 0, "2001-05").alias("clore_a"), (F.col("o_custkey") % 5 == 0).alias("_p"),
    )
    f = W.write_facts(api.history_claims(truth, datetime(2001, 3, 1), perishable=F.col("_p")), O.specification(spark))
    return f.select("sujet", F.date_format("valide_de", "yyyy-MM").alias("de"), "statut", "valide_jusqua", F.round("certitude", 6).alias("certitude"), F.round("force", 6).alias("force"), W.n_sources(F.col("provenance")).alias("n_sources"))
