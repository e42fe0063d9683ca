"""Registered queries of the fact engine and their SQL (run by DuckDB on the same tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave import api
from factweave.functions import text as T
from factweave.operators import extraction as X
from factweave.operators import graph as G
from factweave.operators import maintenance as M
from factweave.operators import messages as C
from factweave.operators import models as L
from factweave.operators import promotion as P
from factweave.operators import rendering as R
from factweave.operators import resolution as E
from factweave.operators import scoring as S
from factweave.operators import vectors as V
from factweave.operators import writing as W
from factweave.plans import ontology as O

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# SQL pieces for the normal forms
_NORM = r"regexp_replace(strip_accents(lower({x})), '[^\p{L}\p{N}\s]', ' ', 'g')"
_VALUE = r"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_STATEMENT = "replace(replace(strip_accents(lower({x})), '’', ''''), '`', '''')"


def sql_norm(x: str, form: str = _VALUE) -> str:
    return form.replace("{x}", x)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# ---- expressions ----


@query(f"SELECT p_partkey, {sql_norm('p_name')} AS name_norm, {sql_norm('p_brand')} AS brand_norm FROM part")
def norm_value(spark, d):
    return table(spark, d, "part").select("p_partkey", T.norm_value(F.col("p_name")).alias("name_norm"), T.norm_value(F.col("p_brand")).alias("brand_norm"))


@query(f"""
WITH x AS (SELECT c_custkey, ['M. ', 'Le ', 'U.S.A. ', 'Dr. Mme ', ''][(c_custkey % 5) + 1] || c_name || [' III', '', ' Jr.'][(c_custkey % 3) + 1] AS nom FROM customer),
n AS (SELECT c_custkey, {sql_norm('nom')} AS b FROM x),
k AS (SELECT c_custkey, b, regexp_replace(b, '^((m|mme|mlle|dr|pr|le|la|les|l|entreprise|ville|societe|monsieur|madame)( |$))+', '') AS t FROM n),
j AS (SELECT c_custkey, string_split(CASE WHEN t = '' THEN b ELSE t END, ' ') AS w FROM k),
i AS (SELECT c_custkey, unnest(w) AS tok, generate_subscripts(w, 1) AS ix FROM j),
g AS (SELECT *, CASE WHEN length(tok) = 1 AND lag(length(tok)) OVER (PARTITION BY c_custkey ORDER BY ix) = 1 THEN 0 ELSE 1 END AS head FROM i),
r AS (SELECT *, sum(head) OVER (PARTITION BY c_custkey ORDER BY ix) AS run FROM g),
u AS (SELECT c_custkey, run, string_agg(tok, '' ORDER BY ix) AS tok FROM r GROUP BY 1, 2)
SELECT c_custkey, string_agg(tok, ' ' ORDER BY run) AS nom_norm,
       coalesce(string_agg(tok, ' ' ORDER BY tok) FILTER (WHERE tok IN ('ii','iii','iv','vi','vii','viii','ix','jr','sr','junior','senior')), '') AS marqueurs
FROM u GROUP BY 1""")
def norm_name(spark, d):
    lead = F.element_at(F.array(*map(F.lit, ["M. ", "Le ", "U.S.A. ", "Dr. Mme ", ""])), (F.col("c_custkey") % 5 + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, [" III", "", " Jr."])), (F.col("c_custkey") % 3 + 1).cast("int"))
    n = table(spark, d, "customer").select("c_custkey", T.norm_name(F.concat(lead, "c_name", tail)).alias("nom_norm"))
    return n.withColumn("marqueurs", F.array_join(T.generation(F.col("nom_norm")), " "))


@query("""
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
  WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-') || month(o_orderdate) ELSE 'vers ' || strftime(o_orderdate, '%Y') END AS s FROM orders)
SELECT o_orderkey, strftime(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y-%m'), try_strptime(s, '%Y')), '%Y-%m-%d') AS jour FROM x""")
def parse_date(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    s = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy-MM")).when(k == 2, F.date_format(day, "yyyy"))
    s = s.when(k == 3, F.date_format(day, "yyyy-M")).otherwise(F.concat(F.lit("vers "), F.date_format(day, "yyyy")))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(T.parse_date(s), "yyyy-MM-dd").alias("jour"))


@query("""SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'ignorer' WHEN length(trim(text)) > 600 THEN 'texte' WHEN suffix(trim(text), '?') THEN 'ignorer' ELSE 'fait' END AS classe FROM conversations""")
def gate_classify(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.gate(F.col("text")).alias("classe"))


@query("SELECT conv_id, arg_max(text, turn) AS dernier FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, d):
    return C.last_of(table(spark, d, "conversations"), "user").select("conv_id", F.col("text").alias("dernier"))


@query("SELECT conv_id, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS jetons FROM conversations GROUP BY conv_id")
def token_estimate(spark, d):
    return C.token_estimate(table(spark, d, "conversations"))


_SAYINGS = (
    "il ne dirige plus cette maison", "n'a jamais cessé de diriger", "elle a quitté le groupe", "il envisage de partir", "selon des rumeurs il pourrait céder", "toujours en poste",
    "président de 1990 à 1995", "membre entre 2001 et 2004", "en fonction jusqu'en 2010", "depuis 1999 au conseil", "né le 3 août 1961", "à partir de 2015", "né le 1er mai 1950",
)
_SAID = "['" + "', '".join(s.replace("'", "''") for s in _SAYINGS) + f"'][(c_custkey % {len(_SAYINGS)}) + 1]"


def _statements(spark, d):
    said = F.element_at(F.array(*map(F.lit, _SAYINGS)), (F.col("c_custkey") % len(_SAYINGS) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", "c_name", F.lit("—"), said).alias("texte"))


_STATED = f"WITH s AS (SELECT c_custkey, {sql_norm(f'c_name || ' + chr(39) + ' — ' + chr(39) + f' || {_SAID}', _STATEMENT)} AS t FROM customer)"


@query(f"""{_STATED}
SELECT c_custkey, CASE WHEN regexp_matches(t, {quoted(T.LITOTES)}) THEN NULL WHEN regexp_matches(t, {quoted(T.ENDINGS)}) THEN 'niee' END AS polarite,
  CASE WHEN regexp_matches(t, {quoted(T.UNREAL)}) THEN 'projete' END AS modalite, regexp_matches(t, {quoted(T.GOES_ON)}) AS suite FROM s""")
def polarity_modality(spark, d):
    t = F.col("texte")
    return _statements(spark, d).select("c_custkey", T.polarity_floor(t).alias("polarite"), T.modality_floor(t).alias("modalite"), T.goes_on(t).alias("suite"))


@query(f"""{_STATED},
x AS (SELECT c_custkey, t, nullif(regexp_extract(t, {quoted(T.FROM_TO)}, 1), '') AS a1, nullif(regexp_extract(t, {quoted(T.FROM_TO)}, 2), '') AS b1,
  nullif(regexp_extract(t, {quoted(T.BETWEEN)}, 1), '') AS a2, nullif(regexp_extract(t, {quoted(T.BETWEEN)}, 2), '') AS b2, nullif(regexp_extract(t, {quoted(T.UNTIL)}, 1), '') AS u,
  coalesce(nullif(regexp_extract(t, {quoted(T.SINCE)}, 1), ''), nullif(regexp_extract(t, {quoted(T.SINCE)}, 2), '')) AS d, nullif(regexp_extract(t, {quoted(T.ON_DAY)}, 2), '') AS o FROM s)
SELECT c_custkey, CASE WHEN a1 IS NOT NULL OR a2 IS NOT NULL THEN 'intervalle_ferme' WHEN u IS NOT NULL THEN 'fin_seule' WHEN d IS NOT NULL THEN 'debut_seul' WHEN o IS NOT NULL THEN 'occurrence' END AS forme,
  CASE WHEN a1 IS NOT NULL OR a2 IS NOT NULL THEN coalesce(a1, a2) WHEN u IS NOT NULL THEN NULL ELSE coalesce(d, o) END AS debut, CASE WHEN a1 IS NOT NULL OR a2 IS NOT NULL THEN coalesce(b1, b2) ELSE u END AS fin FROM x""")
def temporality(spark, d):
    f = _statements(spark, d).select("c_custkey", T.temporality_floor(F.col("texte")).alias("f"))
    return f.select("c_custkey", F.col("f.form").alias("forme"), F.col("f.start").alias("debut"), F.col("f.end").alias("fin"))


@query("""
SELECT p_partkey, ['personne','ville','club','pays','prix','xyz'][(p_partkey % 6) + 1] AS t1, ['lieu','Film','banque','region','nation','date'][(p_size % 6) + 1] AS t2,
  [['personne'],['lieu'],['organisation','groupe'],['organisation','lieu'],['valeur','distinction'],[]][(p_partkey % 6) + 1] AS cases,
  coalesce([ 'personne','lieu','organisation','lieu',NULL,NULL][(p_partkey % 6) + 1] = ['lieu','oeuvre','organisation','lieu',NULL,'date'][(p_size % 6) + 1], true) AS compatibles FROM part""")
def type_gate(spark, d):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % 6 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", pick(["personne", "ville", "club", "pays", "prix", "xyz"], F.col("p_partkey")).alias("t1"), pick(["lieu", "Film", "banque", "region", "nation", "date"], F.col("p_size")).alias("t2"))
    return p.select("*", T.type_tags(F.col("t1")).alias("cases"), T.types_compatible(F.col("t1"), F.col("t2")).alias("compatibles"))


# ---- aggregates over claims ----


@query("""
SELECT event_type AS predicat, user_id, count(DISTINCT value) AS n_src, least(0.95, 0.55 + 0.20 * (count(DISTINCT value) - 1)) AS certitude FROM events GROUP BY 1, 2""")
def source_count(spark, d):
    """A1 over provenance arrays, and the certainty that follows."""
    told = F.struct(F.col("value").cast("string").alias("source_id"), F.col("ts").alias("date"), F.lit("rapport").alias("type"))
    closing = F.struct(F.lit("cloture").alias("source_id"), F.col("ts").alias("date"), F.lit("cloture").alias("type"))
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("predicat"), "user_id").agg(F.flatten(F.collect_list(F.array(told, closing))).alias("provenance"))
    g = g.select("predicat", "user_id", W.n_sources(F.col("provenance")).cast("long").alias("n_src"))
    return g.withColumn("certitude", F.least(F.lit(W.CERT_CAP), W.CERT_INIT + W.CERT_GAIN * (F.col("n_src") - 1)))


_AS_OF = "2024-03-01"


def _event_facts(spark, d):
    """A fact for each user and event type, as it was when last seen, with a source for each whole value."""
    source = F.struct(F.col("value").cast("int").cast("string").alias("source_id"), F.col("ts").alias("date"), F.lit("rapport").alias("type"))
    g = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("predicat")).agg(F.max("ts").alias("vu"), F.count("*").alias("compteur_acces"), F.collect_list(source).alias("provenance"))
    alone = W.n_sources(F.col("provenance")) < 2
    return g.withColumns({
        "dernier_acces": F.col("vu"), "derniere_confirmation": F.col("vu"), "force": F.lit(W.FORCE_INIT), "certitude": F.when(alone, W.CERT_INIT).otherwise(W.CERT_INIT + W.CERT_GAIN),
        "noyau": F.lit(False), "importance": F.lit(0.0), "statut": F.lit("courant"), "statut_avant": F.lit(None).cast("string"),
    })


@query(f"""
WITH f AS (SELECT user_id, event_type AS predicat, max(ts) AS vu, count(*) AS n, count(DISTINCT trunc(value)) AS n_src FROM events GROUP BY 1, 2),
a AS (SELECT *, (n_src >= 3 AND n >= 5) AS noyau, epoch_us(TIMESTAMP '{_AS_OF}' - vu) / 86400e6 AS j FROM f)
SELECT user_id, predicat, noyau, round(0.5 * pow(0.5, j / (240 * CASE WHEN noyau THEN 2 ELSE 1 END)), 9) AS force,
  round(greatest(CASE WHEN n_src < 2 THEN least(0.6, 0.55 * pow(0.5, j / 45)) ELSE 0.75 * pow(0.5, j / (45 * CASE WHEN noyau THEN 2 ELSE 1 END)) END, CASE WHEN n_src >= 2 THEN 0.55 ELSE 0 END), 9) AS certitude,
  (0.5 * pow(0.5, j / (240 * CASE WHEN noyau THEN 2 ELSE 1 END)) < 0.15 AND NOT noyau AND n_src < 3) AS dort FROM a""")
def decay_as_of(spark, d):
    """Core, decay, floor and dormancy of what events say, as of a day."""
    kinds = [(k, False, "volatil", False, None, None, 0.4, O.HALF_LIFE["volatil"]) for k in ("click", "view", "purchase", "signup", "error")]
    spec = O.specification(spark, kinds)
    f = M.core(_event_facts(spark, d))
    f = M.dormancy(M.floor(M.decay(f, spec, F.lit(_AS_OF).cast("timestamp"))))
    return f.select("user_id", "predicat", "noyau", F.round("force", 9).alias("force"), F.round("certitude", 9).alias("certitude"), (F.col("statut") == "dormant").alias("dort"))


@query("""
WITH a AS (SELECT o_orderpriority AS predicat, count(*) AS n_occ, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_clos FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
b AS (SELECT *, n_clos / n_occ AS taux, greatest(20, 730 * pow(0.5, (n_clos / n_occ) / 0.10)) AS vu, CASE WHEN n_occ < 12 OR n_clos < 3 THEN 0 ELSE n_occ / (n_occ + 30) END AS w FROM a)
SELECT predicat, n_occ, n_clos, round_even(taux, 3) AS taux, round_even(w, 2) AS confiance, round_even(vu, 1) AS obs_dv, round_even((1 - w) * 730 + w * vu, 1) AS dv,
  CASE WHEN w >= 0.6 THEN 'appris' WHEN w >= 0.15 THEN 'mixte' ELSE 'supposition' END AS etiquette FROM b""")
def learned_volatility(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "clos").when(F.col("o_orderstatus") == "P", "disputé").otherwise("courant")
    facts = table(spark, d, "orders").select(F.col("o_orderpriority").alias("predicat"), status.alias("statut"))
    return M.learned_volatility(facts, O.specification(spark))


@query("""
WITH s AS (SELECT o_custkey, o_orderpriority, o_orderdate AS de, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a FROM orders)
SELECT o_custkey, o_orderpriority FROM s WHERE de <= TIMESTAMP '1996-07-01' AND (a IS NULL OR TIMESTAMP '1996-07-01' < a)""")
def point_in_time(spark, d):
    """P10: the priority of each customer that held at a moment."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderdate").alias("valide_de"), F.lead("o_orderdate").over(w).alias("valide_jusqua"))
    return G.valid_at(s, F.lit("1996-07-01").cast("timestamp")).select("o_custkey", "o_orderpriority")


# ---- the write path ----


def priority_claims(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    seq = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 10_000_000_000 + F.col("o_orderkey")
    return o.select(
        seq.alias("claim_seq"), F.lit("assert").alias("op"), F.concat(F.lit("cust:"), "o_custkey").alias("sujet"), F.lit("priorite").alias("predicat"),
        F.col("o_orderpriority").alias("objet"), F.col("o_orderstatus").alias("source_id"), F.col("o_orderdate").alias("date_obs"), day.alias("date_validite"),
    )


#: The write rules as SQL: a recursion over each customer's orders whose state is the list of facts.
_FOLD = """
WITH RECURSIVE c AS (
  SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n,
         epoch(date_trunc('day', o_orderdate))::BIGINT // 86400 * 10000000000 + o_orderkey AS seq, o_orderpriority AS v, o_orderstatus AS src, o_orderdate AS d
  FROM orders
), s AS (
  SELECT k, 0::BIGINT AS n, NULL::VARCHAR AS action,
         []::STRUCT(id BIGINT, v VARCHAR, f DOUBLE, c DOUBLE, srcs VARCHAR[], de TIMESTAMP, fin TIMESTAMP, vu TIMESTAMP, st VARCHAR)[] AS x
  FROM (SELECT DISTINCT k FROM c)
  UNION ALL
  SELECT k, n, action,
    CASE action
      WHEN 'repetition' THEN list_transform(x, lambda y: CASE WHEN y.v = v THEN struct_pack(id := y.id, v := y.v, f := least(0.99::DOUBLE, y.f + 0.05::DOUBLE), c := y.c, srcs := y.srcs, de := y.de, fin := y.fin, vu := d, st := y.st) ELSE y END)
      WHEN 'corroboration' THEN list_transform(x, lambda y: CASE WHEN y.v = v THEN struct_pack(id := y.id, v := y.v, f := y.f, c := up, srcs := list_append(y.srcs, src), de := y.de, fin := y.fin, vu := d, st := y.st) ELSE y END)
      WHEN 'corroboration_courant' THEN list_transform(x, lambda y: CASE WHEN y.v = v THEN struct_pack(id := y.id, v := y.v, f := y.f, c := up, srcs := list_append(y.srcs, src), de := y.de, fin := y.fin, vu := d, st := 'courant') ELSE y END)
      WHEN 'creation' THEN list_append(x, fresh)
      WHEN 'cloture' THEN list_append(list_transform(x, lambda y: CASE WHEN y.id = held.id THEN struct_pack(id := y.id, v := y.v, f := y.f, c := y.c, srcs := y.srcs, de := y.de, fin := d, vu := y.vu, st := 'clos') ELSE y END), fresh)
      ELSE list_append(list_transform(x, lambda y: CASE WHEN y.id = held.id THEN struct_pack(id := y.id, v := y.v, f := y.f, c := CASE action WHEN 'dispute_corrobore' THEN greatest(0::DOUBLE, y.c - 0.1::DOUBLE) ELSE y.c END, srcs := y.srcs, de := y.de, fin := y.fin, vu := y.vu, st := 'disputé') ELSE y END),
             struct_pack(id := fresh.id, v := fresh.v, f := fresh.f, c := fresh.c, srcs := fresh.srcs, de := fresh.de, fin := fresh.fin, vu := fresh.vu, st := 'disputé'))
    END
  FROM (
    SELECT *, CASE
        WHEN same IS NOT NULL AND list_contains(same.srcs, src) THEN 'repetition'
        WHEN same IS NOT NULL AND same.st = 'disputé' AND up >= 0.6 THEN 'corroboration_courant'
        WHEN same IS NOT NULL THEN 'corroboration'
        WHEN held IS NULL THEN 'creation'
        WHEN d > held.de AND (NOT list_contains(held.srcs, src) OR held.c < 0.6) THEN 'cloture'
        WHEN held.c >= 0.6 AND len(held.srcs) >= 2 THEN 'dispute_corrobore'
        ELSE 'dispute' END AS action
    FROM (
      SELECT *, least(0.95::DOUBLE, same.c + 0.2::DOUBLE) AS up FROM (
        SELECT s.k, c.n, c.v, c.src, c.d, s.x, list_filter(s.x, lambda y: y.v = c.v)[1] AS same,
               list_filter(s.x, lambda y: y.st IN ('courant', 'disputé') AND y.de = list_max(list_transform(list_filter(s.x, lambda z: z.st IN ('courant', 'disputé')), lambda z: z.de)))[1] AS held,
               struct_pack(id := c.seq, v := c.v, f := 0.5::DOUBLE, c := 0.55::DOUBLE, srcs := [c.src], de := c.d, fin := NULL::TIMESTAMP, vu := c.d, st := 'courant') AS fresh
        FROM s JOIN c ON c.k = s.k AND c.n = s.n + 1)))
), f AS (
  SELECT 'cust ' || k AS sujet_key, unnest(x, recursive := true) FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1
)
"""

PRIORITY = ("priorite", True, "changeant", False, "entite", "valeur", 0.4, 180.0)


@query(_FOLD + """
SELECT id AS fait_id, sujet_key, 'priorite' AS predicat, v AS objet, round(f, 9) AS force, round(c, 9) AS certitude, len(srcs) AS n_sources, de AS valide_de, fin AS valide_jusqua, st AS statut FROM f""")
def priority_facts(spark, d):
    """I1 over orders: the facts of each customer's priority, whole log."""
    f = W.write_facts(priority_claims(spark, d), O.specification(spark, [PRIORITY]))
    n = W.n_sources(F.col("provenance")).cast("long").alias("n_sources")
    return f.select("fait_id", "sujet_key", "predicat", "objet", F.round("force", 9).alias("force"), F.round("certitude", 9).alias("certitude"), n, "valide_de", "valide_jusqua", "statut")


@query(_FOLD + "SELECT action, count(*) AS n FROM s WHERE n > 0 GROUP BY 1")
def priority_actions(spark, d):
    return W.write_report(priority_claims(spark, d), O.specification(spark, [PRIORITY])).groupBy("action").agg(F.count("*").alias("n"))


@query(_FOLD + """
SELECT sujet_key, v AS objet, st AS statut, CASE WHEN st = 'disputé' THEN 'disputé' WHEN c >= 0.6 THEN 'sûr' ELSE 'incertain' END AS etiquette, round(c, 6) AS certitude
FROM f WHERE st IN ('courant', 'disputé')""")
def current_priority(spark, d):
    """The minimum slice: current or disputed value of each customer with its label."""
    f = W.write_facts(priority_claims(spark, d), O.specification(spark, [PRIORITY]))
    label = F.when(F.col("statut") == "disputé", "disputé").when(F.col("certitude") >= W.CERT_SURE, "sûr").otherwise("incertain")
    return f.filter(F.col("statut").isin("courant", "disputé")).select("sujet_key", "objet", "statut", label.alias("etiquette"), F.round("certitude", 6).alias("certitude"))


@query(_FOLD + """
, a AS (SELECT count(*) AS n_occ, count(*) FILTER (WHERE st = 'clos') AS n_clos FROM f WHERE st <> 'disputé'),
w AS (SELECT CASE WHEN n_occ < 12 OR n_clos < 3 THEN 0 ELSE n_occ / (n_occ + 30) END AS w, greatest(20, 730 * pow(0.5, (n_clos / n_occ) / 0.10)) AS seen FROM a),
l AS (SELECT CASE WHEN round_even(w, 2) > 0 THEN round_even((1 - w) * 180 + w * seen, 1) ELSE 180 END AS dv FROM w),
g AS (SELECT st, len(srcs) AS n, (epoch_us(TIMESTAMP '1999-01-01') - epoch_us(vu)) / 86400e6 AS j, (epoch_us(TIMESTAMP '1999-01-01') - epoch_us(de)) / 86400e6 AS acc, f, c, dv FROM f, l),
h AS (SELECT st, n, CASE WHEN acc > 0 THEN f * pow(0.5, acc / 240) ELSE f END AS f, CASE WHEN j > 0 THEN c * pow(0.5, j / dv) ELSE c END AS c FROM g),
i AS (SELECT n, f, CASE WHEN n < 2 THEN least(c, 0.6) ELSE greatest(c, 0.55) END AS c, CASE WHEN f < 0.15 AND n < 3 THEN 'dormant' ELSE st END AS st FROM h)
SELECT st AS statut, false AS noyau, count(*) AS n, round(avg(f), 6) AS force, round(avg(c), 6) AS certitude FROM i GROUP BY 1""")
def consolidated(spark, d):
    """The fold, then consolidation with learned volatility."""
    spec = O.specification(spark, [PRIORITY])
    f = M.consolidate(W.write_facts(priority_claims(spark, d), spec), spec, F.lit("1999-01-01").cast("timestamp"), learn=True)
    return f.groupBy("statut", "noyau").agg(F.count("*").alias("n"), F.round(F.avg("force"), 6).alias("force"), F.round(F.avg("certitude"), 6).alias("certitude"))


@query("""
WITH c AS (SELECT user_id, event_type AS objet, props AS source, ts, event_id FROM events),
f AS (SELECT user_id, objet, source, row_number() OVER (PARTITION BY user_id, objet ORDER BY event_id) AS pos, min(event_id) OVER (PARTITION BY user_id, objet, source) AS first_src, event_id FROM c),
g AS (SELECT user_id, objet, min(event_id) AS fait_id, count(*) AS n, count(DISTINCT source) AS n_src FROM f GROUP BY 1, 2)
SELECT fait_id, 'user ' || user_id AS sujet_key, objet, n_src AS n_sources, round(least(0.99, 0.5 + 0.05 * (n - n_src)), 6) AS force, round(least(0.95, 0.55 + 0.20 * (n_src - 1)), 6) AS certitude FROM g""")
def multi_valued_facts(spark, d):
    """I1 on a multi-valued predicate, where the state has a closed form."""
    e = table(spark, d, "events")
    claims = e.select(
        F.col("event_id").alias("claim_seq"), F.lit("assert").alias("op"), F.concat(F.lit("user:"), "user_id").alias("sujet"), F.lit("produit").alias("predicat"),
        F.col("event_type").alias("objet"), F.col("props").alias("source_id"), F.col("ts").alias("date_obs"),
    )
    f = W.write_facts(claims, O.specification(spark))
    return f.select("fait_id", "sujet_key", "objet", W.n_sources(F.col("provenance")).cast("long").alias("n_sources"), F.round("force", 6).alias("force"), F.round("certitude", 6).alias("certitude"))


# ---- retrieval ----


@query("""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, q), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS sim FROM embeddings, q)
SELECT vec_id, round(sim + 0.5 * ((vec_id % 100) / 100.0) - CASE WHEN vec_id % 7 = 0 THEN greatest(0.05, 0.30 / (1 + 3 * (vec_id % 3))) ELSE 0 END, 6) AS score FROM s
ORDER BY sim + 0.5 * ((vec_id % 100) / 100.0) - CASE WHEN vec_id % 7 = 0 THEN greatest(0.05, 0.30 / (1 + 3 * (vec_id % 3))) ELSE 0 END DESC, vec_id LIMIT 8""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    force, n_src = (F.col("vec_id") % 100) / 100, F.col("vec_id") % 3 + 1
    penalty = F.when(F.col("vec_id") % 7 == 0, G.sleep_penalty(n_src)).otherwise(0.0)
    r = G.vector_topk(e.join(F.broadcast(q)), F.col("q"), id_col="vec_id", extra=G.W_FORCE * force - penalty)
    return r.select("vec_id", F.round("score", 6).alias("score"))


@query("""
SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) > 0.45""")
def near_vectors(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return V.vector_pairs(e, 0.45).select("a", "b")


@query()
def merged_entities(spark, d):
    """R3 over the embeddings, with a type from the label."""
    kind = F.element_at(F.array(*map(F.lit, ["personne", "ville", "film"])), (F.col("label") % 3 + 1).cast("int"))
    return E.merge_entities(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), kind.alias("type"), "embedding"))


@query(f"""
WITH p AS (SELECT DISTINCT {sql_norm('p_name')} AS ent FROM part), q AS (SELECT o_orderkey AS qid, {sql_norm("'y a t il un ' || p_name || ' en ' || o_orderpriority")} AS t FROM orders JOIN part ON p_partkey = o_orderkey % 50)
SELECT qid, ent FROM p, q WHERE list_has_all(string_split(t, ' '), string_split(ent, ' ')) OR (len(list_filter(string_split(ent, ' '), lambda x: length(x) >= 3 AND regexp_full_match(x, '[a-z]+'))) > 0
  AND list_contains(string_split(t, ' '), list_filter(string_split(ent, ' '), lambda x: length(x) >= 3 AND regexp_full_match(x, '[a-z]+'))[1])
  AND list_contains(string_split(t, ' '), list_filter(string_split(ent, ' '), lambda x: length(x) >= 3 AND regexp_full_match(x, '[a-z]+'))[-1]))""")
def recognition(spark, d):
    p = table(spark, d, "part")
    ents = p.select(T.norm_value(F.col("p_name")).alias("ent")).distinct().withColumn("name", F.col("ent"))
    o = table(spark, d, "orders").join(p, F.col("p_partkey") == F.col("o_orderkey") % 50)
    text = F.concat(F.lit("y a t il un "), "p_name", F.lit(" en "), "o_orderpriority")
    return G.recognised(ents, o.select(F.col("o_orderkey").alias("qid"), T.norm_value(text).alias("text")))


def supply_facts(spark, d):
    """Supplier -> nation -> region as facts between entities."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("sujet_key"), F.lit("travaille_pour").alias("predicat"), F.concat(F.lit("n"), "s_nationkey").alias("objet_key"), F.col("s_suppkey").alias("fait_id"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("sujet_key"), F.lit("dirige").alias("predicat"), F.concat(F.lit("r"), "n_regionkey").alias("objet_key"), (F.col("n_nationkey") + 1_000_000_000).alias("fait_id"))
    return s.unionByName(n)


_SUPPLY = """WITH f AS (SELECT 's' || s_suppkey AS a, 'travaille_pour' AS predicat, 'n' || s_nationkey AS b, s_suppkey AS fait_id FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'dirige', 'r' || n_regionkey, n_nationkey + 1000000000 FROM nation)"""


@query(f"""{_SUPPLY},
i AS (SELECT a AS ent, b AS autre, fait_id, predicat, 'sortant' AS sens FROM f UNION ALL SELECT b, a, fait_id, predicat, 'entrant' FROM f),
g AS (SELECT ent, count(DISTINCT autre) AS degre FROM i GROUP BY 1)
SELECT i.ent, i.fait_id, i.sens, i.predicat, i.autre AS vers, g.degre FROM i JOIN g ON g.ent = i.autre""")
def neighbours(spark, d):
    return G.neighbours(supply_facts(spark, d).withColumn("statut", F.lit("courant"))).drop("statut")


@query(f"""{_SUPPLY},
i AS (SELECT a AS ent, fait_id FROM f UNION ALL SELECT b, fait_id FROM f), e0 AS (SELECT DISTINCT ent FROM i WHERE fait_id = 3),
h1 AS (SELECT DISTINCT fait_id FROM i WHERE ent IN (SELECT ent FROM e0) AND fait_id <> 3), e1 AS (SELECT DISTINCT ent FROM i WHERE fait_id IN (SELECT fait_id FROM h1)),
h2 AS (SELECT DISTINCT fait_id FROM i WHERE ent IN (SELECT ent FROM e1) AND fait_id <> 3 AND fait_id NOT IN (SELECT fait_id FROM h1))
SELECT fait_id FROM h1 UNION ALL SELECT fait_id FROM h2""")
def walk_2hop(spark, d):
    f = supply_facts(spark, d)
    return G.walk(f, f.filter("fait_id = 3"))


_LINKS = """WITH l AS (SELECT s_suppkey AS lid, 'n' || s_nationkey AS a, 'n' || ((s_suppkey * 7) % 25) AS b, s_suppkey % 3 = 0 AS dated, s_suppkey % 6 = 0 AS occurrence FROM supplier WHERE s_nationkey <> (s_suppkey * 7) % 25),
g AS (SELECT ent, count(DISTINCT o) AS degre FROM (SELECT a AS ent, b AS o FROM l UNION ALL SELECT b, a FROM l) GROUP BY 1),
f AS (SELECT l.lid, x.degre AS deg_sujet, y.degre AS deg_objet, EXISTS (SELECT 1 FROM l r WHERE r.a = l.b AND r.b = l.a AND r.lid <> l.lid) AS reciproque, dated, occurrence FROM l JOIN g x ON x.ent = l.a JOIN g y ON y.ent = l.b)"""


@query(_LINKS + """
SELECT *, CASE WHEN least(deg_sujet, deg_objet) >= 2 THEN 'DURABLE' ELSE 'ÉPHÉMÈRE' END AS s1, CASE WHEN occurrence THEN 'ÉPHÉMÈRE' WHEN reciproque THEN 'DURABLE' ELSE 'ÉPHÉMÈRE' END AS s2,
 CASE WHEN occurrence THEN 'ÉPHÉMÈRE' WHEN reciproque THEN 'DURABLE' WHEN least(deg_sujet, deg_objet) >= 2 THEN 'DURABLE' ELSE 'ÉPHÉMÈRE' END AS s1s2,
 CASE WHEN reciproque THEN 'DURABLE' ELSE 'ÉPHÉMÈRE' END AS recip_first, CASE WHEN dated THEN 'ÉPHÉMÈRE' WHEN reciproque THEN 'DURABLE' ELSE 'ÉPHÉMÈRE' END AS naive_date FROM f""")
def typology(spark, d):
    s = table(spark, d, "supplier")
    b = (F.col("s_suppkey") * 7) % 25
    links = s.filter(F.col("s_nationkey") != b).select(F.col("s_suppkey").alias("lid"), F.concat(F.lit("n"), "s_nationkey").alias("a"), F.concat(F.lit("n"), b.cast("string")).alias("b"), (F.col("s_suppkey") % 3 == 0).alias("dated"), (F.col("s_suppkey") % 6 == 0).alias("occurrence"))
    return G.typology(links)


@query("""
SELECT 'a_pour_patron' AS predicat, 's' || s_suppkey AS src, 'r' || n_regionkey AS dst, CASE WHEN s_suppkey % 5 = 0 THEN 'clos' WHEN n_nationkey % 4 = 0 THEN 'disputé' ELSE 'courant' END AS statut,
  round(least(0.5 + (s_suppkey % 40) / 100.0, 0.6), 6) AS certitude, s_suppkey AS f1, n_nationkey + 1000000000 AS f2, s_suppkey % 5 <> 0 AS actif FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def compose_chain(spark, d):
    f = supply_facts(spark, d)
    k = F.col("fait_id")
    f = f.withColumns({
        "statut": F.when((F.col("predicat") == "travaille_pour") & (k % 5 == 0), "clos").when((F.col("predicat") == "dirige") & ((k - 1_000_000_000) % 4 == 0), "disputé").otherwise("courant"),
        "certitude": F.when(F.col("predicat") == "dirige", 0.6).otherwise(0.5 + (k % 40) / 100), "valide_jusqua": F.lit(None).cast("timestamp"),
    })
    return G.compose(f, O.specification(spark), most=None).withColumn("certitude", F.round("certitude", 6)).drop("valide_jusqua")


_NEIGH = "SELECT DISTINCT 's' || l_suppkey AS ent, 'p' || l_partkey AS nk FROM lineitem"


@query(f"""
WITH n AS ({_NEIGH}), df AS (SELECT nk, count(*) AS df FROM n GROUP BY 1), k AS (SELECT ent, CASE WHEN CAST(substr(ent, 2) AS BIGINT) % 3 = 0 THEN 'personne' ELSE 'organisation' END AS fam FROM (SELECT DISTINCT ent FROM n))
SELECT a.ent AS a, b.ent AS b, ka.fam, round(sum(1.0 / df), 6) AS score, count(*) FILTER (WHERE 1.0 / df >= 0.25) AS rares
FROM n a JOIN n b ON a.nk = b.nk AND a.ent < b.ent JOIN df ON df.nk = a.nk JOIN k ka ON ka.ent = a.ent JOIN k kb ON kb.ent = b.ent AND kb.fam = ka.fam
GROUP BY 1, 2, 3 HAVING sum(1.0 / df) >= 0.30 AND (ka.fam <> 'personne' OR count(*) FILTER (WHERE 1.0 / df >= 0.25) >= 2 OR sum(1.0 / df) >= 0.75)""")
def fragment_scores(spark, d):
    """Suppliers by the parts that they share."""
    n = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("ent"), F.concat(F.lit("p"), "l_partkey").alias("nk")).distinct()
    kind = F.when(F.expr("cast(substr(ent, 2) as bigint) % 3 = 0"), "individu").otherwise("banque")
    s = E.fragment_scores(n, n.select("ent").distinct().withColumn("type", kind))
    return s.withColumn("score", F.round("score", 6))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1""")
def dedup_triples(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return G.first_of(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("""
WITH a AS (SELECT o_orderkey AS fait_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders), b AS (SELECT o_orderkey AS fait_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
u AS (SELECT fait_id, pos, 0 AS prio FROM a UNION ALL SELECT fait_id, pos, 1 FROM b)
SELECT fait_id, prio, pos FROM u QUALIFY row_number() OVER (PARTITION BY fait_id ORDER BY prio, pos) = 1""")
def ordered_union(spark, d):
    """Two whole ranked lists, the first list that has a fact wins."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("fait_id"), "o_totalprice", "o_orderdate")
    return G.ordered_union([G.ranked(o, F.desc("o_totalprice"), F.asc("fait_id")), G.ranked(o, F.asc("o_orderdate"), F.asc("fait_id"))])


@query("""
WITH i AS (SELECT 'c' || o_custkey AS ent, o_orderkey AS fait_id FROM orders UNION SELECT 'p' || o_orderpriority, o_orderkey FROM orders)
SELECT ent, fait_id, row_number() OVER (PARTITION BY ent ORDER BY fait_id) AS rn FROM i QUALIFY rn <= 64""")
def fanout_cap(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("sujet_key"), F.concat(F.lit("p"), "o_orderpriority").alias("objet_key"), F.col("o_orderkey").alias("fait_id"))
    return G.fanout(o)


@query(f"""
WITH f AS (SELECT p_partkey AS fait_id, p_partkey AS pos, {sql_norm('p_name')} AS s, {sql_norm('p_type')} AS o, CASE WHEN p_size % 2 = 0 THEN 'clos' ELSE 'courant' END AS statut FROM part),
x AS (SELECT *, list_has_any(string_split(s, ' '), ['red', 'ring', 'economy']) AS sn, list_has_any(string_split(o, ' '), ['red', 'ring', 'economy']) AS on_ FROM f)
SELECT fait_id, CASE WHEN sn THEN 2 ELSE 0 END + CASE WHEN sn AND statut = 'clos' THEN 1 ELSE 0 END AS score FROM x WHERE sn OR on_ ORDER BY score DESC, pos LIMIT 10""")
def focus_topk(spark, d):
    f = table(spark, d, "part").select(
        F.col("p_partkey").alias("fait_id"), F.col("p_partkey").alias("pos"), T.norm_value(F.col("p_name")).alias("sujet_nom"), T.norm_value(F.col("p_type")).alias("objet_nom"),
        F.when(F.col("p_size") % 2 == 0, "clos").otherwise("courant").alias("statut"), F.lit(None).cast("string").alias("statut_avant"),
    )
    return G.focus(f, F.lit("red ring economy"))


@query()
def importance(spark, d):
    """N4 on supplier - nation - region, 40 rounds."""
    f = supply_facts(spark, d).join(F.broadcast(O.specification(spark).select("predicat", "poids")), "predicat")
    prov = F.array(F.struct(F.concat(F.lit("src"), (F.col("fait_id") % 3).cast("string")).alias("source_id")))
    f = f.withColumns({"certitude": F.lit(0.6), "provenance": prov})
    ents = f.select(F.col("sujet_key").alias("ent")).union(f.select("objet_key")).distinct().withColumn("type", F.lit("organisation"))
    return G.importance(ents, f, {}).withColumn("importance", F.round("importance", 9))


# ---- rendering, extraction, evaluation ----


@query("""
SELECT fait_id, '• [' || CASE WHEN statut = 'clos' THEN 'CLOS — n''est plus valable depuis ' || strftime(fin, '%Y-%m') || '] ' || sujet || ' appartenait à ' || objet || ' (de ' || strftime(de, '%Y-%m') || ' à ' || strftime(fin, '%Y-%m') || ').'
  WHEN c >= 0.6 THEN 'ACTUEL — sûr, 1 source, confirmé ' || strftime(de, '%Y-%m') || '] ' || sujet || ' appartient à ' || objet || '.'
  ELSE 'ACTUEL — incertain, 1 source, dernière confirmation ' || strftime(de, '%Y-%m') || '] ' || sujet || ' appartient à ' || objet || ' — à revérifier.' END AS ligne
FROM (SELECT o_orderkey AS fait_id, 'Client ' || o_custkey AS sujet, o_orderpriority AS objet, o_orderdate AS de, o_orderdate + INTERVAL 40 DAY AS fin, CASE WHEN o_orderstatus = 'F' THEN 'clos' ELSE 'courant' END AS statut, (o_orderkey % 100) / 100.0 AS c FROM orders)""")
def epistemic_lines(spark, d):
    o = table(spark, d, "orders")
    prov = F.array(F.struct(F.lit("src").alias("source_id"), F.col("o_orderdate").alias("date"), F.lit("rapport").alias("type")))
    f = o.select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("Client "), "o_custkey").alias("sujet"), F.lit("x").alias("sujet_key"), F.lit("appartient_a").alias("predicat"), F.col("o_orderpriority").alias("objet"),
        prov.alias("provenance"), F.col("o_orderdate").alias("derniere_confirmation"), F.col("o_orderdate").alias("valide_de"), (F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS")).alias("valide_jusqua"),
        F.when(F.col("o_orderstatus") == "F", "clos").otherwise("courant").alias("statut"), F.lit(None).cast("string").alias("statut_avant"), ((F.col("o_orderkey") % 100) / 100).alias("certitude"),
    )
    return R.epistemic_lines(f, O.template_table(spark)).select(F.col("pos").alias("fait_id"), "ligne")


@query("""SELECT o_custkey, string_agg('« ' || o_orderpriority || ' » (source ' || o_orderstatus || ', ' || strftime(o_orderdate, '%Y-%m') || ')', ' VS ' ORDER BY o_orderdate, o_orderkey) AS parts FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def disputed_groups(spark, d):
    """The disputed lines that rendering makes, one a customer."""
    o = table(spark, d, "orders").filter("o_orderstatus <> 'F'")
    told = F.array(F.struct(F.col("o_orderstatus").alias("source_id"), F.col("o_orderdate").alias("date"), F.lit("rapport").alias("type")))
    seq = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 10_000_000_000 + F.col("o_orderkey")
    f = o.select(
        seq.alias("pos"), F.col("o_custkey").cast("string").alias("sujet"), F.col("o_custkey").cast("string").alias("sujet_key"), F.lit("priorite").alias("predicat"), F.col("o_orderpriority").alias("objet"),
        told.alias("provenance"), F.col("o_orderdate").alias("derniere_confirmation"), F.col("o_orderdate").alias("valide_de"), F.lit(None).cast("timestamp").alias("valide_jusqua"),
        F.lit("disputé").alias("statut"), F.lit(None).cast("string").alias("statut_avant"), F.lit(0.5).alias("certitude"),
    )
    line = R.epistemic_lines(f, O.template_table(spark)).select(F.regexp_extract("ligne", r"^• \[DISPUTÉ — non tranché\] (\d+) : (.*)$", 1).cast("long").alias("o_custkey"), F.regexp_extract("ligne", r"^[^:]* : (.*)$", 1).alias("parts"))
    return line


@query(f"""{_STATED},
p AS (SELECT c_custkey, CASE WHEN regexp_matches(t, {quoted(T.LITOTES)}) THEN NULL WHEN regexp_matches(t, {quoted(T.ENDINGS)}) THEN 'niee' END AS pol, regexp_matches(t, {quoted(T.UNREAL)}) AS unreal, regexp_matches(t, {quoted(T.GOES_ON)}) AS suite,
  nullif(regexp_extract(t, {quoted(T.FROM_TO)}, 1), '') AS a1, nullif(regexp_extract(t, {quoted(T.FROM_TO)}, 2), '') AS b1, nullif(regexp_extract(t, {quoted(T.BETWEEN)}, 1), '') AS a2, nullif(regexp_extract(t, {quoted(T.BETWEEN)}, 2), '') AS b2,
  nullif(regexp_extract(t, {quoted(T.UNTIL)}, 1), '') AS u, coalesce(nullif(regexp_extract(t, {quoted(T.SINCE)}, 1), ''), nullif(regexp_extract(t, {quoted(T.SINCE)}, 2), '')) AS d, nullif(regexp_extract(t, {quoted(T.ON_DAY)}, 2), '') AS o FROM s),
x AS (SELECT c_custkey, coalesce(pol, 'affirmee') AS polarite, CASE WHEN unreal THEN 'projete' ELSE 'accompli' END AS modalite,
  CASE WHEN suite THEN 'courant' WHEN coalesce(a1, a2) IS NOT NULL THEN 'intervalle_ferme' WHEN u IS NOT NULL THEN 'fin_seule' WHEN d IS NOT NULL THEN 'debut_seul' WHEN o IS NOT NULL THEN 'occurrence' ELSE 'sans_date' END AS temporalite,
  CASE WHEN coalesce(a1, a2) IS NOT NULL THEN coalesce(a1, a2) WHEN u IS NULL THEN coalesce(d, o) END AS date_debut, CASE WHEN NOT suite THEN CASE WHEN coalesce(a1, a2) IS NOT NULL THEN coalesce(b1, b2) ELSE u END END AS date_fin FROM p),
y AS (SELECT *, CASE WHEN modalite <> 'accompli' THEN 'RIEN' WHEN polarite = 'niee' THEN 'CLOTURE_NIEE' WHEN temporalite IN ('intervalle_ferme', 'fin_seule') THEN 'FAIT_CLOS' ELSE 'COURANT' END AS action FROM x)
SELECT c_custkey, 0 AS pos, c_name || ' — ' || {_SAID} AS sujet, 'travaille_pour' AS predicat, 'Ville ' || c_custkey AS objet, polarite, modalite, temporalite, date_debut, date_fin, action,
  CASE action WHEN 'CLOTURE_NIEE' THEN 'negate' WHEN 'FAIT_CLOS' THEN 'closed_interval' WHEN 'COURANT' THEN 'assert' END AS op FROM y JOIN customer USING (c_custkey)""")
def extracted_claims(spark, d):
    """A model's JSON answers (composed here) to operations of the claim log."""
    s = _statements(spark, d)
    grid = F.format_string('<think>…</think> {"faits":[{"sujet":"%s","predicat":"travaille_pour","objet":"Ville %d","type_e_sujet":"personne","type_e_objet":"entreprise"},{"sujet":"il","predicat":"dirige","objet":"X"}]}', F.col("texte"), F.col("c_custkey"))
    grid = F.replace(grid, F.lit("\n"), F.lit(" "))
    axes = X.finalise(X.grids(s.withColumn("reponse", grid)).drop("reponse"), O.specification(spark))
    return X.derive(axes).select("c_custkey", "pos", "sujet", "predicat", "objet", "polarite", "modalite", "temporalite", "date_debut", "date_fin", "action", "op")


@query("""
WITH t AS (SELECT o_orderpriority AS q, o_custkey AS item FROM orders WHERE o_totalprice > 200000), r AS (SELECT o_orderpriority AS q, o_custkey AS item FROM orders WHERE o_orderstatus = 'F'),
j AS (SELECT coalesce(t.q, r.q) AS q, t.item IS NOT NULL AS t, r.item IS NOT NULL AS r FROM (SELECT DISTINCT * FROM t) t FULL JOIN (SELECT DISTINCT * FROM r) r ON t.q = r.q AND t.item = r.item),
g AS (SELECT q, count(*) FILTER (WHERE t AND r) AS pert, count(*) FILTER (WHERE t) AS truth, count(*) FILTER (WHERE r) AS ret FROM j GROUP BY 1)
SELECT q, truth, ret, pert, CASE WHEN truth > 0 THEN pert / truth ELSE 0 END AS completude, CASE WHEN ret > 0 THEN pert / ret ELSE 0 END AS purete,
  CASE WHEN pert > 0 THEN 2 * (pert / truth) * (pert / ret) / (pert / truth + pert / ret) ELSE 0 END AS f_mesure FROM g""")
def completeness_purity(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("q"), F.col("o_custkey").alias("item"), "o_totalprice", "o_orderstatus")
    return S.completeness_purity(o.filter("o_totalprice > 200000"), o.filter("o_orderstatus = 'F'"), "q", "item")


@query("""
SELECT source, count(*) FILTER (WHERE q AND p) AS tp, count(*) FILTER (WHERE NOT q AND p) AS fp, count(*) FILTER (WHERE NOT q AND NOT p) AS tn, count(*) FILTER (WHERE q AND NOT p) AS fn, avg(CASE WHEN q = p THEN 1 ELSE 0 END) AS exactitude
FROM (SELECT source, quality = 1 AS q, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def confusion(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return S.confusion(j, F.col("quality") == 1, F.col("n_chars") > 1000, ["source"])


@query("""
WITH r AS (SELECT o_orderpriority AS q, o_orderstatus = 'F' AS rel, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rk, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT q, count(*) FILTER (WHERE rel AND rk <= 100) / any_value(n) AS recall, count(*) FILTER (WHERE rel AND rk <= n) / any_value(n) AS precision FROM r GROUP BY 1""")
def recall_at_k(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("q"), "o_totalprice", "o_orderkey", (F.col("o_orderstatus") == "F").alias("rel"))
    return S.recall_at(o, "q", "o_totalprice", "o_orderkey", "rel", 100)


@query("""SELECT conv_id, turn, coalesce(string_agg(text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS contexte FROM conversations""")
def trailing_context(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), F.col("text").alias("texte"))
    return X.trailing_context(c).select(F.col("stream").alias("conv_id"), F.col("seq").alias("turn"), "contexte")


@query("""
WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 90) / 100.0 + 0.05 AS c, ['CONFIRME','CONTREDIT','INCERTAIN'][(o_orderkey % 3) + 1] AS v, (epoch_us(TIMESTAMP '1999-01-01' - o_orderdate)) / 86400e6 AS j FROM orders),
u AS (SELECT id, CASE v WHEN 'CONFIRME' THEN least(0.99, c + 0.10) WHEN 'CONTREDIT' THEN greatest(0, c - 0.25) ELSE c END AS c, j FROM o), e AS (SELECT id, CASE WHEN j > 0 THEN c * pow(0.5, j / 30) ELSE c END AS c FROM u)
SELECT id, round(c, 9) AS confiance, CASE WHEN c < 0.15 THEN 'archive' ELSE 'actif' END AS statut FROM e""")
def v1_memories(spark, d):
    k = F.col("o_orderkey")
    verdict = F.element_at(F.array(*map(F.lit, ["CONFIRME", "CONTREDIT", "INCERTAIN"])), (k % 3 + 1).cast("int"))
    m = table(spark, d, "orders").select(k.alias("id"), M.v1_verdict((k % 90) / 100 + 0.05, verdict).alias("confiance"), F.col("o_orderdate").alias("derniere_erosion"), F.lit("actif").alias("statut"))
    m = M.v1_archive(M.v1_erosion(m, F.lit("1999-01-01").cast("timestamp")))
    return m.select("id", F.round("confiance", 9).alias("confiance"), "statut")


_SPEC = ", ".join(f"('{p}', '{kind}')" for p, _, _, _, _, kind, _ in O.PREDICATES)


@query(f"SELECT type_objet, string_agg(predicat, ', ' ORDER BY predicat) AS predicats FROM (VALUES {_SPEC}) v(predicat, type_objet) GROUP BY 1")
def ontology(spark, d):
    """The vocabulary by type of object."""
    return O.vocabulary(O.specification(spark))


# ---- more of the reading surface ----


@query("""
SELECT 'cust ' || o_custkey AS sujet_key, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS sources, count(*) AS n_faits,
  coalesce(max(CASE WHEN o_orderstatus = 'F' THEN 'clos' END), 'courant') AS statut_effectif FROM orders GROUP BY 1""")
def fact_listing(spark, d):
    """The listing of facts; per subject its sources and effective status."""
    told = F.array(F.struct(F.col("o_orderstatus").alias("source_id"), F.col("o_orderdate").alias("date"), F.lit("rapport").alias("type")))
    closed = F.col("o_orderstatus") == "F"
    f = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("fait_id"), F.concat(F.lit("cust "), "o_custkey").alias("sujet"), F.lit("priorite").alias("predicat"), F.col("o_orderpriority").alias("objet"),
        F.when(closed & (F.col("o_orderkey") % 2 == 0), "dormant").when(closed, "clos").otherwise("courant").alias("statut"), F.when(closed & (F.col("o_orderkey") % 2 == 0), "clos").alias("statut_avant"),
        F.lit(0.5).alias("force"), F.lit(0.5).alias("certitude"), told.alias("provenance"), F.col("o_orderdate").alias("valide_de"), F.lit(None).cast("timestamp").alias("valide_jusqua"),
    )
    g = api.listing(f).groupBy(F.col("sujet").alias("sujet_key"))
    status = F.coalesce(F.max(F.when(F.col("statut_effectif") == "clos", "clos")), F.lit("courant"))
    return g.agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))), ",").alias("sources"), F.count("*").alias("n_faits"), status.alias("statut_effectif"))


@query("""
SELECT s_suppkey AS fait_id, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey = 3
UNION ALL SELECT s_suppkey, s_name, coalesce(n_name, '?') FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 7 AND s_nationkey <> 3""")
def incident_facts(spark, d):
    """The facts at an entity, and one by its id, with names."""
    names = table(spark, d, "nation").select(F.concat(F.lit("nation "), "n_nationkey").alias("ent"), F.col("n_name").alias("nom"))
    f = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("fait_id"), "s_name", T.norm_name(F.col("s_name")).alias("sujet_key"), F.concat(F.lit("nation "), "s_nationkey").alias("objet_key"))
    found = api.inspect(f, "Nation 3").unionByName(api.inspect(f, 7)).distinct()
    return G.with_name(found, names, "objet_key", "n_name").select("fait_id", "s_name", "n_name")


@query("""
SELECT o_orderkey, '#' || o_orderkey || ' priorite(cust:' || o_custkey || ')=' || o_orderpriority || ' | F' || printf('%.2f', 0.5) || ' C' || printf('%.2f', 0.25) || ' [' || CASE WHEN o_orderstatus = 'F' THEN 'clos' ELSE 'courant' END || ']' AS ligne FROM orders""")
def one_liners(spark, d):
    f = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderkey").alias("fait_id"), F.lit("priorite").alias("predicat"), F.concat(F.lit("cust:"), "o_custkey").alias("sujet"), F.col("o_orderpriority").alias("objet"),
        F.lit(0.5).alias("force"), F.lit(0.25).alias("certitude"), F.when(F.col("o_orderstatus") == "F", "clos").otherwise("courant").alias("statut"),
    )
    return f.select("o_orderkey", R.one_liner().alias("ligne"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || CASE WHEN c_custkey % 2 = 0 THEN ' dirigeait ' ELSE ' dirige ' END || c_mktsegment
  WHEN 1 THEN 'Le siège de ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' était à ' ELSE ' est à ' END || c_mktsegment ELSE c_name || ' — ' || c_mktsegment END AS phrase FROM customer""")
def sentences(spark, d):
    """Templates by predicate and tense, the dash for the others."""
    p = F.element_at(F.array(*map(F.lit, ["dirige", "siege_de", "verbe_brut"])), (F.col("c_custkey") % 3 + 1).cast("int"))
    c = table(spark, d, "customer").select("c_custkey", p.alias("predicat"), F.col("c_name").alias("sujet_nom"), F.col("c_mktsegment").alias("objet"))
    j = c.join(F.broadcast(O.template_table(spark)), "predicat", "left")
    return j.select("c_custkey", O.sentence(F.col("c_custkey") % 2 == 0).alias("phrase"))


_ANSWERS = ("Elle a quitté le CAC 40", "Oui, elle fait partie du CAC", "Je ne sais pas", "", "Pas encore qualifiée", "L'équipe est qualifiée pour la coupe", "Peut-être")
_ANSWERED = "['" + "', '".join(a.replace("'", "''") for a in _ANSWERS) + f"'][(c_custkey % {len(_ANSWERS)}) + 1]"


def _says(marks: list[str]) -> str:
    return "(" + " OR ".join("contains(a, '" + m.replace("'", "''") + "')" for m in marks) + ")"


@query(f"""
WITH x AS (SELECT c_custkey, trim(regexp_replace(strip_accents(lower({_ANSWERED})), '\\s+', ' ', 'g')) AS a, CASE WHEN c_custkey % 2 = 0 THEN 'absent' ELSE 'present' END AS st, c_nationkey % 2 = 0 AS q FROM customer)
SELECT c_custkey, CASE WHEN a = '' THEN 'VIDE' WHEN st = 'absent' THEN CASE WHEN {_says(S.ABSENCE)} THEN 'OK' WHEN {_says(S.PRESENCE)} THEN 'FAUX' WHEN {_says(S.REFUSAL)} THEN 'REFUS' ELSE 'AUTRE' END
  WHEN q THEN CASE WHEN {_says(S.NOT_QUALIFIED)} THEN 'FAUX' WHEN {_says(S.QUALIFIED)} THEN 'OK' WHEN {_says(S.REFUSAL)} THEN 'REFUS' ELSE 'AUTRE' END
  ELSE CASE WHEN {_says(S.ABSENCE)} THEN 'FAUX' WHEN {_says(S.PRESENCE)} OR contains(left(a, 20), 'oui') THEN 'OK' WHEN {_says(S.REFUSAL)} THEN 'REFUS' ELSE 'AUTRE' END END AS verdict FROM x""")
def answer_verdicts(spark, d):
    """V8r for absent and present."""
    a = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("c_custkey") % len(_ANSWERS) + 1).cast("int"))
    st = F.when(F.col("c_custkey") % 2 == 0, "absent").otherwise("present")
    q = F.when(F.col("c_nationkey") % 2 == 0, "Est-elle qualifiée ?").otherwise("En fait-elle partie ?")
    return table(spark, d, "customer").select("c_custkey", S.verdict(a, st, q).alias("verdict"))


_MORE_ANSWERS = (
    "C'est incertain, une seule source le dit", "Oui l Italie est qualifiée", "Aucune information", "Le CAC 40 est de 8 020 points", "8020 fin novembre", "Euronext et Eiffage ont rejoint l'indice",
    "no_reply", "Peut-être  demain",
)
_MORE = "['" + "', '".join(a.replace("'", "''") for a in _MORE_ANSWERS) + f"'][(c_custkey % {len(_MORE_ANSWERS)}) + 1]"


@query(f"""
WITH x AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(strip_accents(lower({_MORE})), '\\s+', ' ', 'g'), '\\bno_reply\\b', ' ', 'g')) AS a,
  ['incertain', 'reserve', 'historique', 'present', 'autre'][(c_nationkey % 5) + 1] AS st FROM customer)
SELECT c_custkey, CASE WHEN a = '' THEN 'VIDE' WHEN st = 'incertain' THEN CASE WHEN {_says(S.NOT_QUALIFIED)} OR {_says(S.DOUBTED)} THEN 'OK' WHEN {_says(S.ASSERTED)} THEN 'FAUX' WHEN {_says(S.REFUSAL)} THEN 'REFUS' ELSE 'AUTRE' END
  WHEN st = 'reserve' THEN CASE WHEN regexp_matches(a, {quoted(S.STILL_WORTH)}) THEN 'FAUX' WHEN {_says(S.RESERVED)} THEN 'OK' ELSE 'AUTRE' END
  WHEN st = 'historique' THEN CASE WHEN regexp_matches(a, {quoted(S.WORTH)}) THEN 'OK' WHEN {_says(S.REFUSAL)} THEN 'REFUS' ELSE 'AUTRE' END
  WHEN st = 'present' THEN CASE WHEN {_says(S.REFUSAL)} THEN 'REFUS' WHEN contains(a, 'euronext') AND contains(a, 'eiffage') AND {_says(S.ENTERING)} THEN 'OK' ELSE 'AUTRE' END ELSE 'AUTRE' END AS verdict FROM x""")
def answer_verdicts_of_all_kinds(spark, d):
    """V8r for the other statuses, and the question for the list of entrants."""
    a = F.element_at(F.array(*map(F.lit, _MORE_ANSWERS)), (F.col("c_custkey") % len(_MORE_ANSWERS) + 1).cast("int"))
    st = F.element_at(F.array(*map(F.lit, ["incertain", "reserve", "historique", "present", "autre"])), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", S.verdict(a, st, F.lit("Quelles sociétés sont entrées au CAC ?")).alias("verdict"))


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS mois, o_orderstatus = 'F' AS vrai, count(*) AS n, round(avg((o_orderkey % 100) / 100.0), 9) AS confiance FROM orders GROUP BY 1, 2""")
def monthly_confidence(spark, d):
    """Monthly mean confidence of true and stale memories."""
    m = table(spark, d, "orders").select("o_orderdate", (F.col("o_orderstatus") == "F").alias("vrai"), ((F.col("o_orderkey") % 100) / 100).alias("confiance"))
    return S.monthly_confidence(m, "o_orderdate", "vrai", "confiance").withColumn("confiance", F.round("confiance", 9))


@query("""
SELECT o_orderpriority AS configuration, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, count(*) FILTER (WHERE o_orderstatus = 'O') AS faux, count(*) FILTER (WHERE o_orderstatus = 'P') AS refus,
  count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_custkey % 10 = 0) AS faute_extracteur, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_custkey % 10 <> 0) AS faute_memoire FROM orders GROUP BY 1""")
def verdict_counts(spark, d):
    """Verdicts by configuration, and whose errors they are."""
    o = table(spark, d, "orders")
    v = F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "O", "FAUX").otherwise("REFUS")
    rows = o.select(F.col("o_orderpriority").alias("configuration"), v.alias("verdict"), (v == "OK").alias("ok"), F.lit(True).alias("entite_stockee"), (F.col("o_custkey") % 10 != 0).alias("valeur_stockee"))
    faults = S.attribution(rows).groupBy("configuration").agg(F.count_if(F.col("faute") == "extracteur").alias("faute_extracteur"), F.count_if(F.col("faute") == "memoire").alias("faute_memoire"))
    return S.verdict_counts(rows, "configuration").select("configuration", "ok", "faux", "refus").join(faults, "configuration")


@query("""
SELECT p_partkey, round(0.12 * pow(2.0 / greatest(2, greatest(1, least(length(replace(p_name, ' ', '')), length(replace(p_brand, ' ', ''))))), 2), 9) AS malus,
  CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN 'date_fondation_de' WHEN p_partkey % 4 = 0 THEN 'a_fonde' WHEN p_partkey % 4 = 1 THEN 'dirige' ELSE 'produit' END AS predicat,
  month(TIMESTAMP '2020-01-15' + to_days(CAST(p_partkey % 300 AS INTEGER))) AS mois FROM part""")
def names_and_predicates(spark, d):
    """T11, T17, T20, T30."""
    obj = F.when(F.col("p_size") % 2 == 0, "en 1973").otherwise(F.col("p_name"))
    pred = F.when(F.col("p_partkey") % 4 == 0, "a_fonde").when(F.col("p_partkey") % 4 == 1, "a_dirige").otherwise("produit")
    pred = T.rerouted(F.coalesce(T.lookup(T.CANONICAL, pred), pred), obj)
    label = T.month_year(F.date_add(F.lit("2020-01-15").cast("date"), (F.col("p_partkey") % 300).cast("int")))
    months = F.array(*map(F.lit, "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()))
    malus = T.brevity_penalty(F.col("p_name"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.round(malus, 9).alias("malus"), pred.alias("predicat"), F.array_position(months, F.split_part(label, F.lit(" "), F.lit(1))).alias("mois"))
