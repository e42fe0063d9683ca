"""Predicates: their specification as a table, and how a fact of each is said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Predicate, functional, volatility, kind of object, type of subject and of object, weight.
PREDICATES = [
    ("pdg_de", True, "changeant", "entite", "organisation", "personne", 0.9),
    ("maire_de", True, "changeant", "entite", "lieu", "personne", 0.9),
    ("siege_de", True, "stable", "valeur", "organisation", "lieu", 0.5),
    ("effectif_de", True, "changeant", "valeur", "organisation", "valeur", 0.2),
    ("prix_de", True, "volatil", "valeur", "oeuvre", "valeur", 0.1),
    ("horaire_de", True, "volatil", "valeur", "lieu", "valeur", 0.1),
    ("date_fondation_de", True, "immuable", "valeur", "organisation", "date", 0.4),
    ("date_naissance_de", True, "immuable", "valeur", "personne", "date", 0.6),
    ("marie_a", True, "stable", "entite", "personne", "personne", 0.9),
    ("produit", False, "stable", "valeur", "organisation", "valeur", 0.5),
    ("connait", False, "stable", "entite", "personne", "personne", 0.5),
    ("profession_de", True, "stable", "valeur", "personne", "valeur", 0.5),
    ("population_de", True, "stable", "valeur", "lieu", "valeur", 0.4),
    ("ville_exercice_de", True, "changeant", "valeur", "personne", "lieu", 0.4),
    ("rue_de", True, "stable", "valeur", "lieu", "valeur", 0.3),
    ("nom_de", True, "immuable", "valeur", "personne", "valeur", 1.0),
    ("parent_de", False, "immuable", "entite", "personne", "personne", 0.95),
    ("enfant_de", False, "immuable", "entite", "personne", "personne", 0.95),
    ("repas_de", False, "volatil", "valeur", "personne", "valeur", 0.05),
    ("frere_de", False, "immuable", "entite", "personne", "personne", 0.9),
    ("ami_de", False, "stable", "entite", "personne", "personne", 0.5),
    ("dirige", True, "changeant", "entite", "organisation", "personne", 0.9),
    ("appartient_a", False, "stable", "entite", "entite", "groupe", 0.5),
    ("possede", False, "stable", "entite", "personne", "entite", 0.5),
    ("travaille_pour", True, "changeant", "entite", "personne", "organisation", 0.5),
    ("qualifie_pour", False, "stable", "entite", "groupe", "evenement", 0.5),
    ("se_separe_de", False, "stable", "entite", "personne", "personne", 0.6),
    ("a_rencontre", False, "stable", "entite", "personne", "personne", 0.4),
    ("critique", False, "stable", "entite", "personne", "personne", 0.3),
    ("a_fonde", False, "immuable", "entite", "personne", "organisation", 0.7),
    ("a_dirige", False, "changeant", "entite", "personne", "organisation", 0.7),
    ("enseigne_a", False, "changeant", "entite", "personne", "organisation", 0.5),
    ("etudie_a", False, "stable", "entite", "personne", "organisation", 0.4),
    ("a_achete", False, "immuable", "entite", "personne", "organisation", 0.5),
    ("a_investi_dans", False, "stable", "entite", "personne", "organisation", 0.4),
    ("a_demissionne_de", False, "immuable", "entite", "personne", "organisation", 0.5),
    ("lieu_naissance_de", True, "immuable", "valeur", "personne", "lieu", 0.6),
    ("lieu_deces_de", True, "immuable", "valeur", "personne", "lieu", 0.5),
    ("s_installe_a", False, "changeant", "valeur", "personne", "lieu", 0.4),
    ("date_deces_de", True, "immuable", "valeur", "personne", "date", 0.6),
    ("a_cree", False, "immuable", "valeur", "personne", "oeuvre", 0.6),
    ("a_publie", False, "immuable", "valeur", "personne", "oeuvre", 0.5),
    ("a_ecrit_lettre", False, "immuable", "valeur", "personne", "oeuvre", 0.3),
    ("a_signe", False, "immuable", "valeur", "personne", "oeuvre", 0.4),
    ("a_recu_prix", False, "immuable", "valeur", "personne", "distinction", 0.6),
    ("a_decouvert", False, "immuable", "valeur", "personne", "valeur", 0.7),
    ("a_obtenu_diplome", False, "immuable", "valeur", "personne", "valeur", 0.5),
    ("a_nationalite", False, "stable", "valeur", "personne", "valeur", 0.6),
    ("a_contribue_a", False, "immuable", "valeur", "personne", "valeur", 0.5),
    ("a_rejete", False, "stable", "valeur", "personne", "valeur", 0.3),
    ("a_vendu", False, "immuable", "valeur", "personne", "valeur", 0.3),
    ("a_participe_a", False, "immuable", "valeur", "personne", "evenement", 0.4),
    ("s_oppose_a", False, "stable", "valeur", "personne", "evenement", 0.4),
    ("soutient", False, "stable", "valeur", "personne", "evenement", 0.4),
    ("traverse", False, "immuable", "valeur", "lieu", "lieu", 0.3),
    ("a_pour_capitale", True, "stable", "valeur", "organisation", "lieu", 0.5),
    ("a_pour_frontiere", False, "immuable", "valeur", "lieu", "lieu", 0.3),
    ("superficie_de", True, "immuable", "valeur", "lieu", "valeur", 0.3),
    ("altitude_de", True, "immuable", "valeur", "lieu", "valeur", 0.3),
    ("longueur_de", True, "immuable", "valeur", "lieu", "valeur", 0.3),
    ("langue_de", False, "stable", "valeur", "organisation", "valeur", 0.4),
    ("monnaie_de", True, "changeant", "valeur", "organisation", "valeur", 0.4),
    ("situe_dans", True, "stable", "valeur", "lieu", "lieu", 0.4),
    ("a_battu", False, "changeant", "entite", "groupe", "groupe", 0.3),
    ("affronte", False, "changeant", "entite", "groupe", "groupe", 0.2),
    ("organise", False, "stable", "valeur", "organisation", "evenement", 0.5),
    ("detient_record", False, "changeant", "valeur", "personne", "valeur", 0.5),
    ("a_recrute", False, "changeant", "entite", "organisation", "personne", 0.4),
    ("entraine", True, "changeant", "entite", "personne", "organisation", 0.5),
    ("a_remporte", False, "immuable", "valeur", "groupe", "distinction", 0.6),
    ("est_compose_de", False, "stable", "valeur", "substance", "substance", 0.4),
    ("propriete_de", False, "stable", "valeur", "substance", "valeur", 0.3),
    ("a_adopte", False, "changeant", "valeur", "organisation", "oeuvre", 0.5),
    ("a_adhere_a", False, "stable", "entite", "organisation", "organisation", 0.5),
    ("se_retire_de", False, "changeant", "entite", "organisation", "organisation", 0.5),
    ("a_nomme", False, "changeant", "entite", "organisation", "personne", 0.5),
    ("a_pour_date", True, "immuable", "valeur", "evenement", "date", 0.4),
    ("se_deroule_a", False, "stable", "valeur", "evenement", "lieu", 0.4),
    ("expose_a", True, "changeant", "valeur", "oeuvre", "lieu", 0.3),
    ("date_sortie_de", True, "immuable", "valeur", "oeuvre", "date", 0.4),
    ("a_interprete", False, "immuable", "valeur", "personne", "oeuvre", 0.3),
    ("a_acquis", False, "immuable", "entite", "organisation", "organisation", 0.5),
    ("chiffre_affaires_de", True, "changeant", "valeur", "organisation", "valeur", 0.3),
    ("concurrent_de", False, "stable", "entite", "organisation", "organisation", 0.3),
    ("a_lance", False, "immuable", "valeur", "organisation", "oeuvre", 0.4),
    ("partenaire_de", False, "changeant", "entite", "organisation", "organisation", 0.3),
    ("condamne", False, "immuable", "entite", "organisation", "personne", 0.5),
    ("poursuit", False, "stable", "entite", "organisation", "personne", 0.4),
    ("autorise", False, "changeant", "valeur", "organisation", "valeur", 0.4),
    ("interdit", False, "changeant", "valeur", "organisation", "valeur", 0.4),
    ("accorde", False, "immuable", "valeur", "organisation", "valeur", 0.4),
    ("gere", True, "changeant", "entite", "organisation", "lieu", 0.4),
    ("construit_par", False, "immuable", "entite", "lieu", "organisation", 0.4),
    ("date_ouverture_de", True, "immuable", "valeur", "lieu", "date", 0.5),
    ("date_fermeture_de", True, "immuable", "valeur", "lieu", "date", 0.4),
    ("capacite_de", True, "stable", "valeur", "lieu", "valeur", 0.3),
    ("cout_de", True, "stable", "valeur", "oeuvre", "valeur", 0.3),
    ("remporte_election", False, "immuable", "valeur", "personne", "evenement", 0.5),
    ("succede_a", False, "changeant", "entite", "personne", "personne", 0.5),
    ("ordonne", False, "changeant", "valeur", "organisation", "valeur", 0.4),
    ("remplace", False, "changeant", "entite", "personne", "personne", 0.5),
    ("annonce", False, "stable", "valeur", "personne", "valeur", 0.3),
    ("provoque", False, "immuable", "valeur", "evenement", "valeur", 0.4),
    ("attaque", False, "changeant", "entite", "groupe", "lieu", 0.4),
    ("occupe", False, "changeant", "valeur", "groupe", "lieu", 0.4),
    ("renove", False, "immuable", "entite", "organisation", "lieu", 0.3),
    ("signe_accord", False, "immuable", "entite", "organisation", "organisation", 0.5),
]

# Days in which certainty halves, by volatility (immuable: never).
HALF_LIFE = {"stable": 730.0, "changeant": 180.0, "volatil": 45.0}
DEFAULT_WEIGHT = 0.4

# How facts of the predicates that the shipped queries render are said (present, past, group). Other
# predicates' sentences are a parameter: a table (predicat, present, past, grp); without one a dash joins the parts.
TEMPLATES = {
    "maire_de": ("Le maire de {s} est {o}", "{o} était le maire de {s}", "Le maire de {s}"),
    "parent_de": ("{s} est le parent de {o}", "{s} était le parent de {o}", "Les enfants de {s}"),
    "dirige": ("{s} dirige {o}", "{s} dirigeait {o}", "Ce que dirige {s}"),
    "appartient_a": ("{s} appartient à {o}", "{s} appartenait à {o}", "Les appartenances de {s}"),
    "travaille_pour": ("{s} travaille pour {o}", "{s} travaillait pour {o}", "L'employeur de {s}"),
    "profession_de": ("{s} exerce le métier de {o}", "{s} exerçait le métier de {o}", "Le métier de {s}"),
    "date_naissance_de": ("{s} est né(e) en {o}", "{s} est né(e) en {o}", "L'année de naissance de {s}"),
    "prix_de": ("Le prix de {s} est {o}", "Le prix de {s} était {o}", "Le prix de {s}"),
    "siege_de": ("Le siège de {s} est à {o}", "Le siège de {s} était à {o}", "Le siège de {s}"),
}

SPEC_SCHEMA = "predicat string, fonctionnel boolean, volatilite string, objet_entite boolean, type_sujet string, type_objet string, poids double, demivie double"


def spec_rows() -> list[tuple]:
    return [(p, f, v, o == "entite", a, b, w, HALF_LIFE.get(v)) for p, f, v, o, a, b, w in PREDICATES]


def specification(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """The predicate table (107 rows) and a caller's own rows (same columns)."""
    return spark.createDataFrame([*spec_rows(), *extra], SPEC_SCHEMA)


def with_specification(facts: DataFrame, spec: DataFrame) -> DataFrame:
    """Left join on ``predicat``; unknown predicates are multi-valued, stable, with a value as object."""
    j = facts.join(F.broadcast(spec), "predicat", "left")
    defaults = {"fonctionnel": F.lit(False), "objet_entite": F.lit(False), "poids": F.lit(DEFAULT_WEIGHT)}
    unknown = F.col("volatilite").isNull()
    return j.withColumns(
        {c: F.coalesce(F.col(c), d) for c, d in defaults.items()}
        | {"demivie": F.when(unknown, HALF_LIFE["stable"]).otherwise(F.col("demivie")), "volatilite": F.coalesce("volatilite", F.lit("stable"))}
    )


def template_table(spark: SparkSession, rows: dict[str, tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(p, *t) for p, t in rows.items()], "predicat string, present string, past string, grp string")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """A caller's templates: JSON lines (predicat, present, past, grp) with {s} and {o} for subject and object."""
    return spark.read.schema("predicat string, present string, past string, grp string").json(path)


def said(template: Column, s: Column, o: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{s}"), s), F.lit("{o}"), o)


def sentence(past: Column) -> Column:
    """T24 on rows with present, past, sujet_nom, objet (left join of the templates): the fact as a sentence."""
    t = F.coalesce(F.when(past, F.col("past")).otherwise(F.col("present")), F.lit("{s} — {o}"))
    return said(t, F.col("sujet_nom"), F.col("objet"))


def vocabulary(spec: DataFrame) -> DataFrame:
    """The predicates of each type of object, in order."""
    return spec.groupBy("type_objet").agg(F.array_join(F.array_sort(F.collect_list("predicat")), ", ").alias("predicats"))
