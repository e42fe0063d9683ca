"""Normalisation, dates and rule-based classification of statements, as Column expressions (survey T1-T23, S8, S11)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that lead a name, generational markers.
TITLES = ["m", "mme", "mlle", "dr", "pr", "le", "la", "les", "l", "entreprise", "ville", "societe", "monsieur", "madame"]
GENERATIONS = ["ii", "iii", "iv", "vi", "vii", "viii", "ix", "jr", "sr", "junior", "senior"]

# Labels that are only a pronoun or an indefinite.
PRONOUNS = [
    "je", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles", "moi", "toi", "lui", "soi", "eux", "moi-meme", "toi-meme", "lui-meme",
    "elle-meme", "soi-meme", "nous-memes", "vous-memes", "eux-memes", "elles-memes", "celui", "celle", "ceux", "celles", "celui-ci", "celui-la",
    "celle-ci", "celle-la", "ceux-ci", "ceux-la", "celles-ci", "celles-la", "ceci", "cela", "ca", "lequel", "laquelle", "lesquels", "lesquelles",
    "quiconque", "personne", "quelqu'un", "quelque chose", "rien", "nul", "nulle", "aucun", "aucune", "chacun", "chacune", "certains", "certaines",
    "plusieurs", "autrui", "untel", "d'aucuns", "l'un", "l'autre", "les uns", "les autres", "un autre", "une autre", "d'autres", "tout le monde",
    "n'importe qui", "n'importe quoi",
]

# Patterns over text in lower case without accents.
LITOTES = r"n'a\s+pas\s+manqu|n'a\s+(?:jamais\s+)?cess|ne\s+cesse|n'a\s+pas\s+perdu|faux\s+de\s+dire|loin\s+d'?|\bdement\b|\bdementi|ne\s+saurait"
ENDINGS = (
    r"\bne\s+\w+\s+plus\b|\bn'\w+\s+plus\b|\bne\s+\w+\s+pas\b|\bn'\w+\s+pas\b|\bplus\s+(?:partie|membre|dans|en\s+poste)\b|\bquitt\w*|"
    r"\bsort\w*\s+(?:de|du|des|d')|\bse\s+retire\w*|\bs'est\s+retir\w*|\bretir[ée]\w*\s+d[eu']|\bd[ée]missionn\w*|\bd[ée]mis\w*\s+de\b|"
    r"\bperd\w*\s+son\s+poste|\b[ée]limin[ée]\w*|\bexclus?e?\w*\s+d[eu']|\b[ée]cart[ée]\w*\s+d[eu']|\bpas\s+[ée]t[ée]\s+retenu\w*|"
    r"\babandonn\w*|\bdestitu\w*|\bremplac[ée]\w*\s+(?:par|a\s+la\s+tete)|\b(?:a\s+ete|est|fut|ont\s+ete|sont|a\s+ete)\s+remplac[ée]\w*"
)
GOES_ON = r"n'a\s+(?:jamais\s+)?cess|ne\s+cesse|continue\s+(?:de|a)|\btoujours\b"
UNREAL = (
    r"\benvisage\s+de\b|\bprojette\s+de\b|\bcompte\s+\w+er\b|\bpourrait\b|\bdevrait\b|\bselon\s+(?:des\s+rumeurs|certaines\s+sources|des\s+sources)\b|"
    r"\bserait\s+en\s+passe\b|\bprepar\w*rait\b|\benvisagerait\b|\brachterait\b|\w+erait\b\s"
)
YEAR = r"(1[5-9]\d\d|20\d\d)"
MONTHS = "(janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre)"
FROM_TO = rf"\bde\s+{YEAR}\s+(?:a|à)\s+{YEAR}\b"
BETWEEN = rf"\bentre\s+{YEAR}\s+et\s+{YEAR}\b"
UNTIL = rf"\bjusqu'?\s*(?:en|a|à|au)\s+{YEAR}\b"
SINCE = rf"\bdepuis\s+{YEAR}\b|\ba\s+partir\s+de\s+{YEAR}\b"
ON_DAY = rf"\ble\s+\d{{1,2}}(?:er)?\s+{MONTHS}\s+{YEAR}\b"
DATE_OBJECT = r"^\s*([eE][nN]\s+|[vV][eE][rR][sS]\s+)?\d{4}(-\d{2}){0,2}\s*$"

# The family of each fine type; the signature slots that an entity of each type can fill.
FAMILY_OF = {
    "personne": "personne", "individu": "personne", "scientifique": "personne", "artiste": "personne", "athlete": "personne", "joueur": "personne",
    "acteur": "personne", "ecrivain": "personne", "dirigeant": "personne", "homme": "personne", "femme": "personne", "auteur": "personne",
    "realisateur": "personne",
    "organisation": "organisation", "entreprise": "organisation", "societe": "organisation", "institution": "organisation", "club": "organisation",
    "parti": "organisation", "federation": "organisation", "comite": "organisation", "banque": "organisation",
    "lieu": "lieu", "ville": "lieu", "capitale": "lieu", "region": "lieu", "continent": "lieu", "fleuve": "lieu", "riviere": "lieu",
    "montagne": "lieu", "mer": "lieu", "ocean": "lieu", "desert": "lieu", "commune": "lieu", "pays": "lieu", "etat": "lieu",
    "oeuvre": "oeuvre", "film": "oeuvre", "livre": "oeuvre", "roman": "oeuvre", "album": "oeuvre", "tableau": "oeuvre", "chanson": "oeuvre",
    "produit": "oeuvre", "texte": "oeuvre",
    "date": "date", "annee": "date", "periode": "date",
    "distinction": "distinction", "recompense": "distinction", "medaille": "distinction", "trophee": "distinction", "titre": "distinction",
    "evenement": "evenement", "competition": "evenement", "match": "evenement", "tournoi": "evenement", "sommet": "evenement",
    "ceremonie": "evenement", "festival": "evenement",
    "substance": "substance", "molecule": "substance", "element": "substance", "gaz": "substance",
    "espece": "espece", "animal": "espece", "plante": "espece",
    "valeur": "valeur", "nombre": "valeur", "quantite": "valeur", "mesure": "valeur", "record": "valeur",
}
SLOTS_OF = {
    "personne": ["personne"], "individu": ["personne"], "scientifique": ["personne"], "artiste": ["personne"], "athlete": ["personne"],
    "joueur": ["personne"], "acteur": ["personne"], "ecrivain": ["personne"], "dirigeant": ["personne"], "homme": ["personne"],
    "femme": ["personne"],
    "organisation": ["organisation"], "entreprise": ["organisation"], "societe": ["organisation"], "institution": ["organisation"],
    "parti": ["organisation"], "federation": ["organisation"], "comite": ["organisation"], "banque": ["organisation"],
    "club": ["organisation", "groupe"], "pays": ["organisation", "lieu"], "etat": ["organisation", "lieu"],
    "competition": ["evenement", "competition"], "nation": ["organisation", "lieu", "groupe"], "equipe": ["organisation", "groupe"],
    "prix": ["valeur", "distinction"],
    "lieu": ["lieu"], "ville": ["lieu"], "capitale": ["lieu"], "region": ["lieu"], "continent": ["lieu"], "fleuve": ["lieu"], "riviere": ["lieu"],
    "montagne": ["lieu"], "mer": ["lieu"], "ocean": ["lieu"], "desert": ["lieu"], "commune": ["lieu"],
    "oeuvre": ["oeuvre"], "film": ["oeuvre"], "livre": ["oeuvre"], "roman": ["oeuvre"], "album": ["oeuvre"], "tableau": ["oeuvre"],
    "chanson": ["oeuvre"], "produit": ["oeuvre"], "texte": ["oeuvre"],
    "date": ["date"], "annee": ["date"], "periode": ["date"],
    "distinction": ["distinction"], "recompense": ["distinction"], "medaille": ["distinction"], "trophee": ["distinction"], "titre": ["distinction"],
    "evenement": ["evenement"], "match": ["evenement"], "tournoi": ["evenement"], "sommet": ["evenement"], "ceremonie": ["evenement"],
    "festival": ["evenement"],
    "substance": ["substance"], "molecule": ["substance"], "element": ["substance"], "gaz": ["substance"],
    "espece": ["espece"], "animal": ["espece"], "plante": ["espece"],
    "valeur": ["valeur"], "nombre": ["valeur"], "quantite": ["valeur"], "mesure": ["valeur"], "record": ["valeur"],
    "groupe": ["groupe"], "selection": ["groupe"],
}
# Predicates that stand for others.
REROUTED = {"a_fonde": "date_fondation_de", "a_publie": "date_sortie_de", "a_cree": "date_sortie_de", "a_lance": "date_sortie_de"}
CANONICAL = {"pdg_de": "dirige", "a_dirige": "dirige"}
RAW_VERBS = {"diriger": "dirige", "interpreter": "a_interprete"}


def _accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is one letter and marks, and those letters."""
    plain = {}
    for c in range(0xC0, 0x2000):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != chr(c):
            plain[chr(c)] = base
    return "".join(plain), "".join(plain.values())


_FROM, _TO = _accents()


def any_of(pattern: str) -> str:
    """Java needs (?U) for \\w and \\b over all letters."""
    return "(?U)" + pattern


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(x), _FROM, _TO), r"\p{Mn}", "")


def norm(x: Column) -> Column:
    """Lower case, no accents, what is no letter, number or space becomes a space."""
    return F.regexp_replace(strip_accents(x), any_of(r"[^\p{L}\p{N}\s]"), " ")


def norm_value(x: Column) -> Column:
    """T1 with single spaces."""
    return F.trim(F.regexp_replace(norm(x), any_of(r"\s+"), " "))


def norm_name(x: Column) -> Column:
    """Without leading titles (unless nothing else is left), runs of single letters joined."""
    base = norm_value(x)
    bare = F.regexp_replace(base, "^(?:(?:" + "|".join(TITLES) + r")(?: |$))+", "")
    kept = F.when(bare == "", base).otherwise(bare)
    return F.regexp_replace(kept, any_of(r"(?<=(?:^| )\S) (?=\S(?: |$))"), "")


def norm_statement(x: Column) -> Column:
    """T4: punctuation stays, apostrophes become one kind."""
    return F.translate(strip_accents(x), "’`", "''")


def parse_date(x: Column) -> Column:
    """T5: YYYY-MM-DD, YYYY-MM or YYYY, the first of what is missing; else null."""
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-M-d", "yyyy-M", "yyyy")])


def null_string(x: Column) -> Column:
    """T6."""
    t = F.trim(x)
    return F.when(~F.lower(t).isin("", "null", "none"), t)


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def generation(name: Column) -> Column:
    """The markers of a normalised name."""
    return F.array_sort(F.array_intersect(tokens(name), F.array(*map(F.lit, GENERATIONS))))


def distinct_homonyms(a: Column, b: Column) -> Column:
    """T8."""
    return (F.size(tokens(a)) >= 2) & (F.size(tokens(b)) >= 2) & (generation(a) != generation(b))


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def family(kind: Column) -> Column:
    """T9."""
    return lookup(FAMILY_OF, F.lower(F.trim(kind)))


def types_compatible(a: Column, b: Column) -> Column:
    """Only two known and different families block."""
    return family(a).isNull() | family(b).isNull() | (family(a) == family(b))


def brevity_penalty(a: Column, b: Column, most: float = 0.12, reference: int = 2) -> Column:
    """T11, of two normalised names."""
    size = lambda n: F.length(F.replace(n, F.lit(" "), F.lit("")))
    shorter = F.least(size(a), size(b))
    shorter = F.when(shorter == 0, 1).otherwise(shorter)
    return most * F.pow(reference / F.greatest(shorter, F.lit(reference)), F.lit(2))


def is_pronoun(label: Column) -> Column:
    """T12."""
    return F.btrim(norm_statement(label), F.lit(' \t.,;:!?"«»()[]…')).isin(PRONOUNS)


def polarity_floor(text: Column) -> Column:
    """T13: 'niee' for an explicit end or negation, unless a litotes leaves it open."""
    t = norm_statement(text)
    return F.when(t.rlike(any_of(LITOTES)), F.lit(None).cast("string")).when(t.rlike(any_of(ENDINGS)), "niee")


def modality_floor(text: Column) -> Column:
    """T14."""
    return F.when(norm_statement(text).rlike(any_of(UNREAL)), "projete")


def _group(t: Column, pattern: str, i: int) -> Column:
    x = F.regexp_extract(t, any_of(pattern), i)
    return F.when(x != "", x)


def temporality_floor(text: Column) -> Column:
    """struct<form, start, end>, or null. The leftmost interval of either wording counts."""
    t = norm_statement(text)
    both = f"{FROM_TO}|{BETWEEN}"
    start = F.coalesce(_group(t, both, 1), _group(t, both, 3))
    end = F.coalesce(_group(t, both, 2), _group(t, both, 4))
    none = F.lit(None).cast("string")
    form = lambda name, a, b: F.struct(F.lit(name).alias("form"), a.alias("start"), b.alias("end"))
    since = F.coalesce(_group(t, SINCE, 1), _group(t, SINCE, 2))
    return (
        F.when(start.isNotNull(), form("intervalle_ferme", start, end))
        .when(t.rlike(any_of(UNTIL)), form("fin_seule", none, _group(t, UNTIL, 1)))
        .when(since.isNotNull(), form("debut_seul", since, none))
        .when(t.rlike(any_of(ON_DAY)), form("occurrence", _group(t, ON_DAY, 2), none))
    )


def goes_on(text: Column) -> Column:
    """T16."""
    return norm_statement(text).rlike(any_of(GOES_ON))


def rerouted(predicate: Column, obj: Column) -> Column:
    """An agent's predicate with a pure date becomes the predicate of the date."""
    return F.when(obj.rlike(DATE_OBJECT), F.coalesce(lookup(REROUTED, predicate), predicate)).otherwise(predicate)


def type_tags(kind: Column) -> Column:
    """The slots that an entity of this type can fill."""
    m = F.create_map(*[x for w, s in SLOTS_OF.items() for x in (F.lit(w), F.array(*map(F.lit, s)))])
    return F.coalesce(m[F.trim(norm_statement(kind))], F.array().cast("array<string>"))


def swapped(type_s: Column, type_o: Column, slot_s: Column, slot_o: Column) -> Column:
    """Whether subject and object change places: only if the swapped types fit and the given ones do not."""
    s, o = type_tags(type_s), type_tags(type_o)
    has = lambda a, x: F.coalesce(F.array_contains(a, x), F.lit(False))
    return F.coalesce((slot_s != slot_o) & has(o, slot_s) & has(s, slot_o) & ~(has(s, slot_s) & has(o, slot_o)), F.lit(False))


def without_reasoning(answer: Column) -> Column:
    """What follows the last closing tag of the model's reasoning."""
    return F.trim(F.substring_index(answer, "</think>", -1))


def gate(message: Column, longest: int = 600) -> Column:
    """What to do with a message: ignore, read as text, read as one fact."""
    t = F.trim(message)
    return F.when(F.length(t) == 0, "ignorer").when(F.length(t) > longest, "texte").when(t.endswith("?"), "ignorer").otherwise("fait")


def month_year(day: Column) -> Column:
    """French month and year."""
    names = F.array(*map(F.lit, "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()))
    return F.concat_ws(" ", F.element_at(names, F.month(day)), F.year(day).cast("string"))


def answer_text(x: Column) -> Column:
    """For comparing answers: no accents, lower case, single spaces."""
    return F.trim(F.regexp_replace(strip_accents(x), r"\s+", " "))
