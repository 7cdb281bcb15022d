"""Value normalisation and vocabulary checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SYNONYMS = {
    "negatif": "négatif|négative|negative|neg|-|perte d'expression|perte d expression", "positif": "positif|positive|pos|+", "maintenu": "conservé|conservée|conserve", "mute": "muté|mutée|mutee",
    "wt": "wild-type|wild type|sauvage|type sauvage|non muté|non mutée|non mute|non mutee|absence de mutation|pas de mutation", "methyle": "méthylé|methylé|methylation positive|méthylation positive",
    "non methyle": "non méthylé|non methylé|methylation negative|méthylation négative|absence de méthylation|absence de methylation", "perte": "délétion|deletion|deleted|del|perte homozygote",
    "perte partielle": "perte hétérozygote", "oui": "oui|yes|vrai|true|present|présent|présente", "non": "non|no|faux|false|absent", "M": "homme|masculin|h|m|mr|monsieur|male|mâle",
    "F": "femme|féminin|feminin|f|mme|madame|mademoiselle|female", "gauche": "gauche", "droite": "droite", "bilateral": "bilatéral|bilatérale", "median": "médian|médiane|ligne médiane",
    "exerese complete": "exérèse complète|exerese complète", "exerese partielle": "exérèse partielle|exerese partielle", "exerese": "exérèse", "biopsie": "biopsie stéréotaxique|biopsie chirurgicale",
    "2007": "oms 2007|who 2007", "2016": "oms 2016|who 2016", "2021": "oms 2021|who 2021",
}
SYNONYMS = {form: value for value, forms in _SYNONYMS.items() for form in forms.split("|")}


def normalise(value: Column, kind: Column) -> Column:
    """The vocabulary's spelling of a value; null for spellings of nothing, whole numbers for integer fields."""
    s = F.trim(value)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv]), F.lower(s))
    whole = F.when((kind == "integer") & s.rlike(r"^[+-]?\d+$"), s.try_cast("long").cast("string"))
    return F.when(value.isNull() | F.lower(s).isin("", "null", "none", "n/a"), F.lit(None)).when(F.upper(s) == "NA", "NA").otherwise(F.coalesce(known, whole, s))


def checked(rows: DataFrame, field_def: DataFrame, vocab_value: DataFrame) -> DataFrame:
    """rows(field, value, ..) -> the same with vocab_valid and flagged. Unknown fields are flagged; nothing and NA
    are valid; evolution and molecular fields follow their own forms; `autre` admits free text, but no number in a
    vocabulary of numbers."""
    sets = vocab_value.groupBy("vocabulary").agg(F.collect_set(F.lower("value")).alias("_set"))
    known = F.broadcast(field_def.join(sets, "vocabulary", "left").select("field", F.col("grp").alias("_grp"), "_set", F.lit(True).alias("_known")))
    v = F.col("value")
    inside = F.array_contains("_set", F.lower(v))
    numbers = F.forall(F.filter("_set", lambda x: ~x.isin("na", "autre")), lambda x: x.rlike(r"^-?\d+$"))
    free = F.array_contains("_set", "autre") & (F.trim(v) != "") & ~(numbers & v.rlike(r"^-?\d+$"))
    molecular = v.rlike(r"^mute \(.*\)$") | (v.rlike(r"^[A-Za-z0-9_+/ .-]+$") & (F.length(v) <= 200))
    ok = F.when(v.isNull() | (F.upper(v) == "NA") | F.col("_set").isNull(), True).when(F.col("_grp") == "molecular", molecular).otherwise(inside | free)
    out = rows.join(known, "field", "left").withColumn("vocab_valid", F.col("_known").isNotNull() & ok)
    return out.withColumn("flagged", ~F.col("vocab_valid")).drop("_grp", "_set", "_known")


def valid_evolution(v: Column) -> Column:
    return v.isin("initial", "terminal", "autre", "NA") | v.rlike(r"^P\d+$")
