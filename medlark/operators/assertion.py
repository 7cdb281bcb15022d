"""Assertion of a found span - negated, hypothetical, historical - and what negation does to a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 60
NEGATION = r"(?iU)\bpas\s+(?:de|d['’]\s*)|\babsence\s+(?:de|d['’]\s*)|\bsans\s+|\baucune?\s+|\bni\s+|\bnon\s+|\bn['’]?\s*(?:objective|retrouve|révèle|montre|est|a)\s+pas\b|\bn[eé]gati(?:f|ve)\b"
HYPOTHESIS = r"(?iU)\b(?:possible|probable)(?:ment)?\b|\bsuspectée?\b|\bsuspe?icion\b|\bà\s+(?:corréler|confronter|confirmer)\b|\béventuel(?:lement|le)?\b|\bhypothèse\b"
HISTORY = r"(?iU)\bantécédents?\b|\bhistoire\s+de\b|\bhistorique(?:ment)?\b|\bancien(?:nement|ne)?\b|\bpr[eé]c[eé]demment\b|\bant[eé]rieurement\b|\ben\s+\d{4}\b"


def before(text: Column, start: Column, end: Column, window: int = WINDOW, own: bool = True) -> Column:
    """The window before a span from its last sentence on; with the span itself where own is set."""
    left = F.greatest(start - window, F.lit(0))
    lead = F.substring(text, left + 1, start - left)
    lead = F.regexp_replace(lead, r"(?s)^.*[.!?;]\s", "")
    return F.concat(lead, F.substring(text, start + 1, end - start)) if own else lead


def after(text: Column, end: Column, window: int = WINDOW) -> Column:
    """The window after a span up to the end of its sentence."""
    return F.regexp_replace(F.substring(text, end + 1, F.lit(window)), r"(?s)[.!?;]\s.*$", "")


def assertions(text: Column, start: Column, end: Column, self_negation: bool = True) -> list[Column]:
    """negated, hypothesis and history of a span. A span may be its own cue unless self_negation is off."""
    lead, tail = before(text, start, end, own=self_negation), after(text, end)
    near = lambda p: lead.rlike(p) | tail.rlike(p)
    return [lead.rlike(NEGATION).alias("negated"), near(HYPOTHESIS).alias("hypothesis"), near(HISTORY).alias("history")]


FLIP = {
    "positif": "negatif", "positive": "negatif", "maintenu": "negatif", "negatif": "positif", "negative": "positif", "wt": "muté", "mute": "wt", "muté": "wt", "mutée": "wt",
    "methyle": "non methyle", "méthylé": "non methyle", "non methyle": "méthylé", "non méthylé": "méthylé",
}


def negate(value: Column, mapping: Column) -> Column:
    """A negated value: `non` for presence fields, its opposite where there is one, else `non ..` for free values.
    `en attente` stays."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    opposite = F.try_element_at(F.create_map(*[F.lit(x) for kv in FLIP.items() for x in kv]), v)
    free = F.when(v == "", v).otherwise(F.concat(F.lit("non "), v))
    return F.when(v == "en attente", v).when(mapping == "presence", "non").when(opposite.isNotNull(), opposite).when(mapping == "similarity", v).otherwise(free)
