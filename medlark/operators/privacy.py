"""Pseudonyms: detection behind an interface with pattern detectors, salted tokens, protected practitioners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlark.functions.text import replaced, without_overlap

#: label -> pattern and the group that is the span
DETECTORS = {
    "MAIL": (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", 0), "TEL": (r"(?<!\d)0[1-9](?:[ .-]?\d{2}){4}(?!\d)", 0), "SECU": (r"(?<!\d)[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?(?!\d)", 0),
    "DATE_NAISSANCE": (r"(?<=[Nn]ée? le )\d{1,2}/\d{1,2}/\d{4}", 0), "NOM": (r"(?<=(?:Madame|Monsieur|Mme|M\.|Mr) )[A-ZÀ-Ý][\w'-]+(?: [A-ZÀ-Ý][\w'-]+)?", 0), "ZIP": (r"(?<!\d)\d{5}(?= [A-ZÀ-Ý])", 0),
}
PRACTITIONER = r"\b(?:Dr|Pr|Docteur|Professeur|Interne)\.?\s+[A-ZÀ-Ý][\w'-]+(?:\s+[A-ZÀ-Ý][\w'-]+)?"
KEEP = ("IPP", "NDA", "DATE", "HOPITAL")
TAGS = {"ADRESSE": "ADDRESS", "SECU": "SSID"}


def token(text: Column, label: Column, scope: Column, salt: str) -> Column:
    """Ten digits of the digest of salt, scope, label and text."""
    return F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), scope, label, text), 256), 1, 10))


def detected(text: Column, pattern: str) -> Column:
    """Array of struct(start, end) of all matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    at = lambda i: total(F.slice(gaps, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))
    return F.transform(found, lambda m, i: F.struct(at(i).alias("start"), (at(i) + F.length(m)).alias("end")))


def _labelled(spans: Column, by: Callable) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by(s).alias("by")))


def _tokens(text_of: Callable, label: str, scope: Column, salt: str) -> Callable:
    return lambda s: F.concat(F.lit(f"[{TAGS.get(label, label)}_"), token(text_of(s), F.lit(label), scope, salt), F.lit("]"))


def pseudonymised(docs: DataFrame, salt: str, whole_base: bool = False, detectors: dict | None = None, keep: tuple = KEEP) -> DataFrame:
    """docs(doc_id, ipp, text) -> doc_id, text with every detected span replaced: a labelled token, or year-??-?? for
    a birth date. Tokens hold within a patient, or within the whole base. Names after a practitioner's title stay."""
    t = F.coalesce(F.col("text"), F.lit(""))
    scope = F.lit("global") if whole_base else F.coalesce(F.col("ipp"), F.lit(""))
    titled = detected(t, PRACTITIONER)
    made = []
    for label, (pattern, _) in (detectors or DETECTORS).items():
        if label in keep:
            continue
        text_of = lambda s: F.substring(t, s["start"] + 1, s["end"] - s["start"])
        if label == "DATE_NAISSANCE":
            by = lambda s: F.concat(F.regexp_extract(text_of(s), r"(\d{4})$", 1), F.lit("-??-??"))
        else:
            by = _tokens(text_of, label, scope, salt)
        spans = detected(t, pattern)
        if label in ("NOM", "PRENOM"):
            spans = F.filter(spans, lambda s: ~F.exists(titled, lambda p: (p["start"] <= s["start"]) & (s["end"] <= p["end"])))
        made.append(_labelled(spans, by))
    return docs.select("doc_id", replaced(t, without_overlap(F.concat(*made))).alias("text"))


def chunks(text: Column, size: int = 1000, overlap: int = 350) -> Column:
    """Array of struct(offset, chunk): windows that overlap by at most a third, cut at the last paragraph, line,
    sentence or space of their second half where there is one."""
    overlap = min(overlap, size // 3)
    cut = rf"(?s)^(.{{{size // 2},{size}}}\n\n|.{{{size // 2},{size}}}\n|.{{{size // 2},{size}}}[.!?] |.{{{size // 2},{size}}} )"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,chunk:string>>").alias("out"), F.lit(False).alias("over"))

    def step(a: Column, _: Column) -> Column:
        window = F.substring(text, a["at"] + 1, F.lit(size))
        last = a["at"] + size >= F.length(text)
        short = F.regexp_extract(window, cut, 1)
        piece = F.when(last | (short == ""), window).otherwise(short)
        out = F.when(a["over"], a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["at"].alias("offset"), piece.alias("chunk")))))
        return F.struct(F.when(a["over"] | last, a["at"]).otherwise(a["at"] + F.length(piece) - overlap).cast("int").alias("at"), out.alias("out"), (a["over"] | last).alias("over"))

    turns = F.sequence(F.lit(0), F.floor(F.length(text) / max(1, size // 2 - overlap)).cast("int"))
    return F.aggregate(turns, start, step, lambda a: a["out"])
