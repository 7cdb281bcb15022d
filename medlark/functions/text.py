"""Text and date functions over columns, all built from SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medlark.functions.months import month_number

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿœæÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŒÆ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyoaAAAAAACEEEEIIIINOOOOOUUUUYOA"
_SPACES, _SINGLE, _DOUBLE, _DASH = "     ", "‘’‚′", "“”„«»", "‐‑‒–—―"


def clean_text(c: Column) -> Column:
    """Plain spaces, quotes and dashes, no control or zero-width characters, single spaces. The text is taken to
    be in composed form already."""
    c = F.translate(c, _SPACES + _SINGLE + _DOUBLE + _DASH, " " * len(_SPACES) + "'" * len(_SINGLE) + '"' * len(_DOUBLE) + "-" * len(_DASH))
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F​-‏﻿]", "")
    return F.regexp_replace(c, " {2,}", " ")


def unaccent(c: Column) -> Column:
    """Latin letters without their accents, ligatures as their first letter; every character keeps its place."""
    return F.translate(c, _ACCENTED, _PLAIN)


def folded(c: Column) -> Column:
    """Lower case without accents; every character keeps its place."""
    return F.lower(unaccent(c))


def match_form(c: Column) -> Column:
    """folded, with ligatures opened, white space collapsed and trimmed."""
    opened = F.regexp_replace(F.regexp_replace(F.lower(c), "œ", "oe"), "æ", "ae")
    return F.trim(F.regexp_replace(folded(opened), r"\s+", " "))


_LONG_FORMS = [
    ("TMZ", "temozolomide", True), ("RT", "radiotherapie", False), ("GBM", "glioblastome", True), ("GTR", "exerese complete", True), ("STR", "exerese partielle", True),
    ("BST", "biopsie stereotaxique", True), ("IK", "indice de Karnofsky", False), ("KPS", "indice de Karnofsky", True), ("PEC", "proliferation endotheliocapillaire", False),
    ("HGG", "gliome de haut grade", True), ("LGG", "gliome de bas grade", True), ("RCP", "reunion de concertation pluridisciplinaire", True), ("dMMR", "deficit MMR", False),
    ("pMMR", "MMR proficient", False), ("LOH", "perte d'heterozygotie", True),
]


def expand_abbreviations(c: Column) -> Column:
    """Long forms of fifteen abbreviations, in order; some only as written."""
    for short, long, any_case in _LONG_FORMS:
        c = F.regexp_replace(c, ("(?i)" if any_case else "") + rf"\b{short}\b", long)
    return c


def extracted_form(c: Column) -> Column:
    """Text as taken from a PDF: cleaned, folded, one line, a space between letters and digits, letter-spaced runs
    closed up."""
    c = match_form(clean_text(c))
    c = F.regexp_replace(c, r"(?<=\b\w) (?=\w\b)", "")
    c = F.regexp_replace(c, r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def wrapped(c: Column, width: int = 80) -> Column:
    """A line break at the first white space at or after each width characters."""
    return F.regexp_replace(c, rf"(.{{{width}}}\S*)\s", "$1\n")


def context(text: Column, start: Column, end: Column, window: int) -> Column:
    """The text within window characters of [start, end), the span itself as one space."""
    left = F.greatest(start - window, F.lit(0))
    return F.concat(F.substring(text, left + 1, start - left), F.lit(" "), F.substring(text, end + 1, F.lit(window)))


def span_verified(text: Column, span: Column, least: float = 0.8) -> Column:
    """The span occurs in the text, or at least this share of its words does; white space and case aside."""
    form = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    words = F.filter(F.split(form(span), " "), lambda w: w != "")
    share = F.size(F.filter(words, lambda w: form(text).contains(w))) / F.size(words)
    return F.when(F.coalesce(F.trim(span), F.lit("")) == "", False).otherwise(form(text).contains(form(span)) | (share >= least))


def replaced(text: Column, spans: Column) -> Column:
    """Non-overlapping struct(start, end, by) spans replaced, from the right."""
    right_to_left = F.reverse(F.array_sort(spans))
    return F.aggregate(right_to_left, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), s["by"], F.substring(t, s["end"] + 1, F.length(t))))


def without_overlap(spans: Column) -> Column:
    """Of struct(start, end, ..) spans, by start and then longest, those that begin at or after the last kept end."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((b["end"] - b["start"]) - (a["end"] - a["start"])))
    # the empty array has the type of the spans
    return F.aggregate(order, F.filter(spans, lambda s: F.lit(False)), lambda kept, s: F.when((F.size(kept) == 0) | (F.element_at(kept, -1)["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(kept))


def document_identifier(text: Column) -> Column:
    """Ten digits from 8 on after a space or a label."""
    return F.nullif(F.regexp_extract(text, r"(?: |IPP: )(8[0-9]{9})", 1), F.lit(""))


def path_identifier(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"8[0-9]{9}", 0), F.lit(""))


def path_order(path: Column) -> Column:
    return F.when(F.regexp_extract(path, r"([^/\\]*)$", 1).contains("_cs.pdf"), 2).otherwise(1)


def canonical_identifier(c: Column) -> Column:
    """1.0 and 1e0 become 1; null the empty string; other texts are trimmed."""
    s = F.trim(c.cast("string"))
    d = s.try_cast("double")
    return F.coalesce(F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("long").cast("string")).otherwise(s), F.lit(""))


def is_token(c: Column) -> Column:
    """Whether a value is a pseudonym such as [NOM_0A1B2C3D4E]."""
    return F.coalesce(c.rlike(r"^\[[A-Z_]+_[0-9A-F]+\]$"), F.lit(False))


def plausible_date(c: Column, this_year: int) -> Column:
    """False only for a date whose year lies outside 1900 to next year."""
    year = F.year(F.coalesce(F.try_to_date(c, "d/M/yyyy"), F.try_to_date(F.concat(F.lit("01/"), c), "d/M/yyyy")))
    return F.coalesce(year.between(1900, this_year + 1), F.lit(True))


_MONTH = "janvier|janv|jan|février|fevrier|févr|fevr|fév|fev|mars|avril|avr|mai|juin|juillet|juill|juil|août|aout|septembre|sept|octobre|oct|novembre|nov|décembre|decembre|déc|dec"
#: Forms of dates and the groups (day, month, year) in them; 0: the first of the month or year.
DATE_FORMS = {
    "dmy": (r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\b", (1, 2, 3)), "ymd": (r"\b(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})\b", (3, 2, 1)),
    "long": (rf"(?i)\b(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}})\b", (1, 2, 3)), "short": (rf"(?i)\b({_MONTH})[.\-](\d{{4}}|\d{{2,3}})\b", (0, 1, 2)), "year": (r"(?i)\b(?:en|depuis|année)\s+((?:19|20)\d{2})\b", (0, 0, 1)),
}


def full_year(c: Column) -> Column:
    n = c.cast("int")
    return F.lpad(F.when(n < 50, n + 2000).when(n < 100, n + 1900).otherwise(n).cast("string"), 4, "0")


def positions(text: Column, pattern: str) -> Column:
    """Where each match of a pattern starts, from 0; linear in the text."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    steps = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("g"), hits.alias("h")), lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["h"]).alias("h")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("o"))
    return F.aggregate(steps, start, lambda s, x: F.struct((s["at"] + x["g"] + x["h"]).alias("at"), F.concat(s["o"], F.array(s["at"] + x["g"])).alias("o")), lambda s: s["o"])


def dates(text: Column) -> Column:
    """Array of struct(start, date, raw), by start: every date as dd/MM/yyyy, read in five forms."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    found = []
    for form, (pattern, (day, month, year)) in DATE_FORMS.items():
        got = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))  # noqa: B023, E731
        one = F.transform(got(0), lambda _: F.lit("1"))
        # starts are taken once, outside of the lambda, which would split the text again for every date
        rows = F.arrays_zip(positions(text, pattern).alias("start"), got(0).alias("raw"), (got(day) if day else one).alias("d"), (got(month) if month else one).alias("m"), got(year).alias("y"))
        number = (lambda m: month_number(m)) if form in ("long", "short") else (lambda m: m.cast("int"))
        read = F.transform(rows, lambda r: F.struct(r["start"].alias("start"), F.concat_ws("/", two(r["d"].cast("int")), two(number(r["m"])), full_year(r["y"])).alias("date"), r["raw"].alias("raw")))  # noqa: B023
        found.append(F.when(text.rlike(pattern), read).otherwise(F.array().cast("array<struct<start:int,date:string,raw:string>>")))
    return F.array_sort(F.concat(*found))


_CUE = r"(?i)(?:consultation.+du.?|Paris(?:, | +|,|)(?: +|)le +|Date(?: +|)de(?: +|)r(?:é|e)ception(?: +|)(?::| +|)(?: +|))"
_RAW = r"((?:\d{4}|\d{2})/\d{2}/(?:\d{4}|\d{2})|\d{2} +[^\d\s]+ +\d{4})"


def consultation_date(text: Column) -> Column:
    """The raw date after one of three cues; null if none."""
    return F.nullif(F.regexp_extract(text, _CUE + _RAW, 1), F.lit(""))


def date_members(raw: Column) -> Column:
    """[year, a, b] of a raw date: a year in last place is brought first, a second member above 12 last."""
    numbers = F.when(raw.contains("/"), F.transform(F.split(raw, "/"), lambda x: x.cast("int"))).otherwise(
        F.array(F.get(F.split(raw, " +"), F.lit(0)).try_cast("int"), month_number(F.get(F.split(raw, " +"), F.lit(1))), F.get(F.split(raw, " +"), F.lit(2)).try_cast("int"))
    )
    at = lambda a, i: F.get(a, F.lit(i))
    turned = F.when(F.array_position(numbers, F.array_max(numbers)) == 3, F.reverse(numbers)).otherwise(numbers)
    return F.when(at(turned, 1) > 12, F.array(at(turned, 0), at(turned, 2), at(turned, 1))).otherwise(turned)


def date_number(members: Column) -> Column:
    """YYYYMMDD, of six digits where the year had two."""
    pad = lambda x: F.when(F.length(x.cast("string")) < 2, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.array_join(F.transform(members, pad), "").try_cast("int")


def fuzzy_same_date(a: Column, b: Column) -> Column:
    """Equal, equal without accents, or the year of one within the other."""
    fa, fb = match_form(a), match_form(b)
    year = lambda x: F.regexp_extract(x, r"(?:19|20)\d{2}", 0)
    return (a == b) | (fa == fb) | ((year(fa) != "") & fb.contains(year(fa)))
