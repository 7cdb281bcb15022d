"""Registered queries of the text, date, assertion and validation functions.

Inputs are literal cases, the sample reports and the documents table; oracles are DuckDB's own functions or the
expected values of the cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlark.functions import schema, text
from medlark.operators import assertion, evaluation, validation

from .base import REPORTS_SQL, documents, query, reports, table, values, DOCUMENTS_SQL


def _cases(spark, rows, names, kinds=None):
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names.split(", "), kinds or ["string"] * len(names.split(", ")))))


def _expect(name: str, cases: list[tuple], make, kind: str = "string"):
    """A query over (input, expected) cases whose oracle is the expected column."""

    @query(name, values([(a, b) for a, b in cases], "input, output"))
    def run(spark, sf_dir):
        return _cases(spark, [(a,) for a, _ in cases], "input").select("input", make(F.col("input")).cast(kind).alias("output"))

    return run


_CLEAN = "regexp_replace(regexp_replace(translate(text, '     ‘’‚′“”„«»‐‑‒–—―', '     ''''''''\"\"\"\"\"------'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), ' {2,}', ' ', 'g')"
_FOLD = "lower(strip_accents(text))"


@query("T01_clean_text", f"SELECT doc_id, md5({_CLEAN}) AS digest FROM documents")
def clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("digest"))


@query("T02_match_form", f"SELECT doc_id, md5(trim(regexp_replace(replace({_FOLD}, 'œ', 'oe'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def match_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.match_form(F.col("text"))).alias("digest"))


_expect("T03_abbreviations", [("TMZ puis RT", "temozolomide puis radiotherapie"), ("rt et gbm", "rt et glioblastome"), ("IK 80, ik 80", "indice de Karnofsky 80, ik 80"), ("GTR avant STR", "exerese complete avant exerese partielle"), ("dMMR DMMR", "deficit MMR DMMR"), ("aTMZ", "aTMZ")], text.expand_abbreviations)
_expect("T04_extracted_form", [("IDH1 Muté", "idh 1 mute"), ("a\n\nb", "ab"), ("Ki67  :\t10 %", "ki 67 : 10 %"), ("R C P du jour", "rcp du jour")], text.extracted_form)
_expect("P09_document_identifier", [("IPP: 8000000001", "8000000001"), ("x 8123456789 y", "8123456789"), ("x8123456789", None), ("7123456789", None)], text.document_identifier)
_expect("P09_path_identifier", [("/a/8000000002_b.pdf", "8000000002"), ("8000000009/x.pdf", None), ("c_8111111111_cs.pdf", "8111111111")], text.path_identifier)
_expect("P10_path_order", [("/a/8000000002_cs.pdf", "2"), ("8000000002.pdf", "1"), ("/x_cs.pdf/y.pdf", "1")], text.path_order)
_expect("S02_canonical_identifier", [("1.0", "1"), (" 12 ", "12"), ("8e9", "8000000000"), ("abc", "abc"), ("1.5", "1.5"), (None, "")], text.canonical_identifier)
_expect("P07_pseudonym_predicate", [("[NOM_0A1B2C3D4E]", "true"), ("[NOM]", "false"), ("Dupont", "false"), (None, "false")], text.is_token)
_expect("P08_reasonable_date", [("01/01/1850", "false"), ("01/01/2020", "true"), ("01/01/2999", "false"), ("mars 2020", "true"), ("12/2020", "true")], lambda c: text.plausible_date(c, 2025))
_expect("D02_full_year", [("24", "2024"), ("49", "2049"), ("50", "1950"), ("1999", "1999")], text.full_year)
_expect("D02_month_number", [("Janvier", "1"), ("févr", "2"), ("aout", "8"), ("DEC", "12"), ("xyz", None)], evaluation.month_number)
_expect("D05_consultation_date", [("vue en consultation du 05/03/2024.", "05/03/2024"), ("Paris, le 12 mars 2021", "12 mars 2021"), ("Date de réception : 09/01/2024", "09/01/2024"), ("sans date", None)], text.consultation_date)
_expect("D06_date_number", [("05/03/2024", "20240305"), ("2024/03/05", "20240305"), ("12 mars 2021", "20210312"), ("03/25/2020", "20200325"), ("05/03/24", "240305")], lambda c: text.date_number(text.date_members(c)))
_expect("D08_metric_date", [("5/3/2024", "2024-03-05"), ("2024-3-5", "2024-03-05"), ("12 mars 2021", "2021-03-12"), ("mars 2021", "2021-03"), ("avr-10", "2010-04"), ("2008", "2008"), ("bientôt", None)], lambda c: evaluation.canonical_date(F.lower(F.trim(c))))
_expect("X22_normalise_value", [("Négatif", "negatif"), (" wild type ", "wt"), ("Homme", "M"), ("null", None), ("na", "NA"), ("délétion", "perte"), ("OMS 2021", "2021"), ("glioblastome", "glioblastome")], lambda c: validation.normalise(c, F.lit("string")))
_expect("X23_evolution_form", [("P3", "true"), ("initial", "true"), ("P", "false"), ("stable", "false")], validation.valid_evolution)
_expect("U06_multi_values", [("01/01/2020, 02/01/2020", "01/01/2020|02/01/2020"), ("a et b puis a", "a|b"), ("a/b", "a/b"), (";;", "")], lambda c: F.array_join(__import__("medlark.operators.timeline", fromlist=["parts"]).parts(c), "|"))

_PAIRS = [("mars 2020", "03/2020", "true"), ("Février 2019", "fevrier 2019", "true"), ("2018", "2019", "false"), ("x", "y", "false")]


@query("D09_fuzzy_date", values(_PAIRS, "a, b, same"))
def fuzzy_date(spark, sf_dir):
    return _cases(spark, [p[:2] for p in _PAIRS], "a, b").select("a", "b", text.fuzzy_same_date(F.col("a"), F.col("b")).cast("string").alias("same"))


_DATES = [
    ("le 5/3/2024 et 2023-01-02", "3:05/03/2024:5/3/2024|15:02/01/2023:2023-01-02"), ("12 mars 2021, déc-10", "0:12/03/2021:12 mars 2021|14:01/12/2010:déc-10"),
    ("depuis 2015", "0:01/01/2015:depuis 2015"), ("rien", ""), ("janv-25 puis janv-25", "0:01/01/2025:janv-25|13:01/01/2025:janv-25"),
]
_expect("D01_dates", _DATES, lambda c: F.array_join(F.transform(text.dates(c), lambda d: F.concat_ws(":", d["start"].cast("string"), d["date"], d["raw"])), "|"))


@query("S20_wrapped_text", "SELECT doc_id, md5(regexp_replace(text, '(.{80}\\S*)\\s', '\\1' || chr(10), 'g')) AS digest FROM documents")
def wrap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.wrapped(F.col("text"))).alias("digest"))


_ASSERTED = [
    ("Pas de céphalées ce jour", "céphalées", "true", "false", "false"), ("Nécrose absente. Mitoses", "Mitoses", "false", "false", "false"), ("Suspicion de récidive", "récidive", "false", "true", "false"),
    ("Antécédents de tumeur", "tumeur", "false", "false", "true"), ("Pas de fièvre. Crise notée", "Crise", "false", "false", "false"), ("IDH1 négatif", "négatif", "true", "false", "false"), ("crise possible", "crise", "false", "true", "false"),
]


@query("X20_assertions", values(_ASSERTED, "text, span, negated, hypothesis, history"))
def asserted(spark, sf_dir):
    rows = _cases(spark, [r[:2] for r in _ASSERTED], "text, span").withColumn("s", F.expr("instr(text, span) - 1"))
    marks = assertion.assertions(F.col("text"), F.col("s"), F.col("s") + F.length("span"))
    return rows.select("text", "span", *[m.cast("string").alias(n) for m, n in zip(marks, ("negated", "hypothesis", "history"))])


_NEGATED = [("oui", "presence", "non"), ("positif", "similarity", "negatif"), ("gain", "similarity", "gain"), ("en attente", "presence", "en attente"), ("mute", "direct", "wt"), ("01/01/2020", "direct", "non 01/01/2020"), ("", "direct", "")]


@query("X21_negated_values", values(_NEGATED, "value, mapping, output"))
def negated(spark, sf_dir):
    return _cases(spark, [r[:2] for r in _NEGATED], "value, mapping").select("value", "mapping", assertion.negate(F.col("value"), F.col("mapping")).alias("output"))


_CHECKED = [
    ("grade", "3", "true"), ("grade", "7", "false"), ("grade", "haut", "true"), ("ihc_idh1", "Positif", "true"), ("ihc_idh1", "perdu", "false"), ("mol_idh1", "R132H", "true"), ("inconnu", "x", "false"),
    ("sexe", "NA", "true"), ("sexe", None, "true"), ("chimios", "n'importe", "true"), ("type_chirurgie", "libre", "true"), ("ch1p", "perte partielle", "true"),
]


@query("X23_vocabulary_check", values(_CHECKED, "field, value, valid"))
def vocabulary(spark, sf_dir):
    rows = _cases(spark, [r[:2] for r in _CHECKED], "field, value")
    return validation.checked(rows, schema.field_def(spark), schema.vocab_value(spark)).select("field", "value", F.col("vocab_valid").cast("string").alias("valid"))


_VERIFIED = [("Foyers de  nécrose", "nécrose", "true"), ("un deux trois quatre cinq", "un deux trois quatre six", "true"), ("abc", "xyz", "false"), ("abc", "", "false")]


@query("T10_span_verification", values(_VERIFIED, "text, span, ok"))
def verified(spark, sf_dir):
    return _cases(spark, [r[:2] for r in _VERIFIED], "text, span").select("text", "span", text.span_verified(F.col("text"), F.col("span")).cast("string").alias("ok"))


_WINDOWED = [("abcdefghij", 3, 5, 2, "bc fg"), ("abc", 0, 1, 5, " bc"), ("abcdef", 4, 6, 3, "bcd ")]


@query("T09_context_window", values(_WINDOWED, "t, s, e, w, output"))
def windowed(spark, sf_dir):
    rows = _cases(spark, [r[:4] for r in _WINDOWED], "t, s, e, w", ["string", "int", "int", "int"])
    return rows.select("t", "s", "e", "w", text.context(F.col("t"), F.col("s"), F.col("e"), F.col("w")).alias("output"))


_SPANS = [("Jean Dupont, 12 rue", [(0, 4, "A"), (5, 11, "B"), (2, 8, "C")], "A B, 12 rue"), ("abc", [], "abc"), ("aaaa", [(0, 2, "x"), (0, 4, "y")], "y")]


@query("W13_T15_span_replacement", values([(a, c) for a, _, c in _SPANS], "t, output"))
def replacement(spark, sf_dir):
    rows = spark.createDataFrame([(a, b) for a, b, _ in _SPANS], "t string, spans array<struct<start:int,end:int,by:string>>")
    return rows.select("t", text.replaced(F.col("t"), text.without_overlap(F.col("spans"))).alias("output"))


_SINCE = "2025"


@query("W01_order_rank", f"WITH {DOCUMENTS_SQL} SELECT doc_id, rank() OVER (PARTITION BY patient_id ORDER BY coalesce(try_strptime(doc_date, '%d/%m/%Y'), try_strptime(doc_date, '%Y/%m/%d')))::INTEGER AS ord FROM docs WHERE doc_date IS NOT NULL")
def order_rank(spark, sf_dir):
    from medlark.operators.timeline import sort_date
    from pyspark.sql import Window

    w = Window.partitionBy("patient_id").orderBy(sort_date(F.col("doc_date")))
    return documents(spark, sf_dir).filter("doc_date is not null").select("doc_id", F.rank().over(w).alias("ord"))
