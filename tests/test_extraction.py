"""Rule extraction of the sample reports, by hand."""

from medlark.operators import classify, extract
from medlark.plans import base


def test_first_section_that_finds_a_field_gives_it(spark):
    docs = base.reports(spark)
    got = {(r.doc_id, r.field): (r.section, r.value) for r in extract.run_rules(docs, classify.sections(docs)).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "r1"} == {
        "date_chir": ("preamble", "05/02/2024"), "histo_necrose": ("microscopy", "oui"), "histo_pec": ("microscopy", "oui"), "histo_mitoses": ("microscopy", "4"), "ihc_idh1": ("ihc", "positif"), "ihc_atrx": ("ihc", "maintenu"),
        "ihc_p53": ("ihc", "negatif"), "ihc_gfap": ("ihc", "positif"), "ihc_olig2": ("ihc", "positif"), "ihc_ki67": ("ihc", "10 a 15 %"), "diag_histologique": ("conclusion", "astrocytome"),
        "classification_oms": ("conclusion", "2021"), "grade": ("conclusion", "3"),
    }
    assert {k[1]: v[1] for k, v in got.items() if k[0] == "r6"} == {"chimios": "bevacizumab + lomustine", "date_chir": "14/12/2022", "date_progression": "01/01/2023", "rx_date_debut": "14/12/2022", "evol_clinique": "P2", "type_chirurgie": "exerese partielle"}
    # radiology has no rule for the side: the whole text gives it
    assert got["r5", "tumeur_lateralite"] == ("full_text", "droite") and got["r5", "contraste_1er_symptome"] == ("radiology", "oui")
    assert not [k for k in got if k[0] in ("r7", "r8")]


def test_nearest_cue_and_exact_start(spark):
    far = "x " * 110
    text = f"Chirurgie discutée. {far}Le 01/02/2020 rien. {far}Chirurgie du 03/04/2021."
    docs = spark.createDataFrame([(1, text), (2, "IDH10 puis IDH1 positif, né le [DATE_0AB1_1961]"), (3, None)], "doc_id int, text string")
    assert [(r.doc_id, r.field, r.value) for r in extract.keyword_dates(docs).collect()] == [(1, "date_chir", "03/04/2021")]
    got = {(r.doc_id, r.field): r for r in extract.run_rules(docs, classify.sections(docs)).collect()}
    assert got[2, "annee_de_naissance"].value == "1961" and got[2, "ihc_idh1"].start == 11


def test_required_texts_are_in_every_match():
    import re
    import unicodedata

    assert extract.required(r"(?:tumeur|lesion)\s+(?:du\s+)?lobe") == ("lobe",) and extract.required(r"\b(?:bst|biopsie)\b") == ("biopsie", "bst") and extract.required(r"\bik\s*:?\s*\d+") == ()
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    matched = 0
    for rule in extract.RULES:
        words = extract.required(rule.pattern)
        for r in base.REPORTS:
            for m in re.finditer(rule.pattern, fold(r[3])):
                matched += 1
                assert not words or any(w in m[0] for w in words), (rule, m[0])
    assert matched > 40 and sum(bool(extract.required(r.pattern)) for r in extract.RULES) > 0.7 * len(extract.RULES)


def test_all_needed_texts_are_in_every_match():
    import re

    assert extract._needs(r"\bgene\s+(?:idh-?1)\s+sauvage", 2) == (("sauvage",), ("gene",), ("idh",)) and extract._needs(r"\bik\s*:?\s*\d+", 2) == (("ik",),)
    text = " ".join(r[3].lower() for r in base.REPORTS).replace("é", "e").replace("è", "e").replace("ï", "i").replace("œ", "o")
    for rule in extract.RULES:
        for m in re.finditer(rule.pattern, text):
            assert all(any(w in m[0] for w in words) for words in extract._needs(rule.pattern, 2)), (rule, m[0])
