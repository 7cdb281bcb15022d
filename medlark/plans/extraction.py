"""Registered queries of classification, sections and rule extraction over the sample reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlark.operators import classify, extract

from .base import expected, query, reports, seeded, table, values

_KEYWORDS = f"kw AS ({values(classify.keywords(), 'doc_type, type_order, keyword, weight')})"
_SCORES = f"""{_KEYWORDS}, scores AS (SELECT doc_id, doc_type, type_order, coalesce(sum(weight) FILTER (WHERE contains(lower(text), lower(keyword))), 0) AS score FROM documents, kw GROUP BY ALL)"""


@query("A01_keyword_scores", f"WITH {_SCORES} SELECT doc_id, doc_type, score::BIGINT AS score FROM scores")
def keyword_scores(spark, sf_dir):
    return classify.scores(table(spark, sf_dir, "documents")).select("doc_id", "doc_type", F.col("score").cast("long").alias("score"))


@query("A02_document_type", f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM scores WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, type_order))
SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'consultation' ELSE doc_type END AS doc_type, round(CASE WHEN score > 0 THEN (score - second) / score ELSE 0 END, 6) AS confidence, score = 0 OR score - second <= 2 AS is_ambiguous FROM r JOIN documents USING (doc_id) WHERE n = 1""")
def document_type(spark, sf_dir):
    return classify.classify(table(spark, sf_dir, "documents")).select("doc_id", "doc_type", F.round("confidence", 6).alias("confidence"), "is_ambiguous")


@query("W16_ranked_scores", f"WITH {_SCORES} SELECT doc_id, doc_type, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, type_order)::INTEGER AS place FROM scores")
def ranked_scores(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "type_order")
    return classify.scores(table(spark, sf_dir, "documents")).select("doc_id", "doc_type", F.row_number().over(w).alias("place"))


_SECTIONS = [
    ("r1", "preamble", 0), ("r1", "microscopy", 1), ("r1", "ihc", 2), ("r1", "conclusion", 3), ("r2", "full_text", 0), ("r3", "full_text", 0), ("r4", "molecular", 0), ("r4", "chromosomal", 1),
    ("r5", "radiology", 0), ("r6", "full_text", 0), ("r7", "full_text", 0), ("r8", "full_text", 0),
]


@query("T05_sections", values(_SECTIONS, "doc_id, section, position"))
def section_names(spark, sf_dir):
    return classify.sections(reports(spark)).select("doc_id", "section", "position")


#: name -> extractor and, by report, the fields that a reader finds in it.
_NUMBERED = {
    "X01_ihc": ("ihc", {0: {"ihc_idh1": "positif", "ihc_atrx": "maintenu", "ihc_p53": "negatif", "ihc_gfap": "positif", "ihc_olig2": "positif", "ihc_ki67": "10 a 15 %"}}),
    "X02_molecular": ("molecular", {3: {"mol_idh1": "wt", "mol_idh2": "wt", "mol_tert": "mute", "mol_mgmt": "methyle"}}),
    "X03_chromosomal": ("chromosomal", {3: {"ch7p": "gain", "ch10q": "perte", "ch10p": "perte", "ch1p": "perte", "ch19q": "perte"}}),
    "X04_binary": ("binary", {
        0: {"histo_necrose": "oui", "histo_pec": "oui"}, 1: {"ceph_hic": "non", "anti_epileptiques": "oui", "corticoides": "non"}, 2: {"progress_radiologique": "oui", "antecedent_tumoral": "oui"},
        4: {"contraste_1er_symptome": "oui", "oedeme_1er_symptome": "oui", "calcif_1er_symptome": "non"},
    }),
    "X05_numerical": ("numerical", {0: {"histo_mitoses": "4", "ihc_ki67": "10 a 15", "grade": "3"}, 1: {"ik_clinique": "80"}, 2: {"chm_cycles": "6", "rx_dose": "60"}}),
    "X06_amplifications": ("amplification", {3: {"ampli_egfr": "non", "ampli_cdk4": "oui"}}),
    "X07_fusions": ("fusion", {3: {"fusion_fgfr": "non", "fusion_ntrk": "oui"}}),
    "X08_sexe": ("sexe", {1: {"sexe": "F"}, 2: {"sexe": "M"}}),
    "X09_tumeur_lateralite": ("tumeur_lateralite", {1: {"tumeur_lateralite": "gauche"}, 2: {"tumeur_lateralite": "droite"}, 4: {"tumeur_lateralite": "droite"}}),
    "X10_evol_clinique": ("evol_clinique", {5: {"evol_clinique": "P2"}}),
    "X11_type_chirurgie": ("type_chirurgie", {5: {"type_chirurgie": "exerese partielle"}}),
    "X12_classification_oms": ("classification_oms", {0: {"classification_oms": "2021"}}),
    "X13_chimios": ("chimios", {2: {"chimios": "temozolomide"}, 5: {"chimios": "bevacizumab + lomustine"}}),
    "X14_tumeur_position": ("tumeur_position", {2: {"tumeur_position": "temporal"}}),
    "X15_diag_histologique": ("diag_histologique", {0: {"diag_histologique": "astrocytome"}, 2: {"diag_histologique": "glioblastome"}}),
}


def _register(name: str, extractor: str, facts: dict) -> None:
    @query(name, expected(facts, "field, value"))
    def run(spark, sf_dir):
        return extract.extract(seeded(spark, sf_dir), [extractor]).select("doc_id", "field", "value")


for _name, (_extractor, _facts) in _NUMBERED.items():
    _register(_name, _extractor, _facts)


@query("X16_rule_extraction")
def rule_extraction(spark, sf_dir):
    return extract.rule_facts(seeded(spark, sf_dir))


_DATED = [("r1", "date_chir", "05/02/2024"), ("r2", "annee_de_naissance", "1961"), ("r2", "dn_date", "05/03/2024"), ("r5", "exam_radio_date_decouverte", "30/11/2022"), ("r6", "date_chir", "14/12/2022"), ("r6", "rx_date_debut", "14/12/2022"), ("r6", "date_progression", "01/01/2023")]


@query("D03_keyword_dates", values(_DATED, "doc_id, field, value"))
def dated(spark, sf_dir):
    return extract.keyword_dates(reports(spark))
