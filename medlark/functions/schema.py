"""The field dimension: 110 fields with group, type, vocabulary, mapping mode, temporal class and event axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VOCABULARY = {
    "binary": "non oui NA", "ihc": "maintenu negatif positif NA", "molecular": "mute wt autre NA", "arm": "perte gain NA|perte partielle", "mgmt": "wt mute NA methyle|non methyle",
    "grade": "1 2 3 4 NA autre", "who": "2021 2016 2007 NA", "surgery": "biopsie NA autre exerese|en attente|exerese partielle|exerese complete", "sex": "F M NA", "side": "median bilateral droite gauche NA",
    "hand": "ambidextre gaucher droitier NA|gaucher contrarié|droitier contrarié", "yesno": "Non Oui non oui NA",
}


def allowed(vocabulary: str) -> list[str]:
    """Values of a vocabulary: one-word ones first, then those written with spaces."""
    plain, *spaced = VOCABULARY[vocabulary].split("|")
    return [*plain.split(), *spaced]


#: branch / group / type / vocabulary / mapping / temporal class / axis: names
_SPEC = """
bio identifiers date - direct specimen surgery: date_chir
bio identifiers string - direct specimen -: num_labo
bio diagnosis text - direct specimen -: diag_integre diag_histologique
bio diagnosis categorical who similarity specimen -: classification_oms
bio diagnosis categorical grade similarity specimen -: grade
bio ihc categorical ihc similarity specimen -: ihc_mmr ihc_olig2 ihc_gfap ihc_hist_h3k27me3 ihc_hist_h3k27m ihc_braf ihc_fgfr3 ihc_atrx ihc_p53 ihc_idh1
bio ihc string - direct specimen -: ihc_ki67 ihc_egfr_hirsch
bio histology categorical binary presence specimen -: histo_pec histo_necrose
bio histology integer - direct specimen -: histo_mitoses
bio histology text - direct specimen -: aspect_cellulaire
bio molecular string - direct specimen -: mol_atrx mol_fubp1 mol_cic mol_pten mol_p53 mol_prkca mol_egfr_mut mol_fgfr1 mol_mgmt mol_braf mol_hist1h3b mol_h3f3a mol_CDKN2A mol_tert mol_idh2 mol_idh1
bio chromosomal categorical arm similarity specimen -: ch9q ch9p ch7q ch7p ch10q ch10p ch19q ch1p
bio chromosomal categorical binary presence specimen -: ch1p19q_codel
bio amplification categorical binary presence specimen -: ampli_mdm4 ampli_met ampli_egfr ampli_cdk4 ampli_mdm2
bio fusion categorical binary presence specimen -: fusion_autre fusion_ntrk fusion_fgfr
clinical demographics date - direct static -: date_rcp
clinical demographics integer - direct static -: annee_de_naissance
clinical demographics categorical sex similarity static -: sexe
clinical demographics text - direct static -: activite_professionnelle
clinical demographics categorical yesno presence static -: antecedent_tumoral
clinical care_team text - direct static -: localisation_chir localisation_radiotherapie anatomo_pathologiste radiotherapeute neurochirurgien neuroncologue
clinical outcome date - direct static -: date_deces
clinical outcome text - direct static -: survie_globale infos_deces
clinical first_symptoms date - direct static -: date_1er_symptome
clinical first_symptoms categorical binary presence static -: autre_trouble_1er_symptome cognitif_1er_symptome deficit_1er_symptome ceph_hic_1er_symptome epilepsie_1er_symptome
clinical radiology date - direct static -: exam_radio_date_decouverte
clinical radiology categorical binary presence static -: calcif_1er_symptome oedeme_1er_symptome contraste_1er_symptome
clinical radiology categorical binary presence varying -: prise_de_contraste
clinical tumour_location categorical side similarity static -: tumeur_lateralite
clinical tumour_location text - direct static -: tumeur_position
clinical tumour_location categorical hand similarity static -: dominance_cerebrale
clinical evolution date - direct varying state: dn_date
clinical evolution string - direct varying state: evol_clinique
clinical evolution text - direct varying progression: reponse_radiologique
clinical treatment_chemo text - direct varying chemo: chimio_protocole chimios
clinical treatment_chemo date - direct varying chemo: chm_date_fin chm_date_debut
clinical treatment_chemo integer - direct varying chemo: chm_cycles
clinical clinical_state integer - direct varying state: ik_clinique
clinical clinical_state categorical binary presence varying progression: progress_radiologique progress_clinique
clinical clinical_state date - direct varying progression: date_progression
clinical current_symptoms categorical binary presence varying state: cognitif deficit ceph_hic epilepsie
clinical current_symptoms text - direct varying state: autre_trouble
clinical adjunct categorical binary presence varying state: optune corticoides essai_therapeutique anti_epileptiques
clinical surgery categorical surgery similarity varying surgery: type_chirurgie
clinical surgery string - direct varying surgery: qualite_exerese
clinical treatment_radio date - direct varying radio: rx_date_fin rx_date_debut
clinical treatment_radio string - direct varying radio: rx_fractionnement rx_dose
"""

FIELDS: dict[str, dict[str, str]] = {}
for _line in _SPEC.strip().splitlines():
    _head, _names = _line.split(": ")
    for _name in _names.split():
        FIELDS[_name] = dict(zip(("branch", "grp", "type", "vocabulary", "mapping", "temporal", "axis"), _head.split()))

BIO = sorted(n for n, f in FIELDS.items() if f["branch"] == "bio")
CLINICAL = sorted(n for n, f in FIELDS.items() if f["branch"] == "clinical")
#: Field holding the dates that open an axis' events, in order of precedence.
AXES = {"surgery": "date_chir", "chemo": "chm_date_debut", "radio": "rx_date_debut", "progression": "date_progression"}
#: Document types, most trusted first.
PRIORITY = {"bio": "anapath molecular_report rcp consultation radiology".split(), "clinical": "consultation rcp anapath molecular_report radiology".split()}
METADATA = ["_patient_id", "_document_id", "_document_type", "_document_date"]


def field_def(spark: SparkSession) -> DataFrame:
    """One row a field: field, branch, grp, type, vocabulary, mapping, temporal, axis."""
    rows = [(n, *f.values()) for n, f in FIELDS.items()]
    return spark.createDataFrame(rows, "field string, branch string, grp string, type string, vocabulary string, mapping string, temporal string, axis string")


def vocab_value(spark: SparkSession) -> DataFrame:
    """One row a vocabulary and value."""
    return spark.createDataFrame([(v, x) for v in VOCABULARY for x in allowed(v)], "vocabulary string, value string")


def priority(spark: SparkSession) -> DataFrame:
    """Rank of a document type by branch, 0 the most trusted."""
    return spark.createDataFrame([(b, t, i) for b, types in PRIORITY.items() for i, t in enumerate(types)], "branch string, doc_type string, rank int")
