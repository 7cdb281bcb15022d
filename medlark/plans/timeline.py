"""Registered queries of the timeline, merge and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlark.functions import schema
from medlark.operators import evaluation, merge, timeline

from .base import FACTS_SQL, documents, facts, query, table, values

_RANKS = [(b, t, i) for b, types in schema.PRIORITY.items() for i, t in enumerate(types)]
_FIELD_SQL = f"field_def AS ({values([(n, f['branch'], f['temporal']) for n, f in schema.FIELDS.items()], 'field, branch, temporal')}), priority AS ({values(_RANKS, 'branch, doc_type, rank')})"
_DATE = "coalesce(try_strptime(doc_date, '%d/%m/%Y'), try_strptime(doc_date, '%Y/%m/%d'))"
_GRID = f"""{FACTS_SQL}, {_FIELD_SQL}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY {_DATE} NULLS LAST, doc_id) AS seq_no FROM (SELECT DISTINCT patient_id, doc_id, doc_type, doc_date FROM facts)
), grid AS (
  SELECT o.patient_id, o.doc_id, o.doc_type, o.doc_date, o.seq_no, f.field, x.value FROM ordered o JOIN (SELECT DISTINCT patient_id, field FROM facts) f USING (patient_id)
  LEFT JOIN facts x ON x.doc_id = o.doc_id AND x.field = f.field
), cells AS (
  SELECT g.*, coalesce(d.temporal, 'varying') AS temporal, coalesce(p.rank, 5) AS rank,
    sum(CASE WHEN c.doc_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY g.patient_id, g.field ORDER BY g.seq_no) AS epoch
  FROM grid g LEFT JOIN field_def d ON d.field = g.field LEFT JOIN priority p ON p.branch = coalesce(d.branch, 'clinical') AND p.doc_type = g.doc_type
  LEFT JOIN (SELECT DISTINCT doc_id FROM facts WHERE field = 'date_chir' AND value IS NOT NULL) c ON c.doc_id = g.doc_id
)"""
_W = "PARTITION BY patient_id, field{} ORDER BY seq_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_FIRST = "arg_min(value, rank * 1000000 + seq_no) FILTER (WHERE value IS NOT NULL) OVER ({})"
_STATIC, _SPECIMEN = _FIRST.format(_W.format("")), _FIRST.format(_W.format(", epoch"))
_VARYING = f"arg_max(value, seq_no - rank * 1000000) FILTER (WHERE value IS NOT NULL) OVER ({_W.format('')})"
_STATE = f"{_GRID}, state AS (SELECT patient_id, doc_id, doc_type, doc_date, seq_no, field, CASE temporal WHEN 'static' THEN {_STATIC} WHEN 'specimen' THEN {_SPECIMEN} ELSE {_VARYING} END AS value FROM cells)"


def _dims(spark):
    return schema.field_def(spark), schema.priority(spark)


@query("W03_chronological", f"WITH {_GRID} SELECT patient_id, doc_id, seq_no AS seq FROM ordered")
def chronological(spark, sf_dir):
    return timeline.chronological(facts(spark, sf_dir)).select("patient_id", "doc_id", F.col("seq").cast("long").alias("seq"))


@query("J13_dense_grid", f"WITH {_GRID} SELECT patient_id, doc_id, field, value FROM grid")
def dense_grid(spark, sf_dir):
    return timeline.grid(facts(spark, sf_dir)).select("patient_id", "doc_id", "field", "value")


def _cells(spark, sf_dir):
    return timeline.ranked(timeline.grid(facts(spark, sf_dir)), *_dims(spark))


@query("W04_static_fold", f"WITH {_GRID} SELECT doc_id, field, {_STATIC} AS value FROM cells")
def static_fold(spark, sf_dir):
    return _cells(spark, sf_dir).select("doc_id", "field", timeline.static_fold().alias("value"))


@query("W05_specimen_fold", f"WITH {_GRID} SELECT doc_id, field, epoch::BIGINT AS epoch, {_SPECIMEN} AS value FROM cells")
def specimen_fold(spark, sf_dir):
    return _cells(spark, sf_dir).select("doc_id", "field", "epoch", timeline.specimen_fold().alias("value"))


@query("W06_varying_fold", f"WITH {_GRID} SELECT doc_id, field, {_VARYING} AS value FROM cells")
def varying_fold(spark, sf_dir):
    return _cells(spark, sf_dir).select("doc_id", "field", timeline.varying_fold().alias("value"))


@query("W07_source_priority", f"WITH {_GRID} SELECT doc_id, field, rank::INTEGER AS rank FROM cells")
def source_priority(spark, sf_dir):
    return _cells(spark, sf_dir).select("doc_id", "field", "rank")


@query("W08_temporal_dispatch", f"WITH {_STATE} SELECT doc_id, field, value FROM state")
def temporal_dispatch(spark, sf_dir):
    return timeline.fold(facts(spark, sf_dir), *_dims(spark)).select("doc_id", "field", "value")


_NAMES = sorted(["tumeur_lateralite", "ik_clinique", "ihc_idh1", "date_chir", "grade", "epilepsie", "champ_inconnu"])


@query("timeline", f"WITH {_STATE} SELECT patient_id AS _patient_id, doc_id AS _document_id, doc_type AS _document_type, doc_date AS _document_date, " + ", ".join(f"max(CASE WHEN field = '{n}' THEN value END) AS {n}" for n in _NAMES) + " FROM state GROUP BY ALL")
def timeline_wide(spark, sf_dir):
    return timeline.wide(facts(spark, sf_dir), _NAMES)


_EVENTS = [
    ("e1", {"date_chir": "01/01/2020, 02/02/2021", "type_chirurgie": "exerese", "sexe": "F", "chimios": "temozolomide", "ik_clinique": "80"}),
    ("e2", {"chm_date_debut": "01/01/2020 puis 01/06/2020", "chimios": "temozolomide; lomustine", "grade": "4", "date_chir": "05/05/2019"}),
    ("e3", {"chm_date_debut": "01/01/2020 et 01/06/2020", "chimios": "temozolomide", "rx_dose": "60"}),
    ("e4", {"rx_date_debut": "01/02/2020;01/02/2020", "sexe": "M"}),
    ("e5", {"rx_date_debut": "01/02/2020;01/03/2021", "rx_dose": "60", "sexe": "M", "prise_de_contraste": "oui"}),
    ("e6", {"date_progression": "2020 puis 2021 puis 2022", "progress_clinique": "oui", "neuroncologue": "x"}),
    ("e7", {"date_chir": "01/01/2020,02/01/2020", "chm_date_debut": "01/02/2020,01/03/2020"}),
]
_SPLIT = [
    ("e1", 0, "surgery", "date_chir=01/01/2020|ik_clinique=80|sexe=F|type_chirurgie=exerese"), ("e1", 1, "surgery", "date_chir=02/02/2021|ik_clinique=80|sexe=F|type_chirurgie=exerese"),
    ("e2", 0, "chemo", "chimios=temozolomide|chm_date_debut=01/01/2020|grade=4"), ("e2", 1, "chemo", "chimios=lomustine|chm_date_debut=01/06/2020|grade=4"),
    ("e3", 0, "chemo", "chimios=temozolomide|chm_date_debut=01/01/2020"), ("e3", 1, "chemo", "chimios=temozolomide|chm_date_debut=01/06/2020"),
    ("e4", 0, None, "rx_date_debut=01/02/2020;01/02/2020|sexe=M"),
    ("e5", 0, "radio", "rx_date_debut=01/02/2020|rx_dose=60|sexe=M"), ("e5", 1, "radio", "rx_date_debut=01/03/2021|rx_dose=60|sexe=M"),
    *[("e6", i, "progression", f"date_progression={2020 + i}|neuroncologue=x|progress_clinique=oui") for i in range(3)],
    ("e7", 0, "surgery", "date_chir=01/01/2020"), ("e7", 1, "surgery", "date_chir=02/01/2020"),
]


@query("G01_event_split", values(_SPLIT, "doc_id, event, axis, features"))
def event_split(spark, sf_dir):
    docs = spark.createDataFrame(_EVENTS, "doc_id string, features map<string,string>")
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("features"), lambda e: F.concat_ws("=", e.key, e.value))), "|")
    return timeline.split_events(docs).select("doc_id", "event", "axis", listed.alias("features"))


# --- merging -------------------------------------------------------------------------------------------------

_EXTRACTOR = "CASE supplier % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'eds' WHEN 2 THEN 'controlled' ELSE 'date' END"


def _extracted(spark, sf_dir):
    """Two extractors' values of each fact."""
    f = facts(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(e) for e in merge.EXTRACTORS]), (F.col("supplier") % 4 + 1).cast("int"))
    one = f.select("doc_id", "field", name.alias("extractor"), "value", "score", "seq")
    return one.union(f.filter("supplier % 4 != 0").select("doc_id", "field", F.lit("rule"), "other_value", "score", "seq"))


@query("J03_priority_overlay", f"WITH {FACTS_SQL} SELECT doc_id, field, value, {_EXTRACTOR} AS extractor FROM facts")
def priority_overlay(spark, sf_dir):
    return merge.overlay(_extracted(spark, sf_dir)).select("doc_id", "field", "value", "extractor")


_MODEL_FIELDS, _ALLOWED = ["grade", "ik_clinique", "epilepsie"], [("grade", "no"), ("grade", "FO"), ("epilepsie", "RF")]


def _model(f):
    return f.filter("other_value is not null").select("doc_id", "field", F.col("other_value").alias("value"))


_MODEL_SQL = f"{FACTS_SQL}, allowed AS ({values(_ALLOWED, 'field, value')}), model AS (SELECT doc_id, field, other_value AS value FROM facts WHERE other_value IS NOT NULL), fine AS (SELECT * FROM model m WHERE m.field NOT IN (SELECT field FROM allowed) OR EXISTS (SELECT 1 FROM allowed a WHERE a.field = m.field AND lower(a.value) = lower(m.value)))"


@query("P12_plausibility_gate", f"WITH {_MODEL_SQL} SELECT * FROM fine")
def plausibility(spark, sf_dir):
    return merge.plausible(_model(facts(spark, sf_dir)), spark.createDataFrame(_ALLOWED, "field string, value string")).select("doc_id", "field", "value")


@query("J04_rule_model_decision", f"""WITH {_MODEL_SQL}, r AS (SELECT doc_id, field, value FROM facts WHERE value IS NOT NULL), m AS (SELECT * FROM fine WHERE field IN ('grade', 'ik_clinique', 'epilepsie'))
SELECT coalesce(r.doc_id, m.doc_id) AS doc_id, coalesce(r.field, m.field) AS field, coalesce(m.value, r.value) AS value, CASE WHEN m.value IS NOT NULL THEN 'ml' ELSE 'rule' END AS source FROM r FULL JOIN m ON r.doc_id = m.doc_id AND r.field = m.field""")
def rule_model(spark, sf_dir):
    f = facts(spark, sf_dir)
    fields = spark.createDataFrame([(x,) for x in _MODEL_FIELDS], "field string")
    return merge.decide(f.filter("value is not null").select("doc_id", "field", "value"), _model(f), fields, spark.createDataFrame(_ALLOWED, "field string, value string"))


_CAND = f"{FACTS_SQL}, cand AS (SELECT patient_id AS doc_id, field, value, score, seq, doc_id AS section, supplier % 3 AS ord, CAST(score AS BIGINT) % 1000 AS start, supplier % 2 = 0 AS preferred FROM facts)"


def _candidates(spark, sf_dir):
    """Halves are rounded to even numbers, as DuckDB casts them."""
    f = facts(spark, sf_dir)
    return f.select(F.col("patient_id").alias("doc_id"), "field", "value", "score", "seq", F.col("doc_id").alias("section"), (F.col("supplier") % 3).alias("ord"), (F.rint("score").cast("long") % 1000).alias("start"), (F.col("supplier") % 2 == 0).alias("preferred"))


def _pick(order: str) -> str:
    return f"WITH {_CAND} SELECT doc_id, field, value, section FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY {order}) = 1"


@query("W09_first_match", _pick("ord, start, section"))
def first_match(spark, sf_dir):
    return merge.best(_candidates(spark, sf_dir), ["doc_id", "field"], F.col("ord"), F.col("start"), F.col("section")).select("doc_id", "field", "value", "section")


@query("W10_first_section", _pick("section, ord"))
def first_section(spark, sf_dir):
    return merge.first_section(_candidates(spark, sf_dir).withColumn("section_pos", F.col("section")).withColumn("extractor_ord", F.col("ord"))).select("doc_id", "field", "value", "section")


@query("W11_highest_score", _pick("score DESC, section"))
def highest_score(spark, sf_dir):
    return merge.highest_score(_candidates(spark, sf_dir).withColumn("seq", F.col("section"))).select("doc_id", "field", "value", "section")


@query("W14_preferred_section", _pick("NOT preferred, start, section"))
def preferred_section(spark, sf_dir):
    return merge.best(_candidates(spark, sf_dir), ["doc_id", "field"], (~F.col("preferred")).cast("int"), F.col("start"), F.col("section")).select("doc_id", "field", "value", "section")


@query("W15_last_entity", _pick("section DESC"))
def last_entity(spark, sf_dir):
    return merge.last_entity(_candidates(spark, sf_dir).withColumn("seq", F.col("section"))).select("doc_id", "field", "value", "section")


@query("J02_fields_facts", f"WITH {FACTS_SQL}, {_FIELD_SQL} SELECT f.doc_id, f.field, f.value, d.branch, d.temporal FROM facts f LEFT JOIN field_def d USING (field)")
def fields_facts(spark, sf_dir):
    return facts(spark, sf_dir).join(F.broadcast(schema.field_def(spark)), "field", "left").select("doc_id", "field", "value", "branch", "temporal")


# --- evaluation ----------------------------------------------------------------------------------------------

_CONFUSION = f"""{FACTS_SQL}, c AS (SELECT doc_id, field, 'rule' AS tier, lower(value) AS g, lower(other_value) AS p FROM facts), confusion AS (
SELECT doc_id, field, tier, (g = p)::INTEGER AS t, CASE WHEN g = p THEN 1 ELSE 0 END AS tp, CASE WHEN g IS NULL AND p IS NULL THEN 1 ELSE 0 END AS tn, CASE WHEN g IS NULL AND p IS NOT NULL THEN 1 ELSE 0 END AS hallucination,
  CASE WHEN g IS NOT NULL AND p IS NULL THEN 1 ELSE 0 END AS omission, CASE WHEN g != p THEN 1 ELSE 0 END AS alteration FROM c)"""


def _rows(spark, sf_dir):
    f = facts(spark, sf_dir)
    return evaluation.confusion(f.select("doc_id", "field", "value"), f.select("doc_id", "field", F.col("other_value").alias("value")))


@query("A03_confusion", f"WITH {_CONFUSION} SELECT doc_id, field, tp, tn, hallucination, omission, alteration FROM confusion")
def confusion(spark, sf_dir):
    return _rows(spark, sf_dir).drop("tier")


_SUMS = "sum(tp)::BIGINT AS tp, sum(tn)::BIGINT AS tn, sum(hallucination)::BIGINT AS hallucination, sum(omission)::BIGINT AS omission, sum(alteration)::BIGINT AS alteration"
_P, _R = "CASE WHEN tp + hallucination + 0.5::DOUBLE * alteration > 0 THEN tp / (tp + hallucination + 0.5::DOUBLE * alteration) ELSE 0 END", "CASE WHEN tp + omission + 0.5::DOUBLE * alteration > 0 THEN tp / (tp + omission + 0.5::DOUBLE * alteration) ELSE 0 END"
_BY_FIELD = f"""{_CONFUSION}, sums AS (SELECT field, {_SUMS} FROM confusion GROUP BY field), pr AS (SELECT *, {_P} AS precision, {_R} AS recall FROM sums),
by_field AS (SELECT field, tp, tn, hallucination, omission, alteration, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


@query("A04_metric_aggregate", f"WITH {_BY_FIELD} SELECT field, tp, tn, hallucination, omission, alteration, 'rule' AS main_tier, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM by_field")
def metric_aggregate(spark, sf_dir):
    rows = evaluation.by_field(_rows(spark, sf_dir))
    return rows.select("field", *evaluation.COUNTS, "main_tier", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_CATEGORY = [(f["grp"], n) for n, f in schema.FIELDS.items()]


@query("A05_category_macro", f"WITH {_BY_FIELD}, category AS ({values(_CATEGORY, 'category, field')}) SELECT category, round(avg(coalesce(f1, 0)), 6) AS f1, count(f1) AS attempted, count(*) AS fields FROM category LEFT JOIN by_field USING (field) GROUP BY category")
def category_macro(spark, sf_dir):
    category = spark.createDataFrame(_CATEGORY, "category string, field string")
    return evaluation.by_category(evaluation.by_field(_rows(spark, sf_dir)), category).select("category", F.round("f1", 6).alias("f1"), "attempted", "fields")


@query("A06_tier_category", f"""WITH {_CONFUSION}, category AS ({values(_CATEGORY, 'category, field')}), sums AS (SELECT category, tier, {_SUMS} FROM confusion JOIN category USING (field) GROUP BY ALL), pr AS (SELECT *, {_P} AS precision, {_R} AS recall FROM sums)
SELECT category, tier, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM pr""")
def tier_category(spark, sf_dir):
    return evaluation.by_tier(_rows(spark, sf_dir), spark.createDataFrame(_CATEGORY, "category string, field string")).select("category", "tier", F.round("f1", 6).alias("f1"))


@query("J05_gold_left_join", f"WITH {FACTS_SQL} SELECT g.doc_id, g.field, g.value AS gold, p.other_value AS predicted FROM facts g LEFT JOIN (SELECT * FROM facts WHERE other_value IS NOT NULL) p ON g.doc_id = p.doc_id AND g.field = p.field WHERE g.value IS NOT NULL")
def gold_left(spark, sf_dir):
    f = facts(spark, sf_dir)
    p = f.filter("other_value is not null").select("doc_id", "field", F.col("other_value").alias("predicted"))
    return f.filter("value is not null").select("doc_id", "field", F.col("value").alias("gold")).join(p, ["doc_id", "field"], "left")


@query("J06_full_join", f"WITH {FACTS_SQL}, g AS (SELECT doc_id, field, value FROM facts WHERE value IS NOT NULL), p AS (SELECT doc_id, field, other_value FROM facts WHERE other_value IS NOT NULL) SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.field, p.field) AS field, g.value AS gold, p.other_value AS predicted FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.field = p.field")
def full_join(spark, sf_dir):
    f = facts(spark, sf_dir)
    p = f.filter("other_value is not null").select("doc_id", "field", F.col("other_value").alias("predicted"))
    return f.filter("value is not null").select("doc_id", "field", F.col("value").alias("gold")).join(p, ["doc_id", "field"], "full_outer")


@query("A09_set_level_scores", f"""WITH {FACTS_SQL}, g AS (SELECT DISTINCT doc_id, field AS label, value AS entity FROM facts WHERE value IS NOT NULL), p AS (SELECT DISTINCT doc_id, field AS label, other_value AS entity FROM facts WHERE other_value IS NOT NULL),
m AS (SELECT coalesce(g.label, p.label) AS label, g.doc_id IS NOT NULL AS ing, p.doc_id IS NOT NULL AS inp FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.label = p.label AND g.entity = p.entity),
s AS (SELECT label, count(*) FILTER (WHERE ing AND inp) AS tp, count(*) FILTER (WHERE ing) AS g, count(*) FILTER (WHERE inp) AS p FROM m GROUP BY label UNION ALL SELECT 'micro', count(*) FILTER (WHERE ing AND inp), count(*) FILTER (WHERE ing), count(*) FILTER (WHERE inp) FROM m),
r AS (SELECT label, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 4) AS precision, round(CASE WHEN g > 0 THEN tp / g ELSE 0 END, 4) AS recall, round(CASE WHEN p + g > 0 THEN 2 * tp / (p + g) ELSE 0 END, 4) AS f1, g AS support FROM s)
SELECT * FROM r UNION ALL SELECT 'macro', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::BIGINT FROM r WHERE label != 'micro'""")
def set_level(spark, sf_dir):
    f = facts(spark, sf_dir)
    g = f.filter("value is not null").select("doc_id", F.col("field").alias("label"), F.col("value").alias("entity"))
    p = f.filter("other_value is not null").select("doc_id", F.col("field").alias("label"), F.col("other_value").alias("entity"))
    return evaluation.sets(g, p)
