"""Registered queries of the training-set operators."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from medlark.functions import schema
from medlark.operators import training_set as ts
from medlark.sources.storage import durable

from .base import FACTS_SQL, facts, query, table, values

_W = "list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x != '')"


@query("J15_T18_near_duplicates", f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS s FROM w),
u AS (SELECT s, min(doc_id) AS doc_id FROM s WHERE len(s) > 0 GROUP BY s), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM u),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM p WHERE k / (na + nb - k) >= 0.85""")
def near_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return ts.near_duplicates(d, signed=durable(ts.signatures(d))).withColumn("jaccard", F.round("jaccard", 6))


_PAIRS = [("g1", "a", "x", 0.9, 1), ("g1", "a", "y", 0.8, 2), ("g1", "b", "x", 0.7, 3), ("g1", "b", "y", 0.6, 4), ("g2", "a", "x", 0.5, 1), ("g2", "b", "x", 0.5, 2)]


@query("W12_J07_greedy_pairs", values([("g1", "a", "x"), ("g1", "b", "y"), ("g2", "a", "x")], 'grp, "left", "right"'))
def greedy(spark, sf_dir):
    rows = spark.createDataFrame(_PAIRS, "grp string, left string, right string, score double, seq int")
    return ts.greedy_pairs(rows, "grp").select("grp", "left", "right")


@query("J15_membership", f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS s FROM w)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS representative, count(*) OVER (PARTITION BY s) AS copies FROM s WHERE len(s) > 0""")
def membership(spark, sf_dir):
    return ts.membership(table(spark, sf_dir, "documents"))


@query("W17_representatives")
def representatives(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rate = d.select("doc_id", (1.0 - F.col("doc_id") % 7 / 10).alias("rate"))
    signed = durable(ts.signatures(d))  # texts are read once for them; classes and pairs both come from them
    return ts.representatives(ts.near_duplicates(d, signed=signed), durable(ts.membership(d, signed=signed)), rate, durable)


_JSON = [("<think>x</think>```json\n{\"a\": [1, 2,],}\n```", '{"a": [1, 2]}'), ("rien", None), ("ok {\"b\": 1} fin", '{"b": 1}')]


@query("T16_json_repair", values(_JSON, "answer, json"))
def repair(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in _JSON], "answer string").select("answer", ts.repaired_json(F.col("answer")).alias("json"))


_LANG = [("le patient est vu dans le service", "fr"), ("the patient was seen with the team", "en"), ("", "fr")]


@query("T19_language", values(_LANG, "text, lang"))
def language(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in _LANG], "text string").select("text", ts.language(F.col("text")).alias("lang"))


_CAUSES = [
    ("sexe", "hallucination", "[NOM_0A1B2C]", None, "Jean", "pseudo_token"), ("sexe", "omission", None, "F", "une femme", "routing_omission"), ("date_chir", "alteration", "01/02/2020", "02/02/2020", "", "date_mismatch"),
    ("grade", "omission", None, "fin", "x" * 40 + " fin", "truncation"), ("grade", "omission", None, "debut", "debut " + "x" * 40, "hallucination"), ("grade", "alteration", "Élevé ", "elevé", "", "format_mismatch"),
    ("grade", "alteration", "Répété", "repete", "", "format_mismatch"), ("grade", "alteration", "3", "4", "", "format_mismatch"), ("grade", "hallucination", "4", None, "t", "hallucination"),
]


@query("A31_error_causes", values([(i, c[5]) for i, c in enumerate(_CAUSES)], "id, cause"))
def causes(spark, sf_dir):
    rows = spark.createDataFrame([(i, *c[:5], ["grade", "date_chir"]) for i, c in enumerate(_CAUSES)], "id int, feature string, error string, predicted string, gold string, text string, extractable array<string>")
    return rows.select("id", ts.error_cause(*[F.col(c) for c in ("feature", "error", "predicted", "gold", "extractable", "text")]).alias("cause"))


@query("X30_json_schema", values([("surgery", "date_chir" not in ts.json_schema("surgery")["properties"], len(ts.json_schema("surgery")["properties"]))], "grp, own, n"))
def schemas(spark, sf_dir):
    s = json.loads(json.dumps(ts.json_schema("surgery")))
    fields = sum(f["grp"] == "surgery" for f in schema.FIELDS.values())
    return spark.createDataFrame([("surgery", set(s["required"]) == {n for n, f in schema.FIELDS.items() if f["grp"] == "surgery"}, 2 * fields)], "grp string, own boolean, n int")


@query("G05_task_list", values([("p1", "rcp"), ("p1", "anapath"), ("p2", "rcp")], "patient_id, doc_type"))
def task_list(spark, sf_dir):
    return ts.tasks(spark.createDataFrame([("p1", ["rcp", "anapath"]), ("p2", ["rcp"]), ("p3", [])], "patient_id string, document_types array<string>"))


@query("P06_profile_projection", values([("p1", "grade=4")], "patient_id, fields"))
def projection(spark, sf_dir):
    rows = spark.createDataFrame([("p1", {"grade": "4", "sexe": "F", "num_labo": None})], "patient_id string, profile map<string,string>")
    return rows.select("patient_id", F.array_join(F.transform(F.map_entries(ts.relevant(F.col("profile"), schema.BIO)), lambda e: F.concat_ws("=", e.key, e.value)), "|").alias("fields"))


@query("P11_raw_document_check", values([(1, True), (2, False), (3, False)], "id, valid"))
def raw_check(spark, sf_dir):
    rows = [(1, ("x" * 120, {"grade": ("4", "grade 4")})), (2, ("court", {})), (3, ("x" * 120, {"grade": ("4", None)}))]
    made = spark.createDataFrame(rows, "id int, doc struct<document_text:string,annotations:map<string,struct<value:string,span:string>>>")
    return made.select("id", ts.raw_valid(F.col("doc")).alias("valid"))


@query("G07_format_conversion", values([("grade", "3-10"), ("ihc_idh1", "long")], "label, span"))
def conversion(spark, sf_dir):
    rows = spark.createDataFrame([([(3, 10, "grade", "4"), (0, 400, "ihc_idh1", "long")],)], "e array<struct<start:int,end:int,label:string,value:string>>")
    return rows.select(F.explode(ts.by_label(F.col("e"))).alias("label", "spans")).select("label", F.array_join("spans", "|").alias("span"))


@query("X29_year_variation", "SELECT doc_id, length(text) + 9 AS n FROM documents")
def years(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" OMS 2021")).alias("text"))
    return ts.who_years(d).select("doc_id", F.length("text").cast("long").alias("n"))


@query("S23_ablation_records", f"WITH {FACTS_SQL} SELECT DISTINCT doc_id FROM facts WHERE value IS NOT NULL")
def ablation(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("extractor", F.when(F.col("supplier") % 2 == 0, "rule").otherwise("eds"))
    return ts.ablation_records(f).filter(F.get_json_object("json", "$.rule").isNotNull() | F.get_json_object("json", "$.eds").isNotNull()).select("doc_id")
