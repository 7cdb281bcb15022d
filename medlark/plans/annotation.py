"""Registered queries of the operators on annotated documents and controlled vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlark.functions import similarity
from medlark.operators import annotation, evaluation, vocabulary, who

from .base import DOCUMENTS_SQL, FACTS_SQL, documents, expected, facts, query, seeded, table, values

_MODES = f"""{FACTS_SQL}, p AS (SELECT 'rule' AS mode, doc_id, field, lower(other_value) AS p FROM facts UNION ALL SELECT 'ml', doc_id, field, lower(other_value) FROM facts WHERE supplier % 2 = 0),
g AS (SELECT m.mode, doc_id, field, lower(value) AS g FROM facts, (VALUES ('rule'), ('ml')) m(mode)),
s AS (SELECT mode, field, count(*) FILTER (WHERE p = g) AS tp, count(p) AS np, count(g) AS ng FROM g LEFT JOIN p USING (mode, doc_id, field) GROUP BY ALL HAVING count(p) + count(g) > 0)"""


@query("A08_macro_by_mode", f"WITH {_MODES} SELECT mode, count(*) AS fields, round(avg(2 * tp / (np + ng)), 6) AS exact, round(avg(2 * tp / (np + ng)), 6) AS relaxed FROM s GROUP BY mode")
def macro_by_mode(spark, sf_dir):
    f = facts(spark, sf_dir)
    p = f.select(F.lit("rule").alias("mode"), "doc_id", "field", F.col("other_value").alias("value"))
    return evaluation.macro_by_mode(f.select("doc_id", "field", "value"), p.unionByName(f.filter("supplier % 2 = 0").select(F.lit("ml").alias("mode"), "doc_id", "field", F.col("other_value").alias("value"))))


@query("U03_column_guard", values([("o_custkey", False, True), ("patient_id", True, False)], "name, in_a, in_b"))
def column_guard(spark, sf_dir):
    d = documents(spark, sf_dir)
    found = annotation.column_differences(d, d.withColumnRenamed("patient_id", "o_custkey"))
    return spark.createDataFrame(found, "name string, in_a boolean, in_b boolean")



@query("J10_profile_agreement", f"""WITH {FACTS_SQL}, prof AS (SELECT patient_id, field, min(value) AS p FROM facts WHERE value IS NOT NULL GROUP BY ALL), ids AS (SELECT DISTINCT doc_id, patient_id FROM facts)
SELECT ids.doc_id, count(p.p) AS checked, count(*) FILTER (WHERE lower(f.value) = lower(p.p)) AS agreed FROM ids LEFT JOIN (SELECT * FROM facts WHERE value IS NOT NULL AND field != 'date_chir') f USING (doc_id) LEFT JOIN prof p ON p.patient_id = ids.patient_id AND p.field = f.field GROUP BY ids.doc_id""")
def profile_agreement(spark, sf_dir):
    f = facts(spark, sf_dir)
    profiles = f.filter("value is not null").groupBy("patient_id", "field").agg(F.min("value").alias("value"))
    return annotation.profile_agreement(profiles, f.filter("field != 'date_chir'").select("doc_id", "field", "value"), f.select("doc_id", "patient_id").distinct())


@query("X31_quality_filters", """WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, doc_id % 5 AS total, doc_id % 3 AS lost FROM documents)
SELECT doc_id, CASE WHEN total = 0 THEN 'reject' WHEN (total - least(lost, total)) / total < 0.7 THEN 'reject' WHEN (total - least(lost, total)) / total < 0.9 THEN 'review' ELSE 'pass' END AS resolution,
  CASE WHEN n < 200 OR n > 6000 THEN 'review' ELSE 'pass' END AS length FROM d""")
def quality_filters(spark, sf_dir):
    total = F.col("doc_id") % 5
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", annotation.resolution_filter(total, F.least(F.col("doc_id") % 3, total)).alias("resolution"), annotation.length_filter(F.col("text")).alias("length"))


@query("G04_token_chunks", r"""WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents)
SELECT doc_id, unnest(range(0, CASE WHEN n <= 180 THEN 1 ELSE ceil((n - 20) / 160)::BIGINT END))::INTEGER AS chunk FROM d""")
def token_chunks(spark, sf_dir):
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return annotation.token_chunks(table(spark, sf_dir, "documents").select("doc_id", "text", none.alias("entities")), 180, 20).select("doc_id", "chunk")


@query("T13_U05_augmented", """WITH d AS (SELECT doc_id, left(coalesce(text, ''), 12) AS head FROM documents) SELECT 'original' AS cohort, doc_id, head FROM d UNION ALL SELECT 'augmented', doc_id, head FROM d""")
def augmented(spark, sf_dir):
    """Originals with their augmented copies; an entity at the start of each text comes back whole."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    end = F.least(F.length("text"), F.lit(12))
    more = annotation.augmented(d.withColumn("entities", F.array(F.struct(F.lit(0).alias("start"), end.alias("end"), F.lit("x").alias("label")))))
    annotation.same_columns(d, more.drop("entities"))
    e = F.col("entities")[0]
    head = F.substring("text", e["start"] + 1, e["end"] - e["start"]).alias("head")
    return d.select(F.lit("original").alias("cohort"), "doc_id", F.substring("text", F.lit(1), end).alias("head")).unionByName(more.select(F.lit("augmented").alias("cohort"), "doc_id", head))


_REPAIRS = [
    (1, "grade", "4", "grade 4", "grade", "grade 4", "kept"), (2, "ihc_idh", "positif", "IDH1 positif", "ihc_idh1", "IDH1 positif", "renamed"), (3, "zzzzzzzz", "x", "grade 4", None, None, None),
    (4, "grade", "3", "absent du texte", None, None, None), (5, "sexe", "patiente", "grade 4", "sexe", "Patiente", "repaired"), (6, "sexe", "homme", "grade 4", None, None, None),
]


@query("T12_annotation_repair", values([(r[0], r[4], r[5], r[6]) for r in _REPAIRS if r[6]], "doc_id, field, span, status"))
def annotation_repair(spark, sf_dir):
    from medlark.functions import schema

    rows = spark.createDataFrame([(r[0], "Patiente, grade 4, IDH1 positif", *r[1:4]) for r in _REPAIRS], "doc_id int, text string, field string, value string, span string")
    return annotation.repaired(rows, sorted(schema.FIELDS)).select("doc_id", "field", "span", "status")


@query("X25_ordered_encryption", "SELECT o_orderkey AS id, true AS ordered FROM orders")
def ordered_encryption(spark, sf_dir):
    """Every order's day since 1990 under the key, and whether the cipher keeps its place among all days."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.pmod(F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")), F.lit(3000)).alias("day"))
    coded = o.withColumn("cipher", annotation.ordered_cipher(F.col("day"), "k"))
    days = coded.select("day", "cipher").distinct()  # at most 3000
    placed = days.withColumn("ordered", F.rank().over(Window.orderBy("day")) == F.rank().over(Window.orderBy("cipher")))
    return coded.join(placed.select("day", "ordered"), "day").select("id", "ordered")


@query("A23_profile_summary", f"""WITH {DOCUMENTS_SQL}, p AS (SELECT c_custkey::VARCHAR AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, c_acctbal < 0 AS deceased FROM customer)
SELECT 'sex' AS measure, sex AS value, count(*) AS n FROM p GROUP BY sex UNION ALL SELECT 'deceased', CASE WHEN deceased THEN 'true' ELSE 'false' END, count(*) FROM p GROUP BY deceased
UNION ALL SELECT 'duplicates', 'patients', count(*) FROM (SELECT patient_id FROM p GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'doc_type', doc_type, count(*) FROM docs GROUP BY doc_type""")
def profile_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    p = c.select(F.col("c_custkey").cast("string").alias("patient_id"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("sex"), (F.col("c_acctbal") < 0).alias("deceased"))
    return annotation.profile_summary(p, documents(spark, sf_dir))



@query("A15_who_counts", f"SELECT CASE c_custkey % 3 WHEN 0 THEN 'gbm' WHEN 1 THEN 'oligo' ELSE 'astro' END AS family, CASE WHEN c_custkey % 2 = 0 THEN 'mute' ELSE 'wt' END AS idh, count(*) AS n FROM customer GROUP BY ALL")
def who_counts(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Glioblastome", "Oligodendrogliome", "Astrocytome")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    profile = F.create_map(F.lit("diag_integre"), kind, F.lit("mol_idh1"), F.when(F.col("c_custkey") % 2 == 0, "mute").otherwise("wt"))
    return who.counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), profile.alias("profile")))


_WORDS = [("prise de temozolomide hier", "temozolomid", True), ("prise de keppra", "temozolomid", False), ("abc", "abc", False), (None, "abcd", False)]


@query("T06_fuzzy_word", values([(i, w[2]) for i, w in enumerate(_WORDS)], "id, found"))
def fuzzy_word(spark, sf_dir):
    rows = spark.createDataFrame([(i, *w[:2]) for i, w in enumerate(_WORDS)], "id int, text string, word string")
    return rows.select("id", similarity.fuzzy_word(F.col("text"), F.col("word")).alias("found"))


@query("X17_controlled_vocabulary", expected({0: {"ihc_idh1": "positif", "ihc_atrx": "maintenu"}, 3: {"ch10q": "perte", "mol_mgmt": "methyle", "mol_idh2": "wt"}}, "field, value"))
def controlled(spark, sf_dir):
    """Scored over all documents; the fields that a reader is sure of in the sample reports."""
    wanted = {f: vocabulary.FIELDS[f] for f in ("ihc_idh1", "ihc_atrx", "ch10q", "mol_mgmt", "mol_idh2")}
    sure = {0: ("ihc_idh1", "ihc_atrx"), 3: ("ch10q", "mol_mgmt", "mol_idh2")}
    keep = F.lit(False)
    for report, fields in sure.items():
        keep = keep | ((F.pmod("doc_id", F.lit(8)) == report) & F.col("field").isin(*fields))
    return vocabulary.controlled(seeded(spark, sf_dir), wanted).filter(keep).select("doc_id", "field", "value")
