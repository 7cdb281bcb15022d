"""Registered queries of sources, sinks, joins, set operations, similarity and privacy."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from medlark.functions import schema, similarity
from medlark.operators import privacy
from medlark.sources import database
from medlark.sources.storage import shared_dir

from .base import DOCUMENTS_SQL, FACTS_SQL, documents, facts, query, table, values
from .timeline import _NAMES, _STATE, timeline_wide

#: The documents table as a database of which every fifth row is a new batch, half of it seen before.
_DB = "db AS (SELECT doc_id AS did, (doc_id % 97)::VARCHAR AS ipp, source AS source_file, text AS document FROM documents WHERE doc_id % 5 != 0), batch AS (SELECT doc_id AS row_id, ((doc_id + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) % 97)::VARCHAR AS ipp, text AS document FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, (doc_id % 97)::VARCHAR, text FROM documents WHERE doc_id % 5 = 1)"


def _db(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    own = d.filter("doc_id % 5 != 0").select(F.col("doc_id").alias("did"), (F.col("doc_id") % 97).cast("string").alias("ipp"), F.col("source").alias("source_file"), F.col("text").alias("document"))
    shift = F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)
    new = d.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("row_id"), ((F.col("doc_id") + shift) % 97).cast("string").alias("ipp"), F.col("text").alias("document"))
    old = d.filter("doc_id % 5 = 1").select(F.col("doc_id").alias("row_id"), (F.col("doc_id") % 97).cast("string").alias("ipp"), F.col("text").alias("document"))
    return own, new.union(old)


@query("S01_empty_database", "SELECT 0::BIGINT AS n, 8::BIGINT AS columns")
def empty(spark, sf_dir):
    rows = database.create(spark)
    return rows.agg(F.count("*").alias("n")).withColumn("columns", F.lit(len(rows.columns)).cast("long"))


@query("S02_load_database", f"WITH {DOCUMENTS_SQL} SELECT doc_id AS did, patient_id AS ipp, doc_type AS document, CASE WHEN doc_date IS NULL THEN NULL ELSE '1' END AS ord FROM docs")
def load(spark, sf_dir):
    """Written as CSV with identifiers as 1.0 and read back."""
    path = shared_dir(spark) + "/db"
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("did"), F.concat("patient_id", F.lit(".0")).alias("IPP"), F.col("doc_type").alias("document"), F.when(F.col("doc_date").isNotNull(), "1.0").otherwise("x").alias("order"))
    d.write.csv(path, header=True)
    return database.load(spark, path).select("did", "ipp", "document", F.col("order").cast("string").alias("ord"))


@query("S03_save_database", "SELECT doc_id, source FROM documents")
def save(spark, sf_dir):
    path = shared_dir(spark) + "/db"
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    database.save(rows.limit(1), path)
    database.save(rows, path)
    return spark.read.parquet(path)


@query("J01_duplicate_anti_join", f"WITH {_DB} SELECT row_id, ipp FROM batch b WHERE NOT EXISTS (SELECT 1 FROM db WHERE db.ipp = b.ipp AND db.document = b.document)")
def duplicates(spark, sf_dir):
    own, new = _db(spark, sf_dir)
    return database.new_documents(new, own).select("row_id", "ipp")


_APPEND_BASE = "own AS (SELECT o_orderkey AS did, (o_custkey % 500)::VARCHAR AS ipp, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::INTEGER AS num FROM orders WHERE o_orderkey % 3 != 0), new AS (SELECT (o_custkey % 500)::VARCHAR AS ipp, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::INTEGER AS num FROM orders WHERE o_orderkey % 3 = 0)"


@query("S04_W02_append", f"""WITH {_APPEND_BASE}, al AS (SELECT ipp, num FROM own UNION ALL SELECT ipp, num FROM new),
r AS (SELECT ipp, num, rank() OVER (PARTITION BY ipp ORDER BY num) AS r, count(*) OVER (PARTITION BY ipp) AS n FROM al)
SELECT ipp, num, CASE WHEN ipp IN (SELECT ipp FROM new) AND n > 1 THEN r END::VARCHAR AS ord, (SELECT max(did) FROM own) + (SELECT count(*) FROM new) AS last_did FROM r""")
def appended(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    num = F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("consult_date_num")
    ipp = (F.col("o_custkey") % 500).cast("string").alias("ipp")
    own = database.create(spark).unionByName(o.filter("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("did"), ipp, num), allowMissingColumns=True)
    whole = database.append(own, o.filter("o_orderkey % 3 = 0").select(ipp, num))
    last = whole.agg(F.max("did").alias("last_did"))
    return whole.select("ipp", F.col("consult_date_num").alias("num"), F.col("order").cast("string").alias("ord")).crossJoin(F.broadcast(last))


@query("S05_salvage", f"WITH {DOCUMENTS_SQL} SELECT CASE WHEN doc_date IS NULL THEN 'doc_date is missing' ELSE 'committed' END AS status, count(*) AS n FROM docs GROUP BY 1")
def salvage(spark, sf_dir):
    good, bad = database.salvage(documents(spark, sf_dir), ["doc_id", "doc_date"])
    return good.select(F.lit("committed").alias("status")).union(bad.select("reason")).groupBy("status").agg(F.count("*").alias("n"))


@query("S24_audit_log", f"WITH {DOCUMENTS_SQL} SELECT doc_type AS status, count(*) AS n, md5(string_agg(doc_id, ',' ORDER BY doc_id)) AS files FROM docs GROUP BY 1")
def audit(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_type").alias("status"), F.col("doc_id").alias("source_file"))
    return database.audit(rows).select("status", "n", F.md5(F.array_join("files", ",")).alias("files"))


@query("S06_pseudo_only", "SELECT doc_id, source FROM documents")
def pseudo_only(spark, sf_dir):
    return database.pseudo_only(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"), "source"))


@query("S11_extraction_input", f"WITH {DOCUMENTS_SQL} SELECT doc_id::BIGINT AS did, doc_date AS pseudo FROM docs WHERE doc_date IS NOT NULL")
def extraction_input(spark, sf_dir):
    return database.extraction_input(documents(spark, sf_dir).select(F.col("doc_id").alias("did"), F.col("doc_date").alias("pseudo")))


_BIO = [n for n in _NAMES if n in schema.BIO]


@query("S12_P01_branches", f"WITH {_STATE} SELECT patient_id AS _patient_id, doc_id AS _document_id, doc_type AS _document_type, doc_date AS _document_date, " + ", ".join(f"max(CASE WHEN field = '{n}' THEN value END) AS {n}" for n in _BIO) + " FROM state GROUP BY ALL")
def branches(spark, sf_dir):
    return database.branches(timeline_wide(spark, sf_dir))["bio"]


@query("S13_S14_extended_rows", "SELECT doc_id, substr(text, 1, 500) AS document, 1 AS ord, NULL::VARCHAR AS grade, NULL::VARCHAR AS sexe FROM documents")
def extended(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 500).alias("document"), F.lit(1).alias("ord"))
    return database.extended(rows, ["grade", "sexe"])


_SHEET = [["nip", "1001", "1001", "1002"], ["date_chir", "03/2020", "2021", ""], ["grade", "3", "4", "2"]]
_CELLS = [(i, r[0], r[i] or None) for r in _SHEET for i in range(1, 4)]


@query("S16_transposed_sheet", values(_CELLS, "visit, field, value"))
def sheet(spark, sf_dir):
    return database.transposed(spark.createDataFrame(list(enumerate(_SHEET)), "row int, cells array<string>"))


@query("S15_gold_annotations", f"WITH {FACTS_SQL} SELECT doc_id AS document_id, field, value FROM facts WHERE value IS NOT NULL AND field != 'champ_inconnu'")
def gold(spark, sf_dir):
    """Written as JSON documents, read back as maps."""
    path = shared_dir(spark) + "/gold"
    database.gold_documents(facts(spark, sf_dir)).select("json").write.text(path)
    rows = spark.read.schema("document_id string, patient_id string, annotations map<string,string>").json(path)
    return database.gold_annotations(rows, schema.field_def(spark))


@query("S17_gold_documents", f"WITH {FACTS_SQL} SELECT doc_id, count(*) AS n FROM facts WHERE value IS NOT NULL GROUP BY doc_id")
def gold_documents(spark, sf_dir):
    rows = database.gold_documents(facts(spark, sf_dir))
    return rows.select("doc_id", F.size(F.map_keys(F.from_json(F.get_json_object("json", "$.annotations"), "map<string,string>"))).cast("long").alias("n"))


@query("S18_json_lines", "SELECT conv_id, turn, role FROM conversations")
def json_lines(spark, sf_dir):
    path = shared_dir(spark) + "/c"
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").write.json(path)
    return spark.read.schema("conv_id long, turn long, role string").json(path)


@query("S19_resume", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40)")
def resume(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return database.remaining(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("U01_append_columns", "SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS comment FROM customer UNION ALL SELECT s_suppkey, NULL, 's' FROM supplier")
def union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("comment")), allowMissingColumns=True)


@query("U02_patient_sets", "SELECT ipp, bool_or(old) AND bool_or(NOT old) AS common FROM (SELECT o_custkey AS ipp, true AS old FROM orders WHERE o_orderkey % 3 != 0 UNION ALL SELECT o_custkey, false FROM orders WHERE o_orderkey % 3 = 0) GROUP BY ipp HAVING bool_or(NOT old)")
def patient_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old, new = (o.filter(c).select(F.col("o_custkey").alias("ipp")) for c in ("o_orderkey % 3 != 0", "o_orderkey % 3 = 0"))
    return new.intersect(old).withColumn("common", F.lit(True)).union(new.distinct().exceptAll(old.distinct()).withColumn("common", F.lit(False)))


_FIELDS = ", ".join(f"'{n}'" for n in schema.FIELDS)


@query("U04_field_algebra", f"WITH {FACTS_SQL}, seen AS (SELECT DISTINCT field FROM facts), known AS (SELECT unnest([{_FIELDS}]) AS field) SELECT field, 'missing' AS kind FROM known WHERE field NOT IN (SELECT field FROM seen) UNION ALL SELECT field, 'extra' FROM seen WHERE field NOT IN (SELECT field FROM known)")
def field_algebra(spark, sf_dir):
    seen, known = facts(spark, sf_dir).select("field").distinct(), schema.field_def(spark).select("field")
    return known.join(seen, "field", "left_anti").withColumn("kind", F.lit("missing")).union(seen.join(known, "field", "left_anti").withColumn("kind", F.lit("extra")))


@query("J08_J09_positional_merge", f"""WITH {FACTS_SQL}, a AS (SELECT patient_id, value, row_number() OVER (PARTITION BY patient_id ORDER BY doc_id, seq) AS rn FROM facts WHERE field = 'grade'), b AS (SELECT patient_id, value, row_number() OVER (PARTITION BY patient_id ORDER BY doc_id, seq) AS rn FROM facts WHERE field = 'ihc_idh1')
SELECT coalesce(a.patient_id, b.patient_id) AS patient_id, coalesce(a.rn, b.rn) AS rn, coalesce(a.value, b.value) AS value, a.rn IS NOT NULL AND b.rn IS NOT NULL AS paired FROM a FULL JOIN b ON a.patient_id = b.patient_id AND a.rn = b.rn""")
def positional(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("patient_id").orderBy("doc_id", "seq")
    side = lambda f, n: facts(spark, sf_dir).filter(F.col("field") == f).select("patient_id", F.row_number().over(w).cast("long").alias("rn"), F.col("value").alias(n), F.lit(True).alias(f"in_{n}"))
    both = side("grade", "a").join(side("ihc_idh1", "b"), ["patient_id", "rn"], "full_outer")
    return both.select("patient_id", "rn", F.coalesce("a", "b").alias("value"), (F.coalesce("in_a", F.lit(False)) & F.coalesce("in_b", F.lit(False))).alias("paired"))


# --- similarity ----------------------------------------------------------------------------------------------

_RATIOS = [("abc", "abc", 100.0, 100.0), ("abcd", "abxd", 75.0, 75.0), ("glioblastome", "glioblastoma", 91.6667, 95.6522), ("gliome", "un gliome de haut grade", 41.3793, 100.0), ("", "", 100.0, 100.0), ("abc", "xyz", 0.0, 0.0)]


@query("T07_ratio", values(_RATIOS, "a, b, ratio, partial"))
def ratios(spark, sf_dir):
    rows = spark.createDataFrame([r[:2] for r in _RATIOS], "a string, b string")
    return rows.select("a", "b", F.round(similarity.ratio("a", "b"), 4).alias("ratio"), F.round(similarity.partial_ratio("a", "b"), 4).alias("partial"))


_VOCAB_SPANS = [(1, "grade", "3", "3", "exact"), (2, "ihc_idh1", "Négatif", "negatif", "form"), (3, "ihc_idh1", "positiff", "positif", "fuzzy"), (4, "grade", "haut", "haut", "other"), (5, "ihc_idh1", "zzz", "NA", "none"), (6, "sexe", "", "NA", "none"), (7, "type_chirurgie", "Exérèse complète", "exerese complete", "form")]


@query("T08_vocabulary_cascade", values(_VOCAB_SPANS, "id, field, span, value, tier"))
def cascade(spark, sf_dir):
    words = schema.field_def(spark).join(schema.vocab_value(spark), "vocabulary").select("field", "value")
    rows = spark.createDataFrame([r[:3] for r in _VOCAB_SPANS], "id int, field string, span string")
    return similarity.match_vocabulary(rows, words).select("id", "field", "span", "value", "tier")


_RESOLVED = [(1, "Foyers de nécrose", "nécrose", 10, 17, "exact"), (2, "Foyers de Nécrose", "nécrose", 10, 17, "case"), (3, "un  deux\ntrois", "un deux trois", 0, 14, "space"), (4, "le glioblastome temporal", "glioblastone", 3, 15, "fuzzy"), (5, "abc", "xyzxyz", -1, -1, "unresolved")]


@query("T11_span_resolution", values(_RESOLVED, "id, text, span, start, \"end\", method"))
def resolution(spark, sf_dir):
    rows = spark.createDataFrame([r[:3] for r in _RESOLVED], "id int, text string, span string")
    return similarity.resolve_span(rows).join(rows, "id").select("id", "text", "span", "start", "end", "method")


# --- privacy -------------------------------------------------------------------------------------------------


def _token(label: str, scope: str, text: str) -> str:
    return hashlib.sha256(f"sel|{scope}|{label}|{text}".encode()).hexdigest()[:10].upper()


_PRIVATE = [
    ("p1", "8000000001", "Madame Durand, née le 03/09/1961, tel 06 12 34 56 78, vue par le Dr Martin.", f"Madame [NOM_{_token('NOM', '8000000001', 'Durand')}], née le 1961-??-??, tel [TEL_{_token('TEL', '8000000001', '06 12 34 56 78')}], vue par le Dr Martin."),
    ("p2", None, "Ecrire à a.b@c.fr ou Monsieur Petit", f"Ecrire à [MAIL_{_token('MAIL', '', 'a.b@c.fr')}] ou Monsieur [NOM_{_token('NOM', '', 'Petit')}]"), ("p3", "1", "rien", "rien"),
]


@query("X24_pseudonyms", values([(a, d) for a, _, _, d in _PRIVATE], "doc_id, text"))
def pseudonyms(spark, sf_dir):
    return privacy.pseudonymised(spark.createDataFrame([r[:3] for r in _PRIVATE], "doc_id string, ipp string, text string"), "sel")


@query("G03_text_chunks", "SELECT doc_id, length(text) AS covered, true AS bounded FROM documents")
def chunked(spark, sf_dir):
    """Chunks cover the text to its end, and none is longer than a window."""
    rows = table(spark, sf_dir, "documents").select("doc_id", privacy.chunks(F.col("text")).alias("c"))
    last = F.element_at("c", -1)
    return rows.select("doc_id", (last["offset"] + F.length(last["chunk"])).cast("long").alias("covered"), F.forall("c", lambda x: F.length(x["chunk"]) <= 1000).alias("bounded"))
