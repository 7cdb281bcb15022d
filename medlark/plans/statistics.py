"""Registered queries of corpus statistics, splits, quality filters and coherence rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlark.functions import schema, text
from medlark.operators import corpus, timeline, who

from .base import DOCUMENTS_SQL, FACTS_SQL, documents, facts, query, table, values


def _entities(spark, sf_dir):
    return facts(spark, sf_dir).filter("value is not null").select("doc_id", F.col("field").alias("label"), "value")


_ENTITIES = f"{FACTS_SQL}, entities AS (SELECT doc_id, field AS label, value FROM facts WHERE value IS NOT NULL)"


@query("A10_summary", "SELECT lang, count(*) AS n, min(n_chars)::DOUBLE AS least, max(n_chars)::DOUBLE AS most, round(avg(n_chars), 1) AS mean, round(median(n_chars), 1) AS median, round(stddev_samp(n_chars), 1) AS deviation FROM documents GROUP BY lang")
def summary(spark, sf_dir):
    return corpus.summary(table(spark, sf_dir, "documents"), "n_chars", ["lang"])


@query("A11_documents_per_patient", f"WITH {DOCUMENTS_SQL} SELECT doc_type, count(*) AS documents, count(DISTINCT patient_id) AS patients FROM docs GROUP BY doc_type")
def per_patient(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("doc_type").agg(F.count("*").alias("documents"), F.countDistinct("patient_id").alias("patients"))


@query("A12_field_frequency", f"WITH {_ENTITIES} SELECT label, count(DISTINCT doc_id) AS documents, count(*)::BIGINT AS total FROM entities GROUP BY label")
def frequency(spark, sf_dir):
    return corpus.frequency(_entities(spark, sf_dir))


@query("A13_top_values", f"WITH {_ENTITIES}, c AS (SELECT label, value, count(*) AS n FROM entities GROUP BY ALL) SELECT label, value, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, value)::INTEGER AS place FROM c QUALIFY place <= 3")
def top_values(spark, sf_dir):
    return corpus.top_values(_entities(spark, sf_dir), 3)


@query("A14_span_validity", "WITH s AS (SELECT text, doc_id % 40 - 2 AS a, doc_id % 40 + doc_id % 7 AS b FROM documents) SELECT CASE WHEN a < 0 OR b <= a THEN 'bad' WHEN b > length(text) THEN 'outside' WHEN trim(substr(text, a + 1, b - a)) = '' THEN 'empty' ELSE 'ok' END AS state, count(*) AS n FROM s GROUP BY 1")
def spans(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("text", (F.col("doc_id") % 40 - 2).cast("int").alias("a"), (F.col("doc_id") % 40 + F.col("doc_id") % 7).cast("int").alias("b"))
    return rows.groupBy(corpus.span_state(F.col("text"), F.col("a"), F.col("b")).alias("state")).agg(F.count("*").alias("n"))


@query("A16_cohort_comparison", f"WITH {_ENTITIES}, c AS (SELECT *, CASE WHEN split_part(doc_id, '.', 1)::BIGINT % 3 = 0 THEN 'augmented' ELSE 'original' END AS cohort FROM entities) SELECT coalesce(cohort, 'extended') AS cohort, count(*) AS entities, count(DISTINCT doc_id) AS documents FROM c GROUP BY ROLLUP (cohort)")
def cohorts(spark, sf_dir):
    rows = _entities(spark, sf_dir).withColumn("cohort", F.when(F.substring_index("doc_id", ".", 1).cast("long") % 3 == 0, "augmented").otherwise("original"))
    return rows.rollup("cohort").agg(F.count("*").alias("entities"), F.countDistinct("doc_id").alias("documents")).withColumn("cohort", F.coalesce("cohort", F.lit("extended")))


@query("A17_J16_patient_split")
def split(spark, sf_dir):
    return corpus.split(documents(spark, sf_dir))


@query("A18_resampling")
def resample(spark, sf_dir):
    return corpus.resampled(_entities(spark, sf_dir), 150)


@query("A19_resolution_gate", f"WITH {_ENTITIES}, m AS (SELECT CASE WHEN value = 'NO' THEN 'fuzzy' WHEN value = 'NF' THEN 'unresolved' ELSE 'exact' END AS method FROM entities) SELECT method, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, sum(CASE WHEN method != 'unresolved' THEN count(*) ELSE 0 END) OVER () / sum(count(*)) OVER () >= 0.9 AS accepted FROM m GROUP BY method")
def gate(spark, sf_dir):
    rows = _entities(spark, sf_dir).select(F.when(F.col("value") == "NO", "fuzzy").when(F.col("value") == "NF", "unresolved").otherwise("exact").alias("method"))
    return corpus.gate(rows)


@query("A20_A29_reason_counts", f"WITH {_ENTITIES} SELECT doc_id, count(*) AS flags, count(*) FILTER (WHERE value = 'NO') AS no_flags FROM entities GROUP BY doc_id")
def reasons(spark, sf_dir):
    return _entities(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("flags"), F.count_if(F.col("value") == "NO").alias("no_flags"))


_TARGETS = {"rcp": 45.0, "anapath": 20.0, "consultation": 20.0, "radiology": 15.0}


@query("A21_proportions", f"WITH {DOCUMENTS_SQL}, t AS ({values(list(_TARGETS.items()), 'doc_type, target')}) SELECT doc_type, round(100 * n / (SELECT count(*) FROM docs), 3) AS share, target::DOUBLE AS target, abs(100 * n / (SELECT count(*) FROM docs) - target) > 10 AS flagged FROM t JOIN (SELECT doc_type, count(*)::DOUBLE AS n FROM docs GROUP BY 1) USING (doc_type)")
def proportions(spark, sf_dir):
    return corpus.proportions(documents(spark, sf_dir), "doc_type", _TARGETS)


@query("A22_field_coverage", f"WITH {FACTS_SQL}, known AS (SELECT unnest([{', '.join(repr(n) for n in schema.FIELDS)}]) AS field), seen AS (SELECT field, count(DISTINCT patient_id) AS patients FROM facts WHERE value IS NOT NULL GROUP BY field) SELECT coalesce(known.field, seen.field) AS field, coalesce(patients, 0) AS patients, known.field IS NOT NULL AS known FROM known FULL JOIN seen ON known.field = seen.field")
def coverage(spark, sf_dir):
    return corpus.coverage(facts(spark, sf_dir), schema.field_def(spark))


def _results(spark, sf_dir):
    """A tidy results table out of the suppliers of parts."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.concat(F.lit("g"), (F.col("l_partkey") % 10).cast("string")).alias("grp"), F.when(F.col("l_suppkey") % 2 == 0, "eds").otherwise("gliner").alias("method"), F.concat(F.lit("l"), (F.col("l_partkey") % 50).cast("string")).alias("label")).agg(
        F.round(F.avg("l_discount") * 10, 4).alias("precision"), F.round(F.avg("l_tax") * 10, 4).alias("recall"), F.round(F.avg(F.col("l_quantity")) / 50, 4).alias("f1")
    )


_RESULTS = "results AS (SELECT 'g' || (l_partkey % 10) AS grp, CASE WHEN l_suppkey % 2 = 0 THEN 'eds' ELSE 'gliner' END AS method, 'l' || (l_partkey % 50) AS label, round(avg(l_discount) * 10, 4) AS precision, round(avg(l_tax) * 10, 4) AS recall, round(avg(l_quantity) / 50, 4) AS f1 FROM lineitem GROUP BY ALL)"


@query("A24_pass_counts", f"WITH {_RESULTS} SELECT grp, method, count(*) FILTER (WHERE f1 >= 0.5) AS good, count(*) FILTER (WHERE f1 < 0.5) AS poor, round(avg((f1 >= 0.5)::INTEGER), 6) AS share FROM results GROUP BY ALL")
def passes(spark, sf_dir):
    return corpus.passes(_results(spark, sf_dir), 0.5)


@query("A25_pivot", f"WITH {_RESULTS} SELECT grp, round(avg(f1) FILTER (WHERE method = 'eds'), 6) AS eds, round(avg(f1) FILTER (WHERE method = 'gliner'), 6) AS gliner FROM results GROUP BY grp")
def pivot(spark, sf_dir):
    return corpus.pivot_scores(_results(spark, sf_dir))


@query("A26_melt", f"WITH {_RESULTS} SELECT grp, method, label, 'precision' AS metric, precision AS value FROM results UNION ALL SELECT grp, method, label, 'recall', recall FROM results UNION ALL SELECT grp, method, label, 'f1', f1 FROM results")
def melt(spark, sf_dir):
    return corpus.melted(_results(spark, sf_dir))


@query("J11_J12_best_method", f"WITH {_RESULTS} SELECT grp, label, max(f1) AS f1, round(max(f1) FILTER (WHERE method = 'eds') - max(f1) FILTER (WHERE method = 'gliner'), 6) AS gap FROM results GROUP BY ALL")
def best_method(spark, sf_dir):
    r = _results(spark, sf_dir)
    return corpus.best_of(r.filter("method = 'eds'"), r.filter("method = 'gliner'"))


@query("W18_label_order", f"WITH {_RESULTS} SELECT label, row_number() OVER (ORDER BY avg(f1) DESC, label)::INTEGER AS place FROM results GROUP BY label")
def label_order(spark, sf_dir):
    from pyspark.sql import Window

    means = _results(spark, sf_dir).groupBy("label").agg(F.avg("f1").alias("m"))  # one row a label
    return means.select("label", F.row_number().over(Window.orderBy(F.desc("m"), "label")).alias("place"))


@query("A27_merged_annotations", f"WITH {FACTS_SQL} SELECT patient_id, field, arg_max(value, (doc_id, seq)) AS value FROM facts WHERE value IS NOT NULL GROUP BY ALL")
def merged(spark, sf_dir):
    return corpus.merged_annotations(facts(spark, sf_dir))


@query("A28_patient_text", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def patient_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")).alias("digest"))


@query("A30_entity_sets", f"WITH {_ENTITIES} SELECT doc_id, label, string_agg(DISTINCT value, '|' ORDER BY value) AS entity_set FROM entities GROUP BY ALL")
def entity_sets(spark, sf_dir):
    return _entities(spark, sf_dir).groupBy("doc_id", "label").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("entity_set"))


@query("A32_earliest_year", "SELECT o_custkey AS patient_id, o_orderkey AS doc_id, (min(year(o_orderdate)) OVER w)::INTEGER AS year, min(year(o_orderdate)) OVER w != max(year(o_orderdate)) OVER w AS conflict FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def earliest_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return corpus.earliest_year(o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year")))


@query("A07_examples", f"WITH {FACTS_SQL} SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY min(doc_id), value)::INTEGER AS place FROM facts WHERE value IS NOT NULL GROUP BY field, value QUALIFY place <= 5")
def examples(spark, sf_dir):
    from pyspark.sql import Window

    rows = facts(spark, sf_dir).filter("value is not null").groupBy("field", "value").agg(F.min("doc_id").alias("d"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy("d", "value"))).filter("place <= 5").select("field", "value", "place")


_LISTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("T17_language_quality", f"""WITH w AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS w FROM documents)
SELECT doc_id, CASE WHEN {' OR '.join(f"contains(t, '{x}')" for x in corpus.LEAKS)} OR len(list_intersect(w, {_LISTED(corpus._MEDICAL)})) < 5
  OR len(list_filter(w, lambda x: list_contains({_LISTED(corpus._ENGLISH)}, x))) / greatest(len(w), 1) > 0.1 THEN 'reject' ELSE 'pass' END AS verdict FROM w""")
def quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.language_quality(F.col("text")).alias("verdict"))


_PROFILES = [
    ("w1", {"diag_integre": "Glioblastome IDH mute", "mol_idh1": "mute", "grade": "3", "classification_oms": "2021"}, "gbm", "mute", "glioblastome: IDH mute|glioblastome: grade", "classification_oms=2021|diag_integre=Glioblastome IDH mute|grade=4|mol_idh1=mute"),
    ("w2", {"diag_integre": "Oligodendrogliome", "mol_idh1": "non muté", "ch1p19q_codel": "non"}, "oligo", "wt", "oligodendrogliome: IDH sauvage|oligodendrogliome: sans codeletion", "ch1p19q_codel=oui|diag_integre=Oligodendrogliome|mol_idh1=non muté"),
    ("w3", {"diag_histologique": "Astrocytome", "ihc_idh1": "positif", "ch1p19q_codel": "oui"}, "astro", "mute", "astrocytome: codeletion", "ch1p19q_codel=non|diag_histologique=Astrocytome|ihc_idh1=positif"),
    ("w4", {"diag_integre": "Glioblastome", "mol_idh1": "wt", "grade": "4"}, "gbm", "wt", "", "diag_integre=Glioblastome|grade=4|mol_idh1=wt"), ("w5", {"grade": "2"}, "other", "unknown", "", "grade=2"),
]


def _profiles(spark):
    return spark.createDataFrame([p[:2] for p in _PROFILES], "id string, profile map<string,string>")


@query("X26_coherence_predicates", values([(p[0], p[2], p[3]) for p in _PROFILES], "id, family, idh"))
def predicates(spark, sf_dir):
    return _profiles(spark).select("id", who.family(F.col("profile")).alias("family"), who.idh(F.col("profile")).alias("idh"))


@query("X27_coherence_messages", values([(p[0], p[4]) for p in _PROFILES], "id, messages"))
def messages(spark, sf_dir):
    return _profiles(spark).select("id", F.array_join(who.messages(F.col("profile")), "|").alias("messages"))


@query("X28_corrections", values([(p[0], p[5]) for p in _PROFILES], "id, profile"))
def corrections(spark, sf_dir):
    return _profiles(spark).select("id", F.array_join(F.array_sort(F.transform(F.map_entries(who.corrected(F.col("profile"))), lambda e: F.concat_ws("=", e.key, e.value))), "|").alias("profile"))


_DATED = [("d1", {"date_chir": "01/02/2020", "date_deces": "01/01/2020"}, "date_chir after date_deces"), ("d2", {"date_chir": "hier"}, "date_chir unreadable"), ("d3", {"date_chir": "01/02/2020", "date_deces": "01/03/2020"}, "")]


@query("D10_profile_dates", values([(d[0], d[2]) for d in _DATED], "id, messages"))
def profile_dates(spark, sf_dir):
    return spark.createDataFrame([d[:2] for d in _DATED], "id string, profile map<string,string>").select("id", F.array_join(corpus.coherent_dates(F.col("profile")), "|").alias("messages"))


@query("P02_P04_routing", f"WITH t AS ({values([(n, f['grp']) for n, f in schema.FIELDS.items()], 'field, grp')}) SELECT grp, string_agg(field, ',' ORDER BY field) AS fields FROM t GROUP BY grp")
def routing(spark, sf_dir):
    return schema.field_def(spark).groupBy("grp").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


@query("P03_date_fields", f"WITH t AS ({values([(n, f['type']) for n, f in schema.FIELDS.items()], 'field, type')}) SELECT field, type = 'date' AS is_date FROM t")
def date_fields(spark, sf_dir):
    return schema.field_def(spark).select("field", (F.col("type") == "date").alias("is_date"))


@query("P05_G06_group_filter", f"WITH {_ENTITIES} SELECT doc_id, count(*) AS n FROM entities WHERE label IN ('grade', 'ihc_idh1') GROUP BY doc_id")
def group_filter(spark, sf_dir):
    nested = _entities(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("label", "value")).alias("entities"))
    kept = nested.withColumn("entities", F.filter("entities", lambda e: e["label"].isin("grade", "ihc_idh1"))).filter(F.size("entities") > 0)
    return kept.select("doc_id", F.explode("entities").alias("e")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("J14_date_candidates", f"WITH {FACTS_SQL}, d AS (SELECT doc_id, value FROM facts WHERE field = 'date_chir' AND value IS NOT NULL) SELECT d.doc_id, d.value AS date, f.field FROM d, (SELECT unnest(['date_chir', 'dn_date', 'date_rcp']) AS field) f")
def date_candidates(spark, sf_dir):
    """Every date of a document against each requested field: an explode, bounded by the document."""
    d = facts(spark, sf_dir).filter("field = 'date_chir' and value is not null")
    return d.select("doc_id", F.col("value").alias("date"), F.explode(F.array(*[F.lit(f) for f in ("date_chir", "dn_date", "date_rcp")])).alias("field"))
