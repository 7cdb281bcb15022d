"""Cases beyond the registered queries."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from medlark.functions import schema, similarity, text
from medlark.operators import classify, corpus, extract, timeline
from medlark.sources import database, pdf


def test_entry_imports_without_optional_parts(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert entry.entry(spark).columns[:4] == schema.METADATA


def test_field_dimension():
    assert len(schema.BIO) == len(schema.CLINICAL) == 55


def test_folds_equal_a_sequential_reading(spark):
    random.seed(3)
    types = [*schema.PRIORITY["bio"], "other"]
    rows, want = [], {}
    fields = {"tumeur_lateralite": "static", "ihc_idh1": "specimen", "ik_clinique": "varying"}
    for p in range(25):
        state, best = {}, {}
        for d in range(8):
            kind = random.choice(types)
            values = {f: (f"{p}.{d}.{f}" if random.random() < 0.5 else None) for f in fields} | {"date_chir": f"0{d + 1}/01/2020" if random.random() < 0.3 else None}
            if values["date_chir"]:
                state.pop("ihc_idh1", None)
                best.pop("ihc_idh1", None)
            for f, c in fields.items():
                order = schema.PRIORITY["bio" if f in schema.BIO else "clinical"]
                rank = order.index(kind) if kind in order else 5
                if values[f] is not None and (f not in best or (rank <= best[f] if c == "varying" else rank < best[f])):
                    state[f], best[f] = values[f], rank
                want[f"{p}.{d}", f] = state.get(f)
            rows += [(f"p{p}", f"{p}.{d}", kind, f"0{d + 1}/01/2020", f, v) for f, v in values.items()]
    facts = spark.createDataFrame(rows, "patient_id string, doc_id string, doc_type string, doc_date string, field string, value string")
    got = timeline.fold(facts, schema.field_def(spark), schema.priority(spark)).filter("field != 'date_chir'").collect()
    assert {(r.doc_id, r.field): r.value for r in got} == want


@pytest.mark.parametrize("a,b", [("kitten", "sitting"), ("", "x"), ("aaa", "aa"), ("abcabc", "cba")])
def test_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert similarity.common(a, b) == t[-1][-1]


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert extract.extract(docs, ["ihc", "chimios"]).count() == 0
    assert classify.sections(docs).count() == 0
    assert classify.classify(docs).count() == 0
    assert corpus.summary(docs.withColumn("n", F.lit(1)), "n").first().n == 0


def test_appended_ids_are_gapless(spark):
    own = database.create(spark).unionByName(spark.range(5).select(F.col("id").alias("did"), F.lit("1").alias("ipp")), allowMissingColumns=True)
    batch = spark.range(0, 40, 1, 4).select(F.lit("2").alias("ipp"), F.col("id").cast("int").alias("consult_date_num"))
    assert sorted(r.did for r in database.append(own, batch).select("did").collect()) == list(range(45))


def test_pdf_readers_fall_back(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    files = pdf.listing(spark, str(tmp_path))
    got = pdf.texts(files, [lambda b: " ", lambda b: b.decode().upper()]).collect()
    assert [r.text for r in got] == ["ONE"]
    pages = spark.createDataFrame([("a", 10, 0.9), ("a", 10, 0.8), ("a", 500, 0.1), ("b", 900, 0.9)], "path string, characters int, image_share double")
    assert {r.path: r.scanned for r in pdf.scanned(pages).collect()} == {"a": True, "b": False}


def test_rules_run_by_section(spark):
    docs = spark.createDataFrame([("d", "Immunohistochimie\nATRX : positif\nIDH1 : négatif\n\nConclusion\nATRX perdu, grade IV. OMS 2021.")], "doc_id string, text string")
    got = {r.field: (r.section, r.value) for r in extract.run_rules(docs, classify.sections(docs)).collect()}
    assert got["ihc_idh1"] == ("ihc", "negatif")
    assert got["grade"] == ("conclusion", "4")
    assert got["classification_oms"] == ("conclusion", "2021")


def test_text_functions_take_null(spark):
    row = spark.sql("select cast(null as string) as t").select(text.match_form(F.col("t")).alias("a"), text.consultation_date(F.col("t")).alias("b"), text.span_verified(F.col("t"), F.lit("x")).alias("c")).first()
    assert row.a is None and row.b is None
