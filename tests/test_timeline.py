"""Timelines: what they shuffle, and wide rows against long ones."""

import random

import pytest
from pyspark.sql import functions as F

import medlark.plans.registry as registry
from medlark.functions import schema
from medlark.operators import timeline
from medlark.plans import base


@pytest.mark.parametrize("name", ["timeline", "S12_P01_branches", "W08_temporal_dispatch", "W05_specimen_fold", "W04_static_fold", "W06_varying_fold", "J13_dense_grid", "W07_source_priority", "W03_chronological"])
def test_one_shuffle_on_the_order_and_one_on_the_patient(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = registry.QUERIES[f"op_{name}"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = [line.split("Exchange hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sorted(k.split("#")[0] for k in keys) == ["_own_order", "l_orderkey", "patient_id"]


def test_wide_rows_are_the_long_ones_pivoted(spark):
    random.seed(5)
    names = ["tumeur_lateralite", "ihc_idh1", "grade", "ik_clinique", "date_chir", "champ_inconnu"]
    rows = []
    for p in range(30):
        for d in range(random.randint(1, 9)):
            doc = (f"p{p}", f"{p}.{d}", random.choice([*schema.PRIORITY["bio"], "other"]), random.choice([None, "en 2020", f"0{random.randint(1, 9)}/01/2020"]))
            rows += [(*doc, f, random.choice([None, f"{d}{f}"])) for f in random.sample(names, random.randint(1, 4))]
    facts = spark.createDataFrame(rows, "patient_id string, doc_id string, doc_type string, doc_date string, field string, value string")
    long = timeline.fold(facts, schema.field_def(spark), schema.priority(spark)).groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])
    wide = timeline.wide(facts, names).withColumnRenamed("_document_id", "doc_id")
    assert wide.columns[4:] == sorted(names)
    assert sorted(map(repr, wide.select(long.columns).collect())) == sorted(map(repr, long.collect()))


def test_grid_of_odd_facts(spark):
    rows = [("p", "a", "rcp", None, "grade", "1"), ("p", "b", "rcp", None, None, "x"), ("p", None, "rcp", None, "grade", "2"), (None, "c", "rcp", None, "grade", "3"), ("q", "d", None, None, "sexe", None)]
    facts = spark.createDataFrame(rows, "patient_id string, doc_id string, doc_type string, doc_date string, field string, value string")
    got = {(r.patient_id, r.doc_id, r.field, r.value) for r in timeline.grid(facts).collect()}
    assert got == {("p", d, f, "1" if (d, f) == ("a", "grade") else None) for d in ("a", "b", None) for f in ("grade", None)} | {("q", "d", "sexe", None)}


def test_every_line_keeps_its_order(spark, sf_dir):
    assert base.facts(spark, sf_dir).count() == base.table(spark, sf_dir, "lineitem").count()
