"""Patient timelines: the dense document-by-field grid, three carry-forward folds over it, and event splitting.

Facts are long rows (patient_id, doc_id, doc_type, doc_date, field, value); a document belongs to one patient. One
shuffle on the patient serves the grid, the folds and the wide rows, which are windows within a patient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from medlark.functions import schema

DOC = ["patient_id", "doc_id", "doc_type", "doc_date"]


def sort_date(c: Column) -> Column:
    """Date of a day-first or year-first text; null if neither."""
    return F.coalesce(*[F.try_to_date(c, form) for form in ("d/M/yyyy", "yyyy/M/d", "yyyy-M-d")])


def chronological(docs: DataFrame) -> DataFrame:
    """One row a document with seq, its place in the patient's history; undated documents come last."""
    rows = docs.select(*DOC).repartition("patient_id").distinct().withColumn("_date", sort_date(F.col("doc_date")))
    return rows.withColumn("seq", F.row_number().over(_history())).drop("_date")


def _history() -> WindowSpec:
    return Window.partitionBy("patient_id").orderBy(F.col("_date").asc_nulls_last(), "doc_id")


def _histories(rows: DataFrame, *own: Column) -> DataFrame:
    """facts, laid by patient -> one row a document: DOC columns, the aggregates asked for, _date, seq and epoch, the
    number of surgeries up to and including the document."""
    cut = F.max(F.when((F.col("field") == schema.AXES["surgery"]) & F.col("value").isNotNull() & F.col("doc_id").isNotNull(), 1).otherwise(0))
    docs = rows.groupBy(*DOC).agg(cut.alias("_cut"), *own).withColumn("_date", sort_date(F.col("doc_date")))
    so_far = _history().rowsBetween(Window.unboundedPreceding, 0)
    return docs.select("*", F.row_number().over(_history()).alias("seq"), F.sum("_cut").over(so_far).alias("epoch")).drop("_cut")


def _by_patient(facts: DataFrame) -> DataFrame:
    """Facts of known patients, shuffled once: all that follows is local to a patient."""
    return facts.filter(F.col("patient_id").isNotNull()).select(*DOC, "field", "value").repartition("patient_id")


def grid(facts: DataFrame) -> DataFrame:
    """Every document of a patient crossed with every field the patient has, with seq and epoch; value null where
    unmentioned. A document's facts and the patient's other fields are laid side by side: nothing is joined."""
    every, none = Window.partitionBy("patient_id"), F.array().cast("array<string>")
    unnamed = F.when(F.max(F.col("field").isNull()).over(every), F.array(F.lit(None).cast("string"))).otherwise(none)
    rows = _by_patient(facts).withColumn("_fields", F.concat(F.collect_set("field").over(every), unnamed))
    told = F.when(F.col("field").isNotNull() & F.col("doc_id").isNotNull(), F.struct("field", "value"))
    docs = _histories(rows, F.collect_list(told).alias("_facts"), F.first("_fields").alias("_fields"))
    others = F.transform(F.array_except("_fields", F.col("_facts")["field"]), lambda f: F.struct(f.alias("field"), F.lit(None).cast("string").alias("value")))
    return docs.select(*DOC, "seq", "epoch", F.explode(F.concat("_facts", others)).alias("_")).select(*DOC, "seq", "epoch", "_.field", "_.value")


def ranked(cells: DataFrame, field_def: DataFrame, priority: DataFrame) -> DataFrame:
    """Adds temporal (varying by default) and rank, the trust in the document's type for the field's branch."""
    known = cells.join(F.broadcast(field_def.select("field", "branch", "temporal")), "field", "left")
    known = known.withColumn("branch", F.coalesce("branch", F.lit("clinical"))).withColumn("temporal", F.coalesce("temporal", F.lit("varying")))
    return known.join(F.broadcast(priority), ["branch", "doc_type"], "left").withColumn("rank", F.coalesce("rank", F.lit(len(schema.PRIORITY["bio"]))))


def _state(temporal: Column, value: Column, rank: Column, w: WindowSpec) -> Column:
    """The value that holds after each document. static: the first of the best rank so far, replaced only by a strictly
    more trusted source. specimen: the same, begun anew at each surgery. varying: the latest of the best rank so far,
    replaced by any source as trusted. One running minimum over one order serves all three."""
    since = F.when(temporal == "specimen", -F.col("epoch")).otherwise(F.lit(0).cast("long"))
    place = F.when(temporal.isin("static", "specimen"), F.col("seq")).otherwise(-F.col("seq"))
    best = F.min_by(F.struct(value.alias("value"), "epoch"), F.when(value.isNotNull(), F.struct(since, rank, place))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when((temporal != "specimen") | (best["epoch"] == F.col("epoch")), best["value"])


def _cell_state(temporal: Column) -> Column:
    return _state(temporal, F.col("value"), F.col("rank"), Window.partitionBy("patient_id", "field").orderBy("seq"))


def static_fold() -> Column:
    """First value of the best rank so far: replaced only by a strictly more trusted source."""
    return _cell_state(F.lit("static"))


def specimen_fold() -> Column:
    """static_fold begun anew at each surgery."""
    return _cell_state(F.lit("specimen"))


def varying_fold() -> Column:
    """Latest value of the best rank so far: replaced by any source as trusted."""
    return _cell_state(F.lit("varying"))


def fold(facts: DataFrame, field_def: DataFrame, priority: DataFrame) -> DataFrame:
    """DOC columns, seq, field, value: the state of every field after every document."""
    cells = ranked(grid(facts), field_def, priority)
    return cells.select(*DOC, "seq", "field", _cell_state(F.col("temporal")).alias("value"))


def wide(facts: DataFrame, fields: list[str]) -> DataFrame:
    """One row a document, metadata columns then the state of each field after it, by name. The fields' classes and the
    ranks of document types are constants, so the states are windows over documents and no grid is made."""
    rows = _by_patient(facts)
    docs = _histories(rows, *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    ranks = {}
    for branch, types in schema.PRIORITY.items():
        ranks[branch] = F.lit(len(schema.PRIORITY["bio"]))
        for i, t in enumerate(types):
            ranks[branch] = F.when(F.col("doc_type") == t, i).otherwise(ranks[branch])
    known = {f: schema.FIELDS.get(f, {"branch": "clinical", "temporal": "varying"}) for f in fields}
    states = [_state(F.lit(d["temporal"]), F.col(f), ranks[d["branch"]], _history()).alias(f) for f, d in sorted(known.items())]
    return docs.select(*[F.col(a).alias(b) for a, b in zip(DOC, schema.METADATA)], *states)


def parts(value: Column) -> Column:
    """Distinct members of a list written with commas, semicolons, `et` or `puis`, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(value, r"(?iU)[;,]|\bet\b|\bpuis\b"), lambda x: F.trim(x)), lambda x: x != ""))


def split_events(docs: DataFrame) -> DataFrame:
    """docs(doc_id, features map) -> doc_id, event, axis, features: a row for each date of the first axis that has
    two or more. An event keeps what events share, the clinical state and its own axis; other axes go. Drug names
    are dealt to the dates if there are as many of each. Documents without such an axis stay whole (axis null)."""
    keep = {a: [f for f, d in schema.FIELDS.items() if (d["axis"] in ("-", "state") and f != "prise_de_contraste") or d["axis"] == a and f not in schema.AXES.values()] for a in schema.AXES}
    dates = {a: parts(F.col("features")[f]) for a, f in schema.AXES.items()}
    axis = F.lit(None).cast("string")
    for a in reversed(schema.AXES):
        axis = F.when(F.size(dates[a]) >= 2, F.lit(a)).otherwise(axis)
    chosen, kept, opens = F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(None).cast("string")
    for a, f in schema.AXES.items():
        here = F.col("axis") == a
        chosen, kept, opens = F.when(here, dates[a]).otherwise(chosen), F.when(here, F.array(*[F.lit(x) for x in keep[a]])).otherwise(kept), F.when(here, F.lit(f)).otherwise(opens)
    rows = docs.withColumn("axis", axis).select("doc_id", "axis", "features", chosen.alias("_dates"), kept.alias("_kept"), opens.alias("_opens"), parts(F.col("features")["chimios"]).alias("_drugs"))
    each = rows.select("*", F.posexplode_outer("_dates").alias("_i", "_date"))
    shared = F.map_filter("features", lambda k, v: F.array_contains("_kept", k))
    own = F.map_from_arrays(F.array("_opens"), F.array("_date"))
    drug = F.when((F.col("axis") == "chemo") & (F.size("_drugs") == F.size("_dates")), F.map_from_arrays(F.array(F.lit("chimios")), F.array(F.get("_drugs", F.col("_i")))))
    base = F.map_filter(shared, lambda k, v: ~((k == F.col("_opens")) | (drug.isNotNull() & (k == "chimios"))))
    made = F.when(F.col("axis").isNull(), F.col("features")).when(drug.isNotNull(), F.map_concat(base, own, drug)).otherwise(F.map_concat(base, own))
    return each.select("doc_id", F.coalesce("_i", F.lit(0)).alias("event"), "axis", made.alias("features"))
