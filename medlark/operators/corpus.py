"""Statistics of annotated corpora, splits, and quality filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlark.operators.evaluation import canonical_date


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, min, max, mean, median and sample deviation of a number, one decimal."""
    v = F.col(value).cast("double")
    one = lambda c, n: F.round(c, 1).alias(n)
    return rows.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), one(F.avg(v), "mean"), one(F.percentile(v, 0.5), "median"), one(F.coalesce(F.stddev_samp(v), F.lit(0.0)), "deviation"))


def frequency(entities: DataFrame) -> DataFrame:
    """entities(doc_id, label) -> label, documents, total."""
    return entities.groupBy("label", "doc_id").agg(F.count("*").alias("n")).groupBy("label").agg(F.count("*").alias("documents"), F.sum("n").alias("total"))


def top_values(entities: DataFrame, n: int) -> DataFrame:
    """The n most frequent values of each label, the least first on ties."""
    counts = entities.groupBy("label", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("label").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def span_state(text: Column, start: Column, end: Column) -> Column:
    """bad, outside, empty or ok."""
    return F.when(start.isNull() | end.isNull() | (start < 0) | (end <= start), "bad").when(end > F.length(text), "outside").when(F.trim(F.substring(text, start + 1, end - start)) == "", "empty").otherwise("ok")


def split(patients: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """patient_id, part: train or val by a seeded hash, the same for a patient at any size."""
    return patients.select("patient_id").distinct().withColumn("part", F.when(F.pmod(F.xxhash64("patient_id", F.lit(seed)), F.lit(1000)) < int(share * 1000), "train").otherwise("val"))


def resampled(entities: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Documents repeated so that each of their labels comes near to target: a document is read as often as its
    rarest label asks for, the rest of the division going to the first documents by seeded hash."""
    counts = entities.groupBy("label").agg(F.countDistinct("doc_id").alias("n"))
    rare = entities.select("doc_id", "label").distinct().join(F.broadcast(counts), "label").groupBy("doc_id").agg(F.min(F.struct("n", "label")).alias("r"))
    order = Window.partitionBy("r.label").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    placed = rare.withColumn("i", F.row_number().over(order)).withColumn("k", F.count("*").over(Window.partitionBy("r.label")))
    times = F.greatest(F.lit(1), F.floor(F.lit(target) / F.col("k")) + F.when(F.col("i") <= F.lit(target) % F.col("k"), 1).otherwise(0)).cast("int")
    return placed.select("doc_id", times.alias("times"))


def gate(resolutions: DataFrame, least: float = 0.9) -> DataFrame:
    """resolutions(method) -> method, n, share and whether enough was resolved."""
    n = resolutions.groupBy("method").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    share = F.col("n") / F.sum("n").over(whole)
    solved = F.sum(F.when(F.col("method") != "unresolved", F.col("n")).otherwise(0)).over(whole) / F.sum("n").over(whole)
    return n.select("method", "n", F.round(share, 6).alias("share"), (solved >= least).alias("accepted"))


def proportions(rows: DataFrame, column: str, targets: dict[str, float], slack: float = 10.0) -> DataFrame:
    """Share in percent of each class against its target, flagged where they differ by more than slack."""
    t = rows.sparkSession.createDataFrame(list(targets.items()), f"{column} string, target double")
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("_all"))
    joined = t.join(n, column, "left").crossJoin(F.broadcast(total))
    share = 100.0 * F.coalesce("n", F.lit(0)) / F.col("_all")
    return joined.select(column, F.round(share, 3).alias("share"), "target", (F.abs(share - F.col("target")) > slack).alias("flagged"))


def coverage(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """Patients with a value, for every known field, and `extra` ones that aren't known."""
    seen = facts.filter("value is not null").groupBy("field").agg(F.countDistinct("patient_id").alias("patients"))
    known = fields.select("field").withColumn("known", F.lit(True))
    return known.join(seen, "field", "full_outer").select("field", F.coalesce("patients", F.lit(0)).alias("patients"), F.coalesce("known", F.lit(False)).alias("known"))


def pivot_scores(results: DataFrame, methods: list[str] | None = None, most: int = 1000) -> DataFrame:
    """results(grp, method, label, f1) -> mean F1 of each group by method, a column for each. Methods not given are
    looked up; more than `most` can't be columns and are an error."""
    if methods is None:
        methods = sorted(r[0] for r in results.select("method").distinct().limit(most + 1).collect())
        if len(methods) > most:
            raise ValueError(f"more than {most} methods")
    return results.groupBy("grp").pivot("method", methods).agg(F.round(F.avg("f1"), 6))


def melted(results: DataFrame) -> DataFrame:
    return results.unpivot(["grp", "method", "label"], ["precision", "recall", "f1"], "metric", "value")


def best_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b(grp, label, f1) -> the greater F1, and the difference where both have the label."""
    both = a.select("grp", "label", F.col("f1").alias("a")).join(b.select("grp", "label", F.col("f1").alias("b")), ["grp", "label"], "full_outer")
    return both.select("grp", "label", F.greatest("a", "b").alias("f1"), F.round(F.col("a") - F.col("b"), 6).alias("gap"))


def passes(results: DataFrame, least: float = 0.6) -> DataFrame:
    return results.groupBy("grp", "method").agg(F.count_if(F.col("f1") >= least).alias("good"), F.count_if(F.col("f1") < least).alias("poor"), F.round(F.avg((F.col("f1") >= least).cast("int")), 6).alias("share"))


def earliest_year(rows: DataFrame) -> DataFrame:
    """rows(patient_id, doc_id, year): the patient's least year wherever documents disagree."""
    w = Window.partitionBy("patient_id")
    return rows.select("patient_id", "doc_id", F.when(F.min("year").over(w) != F.max("year").over(w), F.min("year").over(w)).otherwise(F.col("year")).alias("year"), (F.min("year").over(w) != F.max("year").over(w)).alias("conflict"))


def merged_annotations(facts: DataFrame) -> DataFrame:
    """One value a patient and field, of the last line."""
    return facts.filter("value is not null").groupBy("patient_id", "field").agg(F.max_by("value", F.struct("doc_id", "seq")).alias("value"))


_MEDICAL = sorted(
    "gliome glioblastome astrocytome oligodendrogliome tumeur biopsie chirurgie histologique immunohistochimie moléculaire anatomopathologie diagnostic examen "
    "irm scanner imagerie radiothérapie chimiothérapie traitement oncologie neurologie médecin clinique hôpital service consultation patiente patient".split()
)
_ENGLISH = sorted("about are been being could from has have into is should that the their there these they this those was were which will with would".split())
#: Traces of a prompt in a generated text.
LEAKS = ("field_name", "document_text", "annotation", "json", "span")


def language_quality(text: Column, leaks: tuple = LEAKS) -> Column:
    """reject or pass: traces of a prompt, fewer than five different medical words, or over a tenth of English ones."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    leak = F.lit(False)
    for x in leaks:
        leak = leak | F.lower(text).contains(x)
    medical = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in _MEDICAL])))
    english = F.size(F.filter(words, lambda w: w.isin(_ENGLISH))) / F.greatest(F.size(words), F.lit(1))
    return F.when(leak | (medical < 5) | (english > 0.1), "reject").otherwise("pass")


def coherent_dates(profile: Column) -> Column:
    """Messages about a profile map's dates that can't be: later ones before earlier ones, and those that don't read."""
    names = ("date_1er_symptome", "date_chir", "chm_date_debut", "date_deces")
    day = lambda n: F.try_to_date(canonical_date(F.try_element_at(profile, F.lit(n))), "yyyy-MM-dd")
    unread = [F.when(F.try_element_at(profile, F.lit(n)).isNotNull() & canonical_date(F.try_element_at(profile, F.lit(n))).isNull(), F.lit(f"{n} unreadable")) for n in names]
    order = [F.when(day(a) > day(b), F.lit(f"{a} after {b}")) for a, b in (("date_1er_symptome", "date_chir"), ("date_chir", "date_deces"), ("chm_date_debut", "date_deces"), ("date_1er_symptome", "date_deces"))]
    return F.array_compact(F.array(*unread, *order))
