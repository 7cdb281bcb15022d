"""The document database: schema, reading, appending without duplicates, ordering, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlark.functions import schema
from medlark.functions.text import canonical_identifier, consultation_date, date_members, date_number

COLUMNS = "did long, ipp string, source_file string, document string, pseudo string, `order` int, consult_date string, consult_date_num int"


def create(spark: SparkSession) -> DataFrame:
    """An empty database."""
    return spark.createDataFrame([], COLUMNS)


def load(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV database, all text, with canonical identifiers and the order as a number or null."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)
    return canonical(rows.toDF(*[c.lower() for c in rows.columns]))


def canonical(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ipp", canonical_identifier(F.col("ipp"))).withColumn("order", F.col("order").try_cast("double").try_cast("int"))


def save(rows: DataFrame, path: str) -> None:
    """Write a new version of the database; the committer makes it visible as a whole."""
    rows.write.mode("overwrite").parquet(path)


def new_documents(batch: DataFrame, database: DataFrame) -> DataFrame:
    """Rows of the batch whose (ipp, document) isn't in the database; copies within the batch stay."""
    known = database.select(F.col("ipp").alias("_i"), F.col("document").alias("_d"), F.xxhash64("document").alias("_h")).distinct()
    return batch.withColumn("_print", F.xxhash64("document")).join(known, (F.col("_print") == F.col("_h")) & (F.col("ipp") == F.col("_i")) & (F.col("document") == F.col("_d")), "left_anti").drop("_print")


def dated(rows: DataFrame) -> DataFrame:
    members = date_members(consultation_date(F.col("document")))
    text = F.array_join(F.transform(members, lambda x: x.cast("string")), "/")
    return rows.withColumn("consult_date", F.when(members.isNotNull(), text)).withColumn("consult_date_num", date_number(members))


def append(database: DataFrame, batch: DataFrame) -> DataFrame:
    """database and batch under one set of ids: the batch continues from the greatest did. Patients of the batch with
    two or more documents get their order anew, by competition rank of the date."""
    greatest = database.agg(F.coalesce(F.max("did"), F.lit(-1)).alias("_max"))
    # One id a partition start: counts by partition, then row numbers within, so the batch is never in one place.
    parts = batch.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    numbered = parts.join(F.broadcast(starts), "_part").crossJoin(F.broadcast(greatest))
    numbered = numbered.withColumn("did", F.col("_max") + 1 + F.col("_start") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_start", "_max")
    whole = database.unionByName(numbered, allowMissingColumns=True)
    touched = batch.select("ipp").distinct().withColumn("_touched", F.lit(True))
    whole = whole.join(touched, "ipp", "left")
    rank = F.rank().over(Window.partitionBy("ipp").orderBy("consult_date_num"))
    several = F.count("*").over(Window.partitionBy("ipp")) > 1
    return whole.withColumn("order", F.when(F.col("_touched") & several, rank).otherwise(F.col("order"))).drop("_touched")


def salvage(batch: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to commit, rows to set aside with the reason)."""
    reason = F.coalesce(*[F.when(F.col(c).isNull() | (F.trim(F.col(c)) == ""), F.lit(f"{c} is missing")) for c in required])
    marked = batch.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def audit(rows: DataFrame) -> DataFrame:
    """rows(status, source_file) -> number and names by status."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("source_file")).alias("files"))


def pseudo_only(database: DataFrame) -> DataFrame:
    return database.drop("document")


def extraction_input(rows: DataFrame) -> DataFrame:
    """Rows with a pseudonymised text that isn't blank, in the order of their number."""
    return rows.filter(F.col("pseudo").isNotNull() & (F.trim("pseudo") != "")).withColumn("did", F.col("did").try_cast("double").try_cast("long")).orderBy(F.col("did").asc_nulls_last())


def extended(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the missing ones of some text columns added as null."""
    return rows.select("*", *[F.lit(None).cast("string").alias(c) for c in columns if c not in rows.columns])


def branches(timeline: DataFrame) -> dict[str, DataFrame]:
    """full, bio and clinical: metadata columns and those fields of a branch that the timeline has."""
    have = set(timeline.columns)
    pick = lambda names: timeline.select(*[c for c in schema.METADATA if c in have], *[c for c in names if c in have])
    return {"full": timeline, "bio": pick(schema.BIO), "clinical": pick(schema.CLINICAL)}


def write_branches(timeline: DataFrame, path: str) -> None:
    for name, rows in branches(timeline).items():
        rows.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def transposed(lines: DataFrame) -> DataFrame:
    """lines(row, cells array), the first cell a field's name and each other a visit -> visit, field, value; empty
    cells are null. Field and visit names may repeat; visits are known by place."""
    each = lines.select(F.col("cells")[0].alias("field"), F.posexplode("cells").alias("visit", "value")).filter("visit > 0")
    return each.select("visit", F.trim("field").alias("field"), F.nullif(F.trim("value"), F.lit("")).alias("value"))


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose key has no result yet: a restart repeats nothing, whatever the order of results."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def gold_annotations(gold: DataFrame, field_def: DataFrame) -> DataFrame:
    """gold(document_id, patient_id, annotations map) -> document_id, field, value; unknown fields are dropped."""
    rows = gold.select("document_id", F.explode("annotations").alias("field", "value"))
    return rows.join(F.broadcast(field_def.select("field")), "field", "left_semi").select("document_id", "field", "value")


def gold_documents(facts: DataFrame) -> DataFrame:
    """facts(doc_id, patient_id, field, value) -> a JSON text for each document."""
    rows = facts.filter("value is not null").groupBy("doc_id", "patient_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("annotations"))
    return rows.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("document_id"), "patient_id", "annotations")).alias("json"))
