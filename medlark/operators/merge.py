"""Reconciling extractors: priority overlay, the rule-or-model decision and first-match choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Later ones overwrite earlier ones.
EXTRACTORS = ("rule", "eds", "controlled", "date")


def best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def overlay(facts: DataFrame, order: tuple = EXTRACTORS) -> DataFrame:
    """facts(doc_id, field, extractor, value) -> the row of the last extractor that has the field."""
    rank = F.array_position(F.array(*[F.lit(e) for e in order]), F.col("extractor"))
    return best(facts, ["doc_id", "field"], rank.desc())


def decide(rules: DataFrame, model: DataFrame, model_fields: DataFrame, values: DataFrame, mode: str = "both") -> DataFrame:
    """rules, model(doc_id, field, value); model_fields(field); values(field, value) for constrained fields.

    `rule` and `ml` return one side. `both` keeps the rule's value unless the field is on the list and the model's
    value is plausible: the field is unconstrained or the value is allowed, whatever its case."""
    if mode != "both":
        return (rules if mode == "rule" else model).select("doc_id", "field", "value", F.lit(mode).alias("source"))
    fine = plausible(model, values).join(F.broadcast(model_fields), "field", "left_semi")
    r, m = rules.select("doc_id", "field", F.col("value").alias("rule_value")), fine.select("doc_id", "field", F.col("value").alias("model_value"))
    both = r.join(m, ["doc_id", "field"], "full_outer")
    return both.select("doc_id", "field", F.coalesce("model_value", "rule_value").alias("value"), F.when(F.col("model_value").isNotNull(), "ml").otherwise("rule").alias("source"))


def plausible(model: DataFrame, values: DataFrame) -> DataFrame:
    """Rows whose field is unconstrained or whose value is allowed."""
    constrained = F.broadcast(values.select("field").distinct().withColumn("_known", F.lit(True)))
    ok = F.broadcast(values.select("field", F.lower("value").alias("_value")).distinct().withColumn("_ok", F.lit(True)))
    joined = model.join(constrained, "field", "left").withColumn("_value", F.lower("value")).join(ok, ["field", "_value"], "left")
    return joined.filter(F.col("_known").isNull() | F.col("_ok").isNotNull()).drop("_known", "_ok", "_value")


def first_match(rows: DataFrame) -> DataFrame:
    """rows(doc_id, field, ord, start, ..): earliest pattern, then earliest position."""
    return best(rows, ["doc_id", "field"], F.col("ord"), F.col("start"))


def first_section(rows: DataFrame) -> DataFrame:
    """rows(.., section_pos, extractor_ord): the field of the first section that has it."""
    return best(rows, ["doc_id", "field"], F.col("section_pos"), F.col("extractor_ord"))


def highest_score(rows: DataFrame) -> DataFrame:
    """rows(.., score, seq): one value a field, by score, then as found."""
    return best(rows, ["doc_id", "field"], F.col("score").desc(), F.col("seq"))


def preferred_section(rows: DataFrame) -> DataFrame:
    """rows(.., preferred, section, start): preferred sections first, the preamble before others."""
    return best(rows, ["doc_id", "field"], (~F.col("preferred")).cast("int"), (F.col("section") != "preamble").cast("int"), F.col("start"))


def last_entity(rows: DataFrame) -> DataFrame:
    """rows(.., seq): the last one of each field."""
    return best(rows, ["doc_id", "field"], F.col("seq").desc())
