"""Scores of extractions against gold annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlark.functions.months import month_number
from medlark.functions.similarity import ratio

ALTERATION = 0.5
#: Free-text fields whose values count as equal from this indel ratio on.
FUZZY = 85.0
FUZZY_FIELDS = sorted(
    "histo_mitoses ihc_ki67 chimios autre_trouble infos_deces localisation_chir localisation_radiotherapie tumeur_position diag_integre diag_histologique "
    "neurochirurgien neuroncologue radiotherapeute activite_professionnelle".split()
)


def canonical_date(s: Column) -> Column:
    """yyyy-mm-dd, yyyy-mm or yyyy of a date written in one of six ways; null otherwise."""
    g = lambda p, i: F.regexp_extract(s, p, i)
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    dmy, ymd, long, my, short = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})\s+([a-zéû]+)\s+(\d{4})$", r"^([a-zéû]+)\s+(\d{4})$", r"^([a-zéû]+)-(\d{2})$"
    named = lambda p, i: month_number(g(p, i))
    return (
        F.when(s.rlike(dmy), F.concat_ws("-", g(dmy, 3), two(g(dmy, 2)), two(g(dmy, 1))))
        .when(s.rlike(ymd), F.concat_ws("-", g(ymd, 1), two(g(ymd, 2)), two(g(ymd, 3))))
        .when(s.rlike(long) & named(long, 2).isNotNull(), F.concat_ws("-", g(long, 3), two(named(long, 2)), two(g(long, 1))))
        .when(s.rlike(my) & named(my, 1).isNotNull(), F.concat_ws("-", g(my, 2), two(named(my, 1))))
        .when(s.rlike(short) & named(short, 1).isNotNull(), F.concat_ws("-", F.concat(F.lit("20"), g(short, 2)), two(named(short, 1))))
        .when(s.rlike(r"^\d{4}$"), s)
    )


def comparable(v: Column) -> Column:
    """Lower-case text; null for the spellings of nothing; whole numbers without a fraction."""
    s = F.lower(F.trim(v))
    number = s.try_cast("double")
    whole = s.rlike(r"^[+-]?\d+(\.\d*)?$") & (number == F.floor(number))
    return F.when(s.isin("", "na", "n/a", "null", "none"), F.lit(None)).when(whole, F.floor(number).cast("string")).otherwise(s)


def confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold, predicted(doc_id, field, value[, tier]) -> a row for each gold entry with tp, tn, hallucination,
    omission, alteration (0 or 1) and the tier. Predictions without a gold entry don't count. Dates compare at
    the coarser granularity, drug lists whatever their order; values of FUZZY_FIELDS and the variants within `mute (..)`
    need be alike only, and a bare `mute` in gold takes any variant."""
    tier = F.col("tier") if "tier" in predicted.columns else F.lit("rule")
    p = predicted.select("doc_id", "field", F.col("value").alias("_p"), tier.alias("tier"))
    rows = gold.select("doc_id", "field", F.col("value").alias("_g")).join(p, ["doc_id", "field"], "left")
    rows = rows.withColumns({"_p": comparable(F.col("_p")), "_g": comparable(F.col("_g")), "tier": F.coalesce("tier", F.lit("unknown"))})
    rows = rows.withColumns({"_pd": canonical_date(F.col("_p")), "_gd": canonical_date(F.col("_g"))})
    n = F.least(F.length("_pd"), F.length("_gd"))
    listed = lambda c: F.array_join(F.array_sort(F.split(c, r" \+ ")), " + ")
    both = F.col("_p").contains(" + ") & F.col("_g").contains(" + ")
    same = F.when(F.col("_pd").isNotNull() & F.col("_gd").isNotNull(), F.substring("_pd", F.lit(1), n) == F.substring("_gd", F.lit(1), n)).when(both, listed(F.col("_p")) == listed(F.col("_g"))).when(
        (F.col("_g") == "mute") & F.col("_p").startswith("mute ("), F.lit(True)
    ).otherwise(F.col("_p").eqNullSafe(F.col("_g")))
    # Python sees only the pairs that the rest leaves open
    variants = F.col("_p").startswith("mute (") & F.col("_g").startswith("mute (")
    open_pair = F.col("_p").isNotNull() & F.col("_g").isNotNull() & ~same & (variants | F.col("field").isin(FUZZY_FIELDS))
    inner = lambda c: F.when(open_pair, F.when(variants, F.substring(c, F.lit(7), F.length(c) - 7)).otherwise(c))
    rows = rows.withColumns({"_same": same, "_a": inner(F.col("_p")), "_b": inner(F.col("_g"))}).withColumn("_alike", ratio("_a", "_b"))
    same = F.col("_same") | F.coalesce(F.col("_alike") >= FUZZY, F.lit(False))
    some, none = F.col("_g").isNotNull(), F.col("_g").isNull()
    flag = lambda c: c.cast("int")
    return rows.select(
        "doc_id", "field", "tier", flag(same & some).alias("tp"), flag(same & none).alias("tn"), flag(~same & none).alias("hallucination"),
        flag(~same & some & F.col("_p").isNull()).alias("omission"), flag(~same & some & F.col("_p").isNotNull()).alias("alteration"),
    )


COUNTS = ("tp", "tn", "hallucination", "omission", "alteration")


def rates() -> list[Column]:
    """Precision, recall, F1 and error rates of summed counts; an alteration is half an error on both sides."""
    tp, h, o, a = (F.col(c).cast("double") for c in ("tp", "hallucination", "omission", "alteration"))
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    p, r = safe(tp, tp + h + ALTERATION * a), safe(tp, tp + o + ALTERATION * a)
    whole = tp + F.col("tn") + h + o + a
    return [p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"), safe(h, whole).alias("hallucination_rate"), safe(a, whole).alias("alteration_rate"), safe(o, whole).alias("omission_rate")]


def by_field(rows: DataFrame) -> DataFrame:
    """Counts, rates and the most frequent tier of each field (the least on ties), from one count by field and tier."""
    by = rows.groupBy("field", "tier").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in COUNTS])
    sums = by.groupBy("field").agg(*[F.sum(c).alias(c) for c in COUNTS], F.min_by("tier", F.struct(-F.col("n"), F.col("tier"))).alias("main_tier"))
    return sums.select("field", *COUNTS, "main_tier", *rates())


def macro_by_mode(gold: DataFrame, predicted: DataFrame, least: float = 80.0) -> DataFrame:
    """gold(doc_id, field, value), predicted(mode, doc_id, field, value) -> mode, fields, exact, relaxed: macro F1 over
    the fields with anything to count. Blank values count as none; relaxed takes values of FUZZY_FIELDS from an indel
    ratio of `least` on, others when equal. A pair that differs is a false positive and a false negative."""
    modes = predicted.select("mode").distinct()
    g = gold.select("doc_id", "field", comparable(F.col("value")).alias("g")).filter("g is not null")
    p = predicted.select("mode", "doc_id", "field", comparable(F.col("value")).alias("p")).filter("p is not null")
    wanted = g.join(F.broadcast(modes))  # a row for each of the few modes
    rows = wanted.join(p, ["mode", "doc_id", "field"], "full_outer")
    unequal = F.col("p").isNotNull() & F.col("g").isNotNull() & (F.col("p") != F.col("g")) & F.col("field").isin(FUZZY_FIELDS)
    rows = rows.withColumn("_alike", ratio(F.when(unequal, F.col("p")), F.when(unequal, F.col("g"))))
    exact = F.coalesce((F.col("p") == F.col("g")).cast("int"), F.lit(0))
    relaxed = F.greatest(exact, F.coalesce((F.col("_alike") >= least).cast("int"), F.lit(0)))
    sums = rows.groupBy("mode", "field").agg(F.sum(exact).alias("e"), F.sum(relaxed).alias("r"), F.count("p").alias("np"), F.count("g").alias("ng"))
    f1 = lambda c: 2 * F.col(c) / (F.col("np") + F.col("ng"))
    return sums.groupBy("mode").agg(F.count("*").alias("fields"), F.round(F.avg(f1("e")), 6).alias("exact"), F.round(F.avg(f1("r")), 6).alias("relaxed"))


def by_category(fields: DataFrame, category: DataFrame) -> DataFrame:
    """fields: by_field's rows; category(category, field) -> mean F1, precision and recall, absent fields as 0, and
    the number of fields that were tried."""
    joined = category.join(fields, "field", "left")
    zero = lambda c: F.avg(F.coalesce(c, F.lit(0.0))).alias(c)
    return joined.groupBy("category").agg(zero("f1"), zero("precision"), zero("recall"), F.count("f1").alias("attempted"), F.count("*").alias("fields"))


def by_tier(rows: DataFrame, category: DataFrame) -> DataFrame:
    """F1 of each category and tier."""
    sums = rows.join(F.broadcast(category), "field").groupBy("category", "tier").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return sums.select("category", "tier", rates()[2])


def sets(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold, predicted(doc_id, label, entity): set-level precision, recall, F1 and support by label, with rows
    `micro` (of the totals) and `macro` (the mean of the rounded labels); four decimals."""
    g, p = gold.distinct().withColumn("_g", F.lit(1)), predicted.distinct().withColumn("_p", F.lit(1))
    rows = g.join(p, ["doc_id", "label", "entity"], "full_outer")
    count = [F.sum(F.col("_g") * F.col("_p")).alias("tp"), F.count("_g").alias("g"), F.count("_p").alias("p")]
    tp, gn, pn = F.coalesce("tp", F.lit(0)), F.col("g"), F.col("p")
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    by = rows.groupBy("label").agg(*count)  # the one pass over rows; the rest rolls a few labels up
    scored = by.select("label", F.coalesce("tp", F.lit(0)).alias("tp"), F.col("g").alias("_gs"), F.col("p").alias("_ps"), F.round(safe(tp, pn), 4).alias("precision"), F.round(safe(tp, gn), 4).alias("recall"), F.round(safe(2 * tp, pn + gn), 4).alias("f1"), gn.alias("support"))
    means = [F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")]
    rolled = scored.rollup("label").agg(F.grouping("label").alias("_all"), F.sum("tp").alias("tp"), F.sum("_gs").alias("g"), F.sum("_ps").alias("p"), *means, F.sum("support").alias("support"))
    score = [F.round(safe(tp, pn), 4), F.round(safe(tp, gn), 4), F.round(safe(2 * tp, pn + gn), 4)]
    line = lambda label, values: F.struct(label.alias("label"), *[v.alias(c) for c, v in zip(("precision", "recall", "f1"), values)], F.col("support"))
    own = [F.col(c) for c in ("precision", "recall", "f1")]
    both = F.array(line(F.lit("micro"), score), line(F.lit("macro"), own))
    return rolled.select(F.explode(F.when(F.col("_all") == 1, both).otherwise(F.array(line(F.col("label"), own)))).alias("_")).select("_.*")
