"""Coherence of tumour profiles with the 2021 classification: predicates, messages, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlark.functions.text import folded


def get(profile: Column, name: str) -> Column:
    return F.coalesce(folded(F.try_element_at(profile, F.lit(name))), F.lit(""))


def family(profile: Column) -> Column:
    """oligodendrogliome before astrocytome before glioblastome, since names of mixed tumours hold both."""
    d = F.concat_ws(" ", get(profile, "diag_integre"), get(profile, "diag_histologique"))
    return F.when(d.contains("oligo"), "oligo").when(d.contains("astrocytom"), "astro").when(d.contains("glioblastom") | d.rlike(r"\bgbm\b"), "gbm").otherwise("other")


def idh(profile: Column) -> Column:
    """mute, wt or unknown. A wild type is told first: `non mute` holds `mute`."""
    m, i = get(profile, "mol_idh1"), get(profile, "ihc_idh1")
    other = get(profile, "mol_idh2")
    wild = lambda c: c.rlike(r"\bwt\b|sauvage|non mut|wild")
    mutant = lambda c: ~wild(c) & c.rlike(r"mut|r132|r172")
    return F.when(mutant(m) | mutant(other) | (i == "positif"), "mute").when(wild(m) | (i == "negatif"), "wt").otherwise("unknown")


def codeleted(profile: Column) -> Column:
    c = get(profile, "ch1p19q_codel")
    both = get(profile, "ch1p").startswith("perte") & get(profile, "ch19q").startswith("perte")
    return F.when(c.isin("oui", "non"), c == "oui").otherwise(both)


def messages(profile: Column) -> Column:
    """Breaches of seven rules, an empty array where there are none."""
    f, i = family(profile), idh(profile)
    grade, who = get(profile, "grade"), get(profile, "classification_oms")
    gain7, loss10 = get(profile, "ch7p").startswith("gain"), get(profile, "ch10q").startswith("perte")
    marks = gain7 & loss10 | (get(profile, "ampli_egfr") == "oui") | get(profile, "mol_tert").rlike("mut|c2[25]")
    rules = [
        F.when((f == "gbm") & (i == "mute") & (who == "2021"), "glioblastome: IDH mute"), F.when((f == "gbm") & ~grade.isin("", "4"), "glioblastome: grade"), F.when((f == "astro") & (i == "wt") & (who == "2021"), "astrocytome: IDH sauvage"),
        F.when((f == "oligo") & (i == "wt"), "oligodendrogliome: IDH sauvage"), F.when((f == "oligo") & ~codeleted(profile) & (get(profile, "ch1p19q_codel") != ""), "oligodendrogliome: sans codeletion"),
        F.when((f == "astro") & codeleted(profile), "astrocytome: codeletion"), F.when((f == "astro") & (i == "wt") & marks & (grade != "4"), "astrocytome: marqueurs de grade 4"),
    ]
    return F.array_compact(F.array(*rules))


def corrected(profile: Column) -> Column:
    """The profile with what the rules decide: grade 4 for a glioblastoma, codeletion for an oligodendroglioma, none
    for an astrocytoma."""
    f = family(profile)
    one = lambda n, v: F.map_from_arrays(F.array(F.lit(n)), F.array(F.lit(v)))
    without = lambda n: F.map_filter(profile, lambda k, v: k != n)
    return F.when((f == "gbm") & ~get(profile, "grade").isin("", "4"), F.map_concat(without("grade"), one("grade", "4"))).when(
        (f == "oligo") & (get(profile, "ch1p19q_codel") == "non"), F.map_concat(without("ch1p19q_codel"), one("ch1p19q_codel", "oui"))
    ).when((f == "astro") & (get(profile, "ch1p19q_codel") == "oui"), F.map_concat(without("ch1p19q_codel"), one("ch1p19q_codel", "non"))).otherwise(profile)


def counts(profiles: DataFrame) -> DataFrame:
    """profiles(id, profile) -> family, IDH status, number."""
    return profiles.groupBy(family(F.col("profile")).alias("family"), idh(F.col("profile")).alias("idh")).agg(F.count("*").alias("n"))
