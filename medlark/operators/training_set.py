"""Building annotated training sets: greedy pairing, near-duplicates, conversions, task lists and document checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlark.functions import schema
from medlark.operators import shingles


def greedy_pairs(candidates: DataFrame, group: str) -> DataFrame:
    """candidates(group, left, right, score, seq): pairs by score, then as listed, each side used once a group. The
    fold runs over the candidates of one document or patient."""
    ordered = candidates.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "seq", "left", "right"))).alias("c"))
    none = F.array().cast("array<struct<left:string,right:string,score:double>>")

    def step(kept: Column, c: Column) -> Column:
        taken = F.exists(kept, lambda k: (k["left"] == c["left"]) | (k["right"] == c["right"]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(F.struct(c["left"].cast("string").alias("left"), c["right"].cast("string").alias("right"), (-c["s"]).cast("double").alias("score")))))

    return ordered.select(group, F.explode(F.aggregate("c", none, step)).alias("_")).select(group, "_.*")


def _lower(docs: DataFrame) -> DataFrame:
    # blank texts go by their text: a filter on what Python returns would be pushed down, before joins too, and run it twice
    return docs.filter(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).select("doc_id", F.lower("text").alias("_t"))


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, s: hashes of the distinct runs of k words, or of all words if these are fewer; blank
    texts are left out."""

    @F.arrow_udf("array<long>")
    def listed(texts: pa.Array) -> pa.Array:
        return shingles.listed(texts, k)

    return _lower(docs).select("doc_id", listed("_t").alias("s"))


def signatures(docs: DataFrame, bands: int = 16, rows: int = 4, k: int = 5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h, n, keys, bins: hash and size of the shingle set, the keys of its bands and how its
    members spread over the bins, in one pass over the texts; blank texts are left out."""

    @F.arrow_udf("struct<h:long,n:int,keys:array<long>,bins:array<int>>")
    def sketched(texts: pa.Array) -> pa.Array:
        return shingles.sketched(texts, k, bands, rows)

    return _lower(docs).select("doc_id", sketched("_t").alias("_")).select("doc_id", "_.*")


def membership(docs: DataFrame, k: int = 5, signed: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, representative (the least id with the same shingles) and copies (how many have
    them): what near_duplicates folds. Sets meet by their hash, in narrow rows. `signed`: the signatures, if there are any yet."""
    same = Window.partitionBy("h", "n")
    keyed = (signatures(docs, 1, 1, k) if signed is None else signed).select("doc_id", "h", "n")
    return keyed.select("doc_id", F.min("doc_id").over(same).alias("representative"), F.count("*").over(same).alias("copies"))


def near_duplicates(docs: DataFrame, least: float = 0.85, bands: int = 16, rows: int = 4, k: int = 5, signed: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text) -> a, b, jaccard: pairs of different texts whose shingle sets are alike, by banded minima and
    an exact check. Equal shingle sets are folded to their least doc_id beforehand; `membership` says which. Only texts of
    candidate pairs are made into sets. `signed`: their signatures, if there are any yet."""
    signed = signatures(docs, bands, rows, k) if signed is None else signed
    classes = signed.groupBy("h", "n").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    # only keys of several classes go on; (n, doc_id) lists, as sets whose sizes are too far apart can't be alike
    met = classes.select(F.posexplode("keys").alias("band", "key"), F.struct("doc_id", "n").alias("d")).groupBy("band", "key").agg(F.collect_list("d").alias("ds")).filter(F.size("ds") > 1)
    x, y = F.col("x"), F.col("y")
    each = met.select("ds", F.explode("ds").alias("x")).select("x", F.explode(F.filter("ds", lambda d: d["doc_id"] > F.col("x.doc_id"))).alias("y"))
    near = each.filter(F.least(x["n"], y["n"]) / F.greatest(x["n"], y["n"]) >= least)
    met = near.select(x["doc_id"].alias("a"), y["doc_id"].alias("b")).distinct()
    # two sets share no more than the lesser count of each bin: most pairs end here, before any set is moved
    of = lambda c: signed.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bins").alias(f"bins_{c}"))
    bounded = met.join(of("a"), "a").join(of("b"), "b").withColumn("most", F.aggregate(F.zip_with("bins_a", "bins_b", lambda u, v: F.least(u, v)), F.lit(0), lambda u, v: u + v))
    pairs = bounded.filter(F.col("most") / (F.col("n_a") + F.col("n_b") - F.col("most")) >= least).select("a", "b")
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("of"))
    # the narrow side is the one in memory: texts are not sorted
    texts = docs.select("doc_id", "text").join(ends.hint("shuffle_hash"), "doc_id")
    sets = shingle_sets(texts.select(F.struct("doc_id", "of").alias("doc_id"), "text"), k)
    full = sets.select(F.col("doc_id.doc_id").alias("doc_id"), F.explode("doc_id.of").alias("p"), "s").groupBy("p").agg(*[F.first(F.when(F.col("doc_id") == F.col(f"p.{c}"), F.col("s")), True).alias(f"s_{c}") for c in "ab"])
    s, t = F.col("s_a"), F.col("s_b")
    n = F.size(F.array_intersect(s, t))
    return full.select("p.a", "p.b", (n / (F.size(s) + F.size(t) - n)).alias("jaccard")).filter(F.col("jaccard") >= least)


def representatives(pairs: DataFrame, members: DataFrame, rate: DataFrame, store) -> DataFrame:
    """pairs(a, b) of class representatives, members(doc_id, representative), rate(doc_id, rate) -> doc_id of the
    documents that stay: documents are walked by id; one not yet seen takes all its unseen near neighbours and copies
    with it, and the best rate of these stays (the least id on ties). Documents without a class stay.

    The walk runs in rounds over classes: a class leads once all smaller neighbours follow others, and follows its
    least leading neighbour. Classes without a neighbour lead themselves and take no part. `store` writes a round down and
    reads it again."""
    edges = store(pairs.select("a", "b").union(pairs.select("b", "a")).toDF("node", "other"))
    state = store(edges.select("node").distinct().withColumn("leader", F.lit(None).cast(members.schema["doc_id"].dataType)))
    left = None
    while (now := state.filter("leader is null").count()) and now != left:
        left = now
        seen = edges.join(state.select(F.col("node").alias("other"), F.col("leader").alias("l")), "other").filter("other < node")
        lead = seen.groupBy("node").agg(F.min(F.when(F.col("l") == F.col("other"), F.col("other"))).alias("first"), F.min(F.when(F.col("l").isNull(), F.col("other"))).alias("open"))
        # an undecided smaller neighbour may still lead, before or after the one found
        follow = F.when(F.col("first").isNotNull() & (F.col("open").isNull() | (F.col("first") < F.col("open"))), F.col("first")).when(F.col("first").isNull() & F.col("open").isNull(), F.col("node"))
        state = store(state.join(lead, "node", "left").select("node", F.coalesce("leader", follow).alias("leader")))
    led = members.join(state.withColumnRenamed("node", "representative"), "representative", "left").withColumn("leader", F.coalesce("leader", "representative"))
    whole = led.join(rate, "doc_id", "left")
    best = whole.groupBy("leader").agg(F.min(F.struct((-F.coalesce("rate", F.lit(0.0))).alias("r"), "doc_id")).alias("b")).select("b.doc_id")
    return best.union(rate.select("doc_id").join(members.select("doc_id"), "doc_id", "left_anti"))


def tasks(profiles: DataFrame) -> DataFrame:
    """profiles(patient_id, document_types array) -> a row for each document to write."""
    return profiles.select("patient_id", F.explode("document_types").alias("doc_type"))


def relevant(profile: Column, fields: list[str]) -> Column:
    """Entries of a profile map that are filled and belong to a document type's fields."""
    return F.map_filter(profile, lambda k, v: v.isNotNull() & k.isin(fields))


def raw_valid(row: Column, least: int = 100) -> Column:
    """struct(document_text, annotations map of value and span): long enough, every annotation with both."""
    return F.coalesce((F.length(row["document_text"]) >= least) & F.forall(F.map_values(row["annotations"]), lambda a: a["value"].isNotNull() & a["span"].isNotNull()), F.lit(False))


def by_label(entities: Column) -> Column:
    """array of struct(start, end, label, value) -> map of label to values; spans over 300 characters give their value."""
    labels = F.array_distinct(F.transform(entities, lambda e: e["label"]))
    return F.map_from_entries(F.transform(labels, lambda n: F.struct(n, F.transform(F.filter(entities, lambda e: e["label"] == n), lambda e: F.when(e["end"] - e["start"] > 300, e["value"]).otherwise(F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string")))))))


def repaired_json(answer: Column) -> Column:
    """The outermost object of a model's answer: no thoughts, no fences, no trailing commas; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.nullif(F.regexp_replace(body, r",\s*([}\]])", "$1"), F.lit(""))


_STOPS = {"fr": "le la les de des et est une dans pour pas que qui avec sur", "en": "the of and is was with for this that not are from has"}


def language(text: Column) -> Column:
    """fr or en by function words in the first 2000 characters; fr on ties."""
    words = F.split(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 2000)), r"\W+")
    return F.when(F.size(_hits(words, "en")) > F.size(_hits(words, "fr")), "en").otherwise("fr")


def _hits(words: Column, name: str) -> Column:
    return F.filter(words, lambda w: w.isin(_STOPS[name].split()))


_TOKEN = r"\[?(?:PRENOM|NOM|MAIL|TEL|ADDRESS|VILLE|HOPITAL|DATE|IPP|NDA|SSID|ZIP)_[A-Fa-f0-9]+\]?"
DATE_FIELDS = sorted(n for n, f in schema.FIELDS.items() if f["type"] == "date")


def error_cause(feature: Column, error: Column, predicted: Column, gold: Column, extractable: Column, text: Column) -> Column:
    """Why an extraction failed, the first that holds: a pseudonym was predicted; the field of an omission was never
    looked for; a date altered; an omitted value that first appears in the last 30 % of the text; an alteration that
    differs by case and two accents; one that is the same text; else hallucination, format_mismatch for alterations."""
    p, g = F.coalesce(predicted, F.lit("")), F.coalesce(gold, F.lit(""))
    omitted, altered, both = error == "omission", error == "alteration", (p != "") & (g != "")
    bare = lambda c: F.translate(F.lower(F.trim(c)), "éè", "ee")
    at = F.instr(F.lower(text), F.lower(g)) - 1
    return (
        F.when(p.rlike(_TOKEN), "pseudo_token").when(omitted & ~F.array_contains(extractable, feature), "routing_omission").when(altered & feature.isin(DATE_FIELDS), "date_mismatch")
        .when(omitted & (g != "") & (at >= 0) & (at > F.length(text) * 0.7), "truncation").when(altered & both & (bare(p) == bare(g)), "format_mismatch")
        .when(altered & both & (F.trim(p) == F.trim(g)), "type_mismatch").when(error.isin("hallucination", "omission"), "hallucination").otherwise("format_mismatch")
    )


def json_schema(group: str) -> dict:
    """JSON schema of a field group: nullable values, enumerations where a vocabulary is set, and a source each."""
    out: dict = {}
    for name, f in schema.FIELDS.items():
        if f["grp"] == group:
            kind = "integer" if f["type"] == "integer" else "string"
            out[name] = {"enum": [*sorted(schema.allowed(f["vocabulary"])), None]} if f["vocabulary"] != "-" else {"type": [kind, "null"]}
            out[f"{name}_source"] = {"type": ["string", "null"]}
    return {"type": "object", "properties": out, "required": sorted(n for n in out if not n.endswith("_source"))}


def who_years(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs(doc_id, text): a tenth of the classifications of 2021 become 2007, two tenths 2016, by seeded hash; lengths stay."""
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(10))
    year = F.when(u < 1, "2007").when(u < 3, "2016").otherwise("2021")
    return docs.withColumn("text", F.regexp_replace(F.col("text"), F.lit(r"(OMS|WHO) 2021"), F.concat(F.lit("$1 "), year)))


def latex(rows: list[dict], columns: list[str]) -> str:
    """A small results table as LaTeX."""
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = "\n".join(" & ".join(cell(r[c]) for c in columns) + r" \\" for r in rows)
    return "\\begin{tabular}{" + "l" * len(columns) + "}\n" + " & ".join(c.replace("_", r"\_") for c in columns) + " \\\\\n\\hline\n" + body + "\n\\end{tabular}"


def ablation_records(facts: DataFrame) -> DataFrame:
    """facts(doc_id, extractor, field, value) -> a JSON text for each document, one map for each extractor."""
    by = facts.filter("value is not null").groupBy("doc_id", "extractor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("m"))
    return by.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extractor", F.to_json("m").alias("j")))))).alias("json"))


def salt(path: str) -> str:
    """A secret beside a database: made once, URL-safe, never part of any output."""
    import base64
    import os
    import secrets

    try:
        fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
    except FileExistsError:
        with open(path) as f:
            return f.read()
    made = base64.urlsafe_b64encode(secrets.token_bytes(32)).decode()
    with os.fdopen(fd, "w") as f:
        f.write(made)
    return made
