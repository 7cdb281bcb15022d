"""Work on annotated documents: profile checks, quality filters, chunks, augmentation, repair, ordered encryption."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlark.functions.similarity import ratio
from medlark.operators.merge import best


def column_differences(a: DataFrame, b: DataFrame) -> list[tuple[str, bool, bool]]:
    """(column, in a, in b) for every column that only one side has; empty when the sets are equal."""
    return [(c, c in a.columns, c in b.columns) for c in sorted({*a.columns} ^ {*b.columns})]


def same_columns(a: DataFrame, b: DataFrame) -> None:
    """Refuse two tables whose column sets differ."""
    if found := column_differences(a, b):
        raise ValueError(f"columns differ: {', '.join(c for c, _, _ in found)}")


def profile_agreement(profiles: DataFrame, entities: DataFrame, documents: DataFrame, least: float = 80.0) -> DataFrame:
    """profiles(patient_id, field, value) joined to the entities(doc_id, field, value) of documents(doc_id, patient_id):
    doc_id, checked and agreed, the fields that both sides have and those whose values come close. Every document has a
    row; equal values need no measure."""
    clean = lambda c: F.lower(F.trim(c))
    mine = entities.filter("value is not null").join(documents.select("doc_id", "patient_id"), "doc_id").select("doc_id", "patient_id", "field", clean(F.col("value")).alias("e"))
    both = mine.join(profiles.filter("value is not null").select("patient_id", "field", clean(F.col("value")).alias("p")), ["patient_id", "field"])
    unequal = F.col("e") != F.col("p")
    scored = both.withColumn("r", ratio(F.when(unequal, F.col("e")), F.when(unequal, F.col("p"))))
    agreed = ~unequal | F.coalesce(F.col("r") >= least, F.lit(False))
    sums = scored.groupBy("doc_id").agg(F.count("*").alias("checked"), F.count_if(agreed).alias("agreed"))
    return documents.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("checked", F.lit(0)).cast("long").alias("checked"), F.coalesce("agreed", F.lit(0)).cast("long").alias("agreed"))


def verdict(rate: Column, reject: float, review: float) -> Column:
    """reject, review or pass of a share; what can't be measured passes."""
    return F.when(rate < reject, "reject").when(rate < review, "review").otherwise("pass")


def resolution_filter(total: Column, unresolved: Column, reject: float = 0.7, review: float = 0.9) -> Column:
    """The share of resolved annotations; a document without any is rejected."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, "reject").otherwise(verdict((total - unresolved) / total, reject, review))


def length_filter(text: Column, least: int = 200, most: int = 6000) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when((n < least) | (n > most), "review").otherwise("pass")


def _borders(texts: pa.Array, size: int, overlap: int, most: int = 1 << 23) -> pa.Array:
    """Arrow strings without nulls -> for each, its chunks: start, end and own (where the words not shared with the chunk
    before begin), in characters. Bytes are looked at, in runs of texts of at most `most` bytes, a longer text on its own."""
    texts, stride = texts.cast(pa.large_string()), size - overlap
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    counts, parts, at = [np.zeros(1, dtype=np.int32)], [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        b, edges = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        space = (b == 0x20) | (b - np.uint8(9) <= 4)
        begins = ~space
        begins[1:] &= space[:-1]
        heads = edges[:-1][edges[:-1] < edges[1:]]
        begins[heads] = ~space[heads]
        words, inner = np.flatnonzero(begins), np.flatnonzero(b & 0xC0 == 0x80)  # bytes within a character
        first = np.searchsorted(words, edges)
        n = np.diff(first)
        whole = n <= size
        count = np.where(whole, 1, -((overlap - n) // stride))
        d = np.repeat(np.arange(to - at), count)
        k = np.arange(len(d)) - np.repeat(np.cumsum(count) - count, count)
        word = lambda i: words[np.minimum(first[d] + i, max(0, len(words) - 1))] if len(words) else edges[d]  # noqa: B023, E731
        start = np.where(whole[d], edges[d], word(k * stride))
        end = np.where(whole[d] | (k * stride + size >= n[d]), edges[d + 1], word(k * stride + size))
        own = np.where(k == 0, edges[d], word(k * stride + overlap))
        characters = lambda x: x - np.searchsorted(inner, x)  # noqa: B023, E731
        parts.append(np.stack([characters(x) - characters(edges[d]) for x in (start, end, own)]).astype(np.int32))
        counts.append(count.astype(np.int32))
        at = to
    flat = pa.StructArray.from_arrays([pa.array(x) for x in (np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), dtype=np.int32))], ["start", "end", "own"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts), dtype=np.int32)), flat)


def token_chunks(docs: DataFrame, size: int = 1800, overlap: int = 200) -> DataFrame:
    """docs(doc_id, text, entities: array of struct(start, end, label)) -> doc_id, chunk, start, text, entities: runs of
    `size` words that overlap by `overlap`, entities moved along. An entity must lie in the chunk; one that starts in
    the words shared with the chunk before stays with that one. White space is that of ASCII. Only the borders of the
    chunks come from Python, which reads each text once; no built-in tells where words begin."""

    # made at the call: a worker that imports this module has no session
    @F.arrow_udf("array<struct<start:int,end:int,own:int>>")
    def borders(texts: pa.Array) -> pa.Array:
        return _borders(texts, size, overlap)

    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_borders", borders("text"))
    each = rows.select("doc_id", "text", "entities", F.posexplode("_borders").alias("chunk", "_b")).select("doc_id", "text", "entities", "chunk", F.col("_b.start").alias("start"), F.col("_b.end").alias("_end"), F.col("_b.own").alias("_own"))
    inside = F.filter("entities", lambda e: (e["start"] >= F.col("start")) & (e["end"] <= F.col("_end")) & (e["start"] >= F.col("_own")))
    moved = F.transform(inside, lambda e: F.struct((e["start"] - F.col("start")).alias("start"), (e["end"] - F.col("start")).alias("end"), e["label"].alias("label")))
    return each.select("doc_id", "chunk", "start", F.substring("text", F.col("start") + 1, F.col("_end") - F.col("start")).alias("text"), moved.alias("entities"))


def augmented(docs: DataFrame, seed: int = 42, share: float = 0.1) -> DataFrame:
    """docs(doc_id, text, entities: array of struct(start, end, label)) -> the same with typing errors outside of the
    entities: by seeded hash of document and word, a word loses its accents or has its second letter doubled; entities
    move with the text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array_sort("entities").alias("entities"))
    n = F.size("entities")
    cuts = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get("entities", i - 1)["end"]).alias("a"), F.coalesce(F.get("entities", i)["start"], F.length("text")).alias("b")))
    rows = rows.withColumn("_cuts", cuts)
    odd = lambda w, i, j: F.pmod(F.xxhash64("doc_id", i, j, w, F.lit(seed)), F.lit(1000))
    plain = lambda w: F.translate(w, "éèêëàâîïôùûç", "eeeeaaiiouuc")
    doubled = lambda w: F.concat(F.substring(w, 1, 2), F.substring(w, 2, 1), F.substring(w, F.lit(3), F.length(w)))
    typo = lambda w, i, j: F.when(odd(w, i, j) < int(share * 500), plain(w)).when((odd(w, i, j) < int(share * 1000)) & w.rlike(r"^\p{L}{4,}$"), doubled(w)).otherwise(w)
    piece = lambda c, i: F.array_join(F.transform(F.split(F.substring(F.col("text"), c["a"] + 1, F.greatest(c["b"] - c["a"], F.lit(0))), " "), lambda w, j: typo(w, i, j)), " ")
    rows = rows.withColumn("_pieces", F.transform("_cuts", piece))
    kept = F.transform("entities", lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]))
    joined = F.array_join(F.flatten(F.transform("_pieces", lambda p, i: F.when(i < n, F.array(p, F.get(kept, i))).otherwise(F.array(p)))), "")
    shift = lambda i: F.aggregate(F.slice(F.arrays_zip(F.col("_pieces").alias("p"), F.col("_cuts").alias("c")), F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x["p"]) - F.greatest(x["c"]["b"] - x["c"]["a"], F.lit(0)))
    moved = F.transform("entities", lambda e, i: F.struct((e["start"] + shift(i)).alias("start"), (e["end"] + shift(i)).alias("end"), e["label"].alias("label")))
    return rows.select("doc_id", joined.alias("text"), moved.alias("entities"))


def repaired(annotations: DataFrame, names: list[str], least: float = 60.0) -> DataFrame:
    """annotations(doc_id, text, field, value, span) -> doc_id, field, value, span, status: an unknown field takes the
    closest known name (renamed) or goes; a span must occur in the text, whatever its case; a value must be in its span,
    whole or by half of its longer words, else the first place of the value in the text becomes the span (repaired), or
    the annotation goes. Only unknown names, made distinct, are measured."""
    lower = lambda c: F.lower(F.trim(c))
    rows = annotations.filter("value is not null and span is not null")
    odd = rows.select("field").distinct().filter(~F.col("field").isin(names))
    pairs = odd.select("field", F.explode(F.array(*[F.lit(n) for n in names])).alias("name")).withColumn("r", ratio("field", "name")).filter(F.col("r") >= least)
    known = best(pairs, ["field"], F.col("r").desc(), F.col("name")).select("field", F.col("name").alias("_name"))
    named = rows.join(known, "field", "left").withColumn("_f", F.when(F.col("field").isin(names), F.col("field")).otherwise(F.col("_name"))).filter("_f is not null")
    text = F.lower(F.coalesce("text", F.lit("")))
    present = named.filter((F.col("span") == "") | text.contains(F.lower("span")))
    tokens = F.filter(F.split(lower(F.col("value")), r"\s+"), lambda w: F.length(w) > 2)
    hits = F.size(F.filter(tokens, lambda w: F.lower("span").contains(w)))
    within = F.lower("span").contains(lower(F.col("value"))) | (F.size(tokens) == 0) | (hits >= F.greatest(F.lit(1.0), F.size(tokens) * 0.5))
    at = F.instr(text, lower(F.col("value")))
    status = F.when(within, F.when(F.col("field") == F.col("_f"), "kept").otherwise("renamed")).when((at > 0) & (F.length(lower(F.col("value"))) >= 2), "repaired")
    out = present.withColumn("status", status).filter("status is not null")
    return out.select("doc_id", F.col("_f").alias("field"), "value", F.when(F.col("status") == "repaired", F.substring("text", at, F.length(lower(F.col("value"))))).otherwise(F.col("span")).alias("span"), "status")


def ordered_cipher(value: Column, key: str, size: int = 3000, most: int = 1 << 20) -> Column:
    """Order-preserving encryption of whole numbers in [0, size): the sum of keyed pseudo-random steps of 1 to `most` up
    to the value. Equal numbers have equal ciphers, greater ones greater; numbers outside the domain are null."""
    total, out = 0, []
    for i in range(size):
        total += 1 + int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "big") % most
        out.append(total)
    table = F.split(F.lit(",".join(map(str, out))), ",").cast("array<long>")
    return F.when((value >= 0) & (value < size), F.get(table, value.cast("int")))


def profile_summary(profiles: DataFrame, documents: DataFrame) -> DataFrame:
    """profiles(patient_id, sex, deceased), documents(patient_id, doc_type): measure, value, n - patients by sex, the
    deceased, the patient_ids that occur more than once, and documents by type, in two passes of small counts."""
    one = lambda rows, name, c: rows.groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "value", "n")
    repeats = profiles.groupBy("patient_id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("duplicates").alias("measure"), F.lit("patients").alias("value"), "n")
    return one(profiles, "sex", F.col("sex")).unionByName(one(profiles, "deceased", F.col("deceased"))).unionByName(repeats).unionByName(one(documents, "doc_type", F.col("doc_type")))
