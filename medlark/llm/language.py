"""Language identification by Bayesian fusion of evidence.

For every row, the log posterior of language l is the sum of
- the tempered log-likelihood of the text under a model of hashed byte trigrams, trained on labelled documents;
- the log probability of the declared markup language and of the address suffix given l, tables counted over the
  whole input with smoothing;
- the log prior of l on the row's host, smoothed towards its domain, smoothed towards the global prior; counts are
  grouped sums of text posteriors, from which the row's own part is taken away.
A class `und`, under which all trigrams are equally likely, catches what is no language; it is rejected.

Text likelihoods come from a vectorised Arrow pass and everything after it is narrow: groups are pre-aggregated
sums over hosts and domains, never gathered.

Defined results: null text counts as empty and leaves the priors to decide; null host, declaration or suffix are
values of their own and carry no evidence of a language; a row without text and without any evidence is `und`;
unknown declared codes count as other; of languages with equal posteriors the first by name wins; repeated rows are
separate rows; a text of any length is read whole, in slices; where no row has a usable label there is no language to
learn, and no row is rejected; more than MAX_LANGUAGES labels are an error, not cut; an empty table gives an empty
result; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import constants, durable, read, stored

#: Labelled documents of each language that the text model is fitted on: those of the least hash, whole.
TRAIN_ROWS = 1000
#: A table of a language has 2 ** BINS_BITS floats; labels beyond MAX_LANGUAGES mean that the column isn't a language.
BINS_BITS, MAX_LANGUAGES = 15, 1000
#: Trigrams overlap and words repeat, so a text speaks with this share of its trigrams.
TEMPER = 0.2
#: Bytes of text that a worker takes at a time; a trigram needs some 30 bytes of memory.
AT_ONCE = 4 << 20
HOST_STRENGTH, DOMAIN_STRENGTH, UNKNOWN = 20.0, 50.0, "und"


def _trigrams(texts):
    """Arrow strings without nulls -> (bin of each trigram of bytes, number of trigrams of each text)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.utf8_lower(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not sizes.sum():
        return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32)
    raw[(raw < 65) & (raw != 10)] = 32  # digits and signs tell no language
    bins = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BINS_BITS) if len(raw) > 2 else np.zeros(0, dtype=np.uint32)
    inside = np.ones(len(raw), dtype=bool)  # a trigram must not reach into the next text
    stops = np.cumsum(sizes)
    for back in (1, 2):
        inside[stops[sizes >= back] - back] = False
    return bins[inside[: len(bins)]], np.maximum(sizes - 2, 0)


def _count(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from .arrowtext import slices

    counts: dict = {}
    for b in (part for whole in batches for part in slices(whole, "text", AT_ONCE)):
        for lang in pc.unique(b.column("lang")).to_pylist():
            bins, _ = _trigrams(b.filter(pc.equal(b.column("lang"), lang)).column("text"))
            counts[lang] = counts.get(lang, 0) + np.bincount(bins, minlength=1 << BINS_BITS)
    if counts:
        yield pa.RecordBatch.from_pydict({"lang": list(counts), "n": [c.astype(np.int64) for c in counts.values()]}, schema=pa.schema([("lang", pa.string()), ("n", pa.list_(pa.int64()))]))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], list]:
    """labelled(doc_id, text, lang) -> (languages, their log probabilities by bin). Fitted on `rows` rows of each
    language at most, so a rare language is learned as well as it can be."""
    import numpy as np

    known = stored(labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang"))
    known = known.withColumn("row", F.monotonically_increasing_id())
    # The choice is made on narrow rows; the rank is limited before the shuffle, so a hot language gathers nothing.
    hashed = known.select("row", "lang", F.xxhash64("doc_id").alias("h"), "doc_id")
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "row"))).filter(F.col("rank") <= rows)
    chosen = durable(ranked.select("row", "lang"))
    names = [r.lang for r in chosen.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    sample = known.join(F.broadcast(chosen.select("row")), "row", "left_semi").select("text", "lang")  # at most rows * MAX_LANGUAGES numbers
    counts: dict = {}
    for r in sample.repartition(4).mapInArrow(_count, "lang string, n array<long>").toLocalIterator():  # 4 tasks, a row a language each
        counts[r.lang] = counts.get(r.lang, 0) + np.array(r.n, dtype=np.float64)
    languages = sorted(counts)
    return languages, [np.log((counts[k] + 0.5) / (counts[k].sum() + 0.5 * (1 << BINS_BITS))).astype(np.float32) for k in languages]


def likelihoods(tables: list) -> Callable:
    """mapInArrow function: (.., text) -> the same without text, with ll: log-likelihoods of the languages, then
    of the unknown class."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .arrowtext import slices, sums

        flat = -math.log(1 << BINS_BITS)
        for b in (part for whole in batches for part in slices(whole, "text", AT_ONCE)):
            bins, sizes = _trigrams(b.column("text"))
            ll = np.stack([*[sums(t[bins].astype(np.float64), sizes) for t in tables], sizes * flat], axis=1)
            names = [n for n in b.schema.names if n != "text"]
            made = pa.FixedSizeListArray.from_arrays(pa.array(ll.reshape(-1)), ll.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], made], names=[*names, "ll"])

    return run


def _normal(logs: Column) -> Column:
    """Probabilities from logs."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda s, v: s + v))


def _vector_sum(name: str, n: int) -> list[Column]:
    return [F.sum(F.get(name, F.lit(i))).alias(f"s{i}") for i in range(n)]


def _gathered(n: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(n)])


def identify(rows: DataFrame, languages: list[str], tables: list) -> DataFrame:
    """rows(key columns..., text, host, declared, suffix) -> key columns, lang, posterior, text_lang, kept."""
    keys = [c for c in rows.columns if c not in ("text", "host", "declared", "suffix")]
    n = len(languages) + 1
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    said = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(None)).when(F.col(c).isin(languages), F.col(c)).otherwise("other")
    narrow = rows.select(*keys, "host", F.when(domain == "", F.col("host")).otherwise(domain).alias("domain"), said("declared").alias("declared"), said("suffix").alias("suffix"), F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text") + ", ll array<double>"
    coded = narrow.mapInArrow(likelihoods(tables), schema)
    prior = constants([math.log(0.98 / max(1, len(languages)))] * len(languages) + [math.log(0.02)])
    text_post = _normal(F.zip_with(F.transform("ll", lambda x: x * TEMPER), prior, lambda a, b: a + b))
    coded = durable(coded.withColumn("p", text_post))
    # Grouped evidence; each is a sum of posteriors by key.
    hosts = coded.groupBy("host", "domain").agg(*_vector_sum("p", n)).select("host", "domain", _gathered(n).alias("host_n"))
    hosts = durable(hosts)
    domains = hosts.groupBy("domain").agg(*_vector_sum("host_n", n)).select("domain", _gathered(n).alias("domain_n"))
    total = [float(x or 0.0) for x in hosts.agg(*_vector_sum("host_n", n)).first()]
    base = [(x + 1.0) / (sum(total) + n) for x in total]
    heard = {}
    for c in ("declared", "suffix"):  # at most MAX_LANGUAGES + 1 rows each
        got = coded.filter(F.col(c).isNotNull()).groupBy(c).agg(*_vector_sum("p", n)).collect()
        values = [*languages, "other"]
        found = {r[0]: [float(r[i + 1]) for i in range(n)] for r in got}
        sums = [sum(v[i] for v in found.values()) + len(values) for i in range(n)]
        heard[c] = {v: [math.log((found.get(v, [0.0] * n)[i] + 1.0) / sums[i]) for i in range(n)] for v in values}
    spread = coded.join(hosts.select("host", "host_n"), coded.host.eqNullSafe(hosts.host), "left").drop(hosts.host)
    spread = spread.join(domains, spread.domain.eqNullSafe(domains.domain), "left").drop(domains.domain)

    def smoothed(counts: Column, own: Column, below: Column, strength: float) -> Column:
        left = F.zip_with(counts, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        size = F.aggregate(left, F.lit(0.0), lambda s, v: s + v)
        return F.transform(F.arrays_zip(left.alias("l"), below.alias("b")), lambda x: (x.l + strength * x.b) / (size + strength))

    spread = spread.withColumn("by_domain", smoothed(F.col("domain_n"), F.col("p"), constants(base), DOMAIN_STRENGTH))
    spread = spread.withColumn("by_host", F.when(F.col("host").isNull(), constants(base)).otherwise(smoothed(F.col("host_n"), F.col("p"), F.col("by_domain"), HOST_STRENGTH)))
    silent = constants([0.0] * n)
    logs = F.transform(F.arrays_zip(F.col("ll").alias("a"), F.col("by_host").alias("b")), lambda x: x.a * TEMPER + F.ln(x.b))
    for c in ("declared", "suffix"):
        told = silent
        for v, row in heard[c].items():
            told = F.when(F.col(c) == v, constants(row)).otherwise(told)
        logs = F.zip_with(logs, told, lambda a, b: a + b)
    out = spread.withColumn("post", _normal(logs)).withColumn("best", F.array_position("post", F.array_max("post")).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in [*languages, UNKNOWN]]), F.col("best"))
    mute = (F.array_min("ll") == 0) & F.col("host").isNull() & F.col("declared").isNull() & F.col("suffix").isNull()
    text_name = F.element_at(F.array(*[F.lit(x) for x in [*languages, UNKNOWN]]), F.array_position("p", F.array_max("p")).cast("int"))
    out = out.withColumn("lang", F.when(mute, F.lit(UNKNOWN)).otherwise(name))
    return out.select(*keys, "lang", F.round(F.array_max("post"), 6).alias("posterior"), text_name.alias("text_lang"), ((F.col("lang") != UNKNOWN) | F.lit(not languages)).alias("kept"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, text, host, declared, suffix."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    top = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>|&[#A-Za-z0-9]+;", " ")
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", text.alias("text"), blank(host).alias("host"), blank(declared).alias("declared"), F.coalesce(blank(path), blank(top)).alias("suffix"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, text, host, declared, suffix; a source takes the place of a host. The
    column lang is what the model is trained on, hence no evidence."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.col("source").alias("host"), none.alias("declared"), none.alias("suffix"))


def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; doc_id is null for pages, page_id for documents."""
    docs = read(spark, sf_dir, "documents")
    languages, tables = train(docs)
    none = F.lit(None).cast("long")
    d = document_evidence(docs).select("doc_id", none.alias("page_id"), "text", "host", "declared", "suffix")
    p = page_evidence(read(spark, sf_dir, "pages")).select(none.alias("doc_id"), "page_id", "text", "host", "declared", "suffix")
    return identify(d.unionByName(p), languages, tables)


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those whose language is rejected."""
    rows = stored(docs)
    languages, tables = train(rows)
    numbered = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    none = F.lit(None).cast("string")
    evidence = numbered.select("row", "doc.text", F.col("doc.source").alias("host"), none.alias("declared"), none.alias("suffix"))
    gone = durable(identify(evidence, languages, tables).filter(~F.col("kept")).select(F.col("row").alias("gone")))
    return numbered.join(gone, F.col("row") == F.col("gone"), "left_anti").select("doc.*")
