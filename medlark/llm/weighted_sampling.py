"""Document fingerprints by consistent weighted sampling.

A text is the set of its words weighted by their counts. Sample k of a word of weight w draws r and c from
Gamma(2, 1) and beta from U(0, 1), all from a hash of (word, k); with t = floor(ln w / r + beta) the word competes
with ln a = ln c - r (t - beta + 1), and the sample is the (word, t) of the least. Two texts agree in a sample with
probability equal to their generalised Jaccard similarity, sum of min over sum of max of the weights. Every distinct
word competes in all `SAMPLES` samples, so the rate of agreement estimates that similarity for weights of any shape,
with a standard error of at most 1 / (2 sqrt(SAMPLES)), 0.0625.

Gamma variates come from tables of 2 ** TABLE_BITS quantiles, indexed by bits of the hash: two reads of an array in
place of three logarithms a draw. The highest cell of r and the lowest of c have a table of their own, down to
2 ** -20; beta has 20 bits, so ties between words stay rare.

A sample is 16 bits of the winner's hash; the fingerprint string is the samples in hex.

Defined results: null text counts as empty; texts without words have empty samples (ffff), are fully alike each other
and unlike all else; null doc_ids come first in the order of documents; of equal doc_ids the row read first comes
first; equal texts have equal fingerprints, repeated rows each have their own; a text of any length is drawn whole, row
by row; a single document is its own next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import constants, durable, read, text_or_empty, words

SAMPLES, TABLE_BITS = 64, 10


def _gamma_quantiles(below: list[float]) -> list[float]:
    """The quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), at 1 - u for each u, by bisection."""
    out = []
    for u in below:
        low, high = 0.0, 60.0
        for _ in range(90):
            x = (low + high) / 2
            # near 0 the distribution is x**2 / 2 - x**3 / 3 + x**4 / 8, where 1 - u would be lost in rounding
            less = x * x / 2 - x**3 / 3 + x**4 / 8 < -u if u < 0 else (1 + x) * math.exp(-x) > u
            low, high = (x, high) if less else (low, x)
        out.append((low + high) / 2)
    return out


_N = 1 << TABLE_BITS
_GAMMA = _gamma_quantiles([1 - (i + 0.5) / _N for i in range(_N)])
#: The highest cell of r and the lowest of c decide who wins among many words: a table for each of them again.
_HIGH = _gamma_quantiles([(i + 0.5) / _N**2 for i in range(_N)])
_LOW = _gamma_quantiles([-(i + 0.5) / _N**2 for i in range(_N)])
_TABLES = {"_gamma": _GAMMA, "_log_gamma": list(map(math.log, _GAMMA)), "_high": _HIGH, "_log_low": list(map(math.log, _LOW))}


def _draw(x: Column, k: int, log_weight: Column) -> Column:
    """An order-preserving long for (ln a, winner's 16 bits) of sample k, from the 64-bit hash x of a word; the tables
    are columns by the names of _TABLES."""
    y = F.xxhash64(x.bitwiseXOR(F.lit(k * 0x9E3779B97F4A7C15 % (1 << 63))))
    index = lambda h, shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_N - 1)).cast("int")
    r = F.when(index(y, 0) == _N - 1, F.get("_high", index(F.xxhash64(y), 0))).otherwise(F.get("_gamma", index(y, 0)))
    log_c = F.when(index(y, TABLE_BITS) == 0, F.get("_log_low", index(F.xxhash64(y), TABLE_BITS))).otherwise(F.get("_log_gamma", index(y, TABLE_BITS)))
    beta = (F.shiftrightunsigned(y, 24).bitwiseAND(F.lit((1 << 20) - 1)).cast("double") + 0.5) * 2.0**-20
    t = F.floor(log_weight / r + beta)
    log_a = log_c - r * (t - beta + 1)
    # log_a lies within (-60, 10): 40 bits for it, 16 for the winner, which are bits of y that nothing else uses.
    winner = (F.shiftrightunsigned(y, 44) + t * 40503).bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(((log_a + 64) * float(1 << 33)).cast("long"), 16).bitwiseOR(winner)


def counted_words(text: Column) -> list[tuple[str, Column]]:
    """Steps that end in `_terms`: an array of struct(word, n), without leaving the row."""
    s = F.col("_sorted")
    starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
    terms = F.transform("_starts", lambda p, i: F.struct(F.get(s, p - 1).alias("word"), (F.coalesce(F.get(F.col("_starts"), i + 1), F.size(s) + 1) - p).alias("n")))
    none = F.array().cast("array<int>")
    return [("_sorted", F.sort_array(words(text))), ("_starts", F.when(F.size(s) > 0, starts).otherwise(none)), ("_terms", terms)]


def signatures(texts: DataFrame, keep: list[str], kinds: int = 1, samples: int = SAMPLES) -> DataFrame:
    """texts(keep..., kind, text); keep and kind identify a row -> a row for each keep, with sig_<kind> (an int for each
    sample, -1 where there are no words). No exchange when texts are already partitioned by some of keep."""
    rows = texts
    for name, col in counted_words(text_or_empty()):
        rows = rows.withColumn(name, col)
    # The tables are columns, not literals in every draw, so that a task holds them once.
    tables = [F.when(F.size("_terms") >= 0, constants(x)).alias(n) for n, x in _TABLES.items()]
    terms = rows.select(*keep, "kind", "_terms", *tables).select(*keep, "kind", *_TABLES, F.explode_outer("_terms").alias("_t"))
    terms = terms.select(*keep, "kind", *_TABLES, F.xxhash64("_t.word").alias("_x"), F.ln(F.col("_t.n").cast("double")).alias("_w"))
    draws = [F.min(_draw(F.col("_x"), k, F.col("_w"))).alias(f"_m{k}") for k in range(samples)]
    least = terms.groupBy(*keep, "kind").agg(*draws)
    low = [F.coalesce(F.col(f"_m{k}").bitwiseAND(F.lit(0xFFFF)).cast("int"), F.lit(-1)) for k in range(samples)]
    found = least.select(*keep, "kind", F.array(*low).alias("_s")).groupBy(*keep).agg(*[F.max(F.when(F.col("kind") == i, F.col("_s"))).alias(f"sig_{i}") for i in range(kinds)])
    return found


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Estimated generalised Jaccard similarity of two signatures: the share of samples in which they agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(1)).otherwise(0)), F.lit(0), lambda s, v: s + v) / F.lit(float(samples))


def as_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit(0xFFFF)))), 4, "0")), "")


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(rid, doc_id, text) -> the same with bucket, a range of the ascending order of (doc_id, rid), and ghost.

    The first document of each range is also put, as a ghost, into the range before it (that of the first range
    into the last), so that every document's successor is in its bucket. Ranges come from a narrow pass; their at
    most `buckets` bounds are broadcast, spread over a grid of doc_id so that a row meets few of them. A rid must be
    the same at every read of docs, as it is for the row numbers of a stored table."""
    spark = docs.sparkSession
    ids = durable(docs.select("rid", "doc_id"))
    parts = ids.repartitionByRange(buckets, "doc_id", "rid").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.max("doc_id").alias("last"))
    firsts = sorted(((r.first.doc_id, r.first.rid, r.last) for r in parts.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    if not firsts:
        firsts = [(None, -1, None)]
    known = [x for f in firsts for x in (f[0], f[2]) if x is not None]
    low, high, n = min(known, default=0), max(known, default=0), len(firsts)
    width = max(1, -(-(high - low + 1) // (4 * n)))
    cell = lambda x: 0 if x is None else (x - low) // width
    rows = []
    for k, (first, rid, _) in enumerate(firsts):
        end = firsts[k + 1][:2] if k + 1 < n else (None, None)
        for c in range(cell(first), cell(end[0] if k + 1 < n else high) + 1):
            rows.append((c, k, (k - 1) % n, first, rid, *end, k + 1 == n))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = F.broadcast(spark.createDataFrame(rows, f"_cell long, bucket int, _before int, _first {kind}, _first_rid long, _end {kind}, _end_rid long, _last boolean"))
    here = F.struct(F.col("doc_id").alias("i"), F.col("rid").alias("r"))
    inside = (here >= F.struct(F.col("_first").alias("i"), F.col("_first_rid").alias("r"))) & (F.col("_last") | (here < F.struct(F.col("_end").alias("i"), F.col("_end_rid").alias("r"))))
    found = docs.withColumn("_cell", F.coalesce(F.floor((F.col("doc_id") - low) / width), F.lit(0)).cast("long")).join(ranges, "_cell").filter(inside)
    own = F.struct(F.col("bucket"), F.lit(False).alias("ghost"))
    both = F.when(F.col("rid") == F.col("_first_rid"), F.array(own, F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("ghost")))).otherwise(F.array(own))
    return found.select(*docs.columns, F.explode(both).alias("_at")).select(*docs.columns, "_at.*")


def op3_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_or_empty().alias("text"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", "rid")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    near = bucketed(docs, buckets).withColumn("_next", F.lead("text").over(order)).withColumn("n_chars", n)
    near = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half))).withColumn("sha", F.sha2("edited", 256))
    texts = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    keep = ["bucket", "ghost", "rid", "doc_id", "n_chars", "sha"]
    sigs = signatures(near.select(*keep, F.explode(texts).alias("_")).filter("not (ghost and _.kind = 1)").select(*keep, "_.*"), keep, kinds=2)
    sigs = sigs.withColumn("n_sig", F.lead("sig_0").over(order)).filter("not ghost")
    own, edited, after = F.col("sig_0"), F.col("sig_1"), F.col("n_sig")
    return sigs.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), as_string(own).alias("fingerprint"),
        as_string(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"), likeness(own, after).alias("near_next"),
    )
