"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is 1 when it is set in over half of the XXH64 values of a text's 3-word shingles. Two
fingerprints within `MAX_BITS` differing bits differ by at most MAX_BITS // SEGMENTS bits in some segment, so
every fingerprint enumerates the small Hamming ball around each of its segments, fetches the fingerprints that the
table holds under those values, and verifies the whole distance. With two 32-bit segments and balls of radius 1
that is 66 probes, and a bucket is one of 2**32 values, so buckets stay small as the table grows.

Equal fingerprints are folded first: one table row stands for all copies, whatever their number, and links exist
between different fingerprints only. A pair seen in two segments is kept by the first, without a distinct.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; component_id
ignores null doc_ids (null when a whole component has none); repeated rows count as separate documents; a bit set in
exactly half the shingles is 0; a text of any length is hashed whole; an empty table gives an empty result; other
columns pass through `drop_near_duplicates` untouched.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, durable, read, stored, text_or_empty, words
from .components import components

WIDTH, MAX_BITS, SEGMENTS = 3, 3, 2


def shingle_hashes(text: str = "text", width: int = WIDTH) -> list:
    """Steps that turn a text column into `_h`, the hashes of its shingles; to be applied in this order."""
    w = F.col("_w")
    shingles = F.transform(F.slice(w, 1, F.size(w) - (width - 1)), lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, width)])))
    whole = F.array(F.xxhash64(F.array_join(w, " ")))
    return [("_w", words(ascii_lower(text_or_empty(text)))), ("_h", F.when(F.size(w) >= width, shingles).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>")))]


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(text, ...) -> keep columns and `fp` (long), a row for every row of docs."""
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), "text")
    for name, col in shingle_hashes():
        rows = rows.withColumn(name, col)
    h = rows.select(*keep, "_row", F.explode_outer("_h").alias("_x"))
    # Bit i and bit i + 32 are counted in the two halves of one sum.
    lanes = [F.sum(F.shiftrightunsigned("_x", i).bitwiseAND(F.lit(0x0000000100000001))).alias(f"_s{i}") for i in range(32)]
    sums = h.groupBy(*keep, "_row").agg(F.count("_x").alias("_n"), *lanes)
    bit: list[Column] = []
    for i in range(32):
        s = F.coalesce(F.col(f"_s{i}"), F.lit(0))
        bit.append(F.when(2 * s.bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("_n"), F.lit(1 << i)).otherwise(F.lit(0).cast("long")))
        high = (1 << (i + 32)) - ((1 << 64) if i == 31 else 0)
        bit.append(F.when(2 * F.shiftrightunsigned(s, 32) > F.col("_n"), F.lit(high)).otherwise(F.lit(0).cast("long")))
    fp = bit[0]
    for b in bit[1:]:
        fp = fp.bitwiseOR(b)
    return sums.select(*keep, fp.cast("long").alias("fp"))


def near_pairs(table: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """table(fp), distinct -> (a, b), a < b, for all pairs with 1 to max_bits differing bits."""
    width = 64 // segments
    radius, mask = max_bits // segments, (1 << width) - 1
    ball = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    part = lambda fp, s: F.shiftrightunsigned(fp, s * width).bitwiseAND(F.lit(mask))
    key = lambda s, value: F.shiftleft(F.lit(s).cast("long"), width).bitwiseOR(value)
    spots = [F.struct(F.lit(s).alias("s"), key(s, part(F.col("fp"), s)).alias("key")) for s in range(segments)]
    index = table.select(F.col("fp").alias("b"), F.explode(F.array(*spots)).alias("_")).select("b", "_.key")
    own = table.select(F.col("fp").alias("a"), F.explode(F.array(*spots)).alias("_")).select("a", "_.s", F.col("_.key").alias("k"))
    probes = own.withColumn("m", F.explode(F.array(*[F.lit(m).cast("long") for m in ball]))).select("a", "s", F.col("k").bitwiseXOR(F.col("m")).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(True)
    for s in range(segments - 1):
        first = first & ((F.col("s") <= s) | (F.bit_count(part(differ, s)) > radius))
    hit = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & first
    # Sizes of exploded tables are underestimated: ask for the join that needs no side in memory.
    return probes.hint("merge").join(index, "key").filter(hit).select("a", "b")


def near_duplicates(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp), stored -> the same with n_near and component_id."""
    table = durable(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")))
    links = durable(near_pairs(table.select("fp")))
    both = links.union(links.select("b", "a"))
    others = both.join(table.select(F.col("fp").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(links)
    known = table.join(roots, table.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    ids = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    out = known.join(ids, "root").join(others, F.col("fp") == F.col("a"), "left")
    out = out.select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id")
    return prints.join(out, "fp")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, null last, then of the least row number. Rows are
    told apart by their number, so rows without a doc_id and rows that share one are never confused. Columns pass
    through untouched, whatever their names."""
    rows = stored(docs)
    numbered = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("doc"), F.monotonically_increasing_id().alias("at"))
    prints = durable(fingerprints(numbered.select("doc.doc_id", "doc.text", "at"), ["doc_id", "at"]))
    table = durable(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at")).alias("first")))
    roots = components(durable(near_pairs(table.select("fp"))))
    rooted = table.join(roots, table.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    keep = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.at").alias("keep"))
    return numbered.join(keep, F.col("at") == F.col("keep"), "left_semi").select("doc.*")


def op6_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = durable(fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]))
    return near_duplicates(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")
