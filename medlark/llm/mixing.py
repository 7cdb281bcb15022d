"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]: a piecewise-linear curve given by knots.
Its integral up to t is the share of the source's quota that training has consumed by then. Inverting this
cumulative demand at the place where a document lies in its source's stream gives the document's training
position, and range-sorting on it yields the curriculum.

Quotas: sources ordered by code point (null last) weigh `weights`, repeating; together they take `share` of all
words; a quota above `cap` times its source's words stops there and the excess is shared again by weight.

A source's stream is its documents in the order of a hash of doc_id, then of their row number, read again from the
start when it ends. Running totals come from two-pass prefix sums over ranges of (source, hash, row), so no task holds
a source or a key, however many rows it has; the sources, however many, are ordered in the same way. All this moves
narrow rows; whole texts are shuffled once to meet their places and once into training order.
The document on which a quota ends is cut to its first words, hence each source takes its rounded quota exactly.

Defined results: null text has size 0; null source is a source of its own, ordered last; null doc_id is hashed
as the empty string; repeated rows are separate documents; of rows that tie in hash, doc_id and size the one stored first
is read first; a text of any length counts and moves whole, but for the cut; an empty table gives an empty result; other
columns pass through untouched whatever their names, but for `mix_position`, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, durable, n_words, read, running, stored, words

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Knots (t, weight) for the 1st, 2nd and 3rd source of each run of three: falling, flat, rising late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))


def _cycle(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index % len(values) + 1).cast("int"))


def quotas(by_source: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """by_source(source, source_size), one row a source -> the same with source_index, source_start (words of the
    sources before it), target and quota (the target, rounded)."""
    ranked = running(by_source, [F.col("source").asc_nulls_last()], {"source_index": F.lit(1), "source_start": F.col("source_size")})
    ranked = ranked.withColumn("_w", _cycle(weights, F.col("source_index"))).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    ranked = durable(ranked.withColumn("_ratio", F.col("_cap") / F.col("_w")))
    size, weight = (x or 0 for x in ranked.agg(F.sum("source_size"), F.sum("_w")).first())
    # Sources stop at their cap in the order of cap over weight; `_level` is what a weight of one gets if all before do.
    filled = running(ranked, [F.col("_ratio").asc(), F.col("source_index").asc()], {"_full": F.col("_cap"), "_shut": F.col("_w")})
    levels = durable(filled.withColumn("_level", (F.lit(float(share) * size) - F.col("_full")) / (F.lit(float(weight)) - F.col("_shut"))))
    stops = F.col("_level") >= F.col("_ratio")
    level = levels.filter(~stops).agg(F.min_by("_level", F.struct("_ratio", "source_index"))).first()[0]
    target = F.when(stops, F.col("_cap")).otherwise(F.lit(level).cast("double") * F.col("_w"))
    return levels.select("source", "source_size", "source_index", "source_start", target.alias("target")).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))


def position(done: Column, index: Column, schedules=SCHEDULES) -> Column:
    """The t in [0, 1] at which a source has consumed the share `done` of its quota."""

    def inverse(knots) -> Column:
        steps = list(zip(knots, knots[1:]))
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in steps]
        cases = F
        for i, ((t0, w0), (t1, w1)) in enumerate(steps):
            rest = done * sum(areas) - sum(areas[:i])
            root = w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * ((w1 - w0) / (t1 - t0)) * rest, F.lit(0.0)))
            last = rest.isNotNull() if i == len(steps) - 1 else rest < areas[i]
            cases = cases.when(last, F.when(root > 0, t0 + 2 * rest / root).otherwise(t0))
        return F.least(cases, F.lit(float(knots[-1][0])))

    pick = index % len(schedules)
    out = inverse(schedules[-1])
    for i in reversed(range(len(schedules) - 1)):
        out = F.when(pick == i, inverse(schedules[i])).otherwise(out)
    return out


def place(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """docs(doc_id, source, size, row), stored; row tells rows apart -> the same rows with key (hash of doc_id),
    source_size, source_index, target, quota and stream_start (words of the source before the document)."""
    sources = quotas(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    keyed = docs.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col("source").asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in ("key", "doc_id", "size", "row")]]
    rows, s = running(keyed, order, {"before": F.col("size")}).alias("d"), sources.alias("s")
    joined = rows.join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
    return joined.select(*[F.col(f"d.{c}") for c in keyed.columns], "source_size", "source_index", "target", "quota", (F.col("before") - F.col("source_start")).alias("stream_start"))


def _taken(turn: int) -> Column:
    """Words that the given reading of the stream (from 0) takes of a document."""
    return F.least(F.col("size"), F.greatest(F.col("quota") - turn * F.col("source_size") - F.col("stream_start"), F.lit(0)))


def _position_of(turn: Column, n: Column) -> Column:
    # quotas are rounded words, so `done` is at most 1
    return position((turn * F.col("source_size") + F.col("stream_start") + n / 2) / F.col("quota"), F.col("source_index"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """Documents in training order: a row for every reading of a document, its text cut where the quota ends,
    with `mix_position` in [0, 1]. Documents without words are never taken."""
    spark = docs.sparkSession
    rows = stored(docs.drop("mix_position"))
    names = rows.columns
    numbered = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    sizes = durable(numbered.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), n_words(F.col("doc.text")).alias("size"), "row"))
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), _taken(i).alias("n")) for i in range(cap)])
    each = place(sizes, weights, share, cap).withColumn("take", F.explode(F.filter(turns, lambda x: x.n > 0)))
    taken = each.select("row", "key", "size", "take.turn", "take.n", _position_of(F.col("take.turn"), F.col("take.n")).alias("mix_position"))
    # Ranges of training time are cut on narrow rows; texts then go straight to theirs.
    parts, order = int(spark.conf.get("spark.sql.shuffle.partitions")), ["mix_position", "key", "row", "turn"]
    ranged = durable(taken.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    found = numbered.join(ranged.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"))
    cut = F.when(F.col("n") < F.col("size"), F.array_join(F.slice(words(F.col("doc.text")), 1, F.col("n").cast("int")), " ")).otherwise(F.col("doc.text"))
    placed = found.repartitionById(parts, "part").sortWithinPartitions(*order)
    return placed.select(*[cut.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in names], "mix_position")


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = durable(read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    taken = [_taken(i) for i in range(CAP)]
    spot = lambda i: F.round(F.when(taken[i] > 0, _position_of(F.lit(i), taken[i])), 6)
    out = place(docs.withColumn("row", F.monotonically_increasing_id())).select(
        "doc_id", "size", "source_size", "target", sum(taken[1:], taken[0]).alias("taken"), spot(0).alias("first_position"), spot(1).alias("second_position"), "key", "row",
    )
    order = ["first_position", "key", "row"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).drop("key", "row")


def _position_sql(done: str) -> str:
    def inverse(knots) -> str:
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        cases, before = [], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            slope, size = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
            rest = f"({done} * {area!r} - {before!r})"
            cases.append(f"WHEN {rest} < {size!r} OR {t1!r} = {knots[-1][0]!r} THEN {t0!r} + 2 * {rest} / ({w0!r} + sqrt(greatest({w0 * w0!r} + {2 * slope!r} * {rest}, 0)))")
            before += size
        return f"least(CASE {' '.join(cases)} END, 1.0)"

    return "CASE source_index % 3 " + " ".join(f"WHEN {i} THEN {inverse(k)}" for i, k in enumerate(SCHEDULES)) + " END"


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_index FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][source_index % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, cap / w AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, source_index, CASE WHEN level >= ratio THEN cap ELSE (SELECT arg_min(level, ratio) FROM l WHERE level < ratio) * w END AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.source_index, t.target, floor(t.target + 0.5)::BIGINT AS quota,
    (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, least(size, greatest(quota - c, 0)) AS n0, least(size, greatest(quota - source_size - c, 0)) AS n1 FROM p
), r AS (
  SELECT *, (c + n0 / 2)::DOUBLE / quota AS d0, (source_size + c + n1 / 2)::DOUBLE / quota AS d1 FROM q
)
SELECT doc_id, size, source_size, target, (n0 + n1)::BIGINT AS taken, CASE WHEN n0 > 0 THEN round({_position_sql("d0")}, 6) END AS first_position,
  CASE WHEN n1 > 0 THEN round({_position_sql("d1")}, 6) END AS second_position FROM r
"""
