"""Shared pieces of the corpus operators: word splitting, row keys and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """Words of a non-null text; an empty or blank text has none."""
    return F.array_remove(F.split(text, SPACE), "")


def n_words(text: Column) -> Column:
    """Number of words of a text, null counting as none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(words(text))).cast("long")


#: Folders of intermediate tables that this process made, for release().
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor of a cluster reaches.

    Where the setting is missing (tests, a laptop) a temporary folder of this machine serves, and the session's
    configuration stays as it is; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="medlark-")
    _MADE.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _MADE[-1]


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far, once results that were read from them are written; their number."""
    jvm, n = spark._jvm, len(_MADE)
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def durable(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df, if it does no more than read files, select and filter; else its rows, written down. Row numbers
    (monotonically_increasing_id) of the result are the same at every read."""

    def plain(plan) -> bool:
        children = plan.children()
        return plan.nodeName() in ("Project", "Filter", "LogicalRelation") and all(plain(children.apply(i)) for i in range(children.size()))

    return df if plain(df._jdf.queryExecution().optimizedPlan()) else durable(df)


def running(df: DataFrame, by: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, under each name of sums, the sum of its value over all rows before, in the order `by`, a total one.

    Two passes of prefix sums: rows are ranged by `by`; the totals of the ranges, one row a partition, say where each
    begins. Whatever the keys, no task holds more than a range. Names in df that begin with an underscore and are those
    of sums with two in front, `_part` and `_at` are taken."""
    ranged = durable(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    starts = totals.select(F.col("_part").alias("_at"), *[F.coalesce(F.sum(n).over(before(Window.orderBy("_part"))), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = before(Window.partitionBy("_part").orderBy(*by))
    rows = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n) for n, v in sums.items()])
    return rows.join(starts, F.col("_part") == F.col("_at")).select(*df.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def constants(values: list[float]) -> Column:
    """A constant array of doubles, folded to one literal; far cheaper to analyse than a literal for each value."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
