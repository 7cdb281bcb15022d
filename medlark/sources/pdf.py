"""PDF sources behind an interface: listing is Spark's own, reading is the caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[bytes], str]


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of every PDF below a folder, or of one file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)


def texts(files: DataFrame, readers: list[Reader]) -> DataFrame:
    """files(path, content) -> path, text: the first reader that yields a text that isn't blank; null if none does."""

    def run(frames: Iterator) -> Iterator:
        for f in frames:
            out = []
            for content in f["content"]:
                text = None
                for reader in readers:
                    try:
                        text = reader(bytes(content))
                    except Exception:  # noqa: BLE001 - a reader that can't read leaves it to the next
                        text = None
                    if text and text.strip():
                        break
                out.append(text if text and text.strip() else None)
            yield f[["path"]].assign(text=out)

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def scanned_page(characters: Column, image_share: Column) -> Column:
    return (characters < 30) & (image_share > 0.5)


def scanned(pages: DataFrame) -> DataFrame:
    """pages(path, characters, image_share) -> path, scanned: over half of the pages are images without text."""
    share = F.avg(scanned_page(F.col("characters"), F.col("image_share")).cast("int"))
    return pages.groupBy("path").agg((share > 0.5).alias("scanned"))
