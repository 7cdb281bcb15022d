"""All registered queries of the reference's own operators, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import annotation as _annotation  # noqa: F401
from . import extraction as _extraction  # noqa: F401
from . import ingest as _ingest  # noqa: F401
from . import statistics as _statistics  # noqa: F401
from . import text as _text  # noqa: F401
from . import training as _training  # noqa: F401
from . import timeline as _timeline
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient timelines: the wide state of every field after every document."""
    return _timeline.timeline_wide(spark, sf_dir)
