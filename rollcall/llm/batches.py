"""How much of a table a Python worker holds at a time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, megabytes: int = 4) -> Iterator[None]:
    """Tables written inside hand Arrow batches of about so many megabytes to Python: rows of long lists and
    texts are bounded by their bytes, not by their number."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, f"{megabytes}m")
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)
