"""How much of a table Python code holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 20) -> None:
    """Hold Arrow batches of this session to ``rows`` and, but for a single long row, ``size`` bytes: each batch is in memory twice."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key, None) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
