"""Dealing rows out in tasks of about the same size, however large the input is."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows of equal keys in one task; ``parts`` tasks where that is more than the session's shuffle partitions, else those."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys) if parts and parts > least else rows.repartition(*keys)
