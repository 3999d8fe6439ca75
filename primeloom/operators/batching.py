"""Batches of rows of like length, for plug-ins that pad their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def by_length(rows: DataFrame, length: Column, partitions: int) -> DataFrame:
    """Rows range-partitioned by length and sorted by it, so every Arrow batch holds texts of like length."""
    return rows.withColumn("_length", length).repartitionByRange(partitions, "_length").sortWithinPartitions("_length").drop("_length")
