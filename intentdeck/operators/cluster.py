"""Partition tables, ownership and membership as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owner_of(partitions: DataFrame, partition_id: int) -> DataFrame:
    return partitions.where(F.col("partition_id") == partition_id).select("owner")


def partitions_for(partitions: DataFrame, node: int) -> DataFrame:
    """Partitions that node owns or replicates."""
    return partitions.where((F.col("owner") == node) | F.array_contains("replicas", F.lit(node).cast("long"))).select("partition_id")


def membership(updates: DataFrame) -> DataFrame:
    """(node, state, version): the update of the highest version of each node."""
    return updates.groupBy("node").agg(F.max_by("state", "version").alias("state"), F.max("version").alias("version"))


def alive(updates: DataFrame) -> DataFrame:
    return membership(updates).where(F.col("state") == "Alive")
