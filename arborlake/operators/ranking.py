"""Top-k without a full sort, and first-match-wins rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_by_order(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in an order that must be total: a partial top-k by task, then a merge."""
    return df.orderBy(*order).limit(k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Up to k rows per key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def running_budget(df: DataFrame, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows in order up to, and without, the first that brings the running cost above budget.

    The window spans all rows: call it on an aggregated or limited input."""
    w = W.orderBy(*order)
    return df.withColumn("_sum", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_over", F.max(F.col("_sum") > budget).over(w.rowsBetween(W.unboundedPreceding, 0))).filter(~F.col("_over")).drop("_over").withColumnRenamed("_sum", "running")
