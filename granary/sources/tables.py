"""Scans of relational tables with their conditions pushed down, and uploads as a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a partition of a remote scan is meant for.
PER_PARTITION = 1_000_000
MOST_PARTITIONS = 200


def matching(rows: DataFrame, query: dict | None) -> DataFrame:
    """rows by a query: column to a value, or to {"in": values}.  Sources get these as filters they can push down.

    A null value matches nothing, as in SQL; an empty list too; no query is no filter.
    """
    tests = [F.col(k).isin(v["in"]) if isinstance(v, dict) and "in" in v else F.col(k) == F.lit(v) for k, v in (query or {}).items()]
    return rows.where(reduce(Column.__and__, tests)) if tests else rows


def scan(spark: SparkSession, url: str, table: str, query: dict | None = None, split: str | None = None, **options: str) -> DataFrame:
    """A table behind JDBC by a query; split, a column of whole numbers, deals the scan to partitions by its range.

    The range and the number of rows are asked for first, with the same conditions, by one aggregate in the database.
    """
    base = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split is None:
        return matching(base.load(), query)
    low, high, n = matching(base.load(), query).agg(F.min(split), F.max(split), F.count(F.lit(1))).first()
    if low is None:
        return matching(base.load(), query)
    parts = max(1, min(MOST_PARTITIONS, -(-n // PER_PARTITION)))
    dealt = base.options(partitionColumn=split, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts))
    return matching(dealt.load(), query)


def insert(rows: DataFrame, url: str, table: str, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
