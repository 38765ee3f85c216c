"""The audit log: filters, summaries, the latest run, and idempotent appends (batch and stream)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST, DEFAULT = 1000, 250


def bucket(status: Column, severity: Column) -> Column:
    """failed, review_required, warnings or success, in this priority; null for any other status."""
    s, v = F.upper(status), F.upper(severity)
    return F.when(s == "FAILED", "failed").when(s == "REVIEW_REQUIRED", "review_required").when(v.isin("WARNING", "ERROR", "CRITICAL"), "warnings").when(s == "SUCCESS", "success")


def summary(events: DataFrame) -> DataFrame:
    """Counts of each bucket by stage, and in all (stage null): one pass with a rollup."""
    b = events.select(F.coalesce("stage", F.lit("UNKNOWN")).alias("stage"), bucket(F.col("status"), F.col("severity")).alias("b"))
    return b.rollup("stage").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("b") == k).alias(k) for k in ("success", "warnings", "review_required", "failed")])


def select(events: DataFrame, *, stage=None, severity=None, event_type=None, status=None, artifact=None, run_id=None, start=None, end=None) -> DataFrame:
    """Events for which every stated condition holds; text compares without case, but for run_id ('all': any)."""
    same = lambda c, v: F.upper(c) == v.upper()
    tests = [same(c, v) for c, v in (("stage", stage), ("severity", severity), ("event_type", event_type), ("status", status)) if v]
    if artifact:
        tests.append(F.coalesce(same("artifact_id", artifact), F.lit(False)) | F.coalesce(same("artifact_name", artifact), F.lit(False)))
    if run_id and run_id != "all":
        tests.append(F.col("run_id") == run_id)
    if start:
        tests.append(F.col("timestamp") >= start)
    if end:
        tests.append(F.col("timestamp") <= end)
    return events.where(reduce(Column.__and__, tests)) if tests else events


def latest(events: DataFrame, order: str, *ties: str, limit: int = DEFAULT) -> DataFrame:
    """The newest events: a top-k, ties by further columns; `counted` gives the total before the limit."""
    return events.orderBy(F.desc(order), *ties).limit(min(max(limit, 1), MOST))


def counted(events: DataFrame) -> DataFrame:
    """total: the events before any limit, which a page of `latest` is a part of."""
    return events.agg(F.count(F.lit(1)).alias("total"))


def latest_run(events: DataFrame) -> DataFrame:
    return events.where("run_id IS NOT NULL AND run_id <> ''").agg(F.max_by("run_id", "timestamp").alias("run_id"))


def health(counts: dict[str, Column]) -> Column:
    """20, and 15, 20, 15, 10, 10, 10 for having files, layouts, programs, jobs, datasets and edges."""
    points = {"files": 15, "copybooks": 20, "programs": 15, "jobs": 10, "datasets": 10, "edges": 10}
    return F.least(F.lit(100), reduce(Column.__add__, [F.when(counts[k] > 0, p).otherwise(0) for k, p in points.items()], F.lit(20)))


def level(score: Column) -> Column:
    return F.when(score >= 90, "PASS").when(score >= 70, "WARNING").otherwise("FAIL")


def verdict(errors: Column, warnings: Column) -> Column:
    """Of two arrays of messages."""
    return F.when(F.size(errors) > 0, "FAIL").when(F.size(warnings) > 0, "WARNING").otherwise("PASS")
