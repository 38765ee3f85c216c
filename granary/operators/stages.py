"""Pipelines of stages with metrics, events, and a place to go on from.

A stage's counts are observed while its result is written, so measuring costs no pass of its own.  What a stage has
written stays; a run that failed goes on from the last stage that ended.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from granary.operators.catalogs import recorded
from granary.sources.snapshots import Table

EVENTS = "run_id string, stage string, component string, action string, event_type string, status string, severity string, summary string, details map<string,string>, metrics map<string,bigint>, timestamp timestamp"
STATE = "run_id string, current_stage string, completed array<string>, failed boolean, timestamp timestamp"


@dataclass(frozen=True)
class Stage:
    """A step from one table to the next, with what is to be counted of its result besides its rows."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    metrics: dict[str, Column] = field(default_factory=dict)


class Run:
    """A run of stages below a folder: data by stage, events, and the state after every step."""

    def __init__(self, spark: SparkSession, path: str, run_id: str) -> None:
        self.spark, self.path, self.run_id = spark, path.rstrip("/"), run_id
        self.events = Table(spark, f"{self.path}/events", EVENTS)
        self.state = Table(spark, f"{self.path}/state", STATE)

    def _record(self, stage: str, event_type: str, summary: str, failed: bool = False, details: dict | None = None, metrics: dict | None = None) -> None:
        row = (self.run_id, "SYSTEM", stage, event_type.split("_")[1], event_type, "FAILED" if failed else "SUCCESS", "ERROR" if failed else "INFO", summary, details or {}, metrics or {}, datetime.now(UTC))
        rows = self.spark.createDataFrame([row], EVENTS)
        names = [c for c in rows.columns if c != "run_id"]
        self.events.insert(recorded(rows, self.run_id, **{c: F.col(c) for c in names}).select(*rows.columns))

    def _at(self, stage: str, completed: list[str], failed: bool) -> None:
        self.state.write(self.spark.createDataFrame([(self.run_id, stage, completed, failed, datetime.now(UTC))], STATE))

    def completed(self) -> list[str]:
        """The stages that have ended in this folder, in order."""
        row = self.state.read().first()
        return list(row.completed) if row else []

    def result(self, number: int, stage: Stage, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/data/{number:03d}-{stage.name}")

    def run(self, stages: list[Stage], first: DataFrame) -> DataFrame:
        """The last stage's result.  Stages that an earlier run of the folder has completed are read and not run again."""
        done, rows = self.completed(), first
        for number, stage in enumerate(stages):
            if number < len(done) and done[number] == stage.name:
                rows = self.result(number, stage, stage.run(rows).schema)
                continue
            done = done[:number]
            self._record(stage.name, "stage_started", f"{stage.name} started.")
            self._at(stage.name, done, False)
            began = time.perf_counter()
            taken = lambda began=began: {"duration_ms": f"{(time.perf_counter() - began) * 1000:.2f}"}
            seen = Observation(stage.name)
            try:
                out = stage.run(rows)
                counted = out.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.cast("long").alias(k) for k, c in stage.metrics.items()])
                counted.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/data/{number:03d}-{stage.name}")
            except Exception as e:
                self._record(stage.name, "stage_failed", f"{stage.name} failed.", True, {"reason": str(e)[:1000]} | taken())
                self._record("Pipeline", "pipeline_failed", "Repository analysis pipeline failed.", True, {"stage": stage.name})
                self._at(stage.name, done, True)
                raise
            done = [*done, stage.name]
            metrics = {k: int(v or 0) for k, v in seen.get.items()}
            self._record(stage.name, "stage_completed", f"{stage.name} completed.", details=taken(), metrics=metrics)
            self._at(stage.name, done, False)
            rows = self.result(number, stage, out.schema)
        return rows

    def metrics(self) -> DataFrame:
        """stage, metric, value of the stages that have completed."""
        ended = self.events.read().where("event_type = 'stage_completed'")
        return ended.select(F.col("component").alias("stage"), F.explode("metrics").alias("metric", "value"))


def parser_events(files: DataFrame, evidence: DataFrame, parser: str, failures: DataFrame | None = None) -> DataFrame:
    """Events of a parser over files (path, artifact_type), from their evidence (path, evidence_type, source_line): a file is
    selected, started, then completed with its lines and number of rows, or failed (failures: path, reason); a file with
    evidence has one event more, with its kinds."""
    found = evidence.groupBy(F.col("path").alias("_path")).agg(
        F.min("source_line").alias("source_line"), F.max("source_line").alias("source_end_line"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("evidence_type")).alias("kinds"))
    rows = files.join(found, F.col("path") == F.col("_path"), "left").drop("_path")
    if failures is not None:
        rows = rows.join(failures.select(F.col("path").alias("_failed"), "reason"), F.col("path") == F.col("_failed"), "left")
    else:
        rows = rows.withColumns({"_failed": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    bad = F.col("_failed").isNotNull()
    n = F.coalesce("n", F.lit(0))

    def event(kind: str, text: Column, details: Column, failed: bool = False, lines: bool = False) -> Column:
        none = F.lit(None).cast("int")
        return F.struct(
            F.lit(kind).alias("event_type"), F.lit("FAILED" if failed else "SUCCESS").alias("status"), F.lit("ERROR" if failed else "INFO").alias("severity"), text.alias("summary"),
            (F.col("source_line") if lines else none).cast("int").alias("source_line"), (F.col("source_end_line") if lines else none).cast("int").alias("source_end_line"), details.cast("map<string,string>").alias("details"))

    path, none = F.col("path"), F.create_map()
    says = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    done = event("parser_completed", says(f"{parser} parsed ", path, "."), F.create_map(F.lit("artifact_type"), F.col("artifact_type"), F.lit("evidence_count"), n.cast("string")), lines=True)
    more = event("evidence_extracted", says("Extracted ", n.cast("string"), " evidence record(s) from ", path, "."), F.create_map(F.lit("evidence_types"), F.array_join("kinds", ",")), lines=True)
    gone = event("parser_failed", says(f"{parser} failed to parse ", path, "."), F.create_map(F.lit("reason"), F.col("reason")), failed=True)
    every = F.array_compact(F.array(
        event("parser_selected", says(f"{parser} selected for ", path, "."), none), event("parser_started", says("Parsing started for ", path, "."), none),
        F.when(bad, gone), F.when(~bad, done), F.when(~bad & (n > 0), more),
    ))
    return rows.select("path", F.lit(parser).alias("component"), F.explode(every).alias("e")).select("path", "component", "e.*")


def decision_events(overlays: DataFrame, repetitions: DataFrame, names: DataFrame) -> DataFrame:
    """Two events for each decision on an overlay or a repetition: what was found, and how it was resolved.

    overlays and repetitions: node_id, strategy, confidence; names: node_id, path, name, redefines_target, occurs_min.
    """
    def told(rows: DataFrame, stage: str, subject: Column, details: Column) -> DataFrame:
        review, low = F.col("strategy") == "REVIEW_REQUIRED", stage.lower()
        found = F.struct(F.lit(f"{low}_detected").alias("event_type"), F.lit("SUCCESS").alias("status"), F.lit("INFO").alias("severity"), F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("string").alias("confidence"), subject.alias("summary"), details.alias("details"))
        solved = F.struct(
            F.when(review, f"{low}_review_required").otherwise(f"{low}_resolved").alias("event_type"), F.when(review, "REVIEW_REQUIRED").otherwise("SUCCESS").alias("status"), F.when(review, "WARNING").otherwise("INFO").alias("severity"),
            F.col("strategy").alias("strategy"), F.col("confidence").alias("confidence"), F.concat(F.lit(f"{stage} strategy "), F.col("strategy"), F.lit(" selected for "), F.col("name"), F.lit(".")).alias("summary"), F.create_map().cast("map<string,string>").alias("details"))
        known = rows.select("node_id", "strategy", "confidence").join(names, "node_id")
        return known.select("path", "name", F.lit(stage).alias("stage"), F.explode(F.array(found, solved)).alias("e")).select("path", "name", "stage", "e.*")

    over = told(overlays, "REDEFINES", F.concat(F.lit("REDEFINES detected for "), F.col("name"), F.lit(" over "), F.col("redefines_target"), F.lit(".")), F.create_map(F.lit("original_field"), F.col("redefines_target"), F.lit("redefining_field"), F.col("name")))
    again = told(repetitions, "OCCURS", F.concat(F.lit("OCCURS detected for "), F.col("name"), F.lit(".")), F.create_map(F.lit("occurs"), F.col("occurs_min").cast("string")))
    return over.unionByName(again)
