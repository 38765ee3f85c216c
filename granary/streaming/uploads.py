"""Uploads as a stream: files and bytes of every upload are counted as they come, and an upload that breaks a limit closes.

A task sums what it has read of an upload before it is shuffled, so an upload of a third of all files costs its state a row
a task.  The state of an upload is four numbers and the reason for which it was closed; a closed upload stays closed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.functions.text import is_unsafe_member
from granary.sources.repository import shared_dir

# fixed values: limits of an upload
MOST_BYTES, MOST_FILES = 50 * 1024 * 1024, 10_000

FILES = "upload string, path string, size long"
_PARTS = "upload string, n_files long, n_empty long, n_bytes long, too_large boolean, unsafe boolean"
STATUS = "upload string, n_files long, n_empty long, n_bytes long, reason string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """FILES below path as a stream: a folder for each upload, the files in it; Spark lists neither hidden nor empty files."""
    schema = "path string, modificationTime timestamp, length long, content binary"  # the content is not read
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    inner = F.replace(F.substring_index("path", path.rstrip("/") + "/", -1), F.lit("\\"), F.lit("/"))
    return rows.select(F.substring_index(inner, "/", 1).alias("upload"), F.regexp_replace(inner, "^[^/]*/", "").alias("path"), F.col("length").alias("size"))


def _summed(most_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            full = frame["size"].fillna(0) > 0
            frame = frame.assign(n_files=full.astype("int64"), n_empty=(~full).astype("int64"), n_bytes=frame["size"].fillna(0).astype("int64"), too_large=frame["size"].fillna(0) > most_bytes)
            yield frame.groupby("upload", as_index=False).agg({"n_files": "sum", "n_empty": "sum", "n_bytes": "sum", "too_large": "any", "unsafe": "any"})

    return run


def _counted(most_files: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n_files, n_empty, n_bytes, reason = state.get if state.exists else (0, 0, 0, None)
        for frame in frames:
            n_files, n_empty, n_bytes = n_files + int(frame["n_files"].sum()), n_empty + int(frame["n_empty"].sum()), n_bytes + int(frame["n_bytes"].sum())
            # the worst reason stands, so that the order of files does not matter
            reason = "unsafe path" if reason == "unsafe path" or frame["unsafe"].any() else "file too large" if reason == "file too large" or frame["too_large"].any() else reason
            reason = reason or ("too many files" if n_files > most_files else None)
        state.update((n_files, n_empty, n_bytes, reason))
        yield pd.DataFrame({"upload": [key[0]], "n_files": [n_files], "n_empty": [n_empty], "n_bytes": [n_bytes], "reason": [reason]})

    return step


def status(files: DataFrame, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES) -> DataFrame:
    """STATUS of every upload of a stream of FILES, again whenever it changes; a reason closes the upload.

    Empty files are counted apart and are no files; a null size is an empty file; files without an upload are left out.
    """
    rows = files.where("upload IS NOT NULL").select("upload", "size", F.coalesce(is_unsafe_member("path"), F.lit(True)).alias("unsafe"))
    parts = rows.mapInPandas(_summed(most_bytes), _PARTS)
    return parts.groupBy("upload").applyInPandasWithState(_counted(most_files), STATUS, "n_files long, n_empty long, n_bytes long, reason string", "update", GroupStateTimeout.NoTimeout)


def latest(files: DataFrame, **limits: int) -> DataFrame:
    """Runs the stream over what is there and gives the last STATUS of every upload; one without a file is closed, too."""
    spark = files.sparkSession
    path = f"{shared_dir(spark)}/granary/uploads-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/status/{number}")  # a batch that is repeated replaces itself

    query = status(files, **limits).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{STATUS}, batch int").option("recursiveFileLookup", "true").parquet(f"{path}/status")
    columns = [c for c in rows.columns if c not in ("upload", "batch")]
    last = rows.groupBy("upload").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("upload", "s.*")
    return last.withColumn("reason", F.coalesce("reason", F.when(F.col("n_files") == 0, "no file")))


def accepted(files: DataFrame, closed: DataFrame) -> DataFrame:
    """The files (batch) of uploads that are open in the end, without empty ones."""
    return files.where("size > 0").join(closed.where("reason IS NULL").select("upload"), "upload", "left_semi")

