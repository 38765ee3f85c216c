"""What the operators of this subpackage share: the shared scratch folder, written tables, words."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators and word characters of every contract of this subpackage: ASCII blank and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/granary/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df with place, the number of rows before a row in the given order, which should tell all rows apart.

    Sorted runs are written, and what stands in earlier runs is added to the places in a run: one number for each run.
    """
    spark, id_bits = df.sparkSession, 33  # the lower bits of monotonically_increasing_id() count the rows of a partition
    runs = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    runs = written(runs, label).withColumn("_run", F.shiftright("_at", id_bits)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << id_bits) - 1)))
    sizes = sorted((r._run, r.n) for r in runs.groupBy("_run").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each task
    before = list(itertools.accumulate((n for _, n in sizes), initial=0))
    table = spark.createDataFrame([(run, b) for (run, _), b in zip(sizes, before, strict=False)], "_run long, _before long")
    return runs.join(F.broadcast(table), "_run", "left").withColumn("place", F.col("_at") + F.col("_before")).drop("_run", "_at", "_before")


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def crc_class(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
