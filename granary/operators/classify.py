"""What kind of source a file is, and what a repository mostly holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import col, extension


def artifact_type(path: str | Column, content: str | Column) -> Column:
    """The first rule that holds: listings, cluster definitions, jobs, layouts, programs, other."""
    ext, text, upper = extension(path), col(content), F.upper(col(content))
    has = lambda *words: reduce(Column.__or__, [upper.contains(w) for w in words])
    return (
        F.when(ext.isin(".csv", ".xlsx", ".xls"), "metadata")
        .when(ext.isin(".txt", ".lst", ".log", ".out") & has("CLUSTER", "NONVSAM", "IDCAMS", "LISTCAT"), "listcat")
        .when(ext.isin(".idcams", ".ams") | upper.contains("DEFINE CLUSTER") | (upper.contains("IDCAMS") & upper.contains("DEFINE ")), "idcams")
        .when(ext.isin(".jcl", ".job", ".cntl") | text.startswith("//") | upper.contains("EXEC PGM="), "jcl")
        .when(ext.isin(".cpy", ".copy"), "copybook")
        .when(ext.isin(".cbl", ".cob", ".cobol") | has("IDENTIFICATION DIVISION", "PROCEDURE DIVISION", "DATA DIVISION"), "cobol")
        .when(ext == ".h", "copybook")
        .otherwise("other")
    )


def artifacts(files: DataFrame) -> DataFrame:
    """files with artifact_type and artifact_id (numbered within a type where stems repeat, in the order of paths)."""
    from pyspark.sql import Window as W

    from granary.functions.text import stem

    typed = files.select("*", artifact_type("path", "content").alias("artifact_type"), stem("path").alias("_stem"))
    nth = F.row_number().over(W.partitionBy("artifact_type", "_stem").orderBy("path"))
    key = F.when(nth > 1, F.concat("_stem", F.lit("__"), nth.cast("string"))).otherwise(F.col("_stem"))
    return typed.select("*", key.alias("artifact_id")).drop("_stem")


def dominant(rows: DataFrame, value: str, *by: str, share: float = 0.8) -> DataFrame:
    """For each group the value with at least `share` of its rows, else Mixed."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.max_by(value, F.struct("n", value)).alias("_top"), F.max("n").alias("_n"))
    return best.select(*by, F.when(F.col("_n") >= share * F.col("n_rows"), F.col("_top")).otherwise("Mixed").alias("dominant"), "n_rows")
