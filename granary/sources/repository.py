"""Sources: source trees, archives, key-value listings; and the tables that results are kept in."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import LINE_END

# fixed values: limits of an archive
MOST_MEMBERS, MOST_BYTES = 5000, 500 * 1024 * 1024


def read_repository(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below path; bytes that are not UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit(path.rstrip("/") + "/")
    name = F.url_decode(F.replace(F.regexp_replace("path", r"\+", "%2B"), F.lit("file:"), F.lit("")))
    shown = F.when(F.instr(name, path.rstrip("/") + "/") > 0, F.substring(name, F.locate(path.rstrip("/") + "/", name) + F.length(root), F.length(name))).otherwise(name)
    return files.select(shown.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("_text"), F.make_valid_utf8(F.col("content").cast("string")).alias("_valid")).select("path", F.coalesce("_text", "_valid").alias("content"))


def unsafe_member(name: str) -> bool:
    name = name.replace("\\", "/")
    return not name.strip() or name.startswith("/") or name[1:2] == ":" or ".." in name.split("/")


def members(data: bytes, most: int = MOST_MEMBERS, most_bytes: int = MOST_BYTES) -> Iterator[tuple[str, str]]:
    """(path, text) of an archive; the whole archive is refused for one unsafe member or too large a sum."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not an archive") from e
    infos = [i for i in archive.infolist() if not i.is_dir()]
    if not infos or len(infos) > most or sum(i.file_size for i in infos) > most_bytes:
        raise ValueError("empty or oversized archive")
    if any(unsafe_member(i.filename) or (i.external_attr >> 28) == 0xA for i in infos):
        raise ValueError("unsafe archive member")
    left = most_bytes
    for i in infos:
        try:  # sizes in headers may lie: what is read is counted
            with archive.open(i) as f:
                data = f.read(left + 1)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error) as e:
            raise ValueError(f"unreadable member {i.filename}: {e}") from e
        left -= len(data)
        if left < 0:
            raise ValueError("oversized archive")
        yield i.filename.replace("\\", "/"), data.decode("utf-8", "replace")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, content, error) of all archives that path names; a refused archive is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(name, p, t, None) for p, t in members(data)]
                except ValueError as e:
                    rows = [(name, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "path", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, path string, content string, error string")


def lines(files: DataFrame, content: str = "content", *keys: str) -> DataFrame:
    """One row a line, with line_no from 1; a text that ends with a line end has no further line."""
    keys = keys or ("path",)
    text = F.regexp_replace(F.col(content), f"(?:{LINE_END})$", "")
    split = F.when(F.col(content) == "", F.array().cast("array<string>")).otherwise(F.split(text, LINE_END))
    return files.select(*keys, F.posexplode(split).alias("_at", "text")).select(*keys, (F.col("_at") + 1).alias("line_no"), "text")


def read_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """A listing with trimmed upper-case column names; all values are text."""
    raw = spark.read.csv(path, header=True)
    return raw.toDF(*[c.strip().upper() for c in raw.columns])


def save(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Audit events of JSON files: lists of objects or an object a line; what is no object is left out."""
    files = spark.read.option("wholetext", "true").text(path).select(F.trim("value").alias("value"))
    entries = F.from_json(F.when(F.col("value").startswith("["), F.col("value")), "array<string>", {"mode": "PERMISSIVE"})
    rows = files.select(F.explode(F.coalesce(entries, F.when(~F.col("value").startswith("["), F.split("value", r"\R")))).alias("e"))
    return rows.where(F.ltrim("e").startswith("{")).select(F.from_json("e", schema).alias("e")).where("e IS NOT NULL").select("e.*")


def write_ddl(scripts: DataFrame, path: str) -> None:
    """The texts of scripts (table_name, ddl) as text files, each text whole, with a blank line after it."""
    scripts.orderBy("table_name").select(F.col("ddl").alias("value")).write.option("lineSep", "\n\n").text(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """Rules as CSV with a header; quotes in values are doubled, and line ends stay inside their quotes."""
    rules.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def append_new(current: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """prior and those rows of current whose key it lacks."""
    return prior.unionByName(current.join(prior.select(key), key, "left_anti"))


def upsert(current: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Rows of current, and those of prior that it does not replace."""
    return current.unionByName(prior.join(current.select(key), key, "left_anti"))


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


def put_down(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: later steps start from there, and know its real size."""
    typed = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    path = f"{shared_dir(df.sparkSession)}/granary/{uuid.uuid4().hex}"
    typed.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(typed.schema).parquet(path)


#: What loops cut their lineage with.
cut = put_down


def spread(df: DataFrame, *by: str, rows: int = 500_000) -> DataFrame:
    """df in partitions of about so many rows, by some columns if given: counted, so a task's rows do not grow with the input.

    Spark would deal a small file, or what it guesses to be small, to few tasks, whatever its rows become afterwards.
    """
    return df.repartition(parts(df, rows), *by)


def parts(df: DataFrame, rows: int = 500_000) -> int:
    """Partitions of about so many rows that df fills."""
    return max(1, -(-df.count() // rows))


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: tables put down are often a hundred times larger than their files,
    by which Spark would judge them."""
    return df.hint("merge")
