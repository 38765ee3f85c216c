"""Tables that are read at a version: each write is a new folder, and the last step of a write names it in the table's log.

A log entry is a small file with the version for its name and the table's folders in it, made only if no file of that name
is there.  Readers see the
last entry, or stay with one that they have chosen; a writer that finds its entry taken has lost the race, and does its work
again from the newer version.  The file system must create files exclusively, as HDFS and local disks do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIES = 20


class Conflict(Exception):
    """Another writer has made the version first."""


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(f"{self.path}/_log").getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_log")
        if not self._files.exists(folder):
            return []
        return sorted(int(x.getPath().getName()) for x in self._files.listStatus(folder) if x.getPath().getName().isdigit())

    def version(self) -> int:
        """The last version; 0 before the first write."""
        return max(self.versions(), default=0)

    def _folders(self, version: int) -> list[str]:
        if version == 0:
            return []
        entry = self._files.open(self._path(f"{self.path}/_log/{version:020d}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(entry, "UTF-8")
        entry.close()
        return text.split()

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last one if none is named; a table that was never written is empty."""
        folders = self._folders(self.version() if version is None else version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{x}" for x in folders])

    def _put(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        df.select(*columns).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def _name(self, version: int, folders: list[str]) -> int:
        try:
            entry = self._files.create(self._path(f"{self.path}/_log/{version:020d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                raise Conflict(f"version {version} of {self.path}") from e
            raise
        entry.write(bytearray("\n".join(folders), "utf-8"))
        entry.close()
        return version

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Makes df the version after a given one (the last, if none is named); Conflict if that version is there already."""
        after = self.version() if after is None else after
        return self._name(after + 1, [self._put(df)])

    def insert(self, rows: DataFrame) -> int:
        """Adds rows: they are written once, and the new version is the folders of the last one and theirs."""
        folder = self._put(rows)
        for _ in range(TRIES):
            version = self.version()
            try:
                return self._name(version + 1, [*self._folders(version), folder])
            except Conflict:
                continue
        raise Conflict(f"{TRIES} versions of {self.path} were made by others")

    def change(self, step: Callable[[DataFrame], DataFrame]) -> int:
        """Writes step(the last version), again from the newer version as long as others are faster."""
        for _ in range(TRIES):
            version = self.version()
            try:
                return self.write(step(self.read(version)), version)
            except Conflict:
                continue
        raise Conflict(f"{TRIES} versions of {self.path} were made by others")

    def upsert(self, rows: DataFrame, key: str) -> int:
        """rows take the place of those with their keys; of rows with one key any one stays; a null key is replaced by none."""
        fresh = rows.where(F.col(key).isNull()).unionByName(rows.where(F.col(key).isNotNull()).dropDuplicates([key]))
        return self.change(lambda prior: fresh.unionByName(prior.join(fresh.select(key), key, "left_anti")))

    def update(self, match: dict, values: dict) -> int:
        """Sets values in the rows whose columns equal those of match."""
        hit = F.lit(True)
        for k, v in match.items():
            hit = hit & F.coalesce(F.col(k) == F.lit(v), F.lit(False))
        return self.change(lambda prior: prior.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()}))


#: The state of jobs: what it may hold beyond that is in the map.
JOBS = "job_id string, status string, completed_at timestamp, facts map<string,string>"


def set_status(jobs: Table, updates: DataFrame) -> int:
    """updates (job_id, status, completed_at, facts) of jobs: facts are added to those there are; an unknown job becomes a
    row of its own, so that none is lost."""
    new = updates.dropDuplicates(["job_id"]).select("job_id", F.col("status").alias("_status"), F.col("completed_at").alias("_at"), F.col("facts").alias("_facts"))

    def step(prior: DataFrame) -> DataFrame:
        both = prior.join(new, "job_id", "full_outer")
        hit, none = F.col("_status").isNotNull(), F.create_map().cast("map<string,string>")
        kept = F.map_filter(F.coalesce("facts", none), lambda k, v: ~F.map_contains_key(F.coalesce("_facts", none), k))
        return both.select(
            "job_id", F.coalesce("_status", "status").alias("status"), F.when(hit, F.col("_at")).otherwise(F.col("completed_at")).alias("completed_at"),
            F.map_concat(kept, F.coalesce("_facts", none)).alias("facts"))

    return jobs.change(step)
