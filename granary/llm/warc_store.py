"""Content-addressed WARC archive.

Two tables make an archive.  `payloads` keeps the bytes of every distinct payload once, under their SHA-256; `records`
keeps the exact header block of every record and the SHA-256 of its payload.  Joining them gives the original records
back, byte for byte; reading checks every payload against its own digest.  `export` writes the records as ordinary WARC
files, `import_files` makes an archive of such files again.

Payloads are dealt by digest when they are stored and stay so, bucketed; joining records to them moves headers only.

Of records with equal payloads of at least LEAST bytes the one with the largest id is a response and the others revisit
it; shorter payloads are cheaper to repeat and are all responses.

Payloads are told apart by their SHA-256 alone, whatever their rows' ids: each task hands on every payload once, and one
of the equal ones is stored.  Short payloads, which may belong to any number of responses, are dealt with a salt.

Defined results: a null html is an empty payload; a null url gives no WARC-Target-URI; line ends inside a url are
percent-encoded; rows that repeat the id of a response are responses too, and so are rows with a null id, which is written
as `null`; they share the one stored payload;
other columns are left alone; an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import scratch_path

LEAST = 1000
SALTS = 16
#: fixed values of the format
CRLF = "\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: One fixed time: archives of the same pages are the same bytes.
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    records: DataFrame
    payloads: DataFrame


def digests(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _header(kind: Column, refers_to: Column) -> Column:
    """The whole header block of a record, with the blank line that ends it and the HTTP head of a response."""
    revisit = kind == "revisit"
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "\x00", "%00")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, F.length(http)).otherwise(F.length(http) + F.col("n_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _name(F.col("page_id"))),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit(f"WARC-Profile: {SAME_PAYLOAD}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _name(refers_to))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http)


def store(pages: DataFrame, path: str, least: int = LEAST) -> Archive:
    """Writes the archive of pages (page_id, url, html) below path and opens it."""
    spark = pages.sparkSession
    found = digests(pages)
    # counts per digest are summed before the shuffle, so a payload of a third of all pages costs one row a task
    shared = found.groupBy("sha256").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").withColumnRenamed("sha256", "_sha256")
    salted = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = dealt.drop("payload").join(salted, (F.col("sha256") == F.col("_sha256")) & (F.col("salt") == F.col("_salt")), "left")
    again = (F.col("n_bytes") >= least) & (F.col("page_id") != F.col("owner"))  # null, so a response, without an id or an owner
    kind = F.when(again, "revisit").otherwise("response")
    records = joined.select("page_id", _header(kind, F.col("owner")).cast("binary").alias("header"), "sha256", kind.alias("kind"), "n_bytes", "owner")
    records.select("header", "sha256").write.option("compression", "zstd").parquet(f"{path}/records")
    # equal digests are equal payloads: any of them will do, and a task hands on one of each
    kept = found.groupBy("sha256").agg(F.first("payload").alias("payload"))
    n, name = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), f"granary_payloads_{uuid.uuid4().hex}"
    # bucketed by digest, as they are dealt already: a join that restores records moves no payload again
    kept.write.option("path", f"{path}/payloads").option("compression", "zstd").bucketBy(n, "sha256").sortBy("sha256").saveAsTable(name)
    return Archive(open_archive(spark, path).records, spark.table(name))


def open_archive(spark, path: str) -> Archive:
    return Archive(spark.read.schema("header binary, sha256 binary").parquet(f"{path}/records"), spark.read.schema("sha256 binary, payload binary").parquet(f"{path}/payloads"))


def parsed(archive: Archive) -> DataFrame:
    """The records with the fields that their header blocks name."""
    text = F.col("header").cast("string")
    of = lambda name, value: F.regexp_extract(text, rf"(?md)^{name}: {value}\r$", 1)
    number = lambda name: F.nullif(F.nullif(of(name, "<urn:page:([^>]*)>"), F.lit("")), F.lit("null")).cast("long")
    return archive.records.select(
        "header", "sha256",
        of("WARC-Type", "(\\w+)").alias("record_type"),
        number("WARC-Record-ID").alias("page_id"),
        number("WARC-Refers-To").alias("refers_to"),
        of("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("stated_digest"),
        F.regexp_extract(text, r"\r\n\r\nHTTP(?s:.*)\r\nContent-Length: (\d+)\r\n", 1).cast("long").alias("stated_bytes"),
    )


def verified(archive: Archive) -> DataFrame:
    """key, payload: the payloads, each read and held against its own SHA-256; a damaged one stops the job.

    The key is the stored one, so that Spark knows how the payloads are dealt.
    """
    sound = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), F.hex("sha256"))).cast("binary")
    return archive.payloads.select(F.col("sha256").alias("key"), F.when(sound, F.col("payload")).otherwise(damaged).alias("payload"))


def reconstruct(archive: Archive, every: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, stated_*, header and the full payload of the records, revisits included if every.

    Payloads below LEAST bytes may have many responses: they are repeated for each salt.
    """
    records = parsed(archive)
    if not every:
        records = records.where("record_type = 'response'")
    salts = F.when(F.octet_length("payload") < LEAST, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)) if not every else F.sequence(F.lit(0), F.lit(SALTS - 1)))
    payloads = verified(archive).select("key", "payload", F.explode(salts).alias("_salt"))
    spread = F.lit(True) if every else F.col("stated_bytes") < LEAST
    dealt = records.withColumn("salt", F.when(spread, F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    return dealt.join(payloads, (F.col("sha256") == F.col("key")) & (F.col("salt") == F.col("_salt"))).drop("key", "_salt", "salt")


def _measured(record: DataFrame) -> DataFrame:
    """Restores each record of record (header, payload, ...) and measures what follows its header."""
    whole = record.withColumn("_record", F.concat("header", "payload")).drop("payload")
    payload = F.substr("_record", F.octet_length("header") + 1)
    return whole.withColumn("_payload", payload).select(
        "page_id", "record_type", "refers_to", "stated_digest", "stated_bytes", F.octet_length("_payload").cast("long").alias("payload_bytes"), F.sha1("_payload").alias("payload_digest"))


def read_back(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, measured on the records restored.

    Responses are restored by joins: those of LEAST bytes or more each with its own payload, which is not shuffled where the
    archive's payloads are bucketed by digest; shorter ones, which may share a payload in any number, with a salt.  A revisit
    holds no payload: its measures are those of the payload that its digest names, as are those of long responses without an
    id.  A header that states another size or digest stops the job.
    """
    records = parsed(archive)
    short, response = F.col("stated_bytes") < LEAST, F.col("record_type") == "response"
    own = response & ~short & F.col("page_id").isNotNull()
    salts, salt = F.sequence(F.lit(0), F.lit(SALTS - 1)), F.pmod(F.xxhash64("header"), F.lit(SALTS)).cast("int")
    payloads = verified(archive)
    long_ones = _measured(records.where(own).join(payloads, F.col("sha256") == F.col("key"), "left"))
    few = payloads.where(F.octet_length("payload") < LEAST).select("key", "payload", F.explode(salts).alias("_salt"))
    short_ones = _measured(records.where(response & short).withColumn("salt", salt).join(few, (F.col("sha256") == F.col("key")) & (F.col("salt") == F.col("_salt")), "left"))
    rest = records.where(~response | (~short & F.col("page_id").isNull())).withColumn("salt", salt).drop("header")
    called = rest.select(F.col("sha256").alias("_called")).distinct()
    told = payloads.join(called, F.col("key") == F.col("_called")).select("key", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.explode(salts).alias("_salt"))
    others = rest.join(told, (F.col("sha256") == F.col("key")) & (F.col("salt") == F.col("_salt")), "left").select(*long_ones.columns)
    found = long_ones.unionByName(short_ones).unionByName(others)
    sound = (F.col("payload_digest") == F.col("stated_digest")) & (F.col("payload_bytes") == F.col("stated_bytes"))
    damage = F.raise_error(F.concat(F.lit("record without its payload "), F.col("stated_digest")))
    return found.select("page_id", "payload_bytes", F.when(sound, F.col("payload_digest")).otherwise(damage).alias("payload_digest"), "record_type", "refers_to")


def export(archive: Archive, path: str, records_per_file: int = 10_000) -> None:
    """Writes the records as WARC files: the blank lines that end a record are the text sink's line separator."""
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.col("header"), F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload")))
    reconstruct(archive).select(block.cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def import_files(spark, files: str, path: str) -> Archive:
    """An archive below path of the records in exported WARC files: a record ends where its stated length does.

    A file is one row, read by one task, so files should stay as small as `export` makes them.  Revisits name their payload
    by the SHA-1 of the response that they refer to.
    """
    import pyarrow as pa

    columns = "page_id long, record_type string, header binary, payload binary"

    def run(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                rows, at = [], 0
                while at < len(raw):
                    head = raw.index(b"\r\n\r\n", at) + 4
                    fields = dict(line.split(b": ", 1) for line in raw[at:head].split(b"\r\n")[1:] if line)
                    stop = head + int(fields[b"Content-Length"])
                    body = raw.index(b"\r\n\r\n", head) + 4
                    name = fields[b"WARC-Record-ID"][len(b"<urn:page:") : -1]
                    rows.append({"page_id": None if name == b"null" else int(name), "record_type": fields[b"WARC-Type"].decode(), "header": raw[at:body], "payload": raw[body:stop], "sha1": fields[b"WARC-Payload-Digest"][5:].decode()})
                    at = stop + 4
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("header", pa.binary()), ("payload", pa.binary()), ("sha1", pa.string())]))

    rows = spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, f"{columns}, sha1 string")
    responses = rows.where("record_type = 'response'").select("header", "payload", "sha1", F.unhex(F.sha2("payload", 256)).alias("sha256"))
    responses.groupBy("sha256").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    named = responses.groupBy("sha1").agg(F.first("sha256").alias("sha256"))
    revisits = rows.where("record_type = 'revisit'").select("header", "sha1").join(named, "sha1", "left")
    responses.select("header", "sha256").unionByName(revisits.select("header", "sha256")).write.option("compression", "zstd").parquet(f"{path}/records")
    return open_archive(spark, path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives the pages in the shared folder and reads them back."""
    return read_back(store(pages, scratch_path(pages.sparkSession, "warc")))
