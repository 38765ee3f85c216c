"""Facts about datasets and schemas from listings, JSON exports and mapped columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.picture import is_valid_type
from granary.functions.text import col, or_null, redacted, redacted_map
from granary.operators.evidence import evidence
from granary.operators.substrings import substring_join

# fixed values: words in a listing's column names that tell a number
NUMBERS = {
    "record_length": ("LRECL", "RECORD LENGTH", "RECORD_LENGTH", "LENGTH"), "key_length": ("KEYLEN", "KEY LENGTH", "KEY_LENGTH", "KEY LEN"), "key_offset": ("KEYOFF", "KEY OFFSET", "KEY_OFFSET", "KEY OFF"),
    "control_interval": ("CISIZE", "CI SIZE", "CI_SIZE", "CI"), "records": ("REC-TOTAL", "RECORDS", "RECORD COUNT", "COUNT"),
}
ORGANIZATIONS = ("KSDS", "ESDS", "RRDS", "LDS")
DSN = r"[A-Z0-9#$@-]+(?:\.[A-Z0-9#$@-]+)+"


def json_entries(files: DataFrame) -> DataFrame:
    """Evidence rows of JSON catalogs (path, content): a list of objects, or one; those with name and organization."""
    text = F.trim("content")
    items = F.from_json(F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), "array<map<string,string>>")
    rows = files.select("path", F.posexplode(items).alias("_at", "_item"))
    of = lambda k: or_null(F.try_element_at("_item", F.lit(k)))
    rows = rows.where(of("dsn").isNotNull() & of("organization").isNotNull())
    kind = F.coalesce(of("entry_type"), of("type"), F.lit("DATASET"))
    entry = evidence("CATALOG_ENTRY", "Dataset", of("dsn"), kind, {})[:-1]
    others = F.map_filter("_item", lambda k, v: (k != "entry_type") & v.isNotNull())
    return rows.select("path", (F.col("_at") + 1).alias("source_line"), *entry, F.map_concat(others, F.create_map(F.lit("entry_type"), kind)).alias("properties"))


def json_errors(files: DataFrame) -> DataFrame:
    """(path, error) of JSON catalogs that are no JSON: `json_entries` has no rows of them."""
    return files.where(F.col("content").isNotNull() & F.try_parse_json("content").isNull()).select("path", F.lit("malformed JSON").alias("error"))


def listing_facts(rows: DataFrame, datasets: DataFrame, whole: bool = False) -> DataFrame:
    """For every dataset (dsn) the first row (path, row_no, cells: header to value) with a cell that names it, and its numbers.

    The header's first match tells a number, its digits the value; a cell names every dataset that is part of its text, or,
    if whole, that it spells as a whole name.
    """
    digits = lambda v: or_null(F.regexp_replace(v, r"\D", "")).cast("long")

    # a cell's digits are read once, for all numbers that its header may tell
    rows = rows.withColumn("_cells", F.transform(F.map_entries("cells"), lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value"), digits(e["value"]).alias("number"))))
    cells = F.col("_cells")

    def number(words: tuple[str, ...]) -> Column:
        right = F.filter(cells, lambda e: reduce(Column.__or__, [e["key"].contains(w) for w in words]) & e["number"].isNotNull())
        return F.try_element_at(right, F.lit(1))["number"]

    kinds = F.upper(F.array_join(F.transform(F.filter(cells, lambda e: e["key"].contains("TYPE")), lambda e: e["value"]), " "))
    organization = F.coalesce(*[F.when(kinds.contains(x), x) for x in ORGANIZATIONS], F.lit("UNKNOWN"))
    facts = [*[number(w).alias(k) for k, w in NUMBERS.items()], organization.alias("organization")]
    if whole:
        named = F.explode(F.array_distinct(F.flatten(F.transform(F.map_values("cells"), lambda v: F.regexp_extract_all(F.upper(v), F.lit(DSN), F.lit(0))))))
        told = rows.select("path", "row_no", *facts, named.alias("dsn"))
    else:  # all cells of a row as one text: no name goes on from one cell into the next
        text = F.upper(F.array_join(F.map_values("cells"), "\n"))
        told = substring_join(rows.select("path", "row_no", *facts, text.alias("_text")), "_text", datasets, "dsn")
    first = F.struct("path", "row_no", *NUMBERS, "organization")
    best = told.groupBy("dsn").agg(F.min_by(first, F.struct("path", "row_no")).alias("f"))
    return datasets.select("dsn").distinct().join(best, "dsn").select("dsn", "f.*", F.lit(0.9).alias("confidence"))


def mapping_summary(columns: DataFrame, *by: str) -> DataFrame:
    """Thirteen counts over mapped columns; excluded ones count only in the total and as handled."""
    active = ~F.coalesce("is_excluded", F.lit(False))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    n = lambda name, when: F.count_if(is_(when)).alias(name)
    of = F.col
    return columns.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_fields"), n("postgres_compatible", active & (of("confidence") == "HIGH")),
        n("requires_review", active & (is_(of("confidence").isin("LOW", "MEDIUM")) | is_(of("schema_status").contains("REVIEW")))),
        n("unsupported", active & (is_(of("logical_type") == "Unknown") | ~is_(is_valid_type("sql_type")))),
        n("numeric_conversions", active & of("logical_type").isin("Integer", "Decimal", "Packed Decimal", "Large Integer", "Float", "Double")),
        n("character_conversions", active & (of("logical_type") == "String")), n("date_conversions", active & (of("logical_type") == "Date")),
        n("redefines_handled", of("is_excluded")), n("alternate_repr_fields", of("is_alternate")), n("occurs_fields", active & of("occurs").isNotNull()),
        n("occurs_needs_review", active & (of("occurs_strategy") == "REVIEW_REQUIRED")), n("occurs_inline_array", active & (of("occurs_strategy") == "INLINE_ARRAY")), n("occurs_child_table", active & (of("occurs_strategy") == "CHILD_TABLE")),
    )


def flat_tables(columns: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tables, columns and foreign keys of flat input: columns (table_name, position, column_name, sql_type, is_primary),
    children (table_name, child, position, column_name, sql_type).  A child gets the parent's first key and its place, if
    the parent has a key."""
    nth = F.when(F.col("is_primary"), F.sum(F.col("is_primary").cast("int")).over(W.partitionBy("table_name").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)))
    own = columns.select("table_name", F.col("position").cast("int").alias("position"), "column_name", "sql_type", F.lit(True).alias("nullable"), nth.cast("int").alias("key_position"))
    key = own.where("key_position = 1").select("table_name", F.col("column_name").alias("_key"), F.col("sql_type").alias("_type"))
    name = F.concat_ws("_", "table_name", "child")
    kids = children.select("table_name", "child").distinct().join(key, "table_name", "left").select(name.alias("name"), F.col("table_name").alias("parent_table"), "_key", "_type")
    linked = kids.where("_key IS NOT NULL").select("*", F.concat(F.lit("PARENT_"), "_key").alias("_link"))
    one = lambda at, c, t: F.struct(F.lit(at).alias("position"), c.alias("column_name"), t.alias("sql_type"), F.lit(False).alias("nullable"), F.lit(at + 3).alias("key_position"))
    added = linked.select(F.col("name").alias("table_name"), F.inline(F.array(one(-2, F.col("_link"), F.col("_type")), one(-1, F.lit("OCCURRENCE_INDEX"), F.lit("INTEGER")))))
    plain = children.select(name.alias("table_name"), F.col("position").cast("int").alias("position"), "column_name", "sql_type", F.lit(True).alias("nullable"), F.lit(None).cast("int").alias("key_position"))
    tables = columns.select("table_name", F.lit(None).cast("string").alias("parent_table")).distinct().unionByName(kids.select(F.col("name").alias("table_name"), "parent_table"))
    keys = linked.select(F.col("name").alias("table_name"), F.col("_link").alias("column_name"), F.col("parent_table").alias("target_table"), F.col("_key").alias("target_column"))
    return tables, own.unionByName(added).unionByName(plain), keys


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that only one of two sets has, with the side that lacks them."""
    a, b = expected.distinct(), actual.select(*expected.columns).distinct()
    return a.exceptAll(b).withColumn("status", F.lit("MISSING")).unionByName(b.exceptAll(a).withColumn("status", F.lit("UNEXPECTED")))


def canonical_name(name: str | Column, aliases: dict[str, str]) -> Column:
    """The name that stands for all names with a known word; the name itself for others."""
    out = F.coalesce(*[F.when(F.upper(col(name)).contains(k.upper()), v) for k, v in aliases.items()], col(name))
    return out


def recorded(rows: DataFrame, run_id: str, **fields: Column) -> DataFrame:
    """Audit events of rows: the given fields with run_id, credentials and local paths taken out of texts and maps."""
    clean = {"summary": redacted, "source_file": redacted, "details": redacted_map, "metadata": redacted_map}
    return rows.select(F.lit(run_id).alias("run_id"), *[(clean[k](v) if k in clean else v).alias(k) for k, v in fields.items()])


def stale(artifacts: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Types of stored artifacts (artifact_type, properties) of which some lack their version marker, with their number."""
    lacks = F.coalesce(*[F.when(F.col("artifact_type") == k, or_null(F.try_element_at("properties", F.lit(v))).isNull()) for k, v in markers.items()], F.lit(False))
    return artifacts.where(lacks).groupBy("artifact_type").agg(F.count(F.lit(1)).alias("n_stale"))
