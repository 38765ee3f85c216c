"""Relational schemas: keys, checks before emission, and DDL text with its digest.

tables: table_name, parent_table; columns: table_name, position, column_name, sql_type, nullable, key_position;
foreign_keys: table_name, column_name, target_table, target_column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import or_null, quoted, sql_identifier
from granary.sources.repository import dealt


def preflight(tables: DataFrame, columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """table_name, issue: repeated tables or columns, missing types, keys and targets that do not exist.

    Names of columns are a side that grows, so none of the joins is a broadcast.
    """
    named = columns.select("*", sql_identifier("column_name").alias("_id"))
    issue = lambda text: F.lit(text).alias("issue")
    repeated = tables.groupBy(sql_identifier("table_name").alias("_t")).agg(F.count(F.lit(1)).alias("n"), F.max("table_name").alias("table_name")).where("n > 1").select("table_name", issue("duplicate table"))
    twice = named.groupBy("table_name", "_id").count().where("count > 1").select("table_name", issue("duplicate column")).distinct()
    untyped = columns.where(or_null("sql_type").isNull()).select("table_name", issue("missing type")).distinct()
    sources = foreign_keys.select("*", sql_identifier("column_name").alias("_id"))
    lost = sources.join(dealt(named.select("table_name", "_id")), ["table_name", "_id"], "left_anti").select("table_name", issue("foreign key column missing"))
    there = named.select(F.col("table_name").alias("target_table"), F.col("_id").alias("_target"))
    goals = sources.join(dealt(named.select("table_name", "_id")), ["table_name", "_id"], "left_semi").withColumn("_target", sql_identifier("target_column"))
    nowhere = goals.join(dealt(there), ["target_table", "_target"], "left_anti").select("table_name", issue("foreign key target missing"))
    return repeated.unionByName(twice).unionByName(untyped).unionByName(lost).unionByName(nowhere)


def emit(tables: DataFrame, columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """table_name, ddl, ddl_hash: one CREATE TABLE a table; a table's columns are gathered in one row."""
    text = F.concat(F.lit("    "), quoted("column_name"), F.lit(" "), F.col("sql_type"), F.when(~F.coalesce("nullable", F.lit(True)), F.lit(" NOT NULL")).otherwise(F.lit("")))
    ordered = lambda value, by, when=None: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(by.alias("o"), value.alias("v"))) if when is not None else F.struct(by.alias("o"), value.alias("v")))), lambda x: x["v"])
    body = columns.groupBy("table_name").agg(ordered(text, F.col("position")).alias("lines"), ordered(quoted("column_name"), F.col("key_position"), F.col("key_position").isNotNull()).alias("keys"))
    link = F.concat(F.lit("    FOREIGN KEY ("), quoted("column_name"), F.lit(") REFERENCES "), quoted("target_table"), F.lit(" ("), quoted("target_column"), F.lit(")"))
    links = foreign_keys.groupBy("table_name").agg(ordered(link, F.col("column_name")).alias("links"))
    rows = tables.select("table_name").distinct().join(dealt(body), "table_name", "left").join(dealt(links), "table_name", "left")
    empty = F.array().cast("array<string>")
    key = F.when(F.size(F.coalesce("keys", empty)) > 0, F.array(F.concat(F.lit("    PRIMARY KEY ("), F.array_join("keys", ", "), F.lit(")")))).otherwise(empty)
    parts = F.concat(F.coalesce("lines", empty), key, F.coalesce("links", empty))
    parts = F.when(F.size(parts) == 0, F.array(F.lit("    -- no automatically mappable columns"))).otherwise(parts)
    ddl = F.concat(F.lit("CREATE TABLE "), quoted("table_name"), F.lit(" (\n"), F.array_join(parts, ",\n"), F.lit("\n);"))
    return rows.select("table_name", ddl.alias("ddl")).select("*", F.sha2("ddl", 256).alias("ddl_hash"))


def generated(ddl: DataFrame, issues: DataFrame, warnings: DataFrame) -> DataFrame:
    """ddl rows with status; a table with issues has no text and no digest.  warnings: table_name, reason."""
    failed = issues.groupBy("table_name").agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    warned = warnings.groupBy("table_name").agg(F.array_sort(F.collect_set("reason")).alias("warnings"))
    rows = ddl.join(failed, "table_name", "left").join(warned, "table_name", "left")
    bad, noted = F.col("issues").isNotNull(), F.col("warnings").isNotNull()
    return rows.select(
        "table_name", F.when(bad, "FAILED").when(noted, "REVIEW_REQUIRED").otherwise("GENERATED").alias("status"), F.when(bad, "").otherwise(F.col("ddl")).alias("ddl"),
        F.when(~bad, F.col("ddl_hash")).alias("ddl_hash"), "issues", "warnings",
    )


def match_keys(fields: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (dataset, key_offset, key_length) against fields (dataset, name, absolute_offset, byte_length).

    One field at that offset and length is the key; several are ambiguous; none is a mismatch of length or unresolved.
    """
    at = F.col("absolute_offset") == F.col("key_offset")
    exact = at & (F.col("byte_length") == F.col("key_length"))
    joined = keys.join(dealt(fields.withColumnRenamed("dataset", "_dataset")), (F.col("dataset") == F.col("_dataset")) & at, "left")
    found = joined.groupBy("dataset", "key_offset", "key_length").agg(F.count_if(exact).alias("n"), F.count_if(at).alias("n_at"), F.min(F.when(exact, F.col("name"))).alias("_name"))
    status = F.when(F.col("n") == 1, "PRIMARY_KEY").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("n_at") > 0, "UNRESOLVED_LENGTH_MISMATCH").otherwise("UNRESOLVED")
    return found.select("dataset", "key_offset", "key_length", status.alias("status"), F.when(F.col("n") == 1, F.col("_name")).alias("column_name"))


def schema_of(nodes: DataFrame) -> DataFrame:
    """Columns (path, table_name, position, column_name, sql_type) of the layouts' elementary items outside repetitions and overlays."""
    from granary.functions.picture import sql_type
    from granary.functions.text import schema_identifier
    from granary.operators.intervals import inside

    stores = ~F.col("node_type").isin("CONDITION", "RENAMES")
    out = stores & (F.col("occurs_min").isNotNull() | F.col("redefines_target").isNotNull())
    leaves = inside(nodes, out).where(F.col("pic").isNotNull() & ~F.col("is_filler") & ~F.col("inside"))
    mapped = sql_type(F.col("pic_category"), F.col("precision"), F.col("scale"), F.col("logical_length"), F.col("usage"))
    return leaves.select("path", schema_identifier(F.regexp_extract("path", r"([^/]*?)(\.[^.]*)?$", 1)).alias("table_name"), F.col("seq").alias("position"), schema_identifier("name").alias("column_name"), mapped.alias("m")).select("path", "table_name", "position", "column_name", "m.*")
