"""DDL text read back into catalog rows, and held against what it should say, without a database.

Statements, their items and the parts of an item are cut out by patterns in the JVM: a comma inside parentheses never
separates items, as names that were made by this library have neither commas nor parentheses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.picture import catalog_type_matches
from granary.functions.text import or_null, sql_identifier

STATEMENT = r'(?is)CREATE\s+TABLE\s+"?([A-Za-z0-9_]+)"?\s*\((.*?)\)\s*;'
# fixed values: how a catalog shows a type: its name, the name below it, bits or digits
SHOWN = {
    "BIGSERIAL": ("bigint", "int8", 64), "BIGINT": ("bigint", "int8", 64), "INTEGER": ("integer", "int4", 32), "SMALLINT": ("smallint", "int2", 16),
    "REAL": ("real", "float4", 24), "DOUBLE PRECISION": ("double precision", "float8", 53), "VARCHAR": ("character varying", "varchar", None),
    "NUMERIC": ("numeric", "numeric", None), "TEXT": ("text", "text", None), "DATE": ("date", "date", None), "BOOLEAN": ("boolean", "bool", None),
    "JSONB": ("jsonb", "jsonb", None), "TIMESTAMP": ("timestamp without time zone", "timestamp", None),
}


@dataclass(frozen=True)
class Catalog:
    """tables (id, table_name), columns (id, table_name, position, column_name, data_type, udt_name, precision, scale,
    nullable), primary keys (id, table_name, columns), foreign keys (id, table_name, column_name, target_table, target_column)."""

    tables: DataFrame
    columns: DataFrame
    primary_keys: DataFrame
    foreign_keys: DataFrame


def _looked_up(base: Column, at: int) -> Column:
    return F.coalesce(*[F.when(base == k, F.lit(v[at])) for k, v in SHOWN.items()])


def read(scripts: DataFrame) -> Catalog:
    """The catalog that scripts (id, ddl) would make; text that is no CREATE TABLE makes nothing."""
    statements = scripts.select("id", F.posexplode(F.regexp_extract_all("ddl", F.lit(STATEMENT), F.lit(0))).alias("_nth", "_s"))
    rows = statements.select("id", "_nth", F.regexp_extract("_s", STATEMENT, 1).alias("table_name"), F.regexp_extract("_s", STATEMENT, 2).alias("_body"))
    # commas in parentheses become semicolons, comments end with their line
    body = F.regexp_replace(F.regexp_replace("_body", r"--[^\n]*", ""), r",(?=[^()]*\))", ";")
    items = rows.select("id", "table_name", F.posexplode(F.split(body, ",")).alias("_at", "_item")).select("id", "table_name", "_at", F.btrim("_item", F.lit(" \n\t\r")).alias("_item")).where("_item <> ''")
    part = lambda p, i=1: F.regexp_extract("_item", p, i)
    names = lambda c: F.transform(F.split(c, ";"), lambda x: F.btrim(F.btrim(x), F.lit('"')))
    key, link = r"(?is)^PRIMARY\s+KEY\s*\(([^)]*)\)", r'(?is)^FOREIGN\s+KEY\s*\("?([^")]*)"?\)\s*REFERENCES\s+"?([^"\s(]*)"?\s*\("?([^")]*)"?\)'
    keys = items.where(F.col("_item").rlike(key)).select("id", "table_name", names(part(key)).alias("columns"))
    links = items.where(F.col("_item").rlike(link)).select("id", "table_name", part(link).alias("column_name"), part(link, 2).alias("target_table"), part(link, 3).alias("target_column"))
    plain = items.where(~F.col("_item").rlike(r"(?i)^(PRIMARY|FOREIGN)\s+KEY"))
    column = r'(?is)^"?([A-Za-z0-9_]+)"?\s+(.*?)(\s+NOT\s+NULL)?$'
    typed = plain.select("id", "table_name", (F.col("_at") + 1).alias("position"), part(column).alias("column_name"), F.upper(part(column, 2)).alias("_type"), (part(column, 3) == "").alias("nullable"))
    is_array, base = F.col("_type").endswith("[]"), F.btrim(F.regexp_replace("_type", r"\(.*|\[\]", ""))
    number = lambda i: or_null(F.regexp_extract("_type", r"NUMERIC\((\d+)(?:\s*;\s*(\d+))?\)", i)).cast("int")
    digits = F.coalesce(number(1), F.when(base != "NUMERIC", _looked_up(base, 2).cast("int")))
    whole = F.when(base.isin("BIGSERIAL", "BIGINT", "INTEGER", "SMALLINT"), F.lit(0))
    columns = typed.select(
        "id", "table_name", "position", "column_name", F.when(is_array, "ARRAY").otherwise(F.coalesce(_looked_up(base, 0), F.lower(base))).alias("data_type"),
        F.when(is_array, F.concat(F.lit("_"), _looked_up(base, 1))).otherwise(F.coalesce(_looked_up(base, 1), F.lower(base))).alias("udt_name"), F.when(~is_array, digits).alias("precision"),
        F.when(~is_array, F.coalesce(number(2), F.when(number(1).isNotNull(), F.lit(0)), whole)).alias("scale"), "nullable")
    return Catalog(rows.select("id", "table_name").distinct(), columns, keys, links)


def checks(found: Catalog, tables: DataFrame, columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """id, check, passed: the sets of tables, every expected column's type, every primary key in order, every foreign key.

    Expected are tables (id, table_name), columns (id, table_name, column_name, sql_type, key_position), foreign_keys (id,
    table_name, column_name, target_table, target_column), under names that become identifiers.
    """
    name = sql_identifier
    there = found.tables.select("id", "table_name", F.lit(1).alias("_there"))
    wanted = tables.select("id", name("table_name").alias("table_name"), F.lit(1).alias("_wanted")).distinct()
    both = there.join(wanted, ["id", "table_name"], "full_outer").groupBy("id").agg(F.bool_and(F.col("_there").isNotNull() & F.col("_wanted").isNotNull()).alias("passed"))
    out = both.select("id", F.lit("tables").alias("check"), "passed")
    asked = columns.select("id", name("table_name").alias("table_name"), name("column_name").alias("column_name"), "sql_type", "key_position")
    seen = asked.join(found.columns, ["id", "table_name", "column_name"], "left")
    right = F.col("data_type").isNotNull() & catalog_type_matches("sql_type", "data_type", "udt_name", "precision", "scale")
    out = out.unionByName(seen.select("id", F.concat_ws(".", F.concat(F.lit("column:"), "table_name"), "column_name").alias("check"), F.coalesce(right, F.lit(False)).alias("passed")))
    order = F.array_sort(F.collect_list(F.when(F.col("key_position").isNotNull(), F.struct(F.col("key_position").alias("o"), F.col("column_name").alias("v")))))
    keys = asked.groupBy("id", "table_name").agg(F.transform(order, lambda x: x["v"]).alias("_expected")).join(found.primary_keys, ["id", "table_name"], "left")
    none = F.array().cast("array<string>")
    out = out.unionByName(keys.select("id", F.concat(F.lit("pk:"), "table_name").alias("check"), (F.col("_expected") == F.coalesce("columns", none)).alias("passed")))
    own = ["id", "table_name", "column_name", "target_table", "target_column"]
    links = foreign_keys.select("id", *[name(c).alias(c) for c in own[1:]]).join(found.foreign_keys.withColumn("_there", F.lit(True)), own, "left")
    return out.unionByName(links.select("id", F.concat_ws(".", F.concat(F.lit("fk:"), "table_name"), "column_name").alias("check"), F.col("_there").isNotNull().alias("passed")))


def validated(generated: DataFrame, tables: DataFrame, columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """generated (id, status, ddl, ddl_hash) with validation_status, failed (names of failed checks) and n_checks.

    A failed generation is not looked at; empty text and text that is not what its digest says fail; else all checks count,
    and a schema under review stays under review.
    """
    empty = F.coalesce(F.col("ddl"), F.lit("")) == ""
    sound = F.coalesce(F.sha2("ddl", 256) == F.col("ddl_hash"), F.lit(False))
    made = F.coalesce(F.col("status") != "FAILED", F.lit(True))
    found = read(generated.where(made & ~empty & sound).select("id", "ddl"))
    told = checks(found, tables, columns, foreign_keys).groupBy("id").agg(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("failed"), F.count(F.lit(1)).alias("n_checks"))
    rows = generated.join(told, "id", "left")
    bad = empty | ~sound | (F.size("failed") > 0)
    status = F.when(~made, "NOT_EXECUTED_GENERATION_FAILED").when(bad, "FAILED_VALIDATION").when(F.col("status") == "REVIEW_REQUIRED", "REVIEW_REQUIRED_VALIDATED_SAFE_SUBSET").otherwise("VALIDATED")
    looked = made & ~empty & sound
    return rows.select(*generated.columns, status.alias("validation_status"), F.when(looked, F.col("failed")).alias("failed"), F.when(looked, F.col("n_checks")).alias("n_checks"))
