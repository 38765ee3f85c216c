"""Column functions for PICTURE clauses: meaning, storage, and relational types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import col, or_null

# fixed values: spellings of a usage
USAGES = {"COMPUTATIONAL": "COMP", "COMPUTATIONAL-1": "COMP-1", "COMPUTATIONAL-2": "COMP-2", "COMPUTATIONAL-3": "COMP-3", "PACKED-DECIMAL": "COMP-3"}
# fixed values: what a relational type may be called
TYPES = ("SMALLINT", "INTEGER", "BIGINT", "NUMERIC", "REAL", "DOUBLE PRECISION", "VARCHAR", "TEXT", "DATE", "JSONB")
LONGEST_VARCHAR, MOST_DIGITS = 10_485_760, 1000


def usage(value: str | Column) -> Column:
    source = F.upper(F.replace(F.coalesce(or_null(value), F.lit("DISPLAY")), F.lit(" "), F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in USAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, source), source)


def _count(text: Column, symbols: str) -> Column:
    """Symbols in a picture, with their repeat counts."""
    repeats = F.regexp_extract_all(text, F.lit(rf"[{symbols}](?:\((\d+)\))?"), F.lit(1))
    return F.aggregate(F.transform(repeats, lambda x: F.when(x == "", 1).otherwise(x.cast("int"))), F.lit(0), lambda a, x: a + x)


def meaning(pic: str | Column, usage_: str | Column) -> Column:
    """Struct: category, signed, precision, scale, logical_length, usage."""
    raw = F.upper(F.replace(F.coalesce(col(pic), F.lit("")), F.lit(" "), F.lit("")))
    # the first V divides the digits
    whole = F.substring_index(raw, "V", 1)
    fraction = F.when(F.instr(raw, "V") > 0, F.regexp_replace(raw, "^[^V]*V", "")).otherwise("")
    alpha, before, after = _count(raw, "XA"), _count(whole, "9Z"), _count(fraction, "9Z")
    digits = before + after
    category = F.when(raw == "", "GROUP").when((alpha > 0) & raw.contains("X"), "ALPHANUMERIC").when(alpha > 0, "ALPHABETIC").when(digits > 0, "NUMERIC").otherwise("UNSUPPORTED")
    return F.struct(
        category.alias("category"),
        raw.startswith("S").alias("signed"),
        F.when((alpha == 0) & (digits > 0), digits).alias("precision"),
        F.when(raw == "", 0).otherwise(after).alias("scale"),
        F.when(alpha > 0, alpha).when(digits > 0, digits).alias("logical_length"),
        usage(usage_).alias("usage"),
    )


def physical_length(node_type: Column, logical: Column, precision: Column, usage_: Column) -> Column:
    """Bytes of one occurrence of an elementary item; null where storage is not known."""
    digits = F.coalesce(precision, F.lit(0))
    return (
        F.when(node_type.isin("CONDITION", "RENAMES"), 0)
        .when(logical.isNull(), F.lit(None).cast("int"))
        .when(usage_ == "DISPLAY", logical)
        .when(usage_ == "COMP-3", F.ceil((digits + 1) / 2).cast("int"))
        .when(usage_.isin("COMP", "BINARY") & (digits <= 4), 2)
        .when(usage_.isin("COMP", "BINARY") & (digits <= 9), 4)
        .when(usage_.isin("COMP", "BINARY") & (digits <= 18), 8)
        .when(usage_ == "COMP-1", 4)
        .when(usage_ == "COMP-2", 8)
    )


def sql_type(category: Column, precision: Column, scale: Column, logical: Column, usage_: Column) -> Column:
    """Struct: sql_type, logical_type, confidence, quality, from parsed meaning."""
    p, s = precision.cast("string"), scale.cast("string")
    text = category.isin("ALPHANUMERIC", "ALPHABETIC") & (logical > 0)
    number = (category == "NUMERIC") & (precision > 0)
    scaled = F.coalesce(scale, F.lit(0)) > 0
    sql = (
        F.when(text, F.concat(F.lit("VARCHAR("), logical.cast("string"), F.lit(")")))
        .when(number & (usage_ == "COMP-1"), "REAL")
        .when(number & (usage_ == "COMP-2"), "DOUBLE PRECISION")
        .when(number & scaled, F.concat(F.lit("NUMERIC("), p, F.lit(","), s, F.lit(")")))
        .when(number & (precision <= 4), "SMALLINT")
        .when(number & (precision <= 9), "INTEGER")
        .when(number & (precision <= 18), "BIGINT")
        .when(number, F.concat(F.lit("NUMERIC("), p, F.lit(", 0)")))
    )
    logical_type = (
        F.when(text, "String").when(number & (usage_ == "COMP-1"), "Float").when(number & (usage_ == "COMP-2"), "Double")
        .when(number & (scaled | (precision > 18)), "Decimal").when(number, "Integer").otherwise("Unknown")
    )
    known = sql.isNotNull()
    return F.struct(sql.alias("sql_type"), logical_type.alias("logical_type"), F.when(known, "HIGH").otherwise("LOW").alias("confidence"), F.when(known, "EXACT").otherwise("REVIEW_REQUIRED").alias("quality"))


def looks_like_date(name: str | Column, pic: str | Column) -> Column:
    return col(pic).isin("9(8)", "9(6)", "99999999", "999999") & F.upper(col(name)).rlike("DATE|-DT|DT-|_DT|DT_")


def is_valid_type(sql: str | Column) -> Column:
    upper = F.upper(col(sql))
    base = F.substring_index(upper, "(", 1)
    length = F.regexp_extract(upper, r"VARCHAR\((\d+)\)", 1)
    p, s = (F.regexp_extract(upper, r"NUMERIC\((\d+)(?:,\s*(\d+))?\)", i) for i in (1, 2))
    fits = F.when((base == "VARCHAR") & (length != ""), length.cast("long") <= LONGEST_VARCHAR).when((base == "NUMERIC") & (p != ""), (p.cast("long") <= MOST_DIGITS) & (F.coalesce(or_null(s).cast("long"), F.lit(0)) <= p.cast("long"))).otherwise(True)
    return base.isin(*TYPES) & fits


def legacy_type(pic: str | Column, name: str | Column = "") -> Column:
    """sql_type, logical_type, confidence of a picture with its usage in one text, by the older rules: digits default to
    4, more than 1000 are open, what is unknown is TEXT."""
    p = F.replace(F.upper(F.trim(F.coalesce(col(pic), F.lit("")))), F.lit(" "), F.lit(""))
    named = F.lit(name) if name == "" else col(name)
    text = p.rlike(r"^[XA]|[XA]\(")
    n_of = lambda t, symbols: F.regexp_count(t, F.lit(f"[{symbols}]"))
    stated = lambda t, symbols: F.regexp_extract(t, rf"[{symbols}]\((\d+)\)", 1)
    width = F.coalesce(or_null(stated(p, "XA")).cast("long"), F.greatest(n_of(p, "X"), n_of(p, "A"), F.lit(1)).cast("long"))
    whole, part = F.split_part(p, F.lit("V"), F.lit(1)), F.split_part(p, F.lit("V"), F.lit(2))
    digits = lambda t, symbols: F.coalesce(or_null(stated(t, "9")).cast("long"), n_of(t, symbols).cast("long"))
    scale = digits(part, "9")
    total = digits(whole, "9Z") + scale
    some = lambda n: F.when(n == 0, 4).otherwise(n)
    n = some(digits(p, "9Z"))
    by_size = F.when(n <= 4, "SMALLINT").when(n <= 9, "INTEGER").when(n <= 18, "BIGINT").otherwise(F.format_string("NUMERIC(%d, 0)", n))
    size_name = F.when(n <= 18, "Integer").otherwise("Large Integer")
    said = lambda sql, logical, sure="HIGH": F.struct((sql if isinstance(sql, Column) else F.lit(sql)).alias("sql_type"), (logical if isinstance(logical, Column) else F.lit(logical)).alias("logical_type"), F.lit(sure).alias("confidence"))
    numeric = p.rlike("9|V|COMP|BINARY|Z")
    return (
        F.when((p == "") | (F.upper(F.coalesce(col(pic), F.lit(""))) == "GROUP"), said("JSONB", "Group"))
        .when(looks_like_date(named, p), said("DATE", "Date", "MEDIUM"))
        .when(text, said(F.format_string("VARCHAR(%d)", F.least(width, F.lit(LONGEST_VARCHAR).cast("long"))), "String"))
        .when(numeric & p.contains("V") & (total > MOST_DIGITS), said("NUMERIC", "Decimal", "LOW"))
        .when(numeric & p.contains("V"), said(F.format_string("NUMERIC(%d, %d)", some(total), scale), "Decimal"))
        .when(numeric & p.rlike("COMP-3|PACKED-DECIMAL"), said(F.format_string("NUMERIC(%d, 0)", n), "Packed Decimal"))
        .when(numeric & p.contains("COMP-1"), said("REAL", "Float"))
        .when(numeric & p.contains("COMP-2"), said("DOUBLE PRECISION", "Double"))
        .when(numeric, said(by_size, size_name))
        .otherwise(said("TEXT", "Unknown", "LOW"))
    )


def _first_count(text: Column, symbols: str) -> Column:
    """The first stated repeat count, else how often the first of the symbols that occurs stands there."""
    n = F.regexp_extract(text, rf"[{symbols}]\((\d+)\)", 1)
    alone = [F.when(text.contains(s), F.regexp_count(text, F.lit(s))) for s in symbols]
    return F.coalesce(or_null(n).cast("int"), *alone, F.lit(0))


def _binary_bytes(digits: Column) -> Column:
    return F.when(digits <= 4, 2).when(digits <= 9, 4).otherwise(8)


def older_storage(pic: str | Column) -> Column:
    """Bytes of a picture with its usage in one text; every symbol counts with its repetitions."""
    p = F.upper(F.trim(F.coalesce(col(pic), F.lit(""))))
    digits, alpha = _count(F.regexp_replace(p, "[SV]", ""), "9"), _count(p, "XA")
    return (
        F.when(p == "", 0).when(p.contains("COMP-1"), 4).when(p.contains("COMP-2"), 8)
        .when(p.rlike("COMP-3|PACKED-DECIMAL"), F.ceil((digits + 1) / 2).cast("int"))
        .when(p.rlike("COMP|BINARY"), _binary_bytes(digits))
        .when(alpha > 0, alpha).otherwise(digits)
    )


def older_length(pic: str | Column) -> Column:
    """Bytes of a picture by its first stated counts before and after the first V; 0 for groups and what is unknown."""
    p = F.upper(F.trim(F.coalesce(col(pic), F.lit(""))))
    at = F.instr(p, "V")
    whole, part = F.when(at > 0, F.substring_index(p, "V", 1)).otherwise(p), F.when(at > 0, F.substr(p, at + 1)).otherwise("")
    digits = _first_count(whole, "9") + _first_count(part, "9")
    return (
        F.when(p.isin("", "GROUP"), 0).when(p.rlike("COMP-3|PACKED-DECIMAL"), F.ceil((digits + 1) / 2).cast("int"))
        .when(p.contains("COMP-1"), 4).when(p.contains("COMP-2"), 8).when(p.rlike("COMP|BINARY"), _binary_bytes(digits))
        .when(p.rlike("[XA]"), _first_count(p, "XA")).otherwise(digits)
    )


def symbol_length(pic: str | Column) -> Column:
    """All symbols of a picture but signs and the implied point, with their repetitions; null for none."""
    return F.nullif(_count(F.regexp_replace(F.upper(F.coalesce(col(pic), F.lit(""))), "V|S|CR|DB", ""), "X9AZB0*/+\\-"), F.lit(0))


def flat_type(data_type: str | Column) -> Column:
    """The relational type of a flat field by its picture alone."""
    t = F.rtrim(F.upper(F.coalesce(col(data_type), F.lit(""))), F.lit("."))
    width = F.regexp_extract(t, r"X\((\d+)\)", 1)
    number = r"9\((\d+)\)(?:V9\((\d+)\)|V(9+))?"
    whole, stated, spelt = (F.regexp_extract(t, number, i) for i in (1, 2, 3))
    scale = F.coalesce(or_null(stated).cast("int"), F.length(spelt))
    p = or_null(whole).cast("int")
    numeric = F.when(p.isNull(), "NUMERIC").when(scale > 0, F.format_string("NUMERIC(%d,%d)", p + scale, scale)).when(p <= 9, "INTEGER").otherwise("BIGINT")
    return F.when(t.startswith("X"), F.when(width != "", F.format_string("VARCHAR(%s)", width)).otherwise("TEXT")).when(t.rlike("^S?9"), numeric).otherwise("TEXT")


def catalog_type_matches(expected: str | Column, data_type: str | Column, udt: str | Column, precision: str | Column, scale: str | Column) -> Column:
    """Whether a database's catalog shows the type that was asked for; arrays and lengths are not looked into."""
    want, found = F.upper(F.coalesce(col(expected), F.lit(""))), col(data_type)
    p, s = (or_null(F.regexp_extract(want, r"NUMERIC\((\d+),(\d+)\)", i)).cast("int") for i in (1, 2))
    same = (
        F.when(want == "", False).when(want.endswith("[]"), found == "ARRAY").when(want == "BIGSERIAL", found == "bigint")
        .when(want.startswith("VARCHAR"), found == "character varying")
        .when(want.startswith("NUMERIC"), (found == "numeric") & (p.isNull() | (p.eqNullSafe(col(precision)) & s.eqNullSafe(col(scale)))))
        .otherwise((F.upper(found) == want) | (F.upper(col(udt)) == want))
    )
    return F.coalesce(same, F.lit(False))
