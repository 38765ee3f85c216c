"""Column functions over paths, identifiers, source lines and free text.  All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of credentials and of local drive paths
SECRET = r"(?i)(password|passwd|secret|token|api[_-]?key|authorization)\s*([:=])\s*([^\s,;]+)"
SECRET_KEY = r"(?i)(password|passwd|secret|token|api[_-]?key|authorization)"
DRIVE_PATH = r"(?i)[a-z]:\\[^\r\n]*"
# fixed values: everything that ends a line in a source text
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_null(c: str | Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(col(c), F.lit(""))


def first_of(*choices: Column) -> Column:
    """The first choice that is neither null nor empty."""
    return F.coalesce(*[or_null(c) for c in choices])


def basename(path: str | Column) -> Column:
    return F.substring_index(F.replace(col(path), F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: str | Column) -> Column:
    """Lower-case extension with its dot; empty for none, and for names that only begin with dots."""
    return F.regexp_extract(F.lower(basename(path)), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: str | Column) -> Column:
    """Upper-case base name without its last extension: the key of an artifact."""
    return F.upper(F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", ""))


def short_stem(path: str | Column) -> Column:
    """Upper-case base name up to its first dot: the key of rows for a remote store."""
    return F.upper(F.substring_index(basename(path), ".", 1))


def schema_identifier(name: str | Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(F.upper(col(name)), "[^A-Z0-9_]+", "_"), F.lit("_"))
    return F.coalesce(or_null(cleaned), F.lit("FIELD"))


def sql_identifier(name: str | Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(col(name), "[^A-Za-z0-9_]+", "_"), F.lit("_"))
    return F.coalesce(or_null(F.lower(cleaned)), F.lit("unnamed"))


def quoted(name: str | Column) -> Column:
    return F.concat(F.lit('"'), sql_identifier(name), F.lit('"'))


def redacted(text: str | Column) -> Column:
    """Credentials and local drive paths taken out of a text."""
    return F.regexp_replace(F.regexp_replace(col(text), SECRET, "$1$2[REDACTED]"), DRIVE_PATH, "[LOCAL_PATH]")


def redacted_map(properties: str | Column) -> Column:
    return F.transform_values(col(properties), lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit("[REDACTED]")).otherwise(redacted(v)))


def pruned_map(properties: str | Column) -> Column:
    """Without entries that are null or empty."""
    return F.map_filter(col(properties), lambda k, v: v.isNotNull() & (v != ""))


def code_area(line: str | Column) -> Column:
    """What follows sequence number and indicator of a numbered fixed-format line; other lines as they are."""
    return F.when(col(line).rlike(r"^\d{6}"), F.substr(col(line), F.lit(8))).otherwise(col(line))


def is_comment(line: str | Column) -> Column:
    return F.ltrim(col(line)).rlike(r"^($|\*|/\*)")


def keyword_value(text: str | Column, keyword: str) -> Column:
    """Value of KEYWORD=value: quoted (without its quotes), in parentheses up to the first closing one, or a bare run."""
    found = F.regexp_extract(col(text), rf"(?i)\b{keyword}\s*=\s*('[^']*'|\([^)]*\)|[^,\s]+)", 1)
    return or_null(F.regexp_replace(found, "^'([^']*)'$", "$1"))


def is_repository_id(value: str | Column) -> Column:
    return col(value).rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$")


def is_artifact_id(value: str | Column) -> Column:
    return (F.length(col(value)).between(1, 255)) & ~col(value).rlike(r"[\x00/\\]")


def is_unsafe_member(path: str | Column) -> Column:
    """Archive members that would leave the folder they are unpacked in."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)") | (F.trim(p) == "")


# fixed values: intents of a question and the words that tell them, in the order in which they are tried
INTENTS = (
    ("Schema Questions", ("schema", "ddl", "create table", "sql", "er diagram", "diagram", "relational")),
    ("Repository Summary", ("summarize", "statistics", "overview", "health")),
    ("Relationship Analysis", ("access", "depend", "call graph", "used by", "which programs", "which copybooks")),
    ("Program Analysis", ("program", "cbl", "cobol", "does")),
    ("Copybook Analysis", ("copybook", "fields", "layout", "cpy")),
    ("Dataset Analysis", ("dataset", "vsam", "ksds", "esds")),
    ("Business Rules", ("rule", "validation", "logic")),
)


def intent(question: str | Column) -> Column:
    """The first intent of which some word is in the question, whatever its case; a null question has none."""
    q = F.lower(F.coalesce(col(question), F.lit("")))
    found = F.when(F.lit(False), "")
    for name, words in INTENTS:
        found = found.when(reduce(Column.__or__, [q.contains(w) for w in words]), name)
    return found.otherwise("Unknown")
