"""Sources of several languages: what a file is, its language, name and verbs, and which parts of it matter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import basename, col, extension, or_null, stem
from granary.operators.program import IGNORED_QUALIFIERS
from granary.operators.substrings import substring_join, word_join
from granary.sources.repository import dealt

# fixed values: languages in the order in which they are tried, with the type of their programs
LANGUAGES = {"COBOL": "cobol", "PL/I": "pli", "Natural": "natural", "RPG": "rpg"}
# fixed values: how a program states its name
NAMES = {
    "COBOL": r"(?i)PROGRAM-ID\.\s+([A-Z0-9_-]+)",
    "PL/I": r"(?i)([A-Z0-9_-]+)\s*:\s*PROCEDURE",
    "Natural": r"(?i)\bPROGRAM-ID\s+([A-Z0-9_-]+)",
    "RPG": r"(?i)\bCTL-OPT\s+DFTACTGRP\s*\(.*?\)\s*ACTGRP\s*\(\s*'([A-Z0-9_-]+)'\s*\)",
}
# fixed values: verbs that touch files, with the pattern around one and how it is reported
CICS = ("READ", "WRITE", "REWRITE", "DELETE")
FILE_VERBS = {
    "COBOL": (("READ", "WRITE", "REWRITE", "DELETE", "START"), r"(?im)^\s+{}\b", "{}"),
    "PL/I": (("READ", "WRITE", "REWRITE", "DELETE"), r"(?i)\b{}\s+FILE\b", "{} FILE"),
    "Natural": (("READ", "STORE", "UPDATE", "DELETE", "FIND", "GET"), r"(?i)\b{}\b", "{}"),
    "RPG": (("CHAIN", "READ", "READE", "UPDATE", "WRITE", "DELETE"), r"(?i)\b{}\b", "{}"),
}


def _any(text: Column, *words: str) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def sniffed(files: DataFrame) -> DataFrame:
    """files (path, content) with artifact_type by the older rules, which know four languages and no cluster definitions."""
    upper, lower, ext = F.col("_upper"), F.lower("_upper"), F.col("_ext")
    listing = _any(upper, "CLUSTER", "NONVSAM", "IDCAMS", "LISTCAT") & _any(upper, "LISTING FROM CATALOG", "REC-TOTAL", "VOLSER")
    declares = _any(upper, "DCL ", "DECLARE ")
    cobol = _any(upper, "IDENTIFICATION DIVISION", "PROCEDURE DIVISION")
    kind = (
        F.when(ext.isin(".txt", ".lst", ".log", ".out") & listing, "listcat")
        .when(ext.isin(".jcl", ".job", ".cntl") | F.col("content").startswith("//") | upper.contains("EXEC PGM="), "jcl")
        .when(ext.isin(".cpy", ".copy"), "copybook")
        .when(ext.isin(".cbl", ".cob", ".cobol") | cobol | upper.contains("DATA DIVISION"), "cobol")
        .when((ext.isin(".pli", ".pl1", ".inc", ".dcl") | upper.contains("PROCEDURE OPTIONS(MAIN)") | declares) & declares & (ext.isin(".inc", ".dcl") | ~cobol), "copybook")
        .when(ext.isin(".pli", ".pl1", ".inc", ".dcl") | upper.contains("PROCEDURE OPTIONS(MAIN)") | declares, "pli")
        .when((ext == ".ddm") | upper.contains("DEFINE DATA PARAMETER"), "copybook")
        .when(ext.isin(".nsl", ".nsn", ".nsp", ".nsa") | upper.contains("DEFINE DATA"), "natural")
        .when(ext.isin(".rpg", ".rpgle", ".sqlrpgle") | _any(lower, "dcl-s ", "dcl-f ", "dcl-ds ", "dcl-proc "), "rpg")
        .when(ext == ".h", "copybook")
        .otherwise("other")
    )
    known = files.withColumns({"_upper": F.upper(F.coalesce("content", F.lit(""))), "_ext": extension("path")})
    return known.withColumn("artifact_type", kind).drop("_upper", "_ext")


def repository_language(artifacts: DataFrame, *by: str, share: float = 0.8) -> DataFrame:
    """For each repository the language of `share` of its programs; without programs that of its copybooks' extensions."""
    n = {name: F.count_if(F.col("artifact_type") == kind) for name, kind in LANGUAGES.items()}
    programs = reduce(Column.__add__, n.values())
    book = F.col("artifact_type") == "copybook"
    with_ext = lambda *x: F.count_if(book & extension("path").isin(*x)) > 0
    by_share = reduce(lambda c, x: c.when(x[1] >= share * programs, x[0]), list(n.items())[1:], F.when(n["COBOL"] >= share * programs, "COBOL")).otherwise("Mixed")
    by_books = F.when(with_ext(".pli", ".inc", ".dcl"), "PL/I").when(with_ext(".ddm", ".nsl"), "Natural").otherwise("COBOL")
    return artifacts.groupBy(*by).agg(F.when(programs > 0, by_share).when(F.count_if(book) > 0, by_books).otherwise("Mixed").alias("language"), programs.alias("n_programs"))


def copybook_dialect(path: str | Column, content: str | Column) -> Column:
    ext, upper = extension(path), F.upper(col(content))
    return (
        F.when(ext.isin(".pli", ".pl1", ".inc", ".dcl") | _any(upper, "DCL ", "DECLARE "), "PL/I")
        .when(ext.isin(".nsl", ".ddm") | upper.contains("DEFINE DATA"), "Natural")
        .when(ext.isin(".rpg", ".rpgle") | upper.contains("DCL-DS"), "RPG")
        .when(ext.isin(".asm", ".s") | upper.contains("DSECT"), "Assembler")
        .otherwise("COBOL")
    )


def program_name(path: str | Column, content: str | Column, language: str | Column) -> Column:
    """The stated name, else the file's."""
    stated = [F.when(col(language) == k, or_null(F.upper(F.regexp_extract(col(content), p, 1)))) for k, p in NAMES.items()]
    return F.coalesce(*stated, stem(path))


def file_verbs(content: str | Column, language: str | Column) -> Column:
    """Sorted verbs that touch files, those of transactions among them."""
    text = col(content)
    found = [F.when(text.rlike(rf"(?i)EXEC\s+CICS\s+{v}\b"), F.lit(f"EXEC CICS {v}")) for v in CICS]
    for name, (verbs, pattern, shown) in FILE_VERBS.items():
        found += [F.when((col(language) == name) & text.rlike(pattern.format(v)), F.lit(shown.format(v))) for v in verbs]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def slices(lines: DataFrame, relevant: Column) -> DataFrame:
    """Of lines (path, line_no, text) those from a relevant one to the next other line that ends a sentence.

    Blank and comment lines never count; an open end is left out.  part numbers the sentences' ends of a file.
    """
    rows = lines.where(~F.col("text").rlike(r"^\s*($|\*)")).withColumn("_hit", F.coalesce(relevant, F.lit(False)))
    rows = rows.withColumn("_stop", ~F.col("_hit") & F.col("text").rlike(r"\.\s*$"))
    before = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.coalesce(F.sum(F.col("_stop").cast("int")).over(before), F.lit(0)))
    inner = W.partitionBy("path", "part")
    rows = rows.withColumns({"_from": F.min(F.when(F.col("_hit"), F.col("line_no"))).over(inner), "_ends": F.max("_stop").over(inner)})
    return rows.where("_ends AND line_no >= _from").select("path", "part", "line_no", "text")


# fixed value: sources up to so many characters are taken whole
SHORT = 6000
CHARACTERS_A_TASK = 16_000_000


def relevant_source(files: DataFrame, relevant: Column) -> DataFrame:
    """files (path, content) with source: a short content as it is, of a long one its `slices` by relevant (over text), and
    where these are blank its first characters."""
    text = F.coalesce("content", F.lit(""))
    # dealt by counted characters before they become lines, so a task's lines do not grow with the input
    size = files.agg(F.sum(F.length(text))).first()[0] or 0
    files = files.repartition(1 + size // CHARACTERS_A_TASK, "path")
    long_ones = files.where(F.length(text) > SHORT).select("path", F.posexplode(F.split("content", r"\R")).alias("line_no", "text"))
    kept = slices(long_ones, relevant).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_lines"))
    kept = kept.select("path", F.array_join(F.transform("_lines", lambda x: x["text"]), "\n").alias("_kept"))
    cut = F.when(F.trim(F.coalesce("_kept", F.lit(""))) != "", F.col("_kept")).otherwise(F.left(text, F.lit(SHORT)))
    return files.join(dealt(kept), "path", "left").withColumn("source", F.when(F.length(text) <= SHORT, F.col("content")).otherwise(cut)).drop("_kept")


def detected_language(artifacts: DataFrame, *by: str) -> DataFrame:
    """The newer rule for each repository: COBOL with any program of it, else Mixed."""
    return artifacts.groupBy(*by).agg(F.when(F.bool_or(F.coalesce(F.lower("artifact_type") == "cobol", F.lit(False))), "COBOL").otherwise("Mixed").alias("language"))


def uses_dataset(programs: DataFrame, datasets: DataFrame, ignored: tuple[str, ...] = IGNORED_QUALIFIERS) -> DataFrame:
    """Distinct (path, dsn) of programs (path, name, content) that seem to use datasets (dsn, copybook).

    A qualifier of the dataset's name is part of the program's name, begins an ASSIGN target (without its ending DATA), or
    stands in the program between word boundaries; or the program copies the dataset's copybook, whose name ends at a word
    boundary.  Parts of names and words go through an index of terms (`substrings`); beginnings of targets and copied names
    are equi-joins.
    """
    text = F.upper("content")
    listed = lambda xs, kind: programs.select("path", F.lit(kind).alias("_kind"), F.explode(F.array_distinct(xs)).alias("_key"))
    heads = lambda xs: F.flatten(F.transform(xs, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.substring(t, 1, n))))
    targets = F.regexp_extract_all(text, F.lit(r"\bASSIGN\s+TO\s+([A-Z0-9#$@_.-]+)"), F.lit(1))
    copies = F.regexp_extract_all(text, F.lit(r"(?:\bCOPY|%INCLUDE|/COPY|/INCLUDE)\s+([^\s]+)"), F.lit(1))
    bounded = F.flatten(F.transform(copies, lambda t: F.filter(F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.when(_boundary(t, n), F.substring(t, 1, n))), lambda x: x.isNotNull())))
    told = listed(heads(targets), "target").unionByName(listed(bounded, "copy"))
    qualifiers = datasets.select("dsn", F.explode(F.array_distinct(F.split(F.upper("dsn"), r"\."))).alias("_q")).where((F.col("_q") != "") & ~F.col("_q").isin(*ignored))
    short = F.when(F.col("_q").endswith("DATA") & (F.length("_q") > 4), F.expr("left(_q, length(_q) - 4)")).otherwise(F.col("_q"))
    copied = datasets.where("copybook <> 'NOT_FOUND'").select("dsn", F.lit("copy").alias("_kind"), stem(basename("copybook")).alias("_key"))
    asked = qualifiers.select("dsn", F.lit("target").alias("_kind"), short.alias("_key")).unionByName(copied)
    named = substring_join(programs.select("path", F.upper("name").alias("_text")), "_text", qualifiers, "_q").select("path", "_q")
    lines = programs.select("path", F.explode(F.split(text, r"\R")).alias("_text")).distinct()
    worded = word_join(lines, "_text", qualifiers, "_q").select("path", "_q")
    by_part = named.unionByName(worded).distinct().join(qualifiers, "_q").select("path", "dsn")
    return told.join(asked, ["_kind", "_key"]).select("path", "dsn").unionByName(by_part).distinct()


def _boundary(t: Column, n: Column) -> Column:
    """Whether a word ends or begins after the first n characters of t."""
    word = lambda c: F.coalesce(c.rlike(r"\w"), F.lit(False))
    return word(F.substring(t, n, 1)) != word(F.substring(t, n + 1, 1))
