"""Joins on `contains` and on words, through an index of terms instead of all pairs.

A text contains a needle only if it contains every gram of three characters of it, and it has a needle as a word only if it
has every run of word characters of it.  So each needle is posted under one of its terms, the one that the fewest texts
have, texts are posted under those of their terms that some needle has chosen, and the two meet by an equi-join on the term,
after which the condition itself is checked.  A needle with a term that no text has is never posted.  With `scope`, columns
that both sides have, texts and needles meet only where these are equal, and terms are counted within them.

Up to SMALL posts (counted) are broadcast, so texts are not shuffled at all.  Beyond that both sides are shuffled by term;
a term of more than PER_PART texts is dealt to as many parts as it needs.

Defined results: null and empty needles are in no text, null texts contain nothing; equal needles are posted once; every
pair of a text and a distinct needle in it is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import or_null
from granary.sources.repository import put_down

GRAM = 3
#: Posts up to which they are broadcast: some ten megabytes.
SMALL = 200_000
#: Texts of a term that one part is meant for.
PER_PART = 100_000


def grams(text: Column, *lengths: int) -> Column:
    """The distinct substrings of a text of the given lengths."""

    def of(n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))

    return F.array_distinct(F.flatten(F.array_compact(F.array(*[of(n) for n in lengths]))))


def words(text: Column) -> Column:
    """The distinct runs of word characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)))


def _asked(needles: DataFrame, needle: str, scope: tuple[str, ...]) -> DataFrame:
    return needles.where(F.length(F.col(needle)) > 0).select(*scope, F.col(needle).alias("_needle")).distinct()


def substring_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """The rows of texts with needle, for every needle that their column text contains."""
    asked = _asked(needles, needle, scope)
    lengths = sorted(r[0] for r in asked.select(F.least(F.length("_needle"), F.lit(GRAM)).alias("n")).distinct().collect())  # three at most
    if not lengths:
        return texts.withColumn(needle, F.lit(None).cast("string")).limit(0)
    # a short needle is a gram of its own, a long one has grams of three characters only
    size = F.least(F.length("_needle"), F.lit(GRAM))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_needle") - size + 1), lambda i: F.substring(F.col("_needle"), i, size)))
    return _met(texts, text, asked, needle, scope, grams(F.col(text), *lengths), own, F.col(text).contains(F.col("_needle")))


def word_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, scope: tuple[str, ...] = ()) -> DataFrame:
    r"""The rows of texts with needle, for every needle that stands in their column text like \bneedle\b.

    A needle without a word character is in no text.
    """
    holds = F.col(text).contains(F.col("_needle")) & as_word(F.col(text), F.col("_needle"))
    return _met(texts, text, _asked(needles, needle, scope), needle, scope, words(F.col(text)), words(F.col("_needle")), holds)


def _met(texts: DataFrame, text: str, asked: DataFrame, needle: str, scope: tuple[str, ...], of_text: Column, of_needle: Column, holds: Column) -> DataFrame:
    known = [*scope, "_term"]
    posted = texts.where(F.col(text).isNotNull())
    parts = asked.select(*scope, "_needle", F.explode(of_needle).alias("_term"))
    asked_terms = parts.select(*known).distinct()
    held = posted.select(*scope, F.explode(of_text).alias("_term")).groupBy(*known).agg(F.count(F.lit(1)).alias("_n")).join(asked_terms, known, "left_semi")
    counted = parts.join(held, known, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = counted.groupBy(*scope, "_needle").agg(F.min(F.struct("_n", "_term")).alias("_best")).where("_best._n > 0")
    chosen = put_down(rarest.select(*scope, "_needle", F.col("_best._term").alias("_term"), F.col("_best._n").alias("_n")))
    dealt = posted.select("*", F.explode(of_text).alias("_term"))
    if chosen.count() <= SMALL:
        found = dealt.join(F.broadcast(chosen.drop("_n")), known)
    else:
        large = chosen.where(F.col("_n") > PER_PART).select(*known, F.expr(f"1 + _n div {PER_PART}").cast("int").alias("_parts")).distinct()
        large = F.broadcast(large) if large.count() <= SMALL else large.limit(0)  # terms without parts of their own are left to AQE
        n_parts = F.coalesce("_parts", F.lit(1))
        dealt = dealt.join(large, known, "left").withColumn("_part", F.pmod(F.xxhash64(*posted.columns), n_parts).cast("int")).drop("_parts")
        spread = chosen.drop("_n").join(large, known, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n_parts - 1))).drop("_parts")
        found = dealt.join(spread, [*known, "_part"])
    return found.where(holds).select(*[F.col(c) for c in texts.columns], F.col("_needle").alias(needle))


def as_word(text: str | Column, needle: str | Column) -> Column:
    r"""Whether needle stands in text between word boundaries, like \bneedle\b."""
    return F.rlike(text, F.concat(F.lit(r"\b"), _literal(needle), F.lit(r"\b")))


def _literal(needle: str | Column) -> Column:
    return F.regexp_replace(needle, r"([^A-Za-z0-9_\s])", r"\\$1")


def first_lines(names: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, name, line_no): the first line of its file in which a name of names (path, name) stands as a word."""
    upper = lines.select("path", "line_no", F.upper("text").alias("_text"))
    asked = names.select("path", F.upper("name").alias("_name")).distinct()
    found = word_join(upper, "_text", asked, "_name", scope=("path",))
    return found.groupBy("path", F.col("_name").alias("name")).agg(F.min("line_no").alias("line_no"))


def field_evidence(fields: DataFrame, evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """fields (path, name, ...) with the ids of their evidence (path, entity_name, evidence_id, source_line) and its first and
    last line; a field without a line in its evidence gets the first line that names it."""
    known = evidence.groupBy(F.col("path").alias("_path"), F.col("entity_name").alias("_name")).agg(
        F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids"), F.min("source_line").alias("_first"), F.max("source_line").alias("_last"))
    both = fields.join(known, (F.col("path") == F.col("_path")) & (F.col("name") == F.col("_name")), "left").drop("_path", "_name")
    missing = fields.join(known.where("_first IS NOT NULL"), (F.col("path") == F.col("_path")) & (F.col("name") == F.col("_name")), "left_anti")
    told = first_lines(missing, lines).select(F.col("path").alias("_path"), F.col("name").alias("_name"), F.col("line_no").alias("_told"))
    both = both.join(told, (F.col("path") == F.col("_path")) & (F.upper("name") == F.col("_name")), "left").drop("_path", "_name")
    none = F.array().cast("array<string>")
    return both.select(
        *fields.columns, F.coalesce("evidence_ids", none).alias("evidence_ids"), F.coalesce("_first", "_told").alias("source_line"), F.coalesce("_last", "_told").alias("source_end_line"))


def datasets_like(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target, dsn): the candidates (dsn) that contain a target, whatever the case; a target that none contains stands for
    itself, in capitals."""
    asked = targets.select("target").distinct().withColumn("_upper", F.upper("target"))
    found = substring_join(candidates.select("dsn").distinct().withColumn("_text", F.upper("dsn")), "_text", asked, "_upper")
    pairs = asked.where(F.length("_upper") > 0).join(found.select("dsn", "_upper"), "_upper", "left")
    return pairs.select("target", F.coalesce("dsn", "_upper").alias("dsn"))


# fixed values: how a program brings in a layout
COPY = r"(?:COPY|%INCLUDE|/COPY|/INCLUDE)\s+([A-Z0-9_-]+)"


def locate_copybooks(datasets: DataFrame, programs: DataFrame, copybooks: DataFrame, ignored: tuple[str, ...]) -> DataFrame:
    """dsn, program, copybook, copybook_path of datasets (dsn), by programs (path, content) and copybooks (path).

    A program takes part with its first SELECT ... ASSIGN TO, the FD of that file and the first copy after it.  It knows a
    dataset if a qualifier of its name, without an ending DATA, stands anywhere after that ASSIGN TO; the copy names the
    first file whose name contains it.  Of several programs the first by path counts.
    """
    text = F.upper("content")
    assign = F.regexp_extract(text, r"(?s)SELECT\s+([A-Z0-9_-]+)\s+ASSIGN\s+TO(.*)", 1)
    known = programs.select("path", or_null(assign).alias("file"), text.alias("_content"))
    known = known.where("file IS NOT NULL")
    after = F.regexp_extract("_content", r"(?s)SELECT\s+[A-Z0-9_-]+\s+ASSIGN\s+TO(.*)", 1)
    block = F.concat(F.lit(r"(?s)FD\s+"), _literal(F.col("file")), F.lit(rf".*?{COPY}"))
    known = known.select("path", after.alias("_after"), or_null(F.call_function("regexp_extract", F.col("_content"), block, F.lit(1))).alias("copybook")).where("copybook IS NOT NULL")
    names = copybooks.select(F.col("path").alias("copybook_path"), F.upper("path").alias("_shown"))
    files = substring_join(names, "_shown", known, "copybook").groupBy("copybook").agg(F.min("copybook_path").alias("copybook_path"))
    known = known.join(files, "copybook")
    qualifier = F.explode(F.split(F.upper("dsn"), r"\."))
    wanted = datasets.select("dsn", qualifier.alias("_q")).where(~F.col("_q").isin(*ignored))
    wanted = wanted.select("dsn", F.when(F.col("_q").endswith("DATA"), F.expr("left(_q, length(_q) - 4)")).otherwise(F.col("_q")).alias("_q")).where("_q <> ''")
    stretches = known.select("path", F.explode(F.split("_after", r"\R")).alias("_line"))
    hits = substring_join(stretches, "_line", wanted, "_q").select("path", "_q").distinct()
    first = hits.join(wanted, "_q").groupBy("dsn").agg(F.min("path").alias("path"))
    return first.join(known.select("path", "copybook", "copybook_path"), "path").select("dsn", F.col("path").alias("program"), "copybook", "copybook_path")
