"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only combine bits.

The ledger holds the measurements of a document and one integer whose bit i says that rule i failed.  A policy is a
named, versioned mask: a document is kept if none of the mask's bits is set.  Changing a policy, comparing two or
leaving one rule out needs the ledger only, never the texts.

Only DataFrame functions are used.  Everything about a document is computed in its own row, so the ledger needs no
shuffle whatever the size of the corpus and however rows are spread over sources.

Defined results: a null or empty text has no words and fails too_few_words; repeated rows are judged row by row; other
columns of the input pass by untouched in `apply_policy` and are left out of `ledger`; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import words_of

#: Window length of the repetition rule.
WINDOW = 3
#: Up to this many distinct repeated windows are looked up one by one, more by sorting: a matter of speed only.
FEW = 24
NOT_SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """Fails where `failed`, a condition in SQL over the ledger's measurements, is true."""

    name: str
    failed: str


#: In the order of their bits.  A rule never changes its bit; new rules go to the end.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("words_too_short", "word_chars < 2 * n_words"),
    Rule("words_too_long", "word_chars > 14 * n_words"),
    Rule("too_many_words", "n_words > 1000000"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        at = {r.name: i for i, r in enumerate(RULES)}
        return sum(1 << at[x] for x in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
STRICT = Policy("prose", 1, tuple(r.name for r in RULES))
POLICIES = (BASE, Policy("prose", 0, ("too_few_words", "repeated_windows", "symbol_heavy")), STRICT)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and fail_bits of every row of docs (doc_id, text)."""
    return _judged(docs.select("doc_id", "text"), ["doc_id"], rules)


def _judged(docs: DataFrame, own: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """The columns own of docs, the measurements of its column text, and fail_bits."""
    base = docs.select(*own, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    base = base.select("*", words_of(F.col("_text")).alias("words"))
    n = F.size("words")
    base = base.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))).alias("windows"),
    )
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    base = base.select(
        *own, "n_words", "word_chars", "n_symbols", "windows",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(again, F.sort_array("windows")).alias("ordered"),
    )
    base = base.withColumn("repeated", F.when(F.col("ordered").isNotNull(), F.array_distinct(F.filter("ordered", lambda x, i: (i > 0) & (x == F.get("ordered", i - 1))))))
    base = base.withColumn("hits", F.when(F.col("repeated").isNotNull(), _hits()))
    reach = F.transform("hits", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("hits", i + 1) - p, F.lit(WINDOW))))
    # the row number keeps a later filter above this projection: pushed below, it would repeat the window expressions in
    # each lambda.  Counts are never negative, so the value stays as it is.
    found = F.when(F.col("hits").isNotNull(), F.aggregate(reach, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long")
    base = base.withColumn("n_repeat_words", F.greatest(found, -1 - F.monotonically_increasing_id()))
    measured = base.select(*own, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    bits = sum((F.when(F.expr(r.failed), F.lit(1 << i)).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def _hits() -> Column:
    """Ascending starts of the windows that occur twice or more."""
    one_by_one = F.filter(F.sequence(F.lit(0), F.size("windows") - 1), lambda i: F.array_contains("repeated", F.get("windows", i)))
    numbered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    by_order = F.transform(F.array(numbered), lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    return F.when(F.size("repeated") <= FEW, one_by_one).otherwise(F.get(by_order, F.lit(0)))


def kept_by(policy: Policy, bits: str | Column = "fail_bits") -> Column:
    return (bits if isinstance(bits, Column) else F.col(bits)).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns; no join, as the ledger is computed in the row."""
    own = [f"_own{i}" for i in range(len(docs.columns))]  # names that no measurement has
    judged = _judged(docs.toDF(*own).withColumn("text", F.col(own[docs.columns.index("text")])), own, RULES)
    return judged.where(kept_by(policy)).select(*own).toDF(*docs.columns)


def histogram(entries: DataFrame) -> DataFrame:
    """Documents and words by failure pattern: at most 2^rules rows, from which all policies can be compared."""
    return entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and each of its rules: what the rule fails, what it alone removes, what stays without it."""
    at = {r.name: i for i, r in enumerate(RULES)}
    rows = [(p.name, p.version, x, p.mask, 1 << at[x]) for p in policies for x in p.rules]
    table = entries.sparkSession.createDataFrame(rows, "policy string, version int, rule string, mask long, bit long")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    docs = F.col("n_docs")
    return (
        histogram(entries).join(F.broadcast(table))  # the rules of the policies: a few dozen rows
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, docs).otherwise(0)).alias("n_failing"),
            F.sum(F.when(hit == F.col("bit"), docs).otherwise(0)).alias("n_removed_alone"),
            F.sum(F.when(hit == 0, docs).otherwise(0)).alias("n_kept"),
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("mask") - F.col("bit")) == 0, docs).otherwise(0)).alias("n_kept_without"),
        )
    )
