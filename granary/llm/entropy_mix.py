"""Mixing sources to target weights by entropy balancing.

Every document d of source s gets a rate r_d, the one of least relative entropy to "each document once" among those with
sum over s of r_d * size_d = target_s and r_d <= max_rate.  Its dual is convex and splits by source: r_d = exp(t_s *
size_d / mean_s), cut off at max_rate.  Newton steps on t_s solve it for all sources at once; a bracket that shrinks
with every step catches steps that leave it.  A rate depends on source and size alone, so the iterations run over the
distributed table of distinct (source, size) pairs with their number of documents, not over documents.

Rates become copies by systematic rounding in the order of size: the fractions of a source are summed, and a document
gets one more copy where the sum passes a whole number.  So the words taken miss the target by about one document.
All sums over documents are sums over (source, size) pairs plus a place inside a pair, which is counted in hashed parts:
a source, or a pair, with a third of all rows is spread over tasks.  Only DataFrame functions are used.

Defined results: a null or blank text has size 0, counts for nothing and is taken 0 times; a null source is a source of
its own, last in the order; sources weigh by their place in code point order; a corpus without words takes nothing;
repeated ids are rows of their own; an iteration that does not settle raises; other columns pass by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import n_words, written

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
#: Relative miss of a source's target at which its iteration ends; most iterations.
TOLERANCE = 1e-9
MOST_STEPS = 60
#: Fractions are summed as whole billionths: sums do not depend on the order of their terms.
UNIT = 1_000_000_000
#: Parts into which the documents of one (source, size) pair are hashed for their places.
PARTS = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, n_docs) to those with weight and target: shares by weight, cut off at max_rate times the size.

    What a cut-off source cannot take goes to the others by weight until none is above.  That ends with one level x for
    which target = min(max_rate * size, weight * x); sources reach their limit in the order of size / weight.  The table
    has one row per source; its three windows are over sources, not documents.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    of = F.array(*[F.lit(w) for w in weights])
    out = sizes.withColumn("weight", F.get(of, (place % len(weights)).cast("int")).cast("long"))
    order = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = out.withColumn("_total", F.sum("source_size").over(every))
    out = out.withColumn("_limited", F.coalesce(F.sum(max_rate * F.col("source_size")).over(before), F.lit(0)))
    out = out.withColumn("_free", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("_level", (F.col("_total") - F.col("_limited")) / F.col("_free"))
    full = F.col("weight") * F.col("_level") >= max_rate * F.col("source_size")
    out = out.withColumn("_x", F.min(F.when(~full, F.struct((F.col("source_size") / F.col("weight")).alias("o"), F.col("_level").alias("x")))).over(every)["x"])
    limit = (max_rate * F.col("source_size")).cast("double")
    return out.withColumn("target", F.coalesce(F.least(limit, F.col("weight") * F.col("_x")), limit)).drop("_total", "_limited", "_free", "_level", "_x")


def tilts(pairs: DataFrame, goals: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """The dual's solution: goals with t, the exponent of each source; null where all its documents are at max_rate.

    pairs: (source, size, n); goals: (source, source_size, n_docs, target).  One Spark job a step, over pairs.
    """
    mean = (F.col("source_size") / F.col("n_docs")).alias("mean")
    open_ = (F.col("source_size") > 0) & (F.col("target") < max_rate * F.col("source_size") * (1 - TOLERANCE))
    state = goals.select("source", "source_size", "n_docs", "target", mean, F.when(open_, F.lit(0.0)).alias("t"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (~open_).alias("done"))
    cap = math.log(max_rate)
    for _ in range(MOST_STEPS):
        x = F.col("size") / F.col("mean")
        inside = F.col("t") * x < cap
        rate = F.when(inside, F.exp(F.col("t") * x)).otherwise(F.lit(float(max_rate)))
        sums = (
            pairs.join(state.where(~F.col("done")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(inside, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"))
            .withColumnRenamed("source", "s")
        )
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("t")).otherwise(F.col("low")), F.when(gap > 0, F.col("t")).otherwise(F.col("high"))
        newton = F.col("t") - gap / F.col("slope")
        # without a bound on one side the bracket opens by doubling
        lower, upper = F.coalesce(low, F.least(2 * high, high - 1)), F.coalesce(high, F.greatest(2 * low, low + 1))
        fits = newton.isNotNull() & (newton > lower) & (newton < upper)
        near = F.abs(gap) <= TOLERANCE * F.col("target")
        state = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "n_docs", "target", "mean",
            F.when(F.col("done") | near, F.col("t")).when(fits, newton).otherwise((lower + upper) / 2).alias("t"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | near).alias("done"),
        )
        state = state.checkpoint()
        if not state.where(~F.col("done")).take(1):
            return state
    raise RuntimeError(f"entropy balancing did not settle in {MOST_STEPS} steps")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (= copies * size) of every row of docs.

    hashed and place tell a row's cell among the documents of its source and size, and its place there.
    """
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    base = written(base, "mix-sizes")
    pairs = base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    goals = targets(pairs.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")), weights, max_rate).checkpoint()
    tilt = tilts(pairs, goals, max_rate)
    x = F.col("t") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("t").isNull() | (x >= math.log(max_rate)), F.lit(float(max_rate))).otherwise(F.exp(x))
    rated = pairs.join(tilt.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target", F.least(rate, F.lit(float(max_rate))).alias("rate"))
    whole = F.floor(F.col("rate")).cast("long")
    rated = rated.select("*", whole.alias("whole"), F.round((F.col("rate") - whole) * UNIT).cast("long").alias("part"))
    order = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("part")).over(order), F.lit(0))).drop("n")
    return rounded(base, rated)


def rounded(base: DataFrame, rated: DataFrame) -> DataFrame:
    """base (doc_id, source, size) with copies: whole, and one more where the running sum of parts passes a multiple of UNIT."""
    hashed = base.withColumn("hashed", _part(F.col("doc_id")))
    cell = [F.col(c).alias(f"_{c}") for c in ("source", "size", "hashed")]
    counts = hashed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy("_source", "_size").orderBy("_hashed").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_source", "_size", "_hashed", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    starts = starts.join(rated, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size"))).drop("source", "size")
    inner = F.row_number().over(W.partitionBy("source", "size", "hashed").orderBy("doc_id"))
    placed = hashed.withColumn("place", inner).join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("hashed") == F.col("_hashed")))
    end = F.col("before") + (F.col("_start") + F.col("place")) * F.col("part") + UNIT // 2
    extra = F.floor(end / UNIT) - F.floor((end - F.col("part")) / UNIT)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + extra).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "hashed", "place")


def _part(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(PARTS))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their own columns.

    Rows are met by their place among those of equal source, size and part, so rows that repeat an id are rows of their own.
    """
    copies = mix(docs, weights, max_rate).where("copies > 0").select(*[F.col(c).alias(f"_{c}") for c in ("source", "size", "hashed", "place", "copies")])
    own = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*own).alias("row")
    rows = docs.select(row, F.col("source").alias("s"), n_words(F.col("text")).alias("n"), _part(F.col("doc_id")).alias("p"), F.col("doc_id").alias("id"))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("s", "n", "p").orderBy("id")))
    same = F.col("s").eqNullSafe(F.col("_source")) & (F.col("n") == F.col("_size")) & (F.col("p") == F.col("_hashed")) & (F.col("k") == F.col("_place"))
    return rows.join(copies, same).select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")
