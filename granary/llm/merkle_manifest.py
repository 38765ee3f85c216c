"""Merkle manifest of a dataset in an external-memory node store.

Leaves are digests of rows.  The leaves of one tree (here: of one source) are sorted into runs, each run knows how many
leaves of its first tree stand in earlier runs, and so every leaf has its coordinate, its place in its tree, without any
task that sees a whole tree.  From there on everything is addressed by (tree, level, place):

* `grow` reads a level in the order of its coordinates, DEPTH levels a pass: the FAN ** DEPTH nodes below one node are a
  block, blocks are dealt over tasks, and a task streams its blocks and writes the nodes above them to the store, Parquet
  partitioned by level.  The last level written is what the next pass reads, until one node a tree is left, its top.
* `scan` extracts the paths of all leaves by merging what is sorted by the same coordinates: the levels of a block and
  the path above the block, which the pass before has made.  A path is shared by the leaves of a block until the end.

The tops of all trees, ordered by tree, are the leaves of one more tree of the same kind; its top is the root.  A tree may
hold any part of the rows: a block never has more than FAN ** DEPTH leaves, whatever the size of its tree.

Defined results: null fields are written `-`, so a null and an empty text have different leaves; rows with a null id come
first in their source; rows that share an id are ordered by their leaf, equal rows stand beside each other with a leaf
each; a null source is a tree of its own, the first; columns that are not named in FIELDS have no part; an empty table has
no root and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import crc_class, scratch_path, written

FAN = 3
#: Levels of a pass.  A block has FAN ** DEPTH leaves, less than a megabyte of digests.
DEPTH = 8
BLOCK = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_ROW = "tree string, label string, doc_id long, digest string, other string, base int"
_NODE = "top boolean, level int, tree string, idx long, digest string, base int"
_PATH = "tree string, block long, steps array<string>, subroot string, label string, base int"
_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _stated(c: Column) -> Column:
    value = c.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(**changed: Column) -> Column:
    """The digest of a row: every field with its length, so that no two rows state the same bytes."""
    return F.sha2(F.concat(*[_stated(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def tampered(docs: DataFrame) -> Column:
    """The text as tampering leaves it where it strikes: without line ends; null where it does not strike."""
    return F.when(crc_class(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def tree_of(source: Column) -> Column:
    """A name for each tree, never null, in the order of the sources, null first."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterable[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_STRING, _LONG, _INT = pa.string(), pa.int64(), pa.int32()
_RUN_ARROW = pa.schema([("tree", _STRING), ("label", _STRING), ("doc_id", _LONG), ("digest", _STRING), ("other", _STRING), ("base", _INT), ("run", _INT), ("at", _LONG)])
_NODE_ARROW = pa.schema([("top", pa.bool_()), ("level", _INT), ("tree", _STRING), ("idx", _LONG), ("digest", _STRING), ("base", _INT)])
_PATH_ARROW = pa.schema([("tree", _STRING), ("block", _LONG), ("steps", pa.list_(_STRING)), ("subroot", _STRING), ("label", _STRING), ("base", _INT)])
_PROOF_ARROW = pa.schema([("doc_id", _LONG), ("leaf", _STRING), ("subroot", _STRING), ("root", _STRING), ("proof_sha256", _STRING), ("folded_root", _STRING), ("verified", pa.bool_())])


def joined(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


@dataclass
class Forest:
    """Trees in the store: their leaves with coordinates, the nodes above them by level, and where passes began."""

    leaves: DataFrame
    nodes: DataFrame
    bases: list[int] = field(default_factory=list)

    def tops(self) -> DataFrame:
        """tree, digest and base (the pass that ended it) of the top of every tree."""
        return self.nodes.where("top").select("tree", "digest", "base")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their run and their place among the rows of their tree in it."""
    run = TaskContext.get().partitionId()
    rows = (r + (run, at) for _, same in groupby(_rows(batches), key=itemgetter(0)) for at, r in enumerate(same))
    return _batched(rows, _RUN_ARROW)


def _located(rows: DataFrame, order: list[Column], path: str) -> DataFrame:
    """rows with idx, their place in their tree, from sorted runs below path."""
    runs = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).select("tree", "label", "doc_id", "digest", "other", "base")
    runs.mapInArrow(_numbered, f"{_ROW}, run int, at long").write.option("compression", "zstd").parquet(f"{path}/runs")
    runs = rows.sparkSession.read.schema(f"{_ROW}, run int, at long").parquet(f"{path}/runs")
    parts = runs.groupBy("run", "tree").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("tree").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    parts = written(parts.select("run", "tree", F.sum("n").over(earlier).alias("before")).where("before > 0"), "merkle-runs")
    # only the first tree of a run goes on from earlier runs: one row a run at most
    return runs.join(F.broadcast(parts), ["run", "tree"], "left").select("tree", "label", "doc_id", "digest", "other", "base", (F.col("at") + F.coalesce("before", F.lit(0))).alias("idx"))


def _grown(base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def above(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (tree, block), same in groupby(rows, key=itemgetter(0, 1)):
            level = [r[3] for r in same]
            whole = block == 0 and len(level) < BLOCK  # all of the tree: it ends where one node is left
            place, at = block * BLOCK, base
            while len(level) > 1 if whole else at < base + DEPTH:
                level, place, at = [joined(level[i : i + FAN]) for i in range(0, len(level), FAN)], place // FAN, at + 1
                if not whole or len(level) > 1:
                    yield from ((False, at, tree, place + i, d, base) for i, d in enumerate(level))
            if whole:
                yield True, at, tree, 0, level[0], base

    return lambda batches: _batched(above(_rows(batches)), _NODE_ARROW)


def grow(rows: DataFrame, order: list[Column], path: str) -> Forest:
    """The trees over rows (tree, label, doc_id, digest, other, base), each ordered by order, in a store below path."""
    spark = rows.sparkSession
    leaves = _located(rows, order, path)
    nodes = spark.read.schema(_NODE)
    forest = Forest(leaves, None)
    level, base = leaves.select("tree", "idx", "digest"), 0
    while not level.isEmpty():
        blocks = level.select("tree", F.expr(f"idx div {BLOCK}").alias("block"), "idx", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        blocks.mapInArrow(_grown(base), _NODE).write.mode("append").partitionBy("top", "level").option("compression", "zstd").parquet(f"{path}/nodes")
        forest.bases.append(base)
        base += DEPTH
        level = nodes.parquet(f"{path}/nodes").where(~F.col("top") & (F.col("level") == base)).select("tree", "idx", "digest")
    if forest.bases:
        forest.nodes = nodes.parquet(f"{path}/nodes")
    return forest


def _paths_below(base: int) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """Of rows sorted by (tree, block, level, idx), for each leaf of a block: its row, its steps to the top, the top."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, same in groupby(rows, key=itemgetter(0, 1)):
            above, leaves, levels = None, [], {}
            for row in same:
                level = row[2]
                if level < 0:
                    above = row
                    continue
                if level == base:
                    leaves.append(row)
                levels.setdefault(level - base, []).append(row[4])
            if above is None:
                raise ValueError("a block without the path above it")
            sides: list[list[tuple[str, str]]] = []
            for rise, digests in sorted(levels.items()):
                if len(leaves) == 1 and len(levels) == 1:
                    break  # a tree of one node: nothing stands above it here
                if rise != len(sides):
                    raise ValueError("a level is missing from the store")
                sides.append([("".join(digests[i - i % FAN : i]), "".join(digests[i + 1 : i - i % FAN + FAN])) for i in range(len(digests))])
            for i, row in enumerate(leaves):
                steps = []
                for rise, both in enumerate(sides):
                    steps.extend(both[i // FAN**rise])
                yield row, steps + above[5], above[6]

    return run


def scan(forest: Forest, above: DataFrame, emit: Callable[[tuple, list[str], str], tuple], schema: str, arrow: pa.Schema) -> DataFrame:
    """emit(row, steps, subroot) of every leaf of the forest; above (_PATH): the path above the top of every tree.

    steps: the siblings to the left and to the right, two texts a level, from the leaf to the root.
    """
    for base in reversed(forest.bases):
        nodes = forest.nodes.where(~F.col("top") & F.col("level").between(max(base, 1), base + DEPTH - 1))
        nodes = nodes.select("tree", "level", "idx", "digest", *[F.lit(None).cast(t).alias(c) for c, t in (("steps", "array<string>"), ("subroot", "string"), ("doc_id", "long"), ("other", "string"), ("label", "string"), ("base", "int"))])
        if base == 0:
            nodes = nodes.unionByName(forest.leaves.select("*", F.lit(0).alias("level")), allowMissingColumns=True)
        span = F.element_at(F.array(*[F.lit(FAN ** (DEPTH - k)).cast("long") for k in range(DEPTH)]), F.col("level") - base + 1)
        nodes = nodes.withColumn("span", span).withColumn("block", F.expr("idx div span")).drop("span")
        here = above.where(F.col("base") == base).select("tree", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), "steps", "subroot")
        rows = nodes.unionByName(here, allowMissingColumns=True).select("tree", "block", "level", "idx", "digest", "steps", "subroot", "doc_id", "other", "label", "base")
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "level", "idx")
        paths = _paths_below(base)
        if base == 0:
            return rows.mapInArrow(lambda batches: _batched((emit(*x) for x in paths(_rows(batches))), arrow), schema)
        lower = base - DEPTH
        down = lambda batches: _batched(((row[0], row[3], steps, subroot, None, lower) for row, steps, subroot in paths(_rows(batches))), _PATH_ARROW)  # noqa: B023, E731
        above = above.where(F.col("base") != base).unionByName(written(rows.mapInArrow(down, _PATH), "merkle-paths"))
    raise ValueError("a forest without leaves has no paths")


def fold(digest: str, steps: list[str]) -> str:
    """The top that a leaf and its siblings lead to."""
    for left, right in zip(steps[::2], steps[1::2], strict=True):
        digest = sha256((left + digest + right).encode()).hexdigest()
    return digest


@dataclass(frozen=True)
class Manifest:
    documents: Forest
    sources: Forest
    root: str


def build(docs: DataFrame, path: str) -> Manifest | None:
    """The manifest of docs (FIELDS) in a store below path; None of an empty table."""
    base = docs.select(*FIELDS)
    own, other = leaf(), leaf(text=F.col("_tampered"))
    rows = base.withColumn("_tampered", tampered(base)).select(
        tree_of(F.col("source")).alias("tree"), F.lit(None).cast("string").alias("label"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("digest"),
        F.when(F.col("_tampered").isNotNull(), other).alias("other"), F.lit(0).alias("base"), F.monotonically_increasing_id().alias("ordinal"))
    # written before it is sorted: texts are read and digested once, and equal rows keep their order in a repeated task
    rows = written(rows, "merkle-leaves")
    documents = grow(rows, [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("ordinal")], f"{path}/documents")
    if not documents.bases:
        return None
    tops = documents.tops().select(F.lit("").alias("tree"), F.col("tree").alias("label"), F.lit(None).cast("long").alias("doc_id"), "digest", F.lit(None).cast("string").alias("other"), "base")
    sources = grow(written(tops, "merkle-tops"), [F.col("label")], f"{path}/sources")
    return Manifest(documents, sources, sources.tops().first()["digest"])


def _nothing_above(forest: Forest) -> DataFrame:
    """Nothing stands above the top of the one tree of sources."""
    return forest.tops().select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("steps"), F.col("digest").alias("subroot"), F.lit(None).cast("string").alias("label"), "base")


def proofs(found: Manifest) -> DataFrame:
    """For every document its leaf, subroot, root, the digest of its siblings, and the root that its row leads to now."""
    root = found.root
    over = scan(found.sources, _nothing_above(found.sources), lambda row, steps, _: (row[9], 0, steps, row[4], None, row[10]), _PATH, _PATH_ARROW)

    def checked(row: tuple, steps: list[str], subroot: str) -> tuple:
        folded = fold(row[4] if row[8] is None else row[8], steps)
        return row[7], row[4], subroot, root, joined(steps), folded, folded == root

    return scan(found.documents, written(over, "merkle-over"), checked, _PROOF, _PROOF_ARROW)


def verify(docs: DataFrame) -> DataFrame:
    """Builds the manifest of docs in the shared folder and checks every row against it."""
    spark = docs.sparkSession
    found = build(docs, scratch_path(spark, "merkle"))
    return spark.createDataFrame([], _PROOF) if found is None else proofs(found)
