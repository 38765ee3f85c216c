"""Trees as intervals: one ordered pass over a file numbers its items, and "below" and "above" become tests of numbers.

`numbered` reads the items of each file in their order and keeps nothing but the items that are still open, so a file of a
million items is a stream, not a row.  An item gets `enter`, its place in a walk through the tree (before its children), and
`leave`, the place of the last item below it.  From these:

* an item stands below another if its enter lies after the other's enter and not after its leave;
* what a subtree holds is a difference of two running sums, at its leave and at its enter (`below`);
* whether an item stands in some marked subtree is one running maximum (`inside`).

None of these makes a row for each pair of an item and one above it.

The same pass gives byte places (`placed`): an item begins where its group has come to, or where the item it redefines began,
and a group's length is known when it ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.sources.repository import dealt, spread

PLACES = "path string, node_id string, parent_id string, depth int, enter long, leave long"
_ARROW = pa.schema([
    ("path", pa.string()), ("node_id", pa.string()), ("parent_id", pa.string()), ("depth", pa.int32()), ("enter", pa.int64()), ("leave", pa.int64()),
])
BYTES = ("byte_length", "span_min", "span_max", "relative_offset", "absolute_offset")
_SIZED = pa.schema([*_ARROW, *[(c, pa.int32()) for c in BYTES]])
_BATCH = 8192
#: Levels with a meaning of their own in a record layout.
CONDITION, RENAMING, ANEW = 88, 66, 77


class _Open:
    """An item whose subtree is not at its end yet."""

    __slots__ = ("at", "begins", "cursor", "depth", "end", "enter", "is_group", "late", "level", "node_id", "own", "parent_id", "starts", "stored")

    def __init__(self, node_id: str | None, parent_id: str | None, level: int, is_group: bool, depth: int, enter: int, own: tuple | None = None) -> None:
        self.node_id, self.parent_id, self.level, self.is_group, self.depth, self.enter = node_id, parent_id, level, is_group, depth, enter
        self.late: list[str] = []  # renamings of this group that came while a child of it was open
        # bytes: stated ones, place in the group and in the file, how far its items have come, where those with names began
        self.own, self.at, self.begins, self.cursor, self.end, self.stored = own, 0, 0, 0, 0, False
        self.starts: dict[str, int] = {}


def _file(path: str, rows: Iterator[tuple], layout: bool, sized: bool = False) -> Iterator[tuple]:
    """The numbers of the items (node_id, level, is_group) of a file in order.

    If sized, items go on with name, redefines_target, bytes of one occurrence, least and most occurrences, and numbers
    with byte_length, span_min, span_max, relative_offset and absolute_offset.
    """
    stack, n = [_Open(None, None, -1, False, -1, -1)], 0

    def leaf(node_id: str, parent: _Open) -> tuple:
        nonlocal n
        n += 1
        place = path, node_id, parent.node_id, parent.depth + 1, n - 1, n - 1
        return (*place, 0, 0, 0, parent.cursor, parent.begins + parent.cursor) if sized else place

    def begun(x: _Open, group: _Open) -> None:
        """x begins where its group has come to, or at the last item before in the group that it redefines."""
        x.at = group.starts.get(x.own[1], group.cursor) if x.own[1] is not None else group.cursor
        x.begins = group.begins + x.at

    def taken(x: _Open, group: _Open) -> tuple:
        """What x takes, once it has ended, moves its group on."""
        name, target, own, least, most = x.own
        size = max(x.cursor, x.end) if x.is_group and x.stored else own
        low, high = (None, None) if size is None else (size * least, size * most)
        span = high or 0
        group.stored, group.starts[name] = True, x.at
        if target is None:
            group.cursor = x.at + span
        group.end = max(group.end, x.at + span)
        return size, low, high, x.at, x.begins

    def closed() -> Iterator[tuple]:
        """Ends the last open item; what its parent has waiting follows."""
        x = stack.pop()
        top = stack[-1]
        yield (path, x.node_id, x.parent_id, x.depth, x.enter, n - 1, *(taken(x, top) if sized else ()))
        yield from [leaf(i, top) for i in top.late]
        top.late = []

    for node_id, level, is_group, *own in rows:
        if layout and level == CONDITION:
            yield leaf(node_id, stack[-1])
        elif layout and level == RENAMING:
            group = next((x for x in reversed(stack) if x.is_group), stack[0])
            if group is stack[-1]:
                yield leaf(node_id, group)
            else:
                group.late.append(node_id)
        else:
            while len(stack) > 1 and (stack[-1].level >= level or layout and level == ANEW):
                yield from closed()
            top = stack[-1]
            x = _Open(node_id, top.node_id, level, is_group, top.depth + 1, n, own)
            if sized:
                begun(x, top)
            stack.append(x)
            n += 1
    while len(stack) > 1:
        yield from closed()


def _pass(layout: bool, sized: bool = False):
    schema = _SIZED if sized else _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []
        for path, same in groupby(stream, key=itemgetter(0)):
            for row in _file(path, (r[1:] for r in same), layout, sized):
                held.append(row)
                if len(held) == _BATCH:
                    yield _batch(held, schema)
                    held = []
        if held:
            yield _batch(held, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def numbered(items: DataFrame, layout: bool = True) -> DataFrame:
    """PLACES of items (path, seq, node_id, level, node_type).

    A parent is the nearest item before with a smaller level.  In a layout a condition (88) belongs to the item before it, a
    renaming (66) to the nearest open group, in the walk after what that group holds so far, and 77 starts anew.
    """
    rows = items.select("path", "node_id", F.col("level").cast("int"), (F.col("node_type") == "GROUP").alias("is_group"), "seq")
    return _in_order(rows).mapInArrow(_pass(layout), PLACES)


def placed(items: DataFrame, own: Column, least: Column, most: Column) -> DataFrame:
    """PLACES and BYTES of a layout's items as in `numbered`, with name and redefines_target.

    own: bytes of one occurrence of an elementary item; least, most: its occurrences.  Bytes are ints; what goes beyond raises.
    """
    numbers = [x.cast("int").alias(c) for c, x in (("own", own), ("least", least), ("most", most))]
    rows = items.select("path", "node_id", F.col("level").cast("int"), (F.col("node_type") == "GROUP").alias("is_group"), "name", "redefines_target", *numbers, "seq")
    return _in_order(rows).mapInArrow(_pass(True, sized=True), PLACES + "".join(f", {c} int" for c in BYTES))


def _in_order(rows: DataFrame) -> DataFrame:
    return spread(rows, "path").sortWithinPartitions("path", "seq").drop("seq")


def older_tree(items: DataFrame) -> DataFrame:
    """items (path, seq, node_id, level) of older flat lists with PLACES: levels alone decide."""
    places = numbered(items.withColumn("node_type", F.lit("GROUP")), layout=False)
    return items.join(dealt(places.drop("path")), "node_id")


def _so_far() -> W:
    return W.partitionBy("path").orderBy("enter").rowsBetween(W.unboundedPreceding, W.currentRow)


def below(nodes: DataFrame, **counted: Column) -> DataFrame:
    """nodes (path, enter, leave, node_id, ...) with, for each condition, how many items below hold it, themselves left out.

    An item is there twice, where it begins and where its subtree ends; both see the sum so far, and stand side by side by id.
    """
    values = {f"_{k}": F.coalesce(c, F.lit(False)).cast("long") for k, c in counted.items()}
    item = F.struct(*nodes.columns)
    held = nodes.select("path", "node_id", "enter", "leave", item.alias("_item"), *[v.alias(k) for k, v in values.items()])
    side = lambda at, ends: F.struct(F.col(at).alias("_at"), F.lit(ends).alias("_ends"), F.when(F.lit(ends == 0), F.col("_item")).alias("_item"), *[(F.lit(0).cast("long") if ends else F.col(k)).alias(k) for k in values])
    both = held.select("path", "node_id", F.inline(F.array(side("enter", 0), side("leave", 1))))
    so_far = W.partitionBy("path").orderBy("_at", "_ends").rowsBetween(W.unboundedPreceding, W.currentRow)
    one = W.partitionBy("path", "node_id").orderBy("_ends")
    sums = both.select("path", "node_id", "_ends", "_item", *[F.sum(f"_{k}").over(so_far).alias(f"_{k}") for k in counted])
    found = sums.select("_ends", "_item", *[(F.lead(f"_{k}").over(one) - F.col(f"_{k}")).alias(f"_{k}") for k in counted])
    return found.where("_ends = 0").select("_item.*", *[F.col(f"_{k}").alias(k) for k in counted])


def inside(nodes: DataFrame, marked: Column) -> DataFrame:
    """nodes (path, enter, leave, ...) with inside: whether they are marked or stand below a marked one."""
    reach = F.max(F.when(marked, F.col("leave"))).over(_so_far())
    return nodes.withColumn("inside", F.coalesce(reach >= F.col("enter"), F.lit(False)))


def search(nodes: DataFrame, hit: Column) -> DataFrame:
    """The nodes (path, enter, leave, ...) that a search keeps open: hits, and everything above a hit."""
    return below(nodes.withColumn("_hit", F.coalesce(hit, F.lit(False))), _hits=F.col("_hit")).where("_hit OR _hits > 0").drop("_hit", "_hits")


def walk(nodes: DataFrame) -> DataFrame:
    """nodes with place: from 1 in each file, parents before their children, children in order."""
    return nodes.withColumn("place", F.col("enter") + 1)
