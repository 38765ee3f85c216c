"""What items inherit from those above them, by pointer doubling.

Every item starts with its own values and a pointer to its parent.  In a round it takes over what the item it points to
has gathered, and that item's pointer; so pointers skip two, four, eight levels, and a tree of depth d is done after
log2(d) rounds, whatever its shape.  Items that have reached the top leave the rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.repository import dealt, put_down


@dataclass(frozen=True)
class Handed:
    """A value of an item, and how what comes from above and the item's own become one; must be associative."""

    own: Column
    joined: Callable[[Column, Column], Column]


def nearest(own: Column) -> Handed:
    """Its own value, or the nearest above it that is not null."""
    return Handed(own, lambda above, at: F.coalesce(at, above))


def any_of(own: Column) -> Handed:
    return Handed(F.coalesce(own, F.lit(False)), lambda above, at: above | at)


def path_of(own: Column) -> Handed:
    """The values from the root to the item, as an array."""
    return Handed(F.array(own), lambda above, at: F.concat(above, at))


def total(own: Column) -> Handed:
    return Handed(own, lambda above, at: above + at)


def product(own: Column) -> Handed:
    return Handed(own, lambda above, at: above * at)


def handed_down(nodes: DataFrame, **values: Handed) -> DataFrame:
    """nodes (node_id, parent_id, ...) with each value joined over the item and all above it.

    A parent that is not among the nodes is no parent; an item that is below itself raises.
    """
    rows = put_down(nodes.select("node_id", F.col("parent_id").alias("_up"), *[v.own.alias(k) for k, v in values.items()]))
    # no item has more above it than there are items, so pointers that still move after that many rounds go in a ring
    for _ in range(rows.count().bit_length() + 1):
        moving = rows.where("_up IS NOT NULL")
        if moving.isEmpty():
            return nodes.join(dealt(rows.drop("_up")), "node_id")
        above = rows.select(F.col("node_id").alias("_at"), F.col("_up").alias("_next"), *[F.col(k).alias(f"_a_{k}") for k in values])
        lost = F.col("_at").isNull()
        joined = [F.when(lost, F.col(k)).otherwise(v.joined(F.col(f"_a_{k}"), F.col(k))).alias(k) for k, v in values.items()]
        moved = moving.join(dealt(above), F.col("_up") == F.col("_at"), "left").select("node_id", F.col("_next").alias("_up"), *joined)
        rows = put_down(rows.where("_up IS NULL").unionByName(moved))
    raise ValueError("a node is below itself")
