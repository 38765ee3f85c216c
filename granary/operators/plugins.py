"""Extractors of one's own as table functions: each gets the lines of one file after the other, in order.

A plug-in is a class with `start(path)`, `line(line_no, text)` and `end()`; the last two give rows (line_no, evidence_type,
name, value).  Spark deals files to tasks and sorts their lines, so a plug-in holds what it chooses to hold, never a file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "path string, source_line int, evidence_type string, entity_name string, value string"
Found = tuple[int | None, str, str | None, str | None]


class Plugin(Protocol):
    def start(self, path: str) -> None: ...

    def line(self, line_no: int, text: str) -> Iterable[Found]: ...

    def end(self) -> Iterable[Found]: ...


def evidence_of(lines: DataFrame, plugin: type[Plugin]) -> DataFrame:
    """ROWS that a plug-in finds in lines (path, line_no, text); a null text is an empty line."""

    class Adapter:
        def __init__(self) -> None:
            self.path: str | None = None
            self.plugin: Plugin | None = None

        def eval(self, row) -> Iterator[tuple]:
            if self.plugin is None:
                self.path, self.plugin = row["path"], plugin()
                self.plugin.start(self.path)
            for found in self.plugin.line(row["line_no"], row["text"] or ""):
                yield self.path, *found

        def terminate(self) -> Iterator[tuple]:
            if self.plugin is not None:
                for found in self.plugin.end():
                    yield self.path, *found

    table = lines.select("path", F.col("line_no").cast("int").alias("line_no"), "text").asTable()
    return F.udtf(Adapter, returnType=ROWS)(table.partitionBy("path").orderBy("line_no"))
