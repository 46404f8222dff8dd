"""A table of a database read by ranges of its key, as a Spark data source: each range is one query of one task."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class KeyRange(InputPartition):
    """Keys above ``low`` (None: from the first) up to ``high`` (None: to the last); tests are pushed filters."""

    def __init__(self, low, high, tests: list[tuple[str, object]]):
        super().__init__((low, high))
        self.low, self.high, self.tests = low, high, tests


def name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


class KeysetReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.names = schema.names
        self.database, self.table, self.key = options["database"], options["table"], options["key"]
        self.rows = int(options.get("rows", "10000"))
        self.tests: list[tuple[str, object]] = []

    def query(self, columns: str, low, high, tests: list[tuple[str, object]], tail: str) -> Iterator[tuple]:
        where = [(f"{name(self.key)} > ?", low)] if low is not None else []
        where += [(f"{name(self.key)} <= ?", high)] if high is not None else []
        where += tests
        text = f"SELECT {columns} FROM {name(self.table)}" + (f" WHERE {' AND '.join(w for w, _ in where)}" if where else "") + f" {tail}"
        connection = sqlite3.connect(f"file:{self.database}?mode=ro", uri=True)
        try:
            yield from connection.execute(text, [v for _, v in where if v is not None])
        finally:
            connection.close()

    def partitions(self) -> list[KeyRange]:
        """Bounds by keyset: from each bound, the key that is ``rows`` rows of the filtered table further, which an index finds without reading these rows' columns."""
        bounds: list = [None]
        while True:
            after = next(self.query(name(self.key), bounds[-1], None, self.tests, f"ORDER BY {name(self.key)} LIMIT 1 OFFSET {self.rows - 1}"), None)
            if after is None:
                break
            bounds.append(after[0])
        return [KeyRange(a, b, self.tests) for a, b in zip(bounds, [*bounds[1:], None], strict=True)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        yield from self.query(", ".join(map(name, self.names)), partition.low, partition.high, partition.tests, f"ORDER BY {name(self.key)}")


class PushingKeysetReader(KeysetReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of plain columns go into every range's query; all others are left to Spark."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, IsNotNull):
                self.tests.append((f"{name(column)} IS NOT NULL", None))
            elif type(f) in COMPARED and isinstance(f.value, (str, int, float)) and not isinstance(f.value, bool):
                self.tests.append((f"{name(column)} {COMPARED[type(f)]} ?", f.value))
            else:
                yield f


class KeysetTable(DataSource):
    """SRC-11. Options: database (an SQLite file that all executors see), table, key (unique, without nulls) and rows (a range). The schema is given.

    With push=true filters go into the queries, which takes spark.sql.python.filterPushdown.enabled. Another database needs another connection in query() alone.
    """

    @classmethod
    def name(cls):
        return "keyset_table"

    def reader(self, schema):
        return (PushingKeysetReader if self.options.get("push") == "true" else KeysetReader)(schema, self.options)
