"""A database table with a key as a data source: read page by page along the key, written by upserts in batches.

``spark.read.format("keyed_table")`` and ``df.write.format("keyed_table")`` take ``path`` (an SQLite file that driver and executors reach), ``table``, ``key`` and ``page``
(rows of a page or batch, 1,000 by default).  Another database needs another ``connect``.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

KINDS = {"INTEGER": "long", "REAL": "double", "TEXT": "string"}
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(path.removeprefix("file://"), timeout=120)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


@dataclass
class Page(InputPartition):
    """The keys after ``low`` up to ``high``; None is no bound."""

    low: object
    high: object


@dataclass
class Written(WriterCommitMessage):
    task: str
    rows: int
    failed: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.key, self.page = options["path"], _name(options["table"]), _name(options["key"]), int(options.get("page", 1000))
        self.columns, self.where = ", ".join(_name(c) for c in schema.names), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons with a column go to the database; the others are left to Spark."""
        for f in filters:
            column = _name(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column and type(f) in SIGNS and isinstance(f.value, (int, float, str)):
                self.where.append((f"{column} {SIGNS[type(f)]} ?", [f.value]))
            elif column and isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.where.append((f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif column and isinstance(f, IsNotNull):
                self.where.append((f"{column} IS NOT NULL", []))
            else:
                yield f

    def partitions(self) -> list[Page]:
        """Pages along the key: each query starts after the last page, so no row is counted over twice."""
        pages, low = [], None
        with connect(self.path) as con:
            while True:
                after, values = (f"WHERE {self.key} > ?", [low]) if low is not None else ("", [])
                found = con.execute(f"SELECT {self.key} FROM {self.table} {after} ORDER BY {self.key} LIMIT 1 OFFSET {self.page - 1}", values).fetchone()
                pages.append(Page(low, found and found[0]))
                if found is None:
                    return pages
                low = found[0]

    def read(self, partition: Page) -> Iterator[tuple]:
        bounds = [(f"{self.key} {sign} ?", [v]) for sign, v in ((">", partition.low), ("<=", partition.high)) if v is not None]
        wanted = [*bounds, *self.where]
        where = f"WHERE {' AND '.join(w for w, _ in wanted)}" if wanted else ""
        with connect(self.path) as con:
            yield from con.execute(f"SELECT {self.columns} FROM {self.table} {where} ORDER BY {self.key}", [v for _, vs in wanted for v in vs])


class _Writer(DataSourceWriter):
    """Tasks put their batches into a table of the job, with the target's constraints; the commit upserts what the tasks that count have put there, in one transaction.

    A batch that the table doesn't take is left out as a whole and recorded in ``<table>_failed`` with its error.  A job that ends halfway changes nothing, and one that is run again changes nothing more.
    """

    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.key, self.page = options["path"], options["table"], options["key"], int(options.get("page", 1000))
        self.columns, self.job = schema.names, uuid.uuid4().hex
        self.stage = f"{self.table}_{self.job}"
        with connect(self.path) as con:
            (made,) = con.execute("SELECT sql FROM sqlite_master WHERE type = 'table' AND name = ?", [self.table]).fetchone()
            body = made[made.index("(") : made.rindex(")")]
            con.execute(f"CREATE TABLE {_name(self.stage)} {body}, task_ TEXT)".replace("PRIMARY KEY", "NOT NULL"))
            con.execute(f"CREATE TABLE IF NOT EXISTS {_name(self.table + '_failed')} (job TEXT, batch TEXT, n_rows INTEGER, error TEXT)")

    def write(self, iterator: Iterator) -> Written:
        task = f"{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        insert = f"INSERT INTO {_name(self.stage)} ({', '.join(map(_name, self.columns))}, task_) VALUES ({', '.join('?' * len(self.columns))}, ?)"
        out, batch, number = Written(task, 0, []), [], 0
        con = connect(self.path)

        def flush() -> None:
            nonlocal number
            try:
                with con:  # a transaction
                    con.executemany(insert, batch)
                out.rows += len(batch)
            except sqlite3.IntegrityError as error:
                out.failed.append((f"{task}-{number}", len(batch), str(error)))
            number += 1
            batch.clear()

        for row in iterator:
            batch.append((*row, task))
            if len(batch) >= self.page:
                flush()
        if batch:
            flush()
        con.close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        names = ", ".join(map(_name, self.columns))
        rest = [c for c in self.columns if c != self.key]
        update = f"DO UPDATE SET {', '.join(f'{_name(c)} = excluded.{_name(c)}' for c in rest)}" if rest else "DO NOTHING"
        with connect(self.path) as con:
            con.execute("CREATE TEMP TABLE counted (task TEXT)")
            con.executemany("INSERT INTO counted VALUES (?)", [(m.task,) for m in told])
            con.execute(f"INSERT INTO {_name(self.table)} ({names}) SELECT {names} FROM {_name(self.stage)} WHERE task_ IN (SELECT task FROM counted) ORDER BY rowid ON CONFLICT ({_name(self.key)}) {update}")
            con.executemany(f"INSERT INTO {_name(self.table + '_failed')} VALUES (?, ?, ?, ?)", [(self.job, *x) for m in told for x in m.failed])
            con.execute(f"DROP TABLE {_name(self.stage)}")

    def abort(self, messages: list[Written | None]) -> None:
        with connect(self.path) as con:
            con.execute(f"DROP TABLE IF EXISTS {_name(self.stage)}")


class KeyedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_table"

    def schema(self) -> str:
        with connect(self.options["path"]) as con:
            return ", ".join(f"`{name}` {KINDS.get(kind.upper(), 'string')}" for _, name, kind, *_ in con.execute(f"PRAGMA table_info({_name(self.options['table'])})"))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("rows are upserted by their key: append them")
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyedTable)


def create(path: str, table: str, columns: str) -> None:
    """Create an empty table, its columns in SQL with their constraints."""
    with connect(path) as con:
        con.execute(f"CREATE TABLE {_name(table)} ({columns})")
