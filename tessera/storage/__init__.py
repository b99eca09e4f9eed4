"""Snapshot tables with atomic, recoverable commits.

A database is a folder. A table is a list of immutable Parquet folders, less some of their files; a manifest names those of
every table and is published once per transaction by an exclusive link, so two writers can't both publish the
same number. An insert adds a folder with its rows alone; updates and deletes write only the files anew in which they
find rows. compact() puts a table's folders together. Readers take
the highest manifest whose checksum holds; a torn one counts as never committed, but its number is used
up. Folders that no manifest names are left-overs of aborted or crashed transactions and are removed
by vacuum, which spares those that open transactions of the same Database use.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
import weakref
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.sql import Change, Engine, Parser, SqlError


class ConflictError(RuntimeError):
    """Another transaction changed a table that this one read or wrote."""


class Database:
    """Manifests need a POSIX folder; table data may lie wherever Spark can read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.transactions: weakref.WeakSet[Transaction] = weakref.WeakSet()
        os.makedirs(f"{folder}/_manifest", exist_ok=True)

    def numbers(self) -> list[int]:
        """Of all manifests, torn ones too, the highest first."""
        return sorted((int(x[:-5]) for x in os.listdir(f"{self.folder}/_manifest") if x.endswith(".json")), reverse=True)

    def manifest(self) -> dict[str, dict]:
        """The tables as last committed."""
        for n in self.numbers():
            try:
                with open(f"{self.folder}/_manifest/{n}.json", encoding="utf-8") as f:
                    spec = json.load(f)
                if zlib.crc32(spec["body"].encode()) == spec["crc"]:
                    return json.loads(spec["body"])
            except (OSError, ValueError, KeyError):
                continue
        return {}

    def publish(self, tables: dict[str, dict], number: int) -> None:
        """Writes a manifest under a number that nobody has taken; FileExistsError if somebody has."""
        body = json.dumps(tables)
        base = f"{self.folder}/_manifest"
        temporary = f"{base}/.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump({"body": body, "crc": zlib.crc32(body.encode())}, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temporary, f"{base}/{number}.json")
        finally:
            os.unlink(temporary)
        folder = os.open(base, os.O_RDONLY)
        try:
            os.fsync(folder)  # else the new name may be lost with the machine
        finally:
            os.close(folder)

    def begin(self) -> Transaction:
        return Transaction(self)

    def execute(self, statement: str) -> DataFrame | int:
        """One statement in a transaction of its own."""
        t = self.begin()
        try:
            out = t.execute(statement)
            t.commit()
            return out
        except BaseException:
            t.abort()
            raise

    def compact(self, name: str) -> None:
        """Writes a table's rows into one folder."""
        t = self.begin()
        try:
            t.write(name, t.table(name))
            t.commit()
        except BaseException:
            t.abort()
            raise

    def vacuum(self) -> int:
        """Removes folders that neither the newest manifest nor an open transaction of this Database names. Other processes have to be done."""
        live = {p for t in self.manifest().values() for p in t["parts"]}
        for t in self.transactions:
            if t.open:
                live |= {p for x in [*t.begun.values(), *t.staged.values()] for p in x["parts"]} | t.written
        gone = 0
        for name in os.listdir(self.folder):
            if name.startswith("_"):
                continue
            for version in os.listdir(f"{self.folder}/{name}"):
                if f"{name}/{version}" not in live:
                    shutil.rmtree(f"{self.folder}/{name}/{version}")
                    gone += 1
        return gone


class Transaction:
    """Reads the state at its begin and its own changes; commits all of them or none."""

    def __init__(self, database: Database):
        self.database = database
        self.begun = database.manifest()
        self.staged: dict[str, dict] = {}
        self.written: set[str] = set()
        self.used: set[str] = set()
        self.open = True
        database.transactions.add(self)

    def must_be_open(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction is over")

    def now(self, name: str) -> dict:
        """The table's folders, each with the names of its files that no longer count, and its schema."""
        self.must_be_open()
        found = self.staged.get(name) or self.begun.get(name)
        if found is None:
            raise SqlError(f"no table {name!r}")
        self.used.add(name)
        return found

    def files(self, part: str, gone: list[str]) -> list[str]:
        """Names of a folder's files that count."""
        return sorted({n for n in os.listdir(f"{self.database.folder}/{part}") if n.endswith(".parquet")}.difference(gone))

    def read(self, spec: dict, only: set[str] | None = None) -> DataFrame:
        """The table's rows; only: those of these files, as folder/file."""
        paths = []
        for part, gone in spec["parts"].items():
            if only is None and not gone:
                paths.append(f"{self.database.folder}/{part}")
            else:
                paths += [f"{self.database.folder}/{part}/{n}" for n in self.files(part, gone) if only is None or f"{part}/{n}" in only]
        schema = T.StructType.fromJson(spec["schema"])
        return self.database.spark.read.schema(schema).parquet(*paths) if paths else self.database.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        return self.read(self.now(name))

    def stage(self, name: str, df: DataFrame, before: dict[str, list[str]]) -> str:
        path = f"{name}/{uuid.uuid4().hex}"
        self.used.add(name)
        self.written.add(path)
        df.write.parquet(f"{self.database.folder}/{path}")
        self.staged[name] = {"parts": before | {path: []}, "schema": json.loads(df.schema.json())}
        return path

    def write(self, name: str, df: DataFrame) -> None:
        """Stages a table's rows in place of those that were there."""
        self.must_be_open()
        self.stage(name, df, {})

    def append(self, name: str, df: DataFrame) -> int:
        """Stages more rows of a table; only they are written and counted."""
        path = self.stage(name, df, self.now(name)["parts"])
        return self.database.spark.read.schema(df.schema).parquet(f"{self.database.folder}/{path}").count()

    def bind(self, statement: str, **others: DataFrame) -> Change:
        names = {n: (lambda n=n: self.table(n)) for n in self.begun | self.staged}
        return Parser(Engine(self.database.spark, names | others), statement).statement()

    def execute(self, statement: str) -> DataFrame | int:
        """Rows of a SELECT, or the number of rows that a change affected: those it put in, took out or found by its condition."""
        self.must_be_open()
        change = self.bind(statement)
        if change.kind == "select":
            return change.rows
        if change.kind == "insert":
            return self.append(change.table, change.affected)
        spec = self.now(change.table)
        if not any(spec["parts"]):
            return 0
        found = change.affected.groupBy("_row.file_path").count().collect()  # as many as the table has files at most
        if found:
            touched = {"/".join(r.file_path.rsplit("/", 3)[1:]) for r in found}
            # The same statement on these files alone: it finds the same rows there, also the first few by some order.
            rows = self.bind(statement, **{change.table: self.read(spec, touched)}).rows
            left = {part: sorted({*gone, *(t.rsplit("/", 1)[1] for t in touched if t.startswith(f"{part}/"))}) for part, gone in spec["parts"].items()}
            self.stage(change.table, rows, {part: gone for part, gone in left.items() if not gone or self.files(part, gone)})
        return sum(r["count"] for r in found)

    def commit(self) -> None:
        """Publishes all changes; ConflictError, with nothing changed, if another transaction committed to a table that this one read or wrote."""
        self.must_be_open()
        while self.staged:
            number = max(self.database.numbers(), default=0) + 1
            now = self.database.manifest()
            changed = [name for name in self.used if now.get(name) != self.begun.get(name)]
            if changed:
                self.abort()
                raise ConflictError(f"{min(changed)} was changed meanwhile")
            try:
                self.database.publish(now | self.staged, number)
                break
            except FileExistsError:  # somebody was faster: look again at what changed
                continue
        self.open = False

    def abort(self) -> None:
        if self.open:
            for path in self.written:
                shutil.rmtree(f"{self.database.folder}/{path}", ignore_errors=True)
        self.staged, self.written, self.open = {}, set(), False
