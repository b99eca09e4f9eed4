"""Command line: a SQL shell over snapshot tables and a loader of CSV files.

    python -m tessera.shell load --catalog catalog.json --db folder a.csv b.csv
    python -m tessera.shell shell --catalog catalog.json --db folder [--explain]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Iterable
from itertools import chain, islice
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tessera.plans import explain
from tessera.sources import Catalog, CatalogError, read_csv
from tessera.sql import SqlError
from tessera.storage import ConflictError, Database

HELP = "End a statement with ';'. exit, quit or \\q leaves, help shows this text."
#: Rows whose columns are lined up together, so that a result of any size is printed in bounded memory.
PAGE = 1000


def print_rows(df: DataFrame, out: TextIO) -> int:
    """Prints a result with its columns lined up, two spaces apart; the number of rows."""
    rows = df.toLocalIterator()
    shown = ["NULL" if v is None else str(v) for v in df.columns]
    count = 0
    while True:
        page = [["NULL" if v is None else str(v) for v in r] for r in islice(rows, PAGE)]
        count += len(page)
        lines = [shown, *page] if shown else page
        widths = [max(len(x[k]) for x in lines) for k in range(len(df.columns))] if lines else []
        for x in lines:
            print("  ".join(v.ljust(w) for v, w in zip(x, widths, strict=True)).rstrip(), file=out)
        shown = []
        if len(page) < PAGE:
            return count


def load_files(database: Database, catalog: Catalog, paths: Iterable[str], out: TextIO = sys.stdout) -> int:
    """Appends each file's rows to the table that has the file's name without its ending, all in one transaction; files without such a table are skipped."""
    transaction = database.begin()
    total = 0
    try:
        for path in paths:
            name = os.path.splitext(os.path.basename(path))[0]
            if name not in catalog.tables:
                print(f"skipped {path}: no table {name!r}", file=out)
                continue
            df = read_csv(database.spark, path, catalog.table(name))
            if name in transaction.begun or name in transaction.staged:
                n = transaction.append(name, df)
            else:
                transaction.write(name, df)
                n = transaction.table(name).count()
            print(f"{path}: {n} rows into {name}", file=out)
            total += n
        transaction.commit()
    except BaseException:
        transaction.abort()
        raise
    return total


def create_tables(database: Database, catalog: Catalog) -> None:
    """Makes the catalog's tables that aren't there yet, without rows."""
    transaction = database.begin()
    for t in catalog.tables.values():
        if t.name not in transaction.begun:
            transaction.write(t.name, database.spark.createDataFrame([], t.schema))
    transaction.commit()


class Shell:
    """Reads lines, runs each statement that a line ends with ';', prints results and errors."""

    def __init__(self, database: Database, out: TextIO = sys.stdout, explained: bool = False, prompt: bool = True):
        self.database, self.out, self.explained, self.prompt = database, out, explained, prompt
        self.held: list[str] = []

    def run(self, lines: Iterable[str]) -> None:
        self.ask()
        for line in lines:
            if not self.feed(line):
                return
            self.ask()

    def ask(self) -> None:
        if self.prompt:
            print("    -> " if self.held else "tessera> ", end="", file=self.out, flush=True)

    def feed(self, line: str) -> bool:
        """Takes a line; False if it ends the session."""
        line = line.strip()
        if not self.held and line in ("exit", "quit", "\\q"):
            return False
        if not self.held and line == "help":
            print(HELP, file=self.out)
        elif line:
            self.held.append(line)
            if line.endswith(";"):
                text, self.held = " ".join(self.held), []
                try:
                    self.execute(text)
                except (SqlError, CatalogError, ConflictError, PySparkException, ValueError) as e:
                    print(f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=self.out)
        return True

    def execute(self, text: str) -> None:
        began = time.time()
        result = self.database.execute(text)
        if isinstance(result, DataFrame):
            if self.explained:
                print(explain(result), file=self.out)
            n = print_rows(result, self.out)
        else:
            n = result
        print(f"({n} rows) [{time.time() - began:.3f} s]", file=self.out)


def main(arguments: list[str] | None = None) -> int:
    options = argparse.ArgumentParser(prog="tessera")
    options.add_argument("command", choices=["shell", "load"])
    options.add_argument("files", nargs="*")
    options.add_argument("--catalog", default="catalog.json")
    options.add_argument("--db", default="tessera_data")
    options.add_argument("--explain", action="store_true")
    given = options.parse_args(arguments)
    if given.command == "load" and not given.files:
        options.error("load takes CSV files")
    catalog = Catalog.load(given.catalog)
    database = Database(SparkSession.builder.appName("tessera").getOrCreate(), given.db)
    create_tables(database, catalog)
    if given.command == "load":
        print(f"{load_files(database, catalog, given.files)} rows")
    else:
        Shell(database, explained=given.explain).run(chain(sys.stdin))
    return 0


if __name__ == "__main__":
    sys.exit(main())
