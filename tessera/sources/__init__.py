"""Catalog of typed tables (S12, S13), CSV loading (S6) and physical layout in place of indexes."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.functions import all_of

# Type codes of the catalog format.
TYPES = {1: T.LongType(), 2: T.StringType()}


class CatalogError(ValueError):
    pass


@dataclass
class Index:
    oid: int
    name: str
    kind: str
    key: list[str]


@dataclass
class Table:
    oid: int
    name: str
    columns: list[tuple[str, int]]
    indexes: list[Index] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, TYPES[k]) for n, k in self.columns])


class Catalog:
    """Tables by name and oid, kept as JSON beside the data."""

    def __init__(self, tables: list[Table] | None = None, next_id: int = 1):
        self.tables = {t.name: t for t in tables or []}
        self.next_id = next_id

    @classmethod
    def load(cls, path: str) -> Catalog:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tables = [Table(t["oid"], t["name"], [(c["name"], c["type"]) for c in t["columns"]], [Index(i["oid"], i["name"], i["type"], i["key_schema"]) for i in t.get("indexes") or []]) for t in spec["tables"]]
        return cls(tables, spec["next_id"])

    def save(self, path: str) -> None:
        spec = {"next_id": self.next_id, "tables": [{"oid": t.oid, "name": t.name, "columns": [{"name": n, "type": k} for n, k in t.columns], "indexes": [{"oid": i.oid, "table_oid": t.oid, "name": i.name, "type": i.kind, "key_schema": i.key} for i in t.indexes]} for t in self.tables.values()]}
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump(spec, f, indent=1)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}.tmp", path)

    def add_table(self, name: str, columns: list[tuple[str, int]]) -> Table:
        if name in self.tables:
            raise CatalogError(f"table {name!r} is there already")
        self.tables[name] = t = Table(self.next_id, name, list(columns))
        self.next_id += 1
        return t

    def add_index(self, table: str, name: str, kind: str, key: list[str]) -> Index:
        t = self.table(table)
        if any(i.name == name for i in t.indexes):
            raise CatalogError(f"index {name!r} is there already")
        if missing := set(key) - {n for n, _ in t.columns}:
            raise CatalogError(f"no column {sorted(missing)[0]!r}")
        t.indexes.append(i := Index(self.next_id, name, kind, list(key)))
        self.next_id += 1
        return i

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise CatalogError(f"no table {name!r}")
        return self.tables[name]

    def by_oid(self, oid: int) -> Table | Index:
        for t in self.tables.values():
            for x in (t, *t.indexes):
                if x.oid == oid:
                    return x
        raise CatalogError(f"no object {oid}")

    def tables_with_column(self, column: str) -> list[Table]:
        return [t for t in self.tables.values() if any(n == column for n, _ in t.columns)]


def read_csv(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """Typed rows of a file without header; empty fields are null, malformed ones an error."""
    return spark.read.csv(path, schema=table.schema, header=False, mode="FAILFAST")


def write_layout(df: DataFrame, path: str, index: Index, partitions: int = 200) -> None:
    """An index as file layout: ordered for ranges (btree) or Bloom filters for points (hash); pruned by pushed filters."""
    if index.kind == "btree":
        df.repartitionByRange(partitions, *index.key).sortWithinPartitions(*index.key).write.mode("error").parquet(path)
        return
    writer = df.repartition(partitions, *index.key).write.mode("error")
    for c in index.key:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def matching_index(indexes: list[Index], equal: set[str], ranged: set[str] = frozenset()) -> Index | None:
    """The index that a predicate can use best: a hash index if its whole key is compared for equality, else the ordered one with the longest prefix of such columns, perhaps with a range behind it."""
    best, found = (0, 0), None
    for i in indexes:
        prefix = next((k for k, c in enumerate(i.key) if c not in equal), len(i.key))
        if i.kind == "btree":
            uses = (2 * prefix + (prefix < len(i.key) and i.key[prefix] in ranged), 0)
        else:
            uses = (2 * prefix, 1) if prefix == len(i.key) else (0, 0)
        if uses > best:
            best, found = uses, i
    return found


class IndexedTable:
    """A table kept once as it is and once more in the layout of each of its indexes; scans read the one that fits."""

    def __init__(self, spark: SparkSession, folder: str, table: Table):
        self.spark, self.folder, self.table = spark, folder.rstrip("/"), table

    def path(self, index: Index | None) -> str:
        return f"{self.folder}/{self.table.name if index is None else index.name}"

    def write(self, df: DataFrame, partitions: int = 200) -> None:
        df.write.mode("error").parquet(self.path(None))
        for i in self.table.indexes:
            write_layout(df, self.path(i), i, partitions)

    def scan(self, predicate: Column, equal: set[str], ranged: set[str] = frozenset()) -> DataFrame:
        """The rows for which the predicate holds, which compares the columns `equal` with constants and bounds those of `ranged`."""
        return self.spark.read.parquet(self.path(matching_index(self.table.indexes, set(equal), set(ranged)))).where(predicate)


    def probe(self, left: DataFrame, keys: dict[str, str], kind: str = "inner") -> DataFrame:
        """Joins `left` with the rows found by its columns in the table's; keys maps the table's columns to those of `left`.

        The layout whose whole key is asked for is read, else any whose key begins with some of it. Where `left` is small, Catalyst sends it to
        the table's files; where it is large, files ordered by the key keep a merge join's sort short.
        """
        found = self.spark.read.parquet(self.path(matching_index(self.table.indexes, set(keys))))
        return left.join(found, all_of([left[theirs] == found[ours] for ours, theirs in keys.items()]), kind)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only in local mode, where it may be unset, a temporary one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessera-")
