"""Relational operators: pure functions from DataFrames to DataFrames; Catalyst picks the physical plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import all_of
from tessera.plans import estimated_bytes

#: Names of join strategies and the hints that ask for them; "auto" leaves the choice to size statistics and AQE.
STRATEGIES = {"hash": "SHUFFLE_HASH", "merge": "MERGE", "loop": "SHUFFLE_REPLICATE_NL"}
#: Up to this product of both sides' estimated bytes an inner loop goes through all pairs of rows, some ten million a core and second.
ALL_PAIRS = 1e10
KINDS = {"inner", "left", "right", "full", "cross"}
AGGREGATES = {"count", "sum", "min", "max"}


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Reads a table; columns and predicate reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df if predicate is None else df.where(predicate)
    return df.select(*columns) if columns else df


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Constant rows."""
    return spark.createDataFrame(rows, schema)


def project(df: DataFrame, **items: Column) -> DataFrame:
    """Named expressions."""
    return df.select(*(c.alias(n) for n, c in items.items()))


def select(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true, not false or null."""
    return df.where(predicate)


def join(left: DataFrame, right: DataFrame, on: Column | None = None, kind: str = "inner", strategy: str = "auto") -> DataFrame:
    """Equi-keys are taken out of `on` and the rest stays as its residual; null keys never match.

    "loop" goes through all pairs of small sides. Of larger ones, or if a size isn't known, it goes only through the pairs
    with equal keys, which a merge brings together; without an equality in `on` it has to go through all pairs at any size.
    """
    if kind not in KINDS:
        raise ValueError(f"join kind {kind!r} isn't supported")
    if kind == "cross":
        return left.crossJoin(right)
    if on is None:
        raise ValueError(f"a join of kind {kind!r} needs a condition")
    if strategy == "loop" and kind == "inner" and estimated_bytes(left) * estimated_bytes(right) > ALL_PAIRS:
        left = left.hint(STRATEGIES["merge"])  # Spark puts it before the loop where there are keys to merge by
    if strategy != "auto":
        right = right.hint(STRATEGIES[strategy])
    return left.join(right, on, kind)


def join_using(left: DataFrame, right: DataFrame, columns: list[str], kind: str = "inner") -> DataFrame:
    """Equality of the named columns; both copies stay."""
    for c in columns:
        for side in (left, right):
            if c not in side.columns:
                raise ValueError(f"column {c!r} isn't on both sides")
        if left.schema[c].dataType != right.schema[c].dataType:
            raise ValueError(f"column {c!r} has different types")
    return left.join(right, all_of([left[c] == right[c] for c in columns]), kind)


def aggregate(df: DataFrame, keys: list[Column | str], outputs: dict[str, tuple[str, Column | None]], having: Column | None = None) -> DataFrame:
    """A1-A10: outputs map a name to (count | sum | min | max, argument); None is COUNT(*). Null keys are one group."""
    made = []
    for name, (kind, arg) in outputs.items():
        if kind not in AGGREGATES:
            raise ValueError(f"aggregate {kind!r} isn't supported")
        if arg is None and kind != "count":
            raise ValueError(f"{kind} needs an argument")
        made.append(getattr(F, kind)(F.lit(1) if arg is None else arg).alias(name))
    grouped = df.groupBy(*keys)
    out = grouped.agg(*made) if made else df.select(*keys).distinct()
    return out if having is None else out.where(having)


def sort(df: DataFrame, *keys: tuple[Column, bool]) -> DataFrame:
    """O1: (expression, ascending) keys; null is the lowest value."""
    return df.orderBy(*(c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in keys))


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """O2, O3."""
    return (df.offset(offset) if offset else df).limit(n)


def top_n(df: DataFrame, n: int, *keys: tuple[Column, bool]) -> DataFrame:
    """Sort and limit, which Spark runs as one bounded heap a task."""
    return limit(sort(df, *keys), n)


def materialize(df: DataFrame) -> DataFrame:
    """Keeps a relation that is read several times; it spills to disk."""
    return df.persist()


def aligned(target: DataFrame, source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The source's rows in the target's shape, by position among `columns`; others become null."""
    columns = columns or target.columns
    if len(columns) != len(source.columns):
        raise ValueError(f"INSERT names {len(columns)} columns but gets {len(source.columns)}")
    named = source.toDF(*columns)
    return named.select(*((F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema))


def insert(target: DataFrame, source: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """M1, M2: the target's rows and the source's."""
    return target.unionByName(aligned(target, source, columns))


def update(df: DataFrame, changes: dict[str, Column], predicate: Column | None = None) -> DataFrame:
    """M3: all right-hand sides see the old values; rows whose predicate is null stay."""
    hit = F.coalesce(predicate, F.lit(False)) if predicate is not None else F.lit(True)
    return df.select(*(F.when(hit, changes[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in changes else F.col(f.name) for f in df.schema))


def delete(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """M4: rows whose predicate is null stay."""
    return df.where(~F.coalesce(predicate, F.lit(False))) if predicate is not None else df.limit(0)
