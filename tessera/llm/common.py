"""What the operators of this package share: table access, lineage cuts, grouped streaming, components."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only in local mode, where it may be unset, a temporary one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Holds settings of the session, with _ for the dots in their names, for what is run within."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Rows of an Arrow batch. Texts come with ten thousand a batch by default, of which the JVM and Python each hold several.
BATCH = "2000"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage at files that every executor can read again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with settings(spark, spark_sql_execution_arrow_maxRecordsPerBatch=BATCH):
        done = df.checkpoint(eager=True)
    # A checkpoint keeps its plan's size estimate, and a join's is the product of its sides', so the estimate's digits would double with
    # every round that joins what the last one wrote, up to hundreds of megabytes of them. The same rows without it:
    rows = done._jdf.queryExecution().analyzed().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of plans that are done go at once: Spark's cleaner removes them when the driver's collector finds the plans dead."""
    gc.collect()  # Python's unreachable frames hold plans of the driver
    spark.sparkContext._jvm.System.gc()


def fixed_splits(spark: SparkSession):
    """Files are dealt out to partitions alike each time they are read within, though executors come and go meanwhile: Spark looks at their number."""
    known = spark.conf.get("spark.sql.files.minPartitionNum", None)
    return settings(spark, spark_sql_files_minPartitionNum=known or str(max(1, spark.sparkContext.defaultParallelism)))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing will read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Gives each row a number of its own, the same however often it is read: of rows in files the hash of the file's path and the row's place there, of others their place."""
    try:
        return df.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())


def id_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def text_of(column: str = "text"):
    """A null text counts as an empty one in every operator here."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of rows of at most `limit` bytes; a larger row is a run of its own."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > limit:
            yield begin, k
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def utf8_rows(column: pa.Array) -> list[bytes]:
    """The rows of a string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def utf8_slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """The rows of a string column as UTF-8 bytes, about `limit` bytes at a time, each list with its first row's number."""
    texts = batch.column(column)
    for a, b in slices(pc.binary_length(texts).to_pylist(), limit):
        yield a, utf8_rows(texts.slice(a, b - a))


def map_sorted_groups(df: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table], pa.Table | None]) -> DataFrame:
    """Deals rows out by `keys` and calls `work` with the rows of whole groups, many groups at once.

    `work` gets a table sorted by `keys` in which every group is complete. Groups have to be
    small enough for one task; callers split larger ones by a block number among the keys.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    names = dealt.columns

    def changes(t: pa.Table) -> np.ndarray:
        differs = np.zeros(max(0, t.num_rows - 1), dtype=bool)
        for k in keys:
            column = t.column(k).combine_chunks()
            differs |= column.slice(1).to_numpy(zero_copy_only=False) != column.slice(0, len(column) - 1).to_numpy(zero_copy_only=False)
        return np.nonzero(differs)[0] + 1

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 4096:
                continue
            t = pa.Table.from_batches(held)
            at = changes(t)
            if not len(at):
                continue
            cut = int(at[-1])
            out = work(t.slice(0, cut))
            if out is not None and out.num_rows:
                yield from out.to_batches()
            held = t.slice(cut).to_batches()
            rows = t.num_rows - cut
        if held:
            out = work(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return dealt.select(*names).mapInArrow(run, schema)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where the groups of rows sorted by `columns` begin, and the end of the last."""
    n = len(columns[0])
    differs = np.zeros(max(0, n - 1), dtype=bool)
    for c in columns:
        differs |= c[1:] != c[:-1]
    return np.concatenate([[0], np.nonzero(differs)[0] + 1, [n]]).astype(np.int64)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (src, dst); component is the smallest node reachable.

    Alternates large-star and small-star steps: each is one minimum by node, combined before the
    shuffle, and one merge join that streams a node's neighbours past its minimum, however many they are. Steps
    end when every edge points at its component's smallest node. Nothing but two numbers a step reaches the driver.
    """
    now = durable(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        print_of = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (print_of.n, print_of.h) == before or not print_of.n:
            break
        before = (print_of.n, print_of.h)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        now = durable(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v"))).distinct())
        release(edges.sparkSession)  # what steps broadcast goes before the next one
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
