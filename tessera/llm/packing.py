"""Best-fit packing of token pieces into sequences of a fixed length.

Operator: ``pack``. Exact-complement hashing: the counts of the lengths 1 to `capacity` are indexed by
single, pair and triple sums; combinations that fill a sequence exactly are consumed under
these counts, and what is left is packed best-fit. The plan needs the histogram of lengths only,
`capacity` numbers whatever the input's size, and says for each length which ranks go to
which sequence and place; the pieces then find theirs by their rank, without moving to one task.

Edge cases: a null or empty text is one piece that holds the end id; repeated rows and ids are packed
like any others, and pieces of one length take their places in the order of tasks; texts of any length are cut into
pieces; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import durable, id_type, slices, text_of
from tessera.llm.tokens import encoder


#: Places, of 40 bytes each, that are broadcast at most.
MOST = 500_000


class Lengths:
    """Counts of lengths, with an index of the sums of two lengths that are there."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        there = (self.left > 0).astype(np.int64)
        self.pairs = np.convolve(there, there)[: self.capacity + 1]  # ordered pairs of lengths by their sum

    def take(self, length: int, n: int) -> None:
        had = self.left[length] > 0
        self.left[length] -= n
        has = self.left[length] > 0
        if had != has:
            there = self.left > 0
            there[length] = False
            sign = 1 if has else -1
            room = self.capacity - length
            if room >= 0:
                self.pairs[length:] += 2 * sign * there[: room + 1]
            if 2 * length <= self.capacity:
                self.pairs[2 * length] += sign

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        if gap < 2 or self.pairs[gap] <= 0:
            return None
        large = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (self.left[large] > 0) & (self.left[gap - large] > 0)
        if gap % 2 == 0 and self.left[gap // 2] < 2:
            ok &= large * 2 != gap
        found = np.nonzero(ok)[0]
        return (int(large[found[0]]), int(gap - large[found[0]])) if len(found) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        if gap < 3:
            return None
        first = np.arange(gap - 2, 0, -1)
        for a in first[(self.left[first] > 0) & (self.pairs[gap - first] > 0)]:
            a = int(a)
            self.left[a] -= 1
            rest = self.pair(gap - a)
            self.left[a] += 1
            if rest and self.left[a] > 0:
                return (a, *rest)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths whose sum is the gap."""
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def fitting(self, gap: int) -> int:
        """The largest length that fits; 0 if none does."""
        found = np.nonzero(self.left[1 : gap + 1] > 0)[0]
        return int(found[-1]) + 1 if len(found) else 0


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how many sequences each fills. counts[n] is the number of pieces of length n."""
    have = Lengths(counts)
    capacity = have.capacity
    out = []
    for length in range(capacity, 0, -1):
        while have.left[length] > 0:
            used = [length]
            have.left[length] -= 1
            gap = capacity - length
            while gap:
                rest = have.exact(gap)
                if rest is None:
                    best = have.fitting(gap)
                    if not best:
                        break
                    rest = (best,)
                for x in rest:
                    have.left[x] -= 1
                used += rest
                gap -= sum(rest)
            need: dict[int, int] = {}
            for x in used:
                need[x] = need.get(x, 0) + 1
            for x, n in need.items():
                have.left[x] += n
            times = min(int(have.left[x]) // n for x, n in need.items())
            for x, n in need.items():
                have.take(x, n * times)
            out.append((tuple(used), times))
    return out


def segments(combinations: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank behind the last, sequence of the first, offset) of all ranks."""
    rank: dict[int, int] = {}
    out = []
    sequence = 0
    for used, times in combinations:
        offset = 0
        for x in used:
            at = rank.get(x, 0)
            out.append((x, at, at + times, sequence, offset))
            rank[x] = at + times
            offset += x
        sequence += times
    return out


def token_pieces(df: DataFrame, tokenizer: str, id_column: str, text_column: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of each text: place, length, checksum, and its number among those of its length in its task."""
    out = T.StructType([T.StructField("id", id_type(df, id_column)), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())])
    end = np.array([end_id], dtype="<u4").tobytes()
    size = 4 * capacity

    def run(batches):
        encode = encoder(tokenizer).encode
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for a, b in slices(batch.column(2).to_pylist(), 1 << 20):  # texts become Python's a slice at a time
                index, piece, start, length, crc, nth = ([] for _ in range(6))
                for k, ids in enumerate(encode(batch.column(1).slice(a, b - a).to_pylist()), a):
                    ids += end
                    for number, at in enumerate(range(0, len(ids), size)):
                        part = ids[at : at + size]
                        n = len(part) // 4
                        before = seen.get(n, 0)
                        seen[n] = before + 1
                        index.append(k), piece.append(number), start.append(at // 4), length.append(n), crc.append(zlib.crc32(part)), nth.append(before)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array([task] * len(index), pa.int32()), pa.array(nth)], out.names)

    text = text_of(text_column)
    return df.select(F.col(id_column).alias("id"), text.alias("text"), F.octet_length(text).alias("size")).mapInArrow(run, out)


def pack(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every text.

    A text's ids are followed by `end_id`; only texts of more than `capacity` ids are cut.
    """
    spark = df.sparkSession
    pieces = durable(token_pieces(df, tokenizer, id_column, text_column, capacity, end_id))
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # `capacity` rows at most
        counts[row.length] = row.n
    found = segments(plan(counts))
    places = spark.createDataFrame(found, "length long, low long, high long, sequence long, offset long")
    ranked = pieces.join(first, ["length", "task"]).withColumn("rank", F.col("first") + F.col("nth"))
    # The places depend on `capacity` alone: every step of the plan uses up what is left of some length. Beyond MOST, they aren't sent to all.
    placed = ranked.join(F.broadcast(places) if len(found) <= MOST else places, (ranked.length == places.length) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(F.col("id").alias(id_column), "piece", "start", ranked.length.alias("length"), "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
