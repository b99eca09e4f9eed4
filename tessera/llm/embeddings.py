"""Near-duplicate embeddings by random-hyperplane sign hashing.

Operator: ``near_vectors``. Vectors of one label whose values are equal are one class from the start. In each
of several tables the signs of a vector's products with random hyperplanes are its code; classes that
share a label, table and code are compared by exact cosine in double precision. A pair that
shares codes in several tables is counted in the first of them only. Tables and planes are set so that
a pair at the threshold is missed with a probability below 1e-4, closer pairs far less; with 2**20 codes a bucket
of vectors that aren't close has a thousand members in a billion.

Only keys and ids are dealt out to find buckets with several classes; vectors go to those alone, in the type they are given in.
Buckets larger than a block are dealt out as pairs of blocks, as n_links asks for every link's count. A task returns counts of
links and a star for each set of linked vectors it saw, never all pairs. Components are found by distributed star steps.

Edge cases: vectors that are null, zero, empty or hold null or non-finite components, and rows with a null label
or id, link with nothing; their component is their id. Components are scaled by the largest before they are squared, so
tiny and huge vectors are like others. Vectors of different lengths never link. Repeated rows
count as other vectors of the same id. Empty tables give empty results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import connected_components, durable, map_sorted_groups, starts

TABLES = 32
PLANES = 20
SEED = 20260103
BLOCK = 2048


def planes(dimension: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension]).normal(size=(dimension, TABLES * PLANES))


def unit_rows(data: list[bytes], kind: str, dimension: int) -> np.ndarray:
    x = np.frombuffer(b"".join(data), dtype=kind).reshape(-1, dimension).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def with_codes(classes: DataFrame, kind: str) -> DataFrame:
    """(rep, label, m, v, codes, keys): codes are 32-bit numbers, one for each table; keys are hashes of label, length, table and code."""
    width = np.dtype(kind).itemsize

    def run(batches):
        for batch in batches:
            labels, data = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            codes = np.zeros((len(data), TABLES), dtype=np.uint32)
            sizes = np.array([len(x) // width for x in data])
            for size in np.unique(sizes):
                at = np.nonzero(sizes == size)[0]
                signs = (unit_rows([data[k] for k in at], kind, size) @ planes(size) > 0).reshape(len(at), TABLES, PLANES)
                codes[at] = signs @ (1 << np.arange(PLANES))
            seeds = np.array([xxhash.xxh3_64_intdigest(lab.encode(), seed=int(n)) for lab, n in zip(labels, sizes, strict=True)], dtype=np.uint64)
            with np.errstate(over="ignore"):
                keys = (seeds[:, None] ^ (codes.astype(np.uint64) << np.uint64(8) | np.arange(TABLES, dtype=np.uint64))) * np.uint64(0x9E3779B97F4A7C15)
                keys = (keys ^ keys >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], ["rep", "label", "m", "v", "codes", "keys"])

    return classes.select("rep", "label", "m", "v").mapInArrow(run, "rep long, label string, m long, v binary, codes binary, keys array<long>")


def block_links(members: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(rep, n, to): n more vectors linked to each of the class, and a class of the same component, over blocks of buckets."""
    width = np.dtype(kind).itemsize

    def work(t: pa.Table) -> pa.Table | None:
        column = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        key, number, bi, bj, side, rep, m = (column(c) for c in ("key", "tab", "bi", "bj", "side", "rep", "m"))
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.uint32).reshape(-1, TABLES)
        data = t.column("v").to_pylist()
        size = np.array([len(v) // width for v in data])
        reps, counts, to = [], [], []
        at = starts(key, number, bi, bj)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            bucket = np.arange(lo, hi)
            kinds = label[lo:hi].astype(np.int64) << 32 | size[lo:hi]  # keys are hashes: several buckets may have the same
            for which in np.unique(kinds):
                k = bucket[kinds == which]
                same = bi[lo] == bj[lo]
                first = k if same else k[side[k] == 0]
                second = k if same else k[side[k] == 1]
                if not len(first) or not len(second) or len(k) < 2:
                    continue
                x = unit_rows([data[i] for i in first], kind, size[k[0]])
                y = x if same else unit_rows([data[i] for i in second], kind, size[k[0]])
                linked = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(linked, False)
                r, c = np.nonzero(linked)
                # Pairs count in the first table that they share, and where their codes are those of this key.
                before = np.arange(TABLES) < number[lo]
                agree = codes[first[r]] == codes[second[c]]
                counted = agree[:, number[lo]] & ~(agree & before).any(axis=1)
                linked[r[~counted], c[~counted]] = False
                for rows, cols, l in ((first, second, linked),) if same else ((first, second, linked), (second, first, linked.T)):
                    some = np.nonzero(l.any(axis=1))[0]
                    if len(some):
                        reps.append(rep[rows][some]), counts.append(l[some] @ m[cols]), to.append(rep[rows][some])
                for a, b in _stars(linked, same):
                    reps.append(np.array([rep[first[a]]])), counts.append(np.array([0])), to.append(np.array([rep[second[b]]]))
        if not reps:
            return None
        return pa.table({"rep": np.concatenate(reps), "n": np.concatenate(counts).astype(np.int64), "to": np.concatenate(to)})

    return map_sorted_groups(members, ["key", "tab", "bi", "bj"], "rep long, n long, to long", work)


def _stars(linked: np.ndarray, same: bool):
    """Pairs that connect the linked rows and columns as all the links do: at most one for each row and column."""
    rows, cols = linked.shape
    seen_rows, seen_cols = np.zeros(rows, dtype=bool), np.zeros(cols, dtype=bool)
    for r in np.nonzero(linked.any(axis=1))[0]:
        if seen_rows[r]:
            continue
        stack = [int(r)]
        seen_rows[r] = True
        if same:
            seen_cols[r] = True
        while stack:
            a = stack.pop()
            for b in np.nonzero(linked[a] & ~seen_cols)[0]:
                seen_cols[b] = True
                yield a, int(b)
                if same:
                    seen_rows[b] = True
                    stack.append(int(b))
                else:
                    for c in np.nonzero(linked[:, b] & ~seen_rows)[0]:
                        seen_rows[c] = True
                        yield int(c), int(b)
                        stack.append(int(c))


def near_vectors(df: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row; pairs of one label with a cosine of at least `threshold` are linked."""
    element = df.schema[vector_column].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    values = F.transform(F.col(vector_column), lambda x: x.cast("float" if kind == "<f4" else "double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), values.alias("v"))
    rows = rows.select("id", "label", F.when(usable, F.col("v")).alias("v"))

    def pack(batches):
        for batch in batches:
            v, d1, d2 = [], [], []
            for x, lab in zip(batch.column(2), batch.column(1).to_pylist(), strict=True):
                data = None if not x.is_valid else (x.values.to_numpy(zero_copy_only=False).astype(kind) + 0).tobytes()  # minus zero is zero
                digest = (None, None) if data is None else np.frombuffer(xxhash.xxh3_128_digest(len(lab).to_bytes(4, "little") + lab.encode() + data), dtype=np.int64).tolist()
                v.append(data), d1.append(digest[0]), d2.append(digest[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v, pa.binary()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], ["id", "label", "v", "d1", "d2"])

    packed = durable(rows.mapInArrow(pack, "id long, label string, v binary, d1 long, d2 long"))
    good = packed.where("v is not null")
    # Equal digests of 128 bits are equal vectors of one label. Half of the digest numbers a class, as ids may be repeated.
    classes = good.groupBy("d1", "d2").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("m"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = durable(classes.withColumn("rep", F.col("d1")))
    coded = durable(with_codes(classes, kind))
    keyed = coded.select("rep", F.posexplode("keys").alias("tab", "key"))
    shared = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = keyed.join(shared, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", "tab", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "rep")
    found = durable(block_links(members.join(coded.select("rep", "label", "m", "v", "codes"), "rep"), threshold, kind))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    components = connected_components(found.select(F.col("rep").alias("src"), F.col("to").alias("dst")))
    linked = classes.select("rep", "d1", "d2", "smallest", "m").join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    linked = linked.withColumn("component", F.coalesce("component", "rep")).where("m > 1 or n > 0")
    names = linked.groupBy("component").agg(F.min("smallest").alias("name"))
    known = linked.join(names, "component").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "name")
    out = packed.select("id", "d1", "d2").join(known, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left")
    component = F.coalesce("name", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
