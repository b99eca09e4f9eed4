"""Near-duplicate documents by b-bit MinHash.

Operator: ``near_duplicates``. Texts of the same words are one class from the start. Each class has
`HASHES` minima over its word shingles; bands of them give candidate buckets, and of every minimum `BITS`
low bits are packed into a signature. Within a bucket, similarity is estimated from the
signatures' equal fields, corrected for fields that are equal by chance. Pairs above the threshold less a
wide margin must also differ in few enough bits of a parity sketch: a bit field in which each
shingle of the full set flips one bit, so that differing bits tell the sets' difference, almost
exactly for short texts. What is left is confirmed on the full shingle sets.

Buckets of many near copies are not expanded into all pairs. In `HUBS` rounds each member of a bucket is
compared with one of them, the bucket's hub, another each round; a component confirms its closest such pair
and is joined with what it is linked to. What is left are buckets that still hold several components; there
all pairs of different components count. A block of such a bucket gives a spanning forest of its
candidates, closest first; where a pair of it is not confirmed, the bucket is visited again: a member
lists its closest partners among classes that are not yet in its component, eight at first and sixteen
times as many each round; rounds end when no list had to be cut. So a pair is left out only if its
classes are connected already. A bucket's largest component meets the others only, not itself.

The sets of all classes in buckets are written once; texts are dealt out by id once for that.

Edge cases: null and empty texts have no shingles and are linked with nothing; a text with fewer words
than a shingle has one shingle, all of it; a null id is linked with nothing and has a null
component; rows that repeat an id count as one document with several texts; an empty
table gives an empty result; texts of any length are read whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import connected_components, durable, map_sorted_groups, release, starts, text_of, utf8_slices

HASHES = 128
BITS = 4
SEED = 20260102
BLOCK = 1024
PARITY = 1024
MEMO = 200_000
HUBS = 2
WHITE = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(SEED)
FACTORS = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))
ADDED = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
    width = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k])
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(low), 2048):
        best = np.minimum(best, (FACTORS[:, None] * low[None, a : a + 2048] + ADDED[:, None]).min(axis=1))
    return best


def packed(best: np.ndarray) -> bytes:
    """BITS low bits of each minimum, in 64-bit words."""
    fields = (mixed(best.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(fields << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).tobytes()


def parity(hashes: np.ndarray) -> bytes:
    """A field of PARITY bits, each the parity of the number of shingles that fall on it."""
    return np.packbits(np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def allowed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The bits in which the parity fields of sets of the wanted similarity may differ; linked pairs are never above.

    Fields differ in at most as many bits as sets differ in elements, so no linked pair is above the
    largest allowed difference. Where sets are large for the field, 4.5 deviations above the expected number are tighter.
    """
    m = (na + nb) * ((100 - percent) / (100 + percent)) + 1e-6
    decay = np.exp(-4 * m / PARITY)
    spread = np.sqrt(np.maximum(PARITY * (1 - decay) / 4 - m * decay, 0))
    return np.minimum(m, PARITY / 2 * (1 - np.sqrt(decay)) + 4.5 * spread + 1)


def paired_excess(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Differing bits over the allowed ones, of rows of parity fields that broadcast against each other."""
    differ = sum(np.bitwise_count(a[..., k] ^ b[..., k]).astype(np.int32) for k in range(a.shape[-1]))
    return differ - allowed(na, nb, percent)


def excess(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Of each row of a and each of b."""
    return paired_excess(a[:, None], b[None, :], na[:, None], nb[None, :], percent)


def forest(weight: np.ndarray, near: np.ndarray, cx: np.ndarray, cy: np.ndarray):
    """(row, column) of pairs in `near` that connect the components cx of rows and cy of columns as all of them do, light ones first."""
    names, number = np.unique(np.concatenate([cx, cy]), return_inverse=True)
    nx, ny = number[: len(cx)], number[len(cx) :]
    root = np.arange(len(names))
    while True:
        apart = near & (root[nx][:, None] != root[ny][None, :])
        if not apart.any():
            return
        w = np.where(apart, weight, np.inf)
        rows, columns = np.nonzero(apart.any(axis=1))[0], np.nonzero(apart.any(axis=0))[0]
        edges = sorted([(w[r, c], r, c) for r, c in zip(rows, w[rows].argmin(axis=1), strict=True)] + [(w[r, c], r, c) for c, r in zip(columns, w[:, columns].argmin(axis=0), strict=True)])
        for _, r, c in edges:
            x, y = root[nx[r]], root[ny[c]]
            if x != y:
                root[root == x] = y
                yield r, c


def paired_estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from counts of differing fields, of rows of signatures that broadcast against each other."""
    ones = np.uint64(int("1" * (64 // BITS), 1 << BITS) if BITS > 1 else (1 << 64) - 1)
    differ = 0
    for k in range(a.shape[-1]):
        x = a[..., k] ^ b[..., k]
        folded = x
        for s in range(1, BITS):
            folded = folded | (x >> np.uint64(s))
        differ = differ + np.bitwise_count(folded & ones).astype(np.int32)
    chance = 1 / (1 << BITS)
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a and each of b."""
    return paired_estimates(a[:, None], b[None, :])


def sketches(df: DataFrame, id_column: str, text_column: str, size: int, rows: int, bands: int) -> DataFrame:
    """(id, h1, h2, n, signature, bands): h1 and h2 name the class of texts of the same words; null for texts without words."""
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for a, texts in utf8_slices(batch, 1):
                h1, h2, count, signature, keys = [], [], [], [], []
                for data in texts:
                    words = data.translate(WHITE).split(None)
                    if not words:
                        h1.append(None), h2.append(None), count.append(0), signature.append(None), keys.append([])
                        continue
                    digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), dtype=np.int64)
                    hashes = shingle_set(words, size, known)
                    best = minima(hashes)
                    h1.append(int(digest[0])), h2.append(int(digest[1])), count.append(len(hashes)), signature.append(packed(best) + parity(hashes))
                    with np.errstate(over="ignore"):
                        key = np.arange(1, bands + 1, dtype=np.uint64)
                        for k in range(rows):
                            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + best[: rows * bands].reshape(bands, rows)[:, k])
                    keys.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(count, pa.int64()), pa.array(signature, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], out.names)

    return df.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")).mapInArrow(run, out)


def full_sets(df: DataFrame, size: int) -> DataFrame:
    """(id, hashes) of (id, text): the whole set as bytes."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for a, texts in utf8_slices(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array([shingle_set(x.translate(WHITE).split(None), size, known).tobytes() for x in texts], pa.binary())], ["id", "hashes"])

    return df.mapInArrow(run, "id long, hashes binary").where("length(hashes) > 0")


def bucket_pairs(members: DataFrame, least: float, most: int, percent: int) -> DataFrame:
    """Partners within buckets: a spanning forest where `most` is 0, else the closest. members: (key, bi, bj, side, comp, id, n, signature); (key, a, b, cut): cut tells of longer lists."""
    words = HASHES * BITS // 64

    def work(t: pa.Table) -> pa.Table | None:
        key, bi, bj, side, comp, ids, size = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "bi", "bj", "side", "comp", "id", "n"))
        fields = np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype=np.uint64).reshape(-1, words + PARITY // 64)
        sig, bits = fields[:, :words], fields[:, words:]
        keys, left, right, cut = [], [], [], []
        at = starts(key, bi, bj)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                continue
            s = side[lo:hi]
            first = np.arange(lo, hi)[s == 0]
            second = first if bi[lo] == bj[lo] else np.arange(lo, hi)[s == 1]
            for x, y in ((first, second),) if first is second else ((first, second), (second, first)):
                if not len(x) or not len(y):
                    continue
                e = estimates(sig[x], sig[y])
                ok = (e >= least) & (comp[x][:, None] != comp[y][None, :])
                if not ok.any():
                    continue
                over = excess(bits[x], bits[y], size[x], size[y], percent)
                ok &= over <= 0
                if not most:
                    for r, c in forest(over, ok, comp[x], comp[y]):
                        keys.append(key[lo]), left.append(ids[x[r]]), right.append(ids[y[c]]), cut.append(False)
                    break
                over = np.where(ok, over, np.inf)
                n = ok.sum(axis=1)
                for r in np.nonzero(n)[0]:
                    if n[r] <= most:
                        best = np.nonzero(ok[r])[0]
                    else:
                        best = np.argpartition(over[r], most)[:most]
                    full = n[r] > most
                    for c in best:
                        keys.append(key[lo]), left.append(ids[x[r]]), right.append(ids[y[c]]), cut.append(full)
        if not left:
            return None
        a, b = np.array(left), np.array(right)
        return pa.table({"key": np.array(keys), "a": np.minimum(a, b), "b": np.maximum(a, b), "cut": np.array(cut)})

    return map_sorted_groups(members, ["key", "bi", "bj"], "key long, a long, b long, cut boolean", work)


def hub_pairs(pairs: DataFrame, signed: DataFrame, least: float, percent: int) -> DataFrame:
    """(a, b, comp, to, weight): those of `pairs` (a, b, comp, to) that may be linked; weight is small for close ones."""
    words = HASHES * BITS // 64
    left = signed.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("x"))
    right = signed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("y"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint64).reshape(-1, words + PARITY // 64) for k in (5, 7))
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 6))
            weight = paired_excess(x[:, words:], y[:, words:], na, nb, percent)
            ok = pa.array((weight <= 0) & (paired_estimates(x[:, :words], y[:, :words]) >= least))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(ok) for k in range(4)), pa.array(weight).filter(ok)], ["a", "b", "comp", "to", "weight"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "comp", "to", "na", "x", "nb", "y").mapInArrow(run, "a long, b long, comp long, to long, weight double")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' intersection is at least percent / 100 of their union."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):  # a pair's sets at a time, without a copy
                x, y = np.frombuffer(p.as_buffer(), dtype=np.uint64), np.frombuffer(q.as_buffer(), dtype=np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")  # two sorted runs are merged
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Documents are linked whose sets of `size`-word shingles have an intersection of at least `percent` / 100 of
    their union; component_id is the smallest id reachable by links; kept marks that document.
    Words are runs without white space, A-Z in lower case.
    """
    rows = 5 if percent >= 85 else 4
    bands = HASHES // rows
    least = percent / 100 - 5 * ((percent / 100) * (1 - percent / 100) / HASHES) ** 0.5 - 0.05
    all_docs = durable(sketches(df, id_column, text_column, size, rows, bands))
    real = all_docs.where("h1 is not null and id is not null")
    classes = real.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    shown = durable(real.groupBy("h1", "h2").agg(F.min_by(F.struct("id", "n", "signature", "bands"), "id").alias("r")).select("r.id", "r.n", "r.signature", "r.bands"))
    release(df.sparkSession)
    keyed = shown.select("id", F.explode("bands").alias("key"))
    # Counts by key are written before they are joined, here and below: the join's sides are plain shuffles then, of which a hot key's can be split.
    shared = durable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"))
    now = durable(keyed.join(shared, "key").select("key", "id", F.col("id").alias("comp")))
    release(df.sparkSession)
    nodes = durable(now.select("id", "comp").distinct())
    signed = durable(shown.join(nodes, "id", "left_semi").select("id", "n", "signature"))
    texts = df.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")).join(nodes, "id", "left_semi")
    sets = durable(full_sets(texts.dropDuplicates(["id", "text"]), size))
    release(df.sparkSession)

    def join_linked(pairs: DataFrame, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Confirms pairs (a, b, comp, to) and joins the components of those that are linked. The members of buckets that still hold several, of all or of those whose keys `also` takes from the links."""
        nonlocal nodes
        links = durable(confirmed(pairs, sets, percent))
        moved = connected_components(pairs.join(links, ["a", "b"]).select(F.col("comp").alias("src"), F.col("to").alias("dst")))
        moved = durable(moved.withColumnsRenamed({"node": "comp", "component": "joined"}))
        put = lambda rows: rows.join(moved, "comp", "left").withColumn("comp", F.coalesce("joined", "comp")).drop("joined")
        nodes = durable(put(nodes).select("id", "comp"))
        rest = durable(put(now if also is None else now.join(also(links), "key", "left_semi")).select("key", "id", "comp"))
        apart = durable(rest.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"))
        rest = durable(rest.join(apart, "key", "left_semi"))
        release(df.sparkSession)
        return rest

    for k in range(HUBS):
        if now.isEmpty():
            break
        order = F.xxhash64("id", "key", F.lit(k))
        hubs = durable(now.groupBy("key").agg(F.min_by("id", order).alias("b"), F.min_by("comp", order).alias("to")))
        pairs = now.join(hubs, "key").where("comp <> to").select(F.col("id").alias("a"), "b", "comp", "to").distinct()
        near = hub_pairs(pairs, signed, least, percent).groupBy("comp").agg(*(F.min_by(c, "weight").alias(c) for c in ("a", "b", "to")))
        now = join_linked(durable(near.select("a", "b", "comp", "to")))

    most = 0
    while not now.isEmpty():
        found = durable(bucket_pairs(dealt(now, signed), least, most, percent))
        comp = lambda x, y: nodes.select(F.col("id").alias(x), F.col("comp").alias(y))
        pairs = durable(found.select("a", "b").distinct().join(comp("a", "comp"), "a").join(comp("b", "to"), "b"))
        cut = found.where("cut").select("key").distinct() if most else None
        now = join_linked(pairs, (lambda links, cut=cut: cut) if most else (lambda links: found.join(links, ["a", "b"], "left_anti").select("key").distinct()))
        most = 16 * most or 8
    reached = classes.join(nodes, classes.rep == nodes.id, "left").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("comp", "rep").alias("component"))
    out = all_docs.join(reached, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def dealt(members: DataFrame, signed: DataFrame) -> DataFrame:
    """Members (key, id, comp) of buckets as pairs of blocks, with signatures: a bucket's largest component against the others, and the others against each other."""
    held = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    sizes = durable(held.groupBy("key").agg(F.max_by("comp", "m").alias("main"), F.max("m").alias("of_main"), F.sum("m").alias("all")))
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    rows = members.join(sizes, "key").withColumns({"others": blocks(F.col("all") - F.col("of_main")), "mains": blocks(F.col("of_main")), "in_main": F.col("comp") == F.col("main")})
    block = F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("block", block)
    other = F.sequence(F.lit(0), F.col("others") - 1)
    against = F.sequence(F.col("others"), F.col("others") + F.col("mains") - 1)
    mains = F.transform(other, lambda o: F.struct(o.alias("bi"), (F.col("others") + F.col("block")).alias("bj"), F.lit(1).alias("side")))
    among = F.transform(other, lambda o: F.struct(F.least("block", o).alias("bi"), F.greatest("block", o).alias("bj"), F.when(F.col("block") <= o, 0).otherwise(1).alias("side")))
    across = F.transform(against, lambda o: F.struct(F.col("block").alias("bi"), o.alias("bj"), F.lit(0).alias("side")))
    at = F.explode(F.when(F.col("in_main"), mains).otherwise(F.concat(among, across)))
    return rows.join(signed, "id").select("key", "id", "comp", "n", "signature", at.alias("at")).select("key", "at.bi", "at.bj", "at.side", "comp", "id", "n", "signature")
