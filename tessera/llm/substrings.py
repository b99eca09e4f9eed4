"""Repeated passages by content-defined chunking, extended to whole words at both ends.

Operators: ``chunks``, ``repeated_passages``, ``drop_repeats``. A gear rolling hash over the last 32 bytes of UTF-8
text cuts where it is larger than at any of the `reach` places on either side, so cuts depend on near-by
bytes alone, an insertion moves only the chunks it touches, and long gaps without a cut are very rare.
Where text goes round in a period too short for that, cuts are at the equal largest places, once a period.

Chunks are deduplicated by a 64-bit digest of the chunk and of the `reach` bytes behind it, which decided
its end; so chunks that follow each other overlap, and a run of chunks that all stand elsewhere is a chain
of shared bytes, not pieces side by side. A run's ends lie within the passage. Each end is extended: all places
that hold the run's outermost chunk offer the hashes of the words beside it, one word more each time, and the
longest that another place offers too is where the passage ends. Passages of `least_words` whole words or
more are reported. No step lines up pairs of places: all are counts by hash, combined before the shuffle.

A place is one number, the partition of the input and the bytes before it there, so the input, which is read
more than once, has to give its rows in the same order, as files do; their splits are held. A passage may stand elsewhere in the same row.

A passage of 50 words is missed only if it has no whole chunk: of passages of 255 bytes of prose that is less than one
in ten thousand. The bytes that decide a cut lie within `reach` behind it and `LOOK` more before it, so nothing beyond the next chunk and those can be shared.

Edge cases: null and empty texts have no chunks; rows are told apart by their place, so null and repeated ids are rows
like others and null ids are reported as null; texts of any length are read whole; empty tables give empty results; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import durable, fixed_splits, id_type, release, slices, text_of, utf8_slices

GEAR = np.random.default_rng(20260104).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
MIX = np.uint32(0x9E3779B1)
#: Bytes that the gear hash looks back.
LOOK = 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte, h = (h << 1) + gear[byte] in 32 bits, by five doublings of the window; mixed, so that neighbours differ."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k].copy() << np.uint32(k))
    h ^= h >> np.uint32(15)
    return h * MIX


def largest_before(keys: np.ndarray, width: int) -> np.ndarray:
    """Of the `width` keys before each, 0 where there are none."""
    out, size = np.concatenate([np.zeros(width, dtype=keys.dtype), keys]), 1
    while size < width:
        step = min(size, width - size)
        out = np.maximum(out[:-step], out[step:])
        size += step
    return out[: len(keys)]


def cuts(texts: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts put together, and the ends of all chunks in that; every text's end is one."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    if not len(data):
        return data, np.zeros(0, dtype=np.int64)
    h = rolling(data) | np.uint32(1)
    begins = (ends - sizes)[sizes > 0]
    early = (begins[:, None] + np.arange(LOOK - 1)[None, :]).ravel()
    h[early[early < len(h)]] = 0  # the hash there has another text's bytes in it
    before, after = largest_before(h, reach), largest_before(h[::-1], reach)[::-1]
    strict = np.nonzero((h > before) & (h > after))[0] + 1
    ends = ends[sizes > 0]
    found = np.union1d(strict, ends)
    gaps = np.diff(found, prepend=0)
    wide = np.nonzero(gaps > 6 * reach)[0]
    if len(wide):
        equal = np.nonzero((h >= before) & (h >= after) & (h > 0))[0] + 1
        more = []
        for k in wide:
            last, stop = int(found[k] - gaps[k]), int(found[k])
            for at in equal[np.searchsorted(equal, last, side="right") : np.searchsorted(equal, stop)].tolist():
                if at - last > reach:
                    more.append(at)
                    last = at
        found = np.union1d(found, np.array(more, dtype=np.int64))
    return data, found


def numbered(df: DataFrame, id_column: str, text_column: str, out: T.StructType, work) -> DataFrame:
    """What `work` makes of (rows, texts, places of the texts): columns of `out`, some rows at a time."""

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, texts in utf8_slices(batch, 1):
                sizes = [len(t) for t in texts]
                places = at + np.cumsum([0, *sizes[:-1]]) + np.arange(len(sizes))
                at += sum(sizes) + len(sizes)
                for columns in work(batch.slice(a, len(texts)), texts, places):
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], out.names)

    return df.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).mapInArrow(run, out)


def longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in names])


def folded(*fields: tuple[np.ndarray, int]) -> np.ndarray:
    """Small numbers and their widths in bits as one number. Larger ones than fit, of chunks of a megabyte, count as the largest."""
    out = np.zeros(1, dtype=np.int64)
    for values, width in fields:
        out = out << width | np.minimum(values, (1 << width) - 1)
    return out


def unpacked(found: DataFrame) -> DataFrame:
    """(key, place, row, size, left, right, word, to_word, more_left, more_right) and all other columns, for `shape` and `words` of `chunks`.

    size has the bytes the key tells of; left and right are the bytes an extension can reach; word and to_word are the numbers of
    words that begin before the chunk and that end with it at the latest, more_left and more_right those an extension can add.
    """
    field = lambda c, low, width: F.shiftright(c, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    word = field("words", 31, 32)
    columns = {"size": field("shape", 40, 20), "left": field("shape", 20, 20), "right": field("shape", 0, 20), "word": word, "to_word": word + field("words", 20, 11) - 1, "more_left": field("words", 10, 10), "more_right": field("words", 0, 10)}
    return found.withColumns(columns).drop("shape", "words")


def chunks(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = 20, words: bool = True) -> DataFrame:
    """(key, place) of each chunk, and with `words` (row, shape, words), which `unpacked` reads. row is the text's own place."""
    names = ["key", "place"] + ["row", "shape", "words"] * words

    def work(batch, texts, places):
        digest = xxhash.xxh3_64_intdigest
        for a, b in slices([len(t) for t in texts], 1 << 16):  # arrays that fit a core's cache
            data, end = cuts(texts[a:b], reach)
            if not len(data):
                continue
            sizes = np.array([len(t) for t in texts[a:b]], dtype=np.int64)
            stop = np.cumsum(sizes)
            begin = np.concatenate([[0], end[:-1]])
            text = np.searchsorted(stop, begin, side="right")
            low, high = (stop - sizes)[text], stop[text]
            told = np.minimum(end + reach, high)
            raw = data.tobytes()
            key = np.array([digest(raw[x:y]) for x, y in zip(begin.tolist(), told.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
            row = places[a:b][text]
            columns = [key, row + begin - low]
            if words:
                space = np.concatenate([[True], SPACE[data], [True]])
                space_at = stop[sizes > 0]
                is_first = np.zeros(len(data) + 1, dtype=bool)
                is_first[:-1] = space[:-2] & ~space[1:-1]
                is_first[(stop - sizes)[sizes > 0]] |= ~space[1:-1][(stop - sizes)[sizes > 0]]
                is_end = np.zeros(len(data) + 1, dtype=bool)
                is_end[1:] = ~space[1:-1] & space[2:]
                is_end[space_at] |= ~space[1:-1][space_at - 1]
                firsts, lasts = np.concatenate([[0], np.cumsum(is_first)]), np.concatenate([[0], np.cumsum(is_end)])  # before a place; the ends up to it are lasts[place + 1]
                before = np.concatenate([[0], begin[:-1]])
                left = np.where(begin > low, np.minimum(begin - before + LOOK + reach, begin - low), 0)
                after = np.concatenate([end[1:], end[-1:]])
                right = np.where(end < high, np.minimum(after + reach, high) - told, 0)
                words_low, ends_low = firsts[low], lasts[low + 1]
                word, to_word = firsts[begin] - words_low, lasts[told + 1] - ends_low
                columns += [row, folded((told - begin, 20), (left, 20), (right, 20)), folded((word, 32), (to_word - word + 1, 11), (firsts[begin] - firsts[begin - left], 10), (lasts[told + right + 1] - lasts[told + 1], 10))]
            yield [np.asarray(c, dtype=np.int64) for c in columns]

    return numbered(df, id_column, text_column, longs(*names), work)


def extensions(df: DataFrame, asked: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(edge, side, at): how far each edge of `asked` (row, edge, key, side, at, reach) can be extended.

    The words beside `at`, up to `reach` bytes before it on side 0 or behind it on side 1, are offered under the key one by one.
    Edges of number -1 only offer.
    """
    numbers = T.StructType([T.StructField("row", T.LongType()), T.StructField("text", T.StringType())])
    docs = numbered(df, id_column, text_column, numbers, lambda batch, _, places: [[places, batch.column(1)]])
    lists = asked.groupBy("row").agg(F.collect_list(F.struct("edge", "key", "side", "at", "reach")).alias("asked"))

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for first, texts in utf8_slices(batch, 1):
                hashes, edges, sides, ats = [], [], [], []
                part = batch.slice(first, len(texts))
                for row, text, some in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), strict=True):
                    for x in some:
                        at, seed, edge = x["at"] - row, (x["key"] ^ x["side"]) & 0xFFFFFFFFFFFFFFFF, x["edge"]
                        if x["side"]:
                            beside = np.frombuffer(text, dtype=np.uint8, count=min(x["reach"] + 1, len(text) - at), offset=at)
                            space = np.append(SPACE[beside], True) if at + len(beside) == len(text) else SPACE[beside]
                            stops = (np.nonzero(space[1:] & ~space[:-1])[0] + 1).tolist()
                            for n in stops:
                                hashes.append(digest(text[at : at + n], seed)), edges.append(edge), sides.append(1), ats.append(x["at"] + n)
                        else:
                            low = at - x["reach"]
                            beside = np.frombuffer(text, dtype=np.uint8, count=at - max(0, low - 1), offset=max(0, low - 1))
                            space = np.append(True, SPACE[beside]) if low <= 0 else SPACE[beside]
                            begins = np.nonzero(space[:-1] & ~space[1:])[0] + (0 if low <= 0 else 1)
                            for n in (at - max(0, low - 1) - begins).tolist():
                                hashes.append(digest(text[at - n : at], seed)), edges.append(edge), sides.append(0), ats.append(x["at"] - n)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(edges, pa.int64()), pa.array(sides, pa.int64()), pa.array(ats, pa.int64())], ["hash", "edge", "side", "at"])

    offered = durable(docs.join(lists, "row").select("row", "text", "asked").mapInArrow(run, longs("hash", "edge", "side", "at")))
    release(df.sparkSession)
    twice = durable(offered.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    return offered.where("edge >= 0").join(twice, "hash").groupBy("edge", "side").agg(F.when(F.col("side") == 0, F.min("at")).otherwise(F.max("at")).alias("at"), F.count(F.lit(1)).alias("words"))


def repeated_passages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = 50, reach: int = 20) -> DataFrame:
    """(id, start, end, n_words, n_chunks, kept): one row for each passage (UTF-8 byte places) of `least_words` or more that also stands elsewhere.

    kept marks passages in which the first place of each of their chunks lies, by order of the input.
    """
    with fixed_splits(df.sparkSession):  # all that reads the input is done within
        return passages_in(df, id_column, text_column, least_words, reach)


def passages_in(df: DataFrame, id_column: str, text_column: str, least_words: int, reach: int) -> DataFrame:
    """The passages, from files whose splits stay the same."""
    found = chunks(df, id_column, text_column, reach, words=False)  # read twice: cheaper than to keep every chunk on disk
    # Written first, so that the join's sides are plain shuffles, of which a hot key's can be split.
    shared = durable(found.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("first")).where("times > 1").drop("times"))
    release(df.sparkSession)
    hits = unpacked(durable(chunks(df, id_column, text_column, reach).join(shared, "key")))
    release(df.sparkSession)
    by_row = Window.partitionBy("row").orderBy("place")
    begins = F.coalesce(F.col("place") > F.lag(F.col("place") + F.col("size")).over(by_row), F.lit(True))
    lined = hits.withColumn("begins", begins).withColumn("previous", F.lag("key").over(by_row)).withColumn("following", F.lead("key").over(by_row)).withColumn("ends", F.coalesce(F.lead("begins").over(by_row), F.lit(True)))
    lined = lined.withColumn("run", F.sum(F.col("begins").cast("int")).over(by_row.rowsBetween(Window.unboundedPreceding, 0)))  # worked out twice: cheaper than to keep it
    to = F.col("place") + F.col("size")
    ends = [F.min_by("key", "place").alias("left_key"), F.max_by("key", "place").alias("right_key"), F.min_by("left", "place").alias("left"), F.max_by("right", "place").alias("right")]
    runs = lined.groupBy("row", "run").agg(F.min("place").alias("start"), F.max(to).alias("stop"), F.min("word").alias("word"), F.max("to_word").alias("to_word"), F.count(F.lit(1)).alias("n_chunks"), F.min("first").alias("first"), *ends, (F.min_by("more_left", "place") + F.max_by("more_right", "place")).alias("more"))
    runs = durable(runs.where(F.col("to_word") - F.col("word") + F.col("more") >= least_words).drop("more"))

    release(df.sparkSession)
    # The runs' edges, and for each other chunk that stands beside the same outermost one, one place that holds both.
    real = runs.select("row", F.col("start").alias("edge"), F.explode(F.array(*(F.struct(F.col(key).alias("key"), F.lit(k).cast("long").alias("side"), F.col(at).alias("at"), F.col(reach).alias("reach")) for k, key, at, reach in ((0, "left_key", "start", "left"), (1, "right_key", "stop", "right"))))).alias("x"))
    real = real.select("row", "edge", "x.*")
    inner = (F.when(~F.col(edge), F.struct("key", F.lit(k).cast("long").alias("side"), F.col(beside).alias("beside"), at.alias("at"), F.col(reach).alias("reach"))) for k, edge, beside, at, reach in ((0, "begins", "previous", F.col("place"), "left"), (1, "ends", "following", to, "right")))
    inner = lined.select("row", F.explode(F.array_compact(F.array(*inner))).alias("x")).select("row", "x.*").join(durable(real.select("key", "side").distinct()), ["key", "side"], "left_semi")
    inner = durable(inner).groupBy("key", "side", "beside").agg(F.min(F.struct("at", "row", "reach")).alias("one")).select("one.row", F.lit(-1).cast("long").alias("edge"), "key", "side", "one.at", "one.reach")
    asked = durable(real.unionByName(inner).where("reach > 0").select("row", "edge", "key", "side", "at", "reach"))
    release(df.sparkSession)
    reached = durable(extensions(df, asked, id_column, text_column))
    release(df.sparkSession)
    left, right = (reached.where(F.col("side") == k).select(F.col("edge").alias(f"_edge{k}"), F.col("at").alias(f"_at{k}"), F.col("words").alias(f"_words{k}")) for k in (0, 1))
    whole = runs.join(left, F.col("start") == F.col("_edge0"), "left").join(right, F.col("start") == F.col("_edge1"), "left")
    n_words = F.col("to_word") - F.col("word") + F.coalesce("_words0", F.lit(0)) + F.coalesce("_words1", F.lit(0))
    passages = whole.select("row", F.coalesce("_at0", "start").alias("start"), F.coalesce("_at1", "stop").alias("stop"), n_words.alias("n_words"), "n_chunks", (F.col("first") >= F.col("start")).alias("kept")).where(F.col("n_words") >= least_words)
    numbers = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type(df, id_column))])
    ids = durable(numbered(df, id_column, text_column, numbers, lambda batch, _, places: [[places, batch.column(0)]]))
    return passages.join(ids, "row").select(F.col("id").alias(id_column), (F.col("start") - F.col("row")).alias("start"), (F.col("stop") - F.col("row")).alias("end"), "n_words", "n_chunks", "kept")


def drop_repeats(df: DataFrame, passages: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input with each text's passages that aren't kept cut out of it; ids have to be those of single rows."""
    cut = passages.where("not kept").groupBy(F.col(id_column).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    joined = df.join(cut, F.col(id_column) == F.col("_id"), "left")

    @F.pandas_udf(T.StringType())
    def without(texts, spans):
        import pandas as pd

        out = []
        for text, some in zip(texts, spans, strict=True):
            if some is not None and text is not None:
                data, last, parts = text.encode(), 0, []
                for s in some:
                    parts.append(data[last : max(last, s["start"])])
                    last = max(last, s["end"])
                text = b"".join([*parts, data[last:]]).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    return joined.withColumn(text_column, F.when(F.col("_cut").isNull(), F.col(text_column)).otherwise(without(text_column, "_cut"))).select(*df.columns)
