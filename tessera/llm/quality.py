"""Quality classifier: random Fourier features, partition-summed ridge, isotonic calibration.

Operators: ``document_statistics``, ``fit_quality``, ``score_quality``. Random Fourier features approximate a
Gaussian kernel over statistics of the text alone. Each partition sums its share of the normal
equations; the sums are added up by cell before they reach the driver, which gets as many numbers
as `FOLDS` times the square of the features, whatever the input's size. Raw ridge scores are calibrated by
isotonic regression over a fixed grid of scores that rows get from weights fitted without their fold.

Edge cases: null and empty texts are scored by their statistics (all zero); labels that are null don't
count, several labels of one document count each; without labels of both kinds every score is the share of
good labels, or 0.5 without any; repeated rows give repeated results, and texts of equal statistics equal scores;
texts of any length are read whole; a null id is never held out; empty tables give empty results; other columns, whatever their
names, pass through if asked for by `others`.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import durable, text_of, utf8_slices

FEATURES = 192
SEED = 20260101
GRID = 1024
FOLDS = 4
MARKS = [np.frombuffer(s, dtype=np.uint8) for s in (b".", b",", b"|", b"!?", b"#$%&*@^~", b"<>{}[]\\/=_`", b";:'\"()-+")]
NAMES = ["length", "words", "word_length", "upper", "lower", "digits", "space", "lines", "beyond_ascii", *(f"marks_{k}" for k in range(len(MARKS))), "entropy", "distinct", "most_common", "second_common", "repeated_lines", "adjacent_repeats", "one_letter"]


def statistics(data: bytes) -> list[float]:
    n = len(data)
    if not n:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    m = max(1, len(words))
    seen = Counter(words)
    top = sorted(seen.values(), reverse=True)[:2] + [0, 0] if len(seen) < 50 else [c for _, c in seen.most_common(2)]
    share = count[count > 0] / n
    lines = data.split(b"\n")
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(np.log1p(n / m)), count[65:91].sum() / n, count[97:123].sum() / n, count[48:58].sum() / n, count[32] / n, float(np.log1p(len(lines) * 100 / m)), count[128:].sum() / n,
        *(float(np.sqrt(count[k].sum() / n)) for k in MARKS),
        float(-(share * np.log(share)).sum()), float(np.log1p(len(seen)) / np.log1p(m)), top[0] / m, top[1] / m, 1 - len(set(lines)) / len(lines), again / m, sum(c for w, c in seen.items() if len(w) == 1) / m,
    ]


def document_statistics(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns of `others`, features) for every row."""
    taken = [id_column, *others]
    out = T.StructType([*(df.schema[c] for c in taken), T.StructField("features", T.ArrayType(T.DoubleType()))])
    n = len(taken)

    def run(batches):
        for batch in batches:
            for a, texts in utf8_slices(batch, n):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, len(texts)) for k in range(n)), pa.array([statistics(x) for x in texts], pa.list_(pa.float64()))], out.names)

    return df.select(*taken, text_of(text_column).alias("_text")).mapInArrow(run, out)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        rng = np.random.default_rng(SEED)
        d = x.shape[1]
        w = rng.normal(size=(d, FEATURES)) / np.sqrt(2.0 * d)
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ w + b
        return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(NAMES)))


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest non-decreasing sequence, by pooling neighbours that are out of order."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def fit_quality(labelled: DataFrame, ridge: float = 1e-3) -> Model:
    """A model from rows of (features, good, n): n labels of which `good` are 1. Uses every row."""
    d = len(NAMES)
    stats = labelled.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), *(f(F.col("features")[k]).alias(f"{s}{k}") for k in range(d) for f, s in ((F.avg, "m"), (F.stddev_pop, "s")))).first()
    n, good = stats.n or 0, stats.good or 0
    if n == 0 or good == 0 or good == n:
        share = good / n if n else 0.5
        return Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([share, share]))
    scale = np.array([stats[f"s{k}"] for k in range(d)])
    model = Model(np.array([stats[f"m{k}"] for k in range(d)]), np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), np.zeros(2), np.zeros(2))
    width = FEATURES + 1
    upper = np.triu_indices(width)
    size = len(upper[0]) + width
    folded = labelled.select("features", F.col("good").cast("double"), F.col("n").cast("double"), F.pmod(F.xxhash64("features"), F.lit(FOLDS)).alias("fold"))

    def sums(batches):
        found = np.zeros((FOLDS, size))
        for batch in batches:
            z = model.expand(matrix(batch, 0))
            y, w, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for k in np.unique(fold):
                at = fold == k
                found[k] += np.concatenate([((z[at] * w[at, None]).T @ z[at])[upper], z[at].T @ y[at]])
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(found.size)), pa.array(found.ravel())], ["cell", "value"])

    cells = np.zeros(FOLDS * size)
    for row in folded.mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toLocalIterator():
        cells[row.cell] = row.value
    cells = cells.reshape(FOLDS, size)

    def solved(total: np.ndarray) -> np.ndarray:
        gram = np.zeros((width, width))
        gram[upper] = total[: len(upper[0])]
        gram = gram + np.triu(gram, 1).T
        rows = gram[-1, -1]  # the constant's square, summed up
        return np.linalg.solve(gram + ridge * max(rows, 100) / FEATURES * np.eye(width), total[len(upper[0]) :])

    model.weights = solved(cells.sum(axis=0))
    without = np.array([solved(cells.sum(axis=0) - c) for c in cells])  # rows are calibrated by weights that haven't seen them

    def raw(batches):
        for batch in batches:
            fold = batch.column(3).to_numpy(zero_copy_only=False)
            scores = (model.expand(matrix(batch, 0)) * without[fold]).sum(axis=1)
            k = np.clip(np.floor((scores + 0.5) / 2 * GRID), 0, GRID - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column(1), batch.column(2)], ["bin", "good", "n"])

    bins = folded.mapInArrow(raw, "bin long, good double, n double").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).orderBy("bin").collect()  # GRID rows at most
    model.knots = np.array([(r.bin + 0.5) / GRID * 2 - 0.5 for r in bins])
    flat = isotonic(np.array([r.good / r.n for r in bins]), np.array([r.n for r in bins]))
    # A small slope keeps the order of raw scores within a pooled stretch.
    model.values = np.clip(0.99 * flat + 0.01 * np.clip((model.knots + 0.5) / 2, 0, 1), 0, 1)
    return model


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def score_quality(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", others: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns of `others`, held_out, score) for every row; learnt from the labels of rows that aren't held out."""
    features = durable(document_statistics(df, id_column, text_column, others).withColumn("held_out", held_out(id_column)))
    counted = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("_labelled")).agg(F.sum(label_column).alias("good"), F.count(F.lit(1)).alias("n"))
    labelled = features.where("not held_out").select(F.col(id_column).alias("_id"), "features").join(counted, F.col("_id") == F.col("_labelled"))
    model = fit_quality(durable(labelled.select("features", "good", "n")))
    taken = [id_column, *others, "held_out"]
    out = T.StructType([*(features.schema[c] for c in taken), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(taken))), pa.array(model.score(matrix(batch, len(taken))))], out.names)

    return features.select(*taken, "features").mapInArrow(run, out)
