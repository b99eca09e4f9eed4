"""Benchmark decontamination by pigeonhole edit matching over words.

Operator: ``find_leaks``. An item of n words may differ from a passage by k word edits. Split into k + 1
pieces, at least one of them stands unchanged in any such passage. Pieces are found by rolling hashes
of the text's known words; around each hit the whole item is compared by Myers' bit-parallel edit
distance, the passage's ends free.

k is `budget` times n, rounded; pieces are as short as k + 1 of them need. Items of fewer than
`shortest` words are matched exactly, k = 0.

The items are a query set. They are cut into blocks of at most `block_words` words, each broadcast
and matched against all documents in turn, so no broadcast grows beyond that.

Words: lower-case text without ASCII marks, split at white space.

Edge cases: null or empty texts and items match nothing; repeated documents and items are reported each;
null ids pass through; of passages equally close the first counts; texts of any length are read whole; empty tables
give an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_type, slices, text_of

#: ASCII other than letters and digits separates words.
TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(TO_SPACE).split()


def best_distance(pattern: list[int], window: list[int]) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any stretch of the window, and where that stretch ends. Myers, one integer a column."""
    m = len(pattern)
    full = (1 << m) - 1
    top = 1 << (m - 1)
    at: dict[int, int] = {}
    for k, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << k
    plus, minus, score = full, 0, m
    best, where = m, -1
    for k, w in enumerate(window):
        eq = at.get(w, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~((eq | minus) | up))
        minus = up & (eq | minus)
        if score < best:
            best, where = score, k
    return best, where


class Matcher:
    """One block of items, ready to be looked for. Kept for a task."""

    def __init__(self, items: list[tuple[object, str]], budget: float, shortest: int):
        self.items = []
        for key, text in items:
            words = words_of(text or "")
            if words:
                self.items.append((key, words, min(round(budget * len(words)), len(words) - 1) if len(words) >= shortest else 0))
        self.ids: dict[bytes, int] = {}
        for _, words, _ in self.items:
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
        self.coded = [[self.ids[w] for w in words] for _, words, _ in self.items]
        self.pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}  # length: hash: (item, place)
        for k, (_, words, edits) in enumerate(self.items):
            cuts = [len(words) * j // (edits + 1) for j in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                h = int(self.hashes(np.array(self.coded[k][a:b], dtype=np.uint64), b - a)[0])
                self.pieces.setdefault(b - a, {}).setdefault(h, []).append((k, a))
        self.filters = {}
        for n, found in self.pieces.items():
            bits = np.zeros(1 << 18, dtype=bool)
            bits[[h >> 46 for h in found]] = True
            self.filters[n] = bits

        self.words_of_item = [frozenset(ids) for ids in self.coded]

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """Of each run of n ids."""
        with np.errstate(over="ignore"):
            out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
            for k in range(n):
                out = out * BASE + ids[k : len(ids) - n + 1 + k]
            return out ^ (out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)

    def numbers(self, text: str, block: int = 1 << 20) -> np.ndarray:
        """The text's words as numbers, 0 for those of no item; long texts are read in blocks that end at a space."""
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + block)
            end = len(text) if end < 0 else end
            words = words_of(text[at:end])
            out.append(np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.uint64, count=len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, last word) of the best passage for each item found in each text."""
        if not self.items:
            return []
        numbers = [self.numbers(t) for t in texts]
        sizes = np.array([len(x) for x in numbers], dtype=np.int64)
        begin = np.cumsum(sizes + 1) - sizes  # an unknown word parts the texts
        ids = np.zeros(int((sizes + 1).sum()) + 1, dtype=np.uint64)
        for x, at in zip(numbers, begin.tolist(), strict=True):
            ids[at : at + len(x)] = x
        del numbers
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        windows: dict[tuple[int, int], set[int]] = {}
        for n, found in self.pieces.items():
            at = np.nonzero(unknown[n:] == unknown[:-n])[0]  # only runs of known words can be a piece
            if not len(at):
                continue
            h = self.hashes(ids, n)[at]
            hit = np.nonzero(self.filters[n][(h >> np.uint64(46)).astype(np.int64)])[0]
            texts_of = np.searchsorted(begin, at[hit], side="right") - 1
            for p, x, k in zip(at[hit].tolist(), h[hit].tolist(), texts_of.tolist(), strict=True):
                for item, place in found.get(x, ()):
                    windows.setdefault((k, item), set()).add(p - place)
        out = []
        for (k, item), begins in windows.items():
            pattern, known, edits = self.coded[item], self.words_of_item[item], self.items[item][2]
            low_end, high_end = int(begin[k]), int(begin[k] + sizes[k])
            best = None
            for at in sorted(begins):
                low, high = max(low_end, at - edits), min(high_end, at + len(pattern) + edits)
                window = ids[low:high].tolist()
                if sum(map(known.__contains__, window)) < len(pattern) - edits:  # each word that isn't edited away is there
                    continue
                distance, end = best_distance(pattern, window)
                if distance <= edits and (best is None or distance < best[2]):
                    last = low + end - low_end
                    best = (k, item, distance, max(0, last - len(pattern) + 1), last)
            if best:
                out.append(best)
        return out


def find_leaks(df: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", budget: float = 0.2, shortest: int = 8, block_words: int = 2_000_000) -> DataFrame:
    """(id, item, distance, edits_allowed, item_words, first_word, last_word): one row for each document and item found in it."""
    context = df.sparkSession.sparkContext
    blocks: list[list] = [[]]
    size = 0
    for row in items.select(F.col(item_column), F.col(item_text)).where(F.length(item_text) > 0).toLocalIterator():
        n = len(row[1]) // 2
        if blocks[-1] and size + n > block_words:
            blocks.append([])
            size = 0
        blocks[-1].append((row[0], row[1]))
        size += n
    out = T.StructType([T.StructField(id_column, id_type(df, id_column)), T.StructField(item_column, id_type(items, item_column))] + [T.StructField(n, T.LongType()) for n in ("distance", "edits_allowed", "item_words", "first_word", "last_word")])

    def matching(block: list):
        sent = context.broadcast(block)

        def run(batches):
            matcher = Matcher(sent.value, budget, shortest)
            for batch in batches:
                rows = []
                for a, b in slices(pc.binary_length(batch.column(1)).to_pylist(), 1 << 20):
                    for k, item, distance, first, last in matcher.search(batch.column(1).slice(a, b - a).to_pylist()):
                        key, words, edits = matcher.items[item]
                        rows.append((a + k, key, distance, edits, len(words), first, last))
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1]), *(pa.array(x, pa.int64()) for x in c[2:])], out.names)

        return df.select(F.col(id_column), text_of(text_column).alias("text")).mapInArrow(run, out)

    return reduce(DataFrame.unionAll, [matching(b) for b in blocks])


def drop_leaks(df: DataFrame, leaks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents in which no item was found, by `id_column`: to decide on each row, give both the key of a row. Rows with a null key are kept."""
    found = leaks.select(F.col(id_column).alias("_leaked")).distinct()
    return df.join(found, F.col(id_column) == F.col("_leaked"), "left_anti")
