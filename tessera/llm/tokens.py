"""Token ids and counts of whole texts as a tokenizer file gives them.

Operator: ``token_counts``. Batch encoding in Arrow functions that return lengths only; batches are
balanced by bytes and long texts are split at safe boundaries, where no token can span.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows give
repeated results; texts of any length are counted whole; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_type, slices, text_of

#: Segments that a memo remembers in each of its two generations, so that its memory is bounded.
MEMO = 300_000


class Memo(dict):
    """Values of segments, worked out where they aren't known. Of two generations, the older goes when the younger is full."""

    def __init__(self, work):
        super().__init__()
        self.work = work
        self.old: dict = {}

    def __missing__(self, segment: str):
        value = self.old.get(segment)
        if value is None:
            value = self.work(segment)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[segment] = value
        return value


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100, each of which is put in lower case by itself."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Encoder for BPE files whose pre-tokenizer drops white space, lower-cases and splits letters from marks.

    No token of such a file spans a space or line end, nor a letter or digit and a mark after it, so
    a text's ids are those of its segments put together. Segments repeat, so their ids or counts are
    remembered. Special strings of the file hold no white space and none of the marks split at, so they
    are found as in the whole text.
    """

    #: A mark after a letter or digit begins a part. The characters of special strings aren't among the marks.
    PARTS = re.compile(r'(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,!?;:#%&$*()"=/-])')
    #: A word of letters that keep to themselves in normal form, and perhaps marks.
    LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#%&$*()=/-]*)")
    #: What the byte-level step makes of bytes beyond ASCII.
    BYTES = {b: chr(290 + b - 128) for b in range(128, 161)} | {173: chr(323)}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.packed = [pack("<I", k) for k in range(self.tokenizer.get_vocab_size())]
        self.ids = Memo(self.ids_of)
        self.counts = Memo(self.count_of)

    def word(self, letters: str) -> list:
        """The tokens of lower-case letters, which the file's model takes as one pre-token."""
        return self.tokenize(letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.BYTES))

    def library(self, segment: str) -> list[int]:
        """The ids of any other segment, part by part."""
        return [k for p in self.PARTS.split(segment) for k in self.tokenizer.encode(p, add_special_tokens=False).ids]

    def ids_of(self, segment: str) -> bytes:
        packed = self.packed
        if segment.isascii() and segment.isalpha() and segment.islower():
            return b"".join([packed[t.id] for t in self.tokenize(segment)])
        plain = self.LATIN.fullmatch(segment)
        if plain is None:
            return b"".join([packed[k] for k in self.library(segment)])
        letters, mark = plain.groups()
        lower = letters.lower()
        if mark:
            return self.ids[lower] + self.ids_of_mark(mark)
        if lower != segment:
            return self.ids[lower]
        return b"".join([packed[t.id] for t in self.word(lower)])

    @lru_cache(maxsize=4096)  # noqa: B019
    def ids_of_mark(self, mark: str) -> bytes:
        return b"".join([self.packed[k] for k in self.library(mark)])

    def count_of(self, segment: str) -> int:
        if segment.isascii() and segment.isalpha() and segment.islower():
            return len(self.tokenize(segment))
        plain = self.LATIN.fullmatch(segment)
        if plain is None:
            return len(self.library(segment))
        letters, mark = plain.groups()
        lower = letters.lower()
        if mark:
            return self.counts[lower] + len(self.ids_of_mark(mark)) // 4
        if lower != segment:
            return self.counts[lower]
        return len(self.word(lower))

    def split(self, text: str, size: int = 1 << 20):
        """The text's segments, in lists of about `size` characters, in lower case where that can't make a special string."""
        begin = 0
        while begin < len(text):
            end = begin + size
            if end < len(text):
                end = text.find(" ", end)
                end = len(text) if end < 0 else end
            part = text[begin:end].replace("\n", " ")
            if "<|" not in part and (part.isascii() or is_latin(part)):
                part = part.lower()
            yield part.split(" ")
            begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers."""
        known = self.ids.__getitem__
        return [b"".join([b"".join(map(known, s)) for s in self.split(t)]) for t in texts]

    def count(self, texts: list[str]) -> list[int]:
        known = self.counts.__getitem__
        return [sum(sum(map(known, s)) for s in self.split(t)) for t in texts]


class FileEncoder:
    """Encoder for every other .json file: whole texts in one batch."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class PieceEncoder:
    """Encoder for sentencepiece's .model files: whole texts in one batch."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, dtype="<u4").tobytes() for x in self.processor.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.processor.encode(texts, num_threads=1)]


def splits_at_spaces(path: str) -> bool:
    """Whether the file is of the kind WordEncoder needs."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = str(spec.get("normalizer"))
    cut = spec.get("pre_tokenizer") or {}
    first = (cut.get("pretokenizers") or [cut])[0]
    special = all(not re.search(r"\s", a["content"]) and not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not a["normalized"] for a in spec.get("added_tokens", []))
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return special and "Lowercase" in normal and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern") == {"Regex": pattern}


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder | FileEncoder | PieceEncoder:
    """A process's encoder for a file; workers that serve many tasks keep it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path.endswith(".model"):
        return PieceEncoder(path)
    return WordEncoder(path) if splits_at_spaces(path) else FileEncoder(path)


def token_counts(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048, batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    `tokenizer` is the path of a .json or .model file that every executor has. Counts are those of
    the whole text without added tokens; over_limit tells whether they exceed `limit`.
    """
    out = T.StructType([T.StructField(id_column, id_type(df, id_column)), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        count = encoder(tokenizer).count
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            counts: list[int] = []
            for a, b in slices(sizes, batch_bytes):  # texts become Python's a slice at a time
                counts += count(batch.column(1).slice(a, b - a).to_pylist())
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([x > limit for x in counts], pa.bool_())], [id_column, "n_bytes", "n_tokens", "over_limit"])

    text = text_of(text_column)
    return df.select(F.col(id_column), text.alias("text"), F.octet_length(text).cast("long").alias("size")).mapInArrow(run, out)
