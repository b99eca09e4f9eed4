"""A corpus pipeline over `documents`: reject, deduplicate, decontaminate, redact and pack.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which run() writes as Parquet to the shared folder and rereads as the next stage's docs.

Every stage works on all rows it is given and decides on each row, whatever its id: ids may be null or
repeated. Null texts count as empty ones. All but the last return the columns they get, others than those of `documents`
too; none of them may begin with an underscore. An empty table passes through.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, remove, shared_folder, table, with_row_key
from tessera.llm.decontamination import drop_leaks, find_leaks
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import score_quality
from tessera.llm.secrets import redact, secret_scan

#: Documents below this calibrated share of good labels are rejected.
LEAST_SCORE = 0.5
ROW = "_row"


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key isn't in `dropped`, without the key."""
    return rows.join(dropped.select(ROW).distinct(), ROW, "left_anti").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows whose text scores below LEAST_SCORE, empty ones too if they do. Without labels of both kinds all rows have one score."""
    rows = with_row_key(docs, ROW)
    scored = score_quality(rows, table(spark, sf_dir, "labels"), others=(ROW,))
    return without(rows, scored.where(F.col("score") < LEAST_SCORE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: five-word shingles, similarity of 0.8. Texts without words are in no group and stay."""
    rows = with_row_key(docs, ROW)
    return without(rows, near_duplicates(rows, size=5, percent=80, id_column=ROW).where("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item, within its budget of edits. An empty benchmark drops nothing."""
    rows = with_row_key(docs, ROW)
    leaks = durable(find_leaks(rows, table(spark, sf_dir, "benchmark"), id_column=ROW))
    return drop_leaks(rows, leaks, id_column=ROW).drop(ROW)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; each secret in a text is replaced by a mark, and n_chars, if there, is that of the new text."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    spans = F.col("secret_spans")
    changed = {"text": F.when(F.size(spans) > 0, redact(F.col("text"), spans)).otherwise(F.col("text"))}
    if "n_chars" in others:
        changed["n_chars"] = F.when(F.size(spans) > 0, F.length(changed["text"]).cast("long")).otherwise(F.col("n_chars"))
    return secret_scan(docs, keep=others).select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row's tokens and an end id into sequences; a null or empty text is the end id alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: The stages' models and hashes aren't expressible in SQL; tests hold each stage and the run against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes when the next one is written."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
