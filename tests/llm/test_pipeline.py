"""Stages of corpus_pipeline and its run against brute-force versions on small rows, edge cases included."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.decontamination import words_of
from tessera.llm.quality import score_quality
from tessera.llm.secrets import BASE_RULES, MORE_RULES

ROW = "doc_id long, text string, lang string, source string, n_chars long, extra string"
SECRET = "AKIA" + "ABCDEFGHIJKLMNOP"


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(n)) + "."


def junk(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("ABC#$%") for _ in range(6)) + "###" for _ in range(n))


ITEM = prose(1, 30)


@pytest.fixture(scope="module")
def rows():
    base = prose(2, 120)
    near = base.split()
    near[50] = "changed"
    texts = [(k, prose(100 + k)) for k in range(60)] + [(100 + k, junk(k)) for k in range(30)]
    texts += [(200, base), (201, base), (202, " ".join(near)), (203, base.upper()), (None, base), (200, prose(3)), (None, prose(4)), (5, prose(105)), (5, prose(105))]
    texts += [(300, "x " + ITEM), (None, ITEM + " y"), (301, ITEM.replace(ITEM.split()[7], "zzz")), (300, prose(5))]
    texts += [(400, f"{prose(6)} key {SECRET} and token = abcdefghijklmnop1 end"), (401, prose(7, 6000)), (402, None), (403, ""), (None, None), (None, "")]
    return [(k, t, "en", "s", None if t is None else len(t), "more") for k, t in texts]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, ROW).repartition(3).write.parquet(str(folder / "documents.parquet"))
    labels = [(k, 1) for k in range(60)] + [(100 + k, 0) for k in range(30)] + [(200, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(7, ITEM), (8, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))


def rejected(spark, rows, sf_dir):
    """Texts that the model of score_quality rejects: one score a text, whatever its row."""
    df = spark.createDataFrame([(k, t) for k, t, *_ in rows], "doc_id long, text string")
    scored = score_quality(df, spark.read.parquet(f"{sf_dir}/labels.parquet"), others=("text",)).collect()
    return {r.text for r in scored if r.score < corpus_pipeline.LEAST_SCORE}


def by_quality(spark, rows, sf_dir):
    bad = rejected(spark, rows, sf_dir)
    assert {t for k, t, *_ in rows if k is not None and 100 <= k < 130} <= bad and not bad & {t for k, t, *_ in rows if k is not None and k < 60}
    return [r for r in rows if r[1] not in bad]


def groups(rows, size=5, percent=80):
    """Lists of row numbers that near copies connect; rows without words are left out."""
    sets = []
    for r in rows:
        w = re.split("[\x20\x09-\x0d]+", (r[1] or "").lower().strip("\x20\x09\x0a\x0b\x0c\x0d"))
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root = [root[j] if x == root[i] else x for x in root]
    out = {}
    for k, x in enumerate(root):
        if sets[k]:
            out.setdefault(x, []).append(k)
    return list(out.values())


def leaked(row):
    words, item = words_of(row[1] or ""), words_of(ITEM)
    line = [0] * (len(words) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(words):
            new.append(min(line[j] + (c != d), line[j + 1] + 1, new[j] + 1))
        line = new
    return min(line) <= round(0.2 * len(item))


def redacted(row):
    text = row[1]
    spans = sorted((m.start(), m.end()) for rule in BASE_RULES + MORE_RULES for m in re.finditer(rule.pattern, text or "", re.A) if len(m[rule.measured]) >= rule.least)
    if not spans:
        return row
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    out += text[at:]
    return (row[0], out, *row[2:4], len(out), *row[5:])


def check_packing(got, rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows]
    want = [(k, n, at, len(x[at : at + 4096]), zlib.crc32(np.array(x[at : at + 4096], dtype="<u4").tobytes())) for k, x in ids for n, at in enumerate(range(0, len(x), 4096))]
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in places.values():
        assert [a for a, _ in sorted(some)] == np.cumsum([0, *(n for _, n in sorted(some))])[:-1].tolist() and sum(n for _, n in some) <= 4096


def test_quality(spark, rows, sf_dir):
    same(corpus_pipeline.quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect(), by_quality(spark, rows, sf_dir))


def test_near_dedup_keeps_one_row_of_each_group(spark, rows, sf_dir):
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()]
    found = groups(rows)
    assert sorted(len(g) for g in found)[-2:] >= [3, 5]
    for g in found:
        some = [rows[k] for k in g]
        assert sum(got.count(r) for r in set(some)) == 1
    assert sum(got.count(r) for r in {r for r in rows if not (r[1] or "")}) == sum(not (r[1] or "") for r in rows)
    assert len(got) == len(found) + sum(not (r[1] or "") for r in rows)


def test_decontaminate(spark, rows, sf_dir):
    got = corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    kept = [r for r in rows if not leaked(r)]
    assert len(kept) == len(rows) - 3
    same(got.collect(), kept)
    same(corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, ROW), sf_dir).collect(), kept)  # not from files


def test_secrets(spark, rows, sf_dir):
    got = corpus_pipeline.secrets(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert got.columns == [c.split()[0] for c in ROW.split(", ")]
    want = [redacted(r) for r in rows]
    assert sum(a != b for a, b in zip(rows, want, strict=True)) == 1
    same(got.collect(), want)
    two = spark.createDataFrame([(1, f"a {SECRET} b")], "doc_id long, text string")
    same(corpus_pipeline.secrets(spark, two, sf_dir).collect(), [(1, "a [secret] b")])


def test_packing(spark, rows, sf_dir):
    check_packing(corpus_pipeline.packing(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect(), rows)


def test_stages_of_an_empty_table(spark, sf_dir):
    none = spark.createDataFrame([], ROW)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).collect() == []


def test_run(spark, rows, sf_dir):
    """The whole run packs what the brute-force stages leave, for either choice of a row from a group of copies."""
    rest = by_quality(spark, rows, sf_dir)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    empty = [r for r in rest if not (r[1] or "")]
    left = [rest[g[0]] for g in groups(rest)]
    clean = [r for r in left if not leaked(r)]
    assert sum(r.piece == 0 for r in got) == len(clean) + len(empty)
    alone = [redacted(rest[g[0]]) for g in groups(rest) if len(g) == 1 and not leaked(rest[g[0]])]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in alone:
        ids = [*t.encode(r[1], add_special_tokens=False).ids, 1]
        assert any(g.doc_id == r[0] and g.ids_crc32 == zlib.crc32(np.array(ids[:4096], dtype="<u4").tobytes()) for g in got)
