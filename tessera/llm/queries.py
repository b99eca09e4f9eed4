"""The registered queries of this package: thin uses of its operators on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.decontamination import find_leaks
from tessera.llm.embeddings import near_vectors
from tessera.llm.licenses import license_scan
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import score_quality
from tessera.llm.secrets import BASE_RULES, MORE_RULES, secret_scan
from tessera.llm.substrings import repeated_passages
from tessera.llm.tokens import token_counts
from tessera.llm.urls import url_filter

VOCABULARY = "word_bpe_49k.json"


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), capacity=4096, end_id=1)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=2048)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    n = F.size("phrase_starts")
    base = F.array_sort(F.array_distinct("phrase_labels"))
    labels = F.array_sort(F.array_distinct(F.concat("phrase_labels", F.col("spans.label"))))
    return found.select("doc_id", "n_words", n.cast("long").alias("n_base"), F.array_min("phrase_starts").alias("first_word"), F.array_max("phrase_starts").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")


#: Fixed values: (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


OP6_SQL = """
with parts as (
  select page_id, case when position('://' in url) > 0 then regexp_extract(substr(url, position('://' in url) + 3), '^([^?#]*)', 1, 's') else '' end as rest from pages),
split as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(substr(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1), '') as path from parts),
rules(verdict, rhost, rpath) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hits as (
  select page_id, rhost || rpath as rule, verdict, row_number() over (partition by page_id order by length(rhost) desc, length(rpath) desc) as k
  from split join rules on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath))
select s.page_id, s.host, s.path, h.rule, coalesce(h.verdict, 'allow') as verdict from split s left join hits h on s.page_id = h.page_id and h.k = 1
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("secret_spans", lambda s: s["ord"] < len(BASE_RULES))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["ord"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP4_SQL = """
with recursive good as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
named as (select a, min(b) as lowest from reach group by a),
counted as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(c.n, 0) as n_links, least(e.vec_id, coalesce(n.lowest, e.vec_id)) as component_id, e.vec_id = least(e.vec_id, coalesce(n.lowest, e.vec_id)) as kept
from embeddings e left join counted c on e.vec_id = c.a left join named n on e.vec_id = n.a
"""

OP8_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
named as (select a, min(b) as lowest from reach group by a)
select d.doc_id, coalesce(z.n, 0) as n_shingles, least(d.doc_id, coalesce(m.lowest, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(m.lowest, d.doc_id)) as kept
from documents d left join sizes z on d.doc_id = z.doc_id left join named m on d.doc_id = m.a
"""


def secrets_sql() -> str:
    """The pieces between matches and the matches themselves, one behind the other, give the places."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = "\n  union all ".join(
        f"select r, {k} as ord, {quoted(x.kind)} as kind, {x.least} as least, regexp_split_to_array(t, {quoted(x.pattern)}) as s, regexp_extract_all(t, {quoted(x.pattern)}, 0) as m, regexp_extract_all(t, {quoted(x.pattern)}, {x.measured}) as g from docs"
        for k, x in enumerate(BASE_RULES + MORE_RULES)
    )
    counts = ", ".join(f"count(*) filter (ord = {k}) as n_{x.kind}" for k, x in enumerate(BASE_RULES))
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
matched as (
  {rules}),
single as (select r, ord, kind, least, unnest(range(1, len(m) + 1)) as i, unnest(list_transform(s[1:len(m)], lambda x: length(x))) as gap, unnest(list_transform(m, lambda x: length(x))) as w, unnest(list_transform(g, lambda x: length(x))) as p from matched),
placed as (select *, sum(gap + w) over (partition by r, ord order by i) as e from single),
spans as (select r, ord, (e - w)::bigint as b, kind || ':' || (e - w)::bigint || ':' || e::bigint as span from placed where p >= least),
found as (
  select r, {counts}, string_agg(span, ',' order by b, ord) filter (ord < {len(BASE_RULES)}) as base, string_agg(span, ',' order by b, ord) as spans from spans group by r)
select doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) as n_{x.kind}" for x in BASE_RULES)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join found on docs.r = found.r
"""


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), least_words=48)  # of 50 words, the first and the last may be part of longer ones


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_embeddings": OP4_SQL, "op6_url_filter": OP6_SQL, "op7_secrets": secrets_sql(), "op8_minhash": OP8_SQL}
