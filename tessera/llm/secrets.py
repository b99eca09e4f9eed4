"""Secret scans with a trigram inverted index, in DataFrame functions only.

Operator: ``secret_scan``. Each rule's regular expression is parsed into a Boolean query over the
trigrams that every match must hold. The trigrams which some rule asks for are indexed: postings
(trigram, text) meet the queries by trigram, and for each way to satisfy a rule the texts that stand in the postings of all its
trigrams are its candidates; only they are verified with the rule's expression. Rules without mandatory trigrams scan every
document. The index names a text by its hash, so rows of the same text are looked up together, whatever their ids.

Spans are in code points, end exclusive; matches of a rule are leftmost and don't overlap. A match whose
`measured` group is shorter than `least` is dropped after matching.

Edge cases: a null or empty text has no spans; ids may be null or repeated, each row is verified on its own text; an
empty table gives an empty result; spans that begin at one place come in the rules' order; texts of any length are read
whole; other columns, whatever their names, pass through if asked for by `keep`.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # of what Python and Java read alike; (?i) at the start for either case
    measured: int = 0  # the group whose length counts
    least: int = 1


# Fixed values.
BASE_RULES = [
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]+", 0, 16),
]
MORE_RULES = [
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", "xox[abprs]-[0-9A-Za-z-]+", 0, 15),
]

Query = frozenset  # alternatives, each a frozenset of trigrams that must all be there; {{}} asks nothing
NOTHING_ASKED: Query = frozenset([frozenset()])
MANY = 24


def _both(a: Query, b: Query) -> Query:
    out = frozenset(x | y for x in a for y in b)
    return out if len(out) <= MANY else min(a, b, key=lambda q: (q == NOTHING_ASKED, len(q)))


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def _strings(nodes) -> tuple[list[str] | None, Query]:
    """All strings that the nodes can match if few, else None, and what any match must hold."""
    run = [""]
    is_open = False
    asked = NOTHING_ASKED
    for op, arg in nodes:
        some: list[str] | None = None
        inner = NOTHING_ASKED
        if op is C.LITERAL:
            some = [chr(arg).lower()]
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 6:
            some = sorted({chr(a).lower() for _, a in arg})
        elif op is C.SUBPATTERN:
            some, inner = _strings(arg[3])
        elif op is C.BRANCH:
            ways = [_strings(b) for b in arg[1]]
            some = [s for w, _ in ways for s in w] if all(w is not None for w, _ in ways) else None
            inner = frozenset().union(*(q if w is None else _query_of(w) for w, q in ways))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            one, inner = _strings(body)
            if one is not None and low == high and low * max(map(len, one), default=0) <= 16 and len(one) ** low <= MANY:
                some = [""]
                for _ in range(low):
                    some = [a + b for a in some for b in one]
            elif one is not None and (low, high) == (0, 1):
                some = ["", *one]
            inner = inner if low else NOTHING_ASKED
        if some is not None and len(run) * len(some) <= MANY:
            run = [a + b for a in run for b in some]
            continue
        asked = _both(_both(asked, _query_of(run)), _query_of(some) if some is not None else inner)
        run, is_open = [""], True
    return (None, _both(asked, _query_of(run))) if is_open else (run, _query_of(run))


def _query_of(strings: list[str]) -> Query:
    return frozenset(_trigrams(s) for s in strings) if strings else NOTHING_ASKED


def trigram_query(pattern: str) -> Query:
    """What a text in lower case must hold if the pattern matches in it: one of the sets of trigrams, wholly."""
    query = _strings(list(parser.parse(pattern)))[1]
    if any(not q for q in query):
        return NOTHING_ASKED
    return frozenset(q for q in query if not any(p < q for p in query))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, order, end, kind). The pieces between matches and the matches themselves give the places."""
    pattern = rule.pattern
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.measured))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), F.zip_with(whole, part, lambda w, p: F.struct(F.length(w).alias("w"), F.length(p).alias("p"))), lambda b, m: F.struct(F.length(b).alias("b"), m["w"].alias("w"), m["p"].alias("p")))
    kind = "array<struct<start:int,ord:int,end:int,kind:string,size:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc, m):
        start = acc["at"] + m["b"]
        end = start + m["w"]
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"), m["p"].alias("size"))
        return F.struct(end.alias("at"), F.when(m["p"] >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def _verify_pattern(rule: Rule) -> str:
    """A cheap test: whether a row can have a match of the length asked for at all."""
    if rule.measured == 0 and rule.least > 1 and rule.pattern.endswith("]+"):
        widest = parser.parse(rule.pattern)[:-1].getwidth()[1]  # of what stands before the last class
        return f"{rule.pattern}"[:-1] + f"{{{max(1, rule.least - widest)},}}"
    return rule.pattern


def secret_scan(df: DataFrame, rules: list[Rule] | None = None, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns of `keep` and `secret_spans`, an array of (start, ord, end, kind, size) by start and the rules' order."""
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    asked = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    indexed = {k: q for k, q in asked.items() if q != NOTHING_ASKED}
    trigrams = sorted({t for q in indexed.values() for s in q for t in s})
    docs = df.select(F.col(id_column).alias("_id"), text_of(text_column).alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    if trigrams:
        docs = docs.withColumn("_key", F.xxhash64("_text"))
        lower = docs.select("_key", F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("_lower"))
        found = F.array_compact(F.array(*(F.when(F.contains("_lower", F.lit(t)), F.lit(t)) for t in trigrams)))
        postings = lower.select("_key", F.explode(found).alias("trigram"))
        # A row for each trigram of each way to satisfy a rule; more than 60 of a way would only narrow it further.
        asks = [(t, k, w, 1 << n, (1 << min(len(q), 60)) - 1) for k, query in indexed.items() for w, q in enumerate(sorted(query, key=sorted)) for n, t in enumerate(sorted(q)[:60])]
        names = ("trigram", "rule", "way", "bit", "all_bits")
        queries = df.sparkSession.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).cast("long" if n.endswith(("bit", "bits")) else "int" if n != "trigram" else "string").alias(n) for n, v in zip(names, x, strict=True))) for x in asks))))
        held = postings.join(queries, "trigram").groupBy("_key", "rule", "way", "all_bits").agg(F.bit_or("bit").alias("bits")).where("bits = all_bits")
        candidates = held.groupBy(F.col("_key").alias("_candidate")).agg(F.collect_set("rule").alias("_rules"))  # as many as there are rules at most
        docs = docs.join(candidates, F.col("_key") == F.col("_candidate"), "left")
    else:
        docs = docs.withColumn("_rules", F.array().cast("array<int>"))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,size:int>>")
    parts = []
    for k, rule in enumerate(rules):
        may = F.col("_text").rlike(_verify_pattern(rule))
        if k in indexed:
            may = F.coalesce(F.array_contains("_rules", k), F.lit(False)) & may
        parts.append(F.when(may, _spans(rule, k, F.col("_text"))).otherwise(none))
    spans = F.array_sort(F.concat(*parts))
    return docs.select(F.col("_id").alias(id_column), *(F.col(f"_keep_{c}").alias(c) for c in keep), spans.alias("secret_spans"))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans count as one."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        begins = s["start"] >= acc["at"]
        gap = F.when(begins, F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate(spans, zero, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.lit(2147483647))))
