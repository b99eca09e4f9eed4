"""Allow and block rules for urls, held in a trie over reversed host labels and path segments.

Operator: ``url_filter``. A rule names a host and the start of a path; it fits its host and all
subdomains. Of the rules that fit, the one with most host labels wins, then the longest path. The rules
are a list given by the caller, broadcast only up to `max_rules`; longer lists are cut into blocks
of that size, each its own pass whose best match is kept by the same order.

Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: then up to
``?``, ``#`` or the end. A null url or one without ``://`` has an empty host and path and gets the
default verdict. Repeated rows give repeated results; of rules with the same host and path the last counts; an empty
table gives an empty result; urls of any length are read whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_type


class Trie:
    """Nodes are dicts: host labels from the last to the first, then "/" and the path's segments."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault("." + label, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            ends = node.setdefault("", {})  # starts of the next segment, by their length and text
            ends.setdefault(len(last), {})[last] = (verdict, host + path, host.count(".") + 1, len(path))

    def match(self, host: str, path: str) -> tuple[str, str, int, int] | None:
        """The winning rule: (verdict, rule, host labels, path length)."""
        found = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("." + label)
            if node is None:
                break
            at = node
            best = None
            for segment in segments:
                for size, starts in at.get("", {}).items():
                    rule = starts.get(segment[:size])
                    if rule is not None and (best is None or rule[3] > best[3]):
                        best = rule
                at = at.get("/" + segment)
                if at is None:
                    break
            found = best or found
        return found


def url_filter(df: DataFrame, rules: list[tuple[str, str, str]], id_column: str = "page_id", url_column: str = "url", default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """(id, host, path, rule, verdict) for every row. A rule is (verdict, host, path) with a path from "/" on; rule is null where none fits."""
    out = T.StructType([T.StructField(id_column, id_type(df, id_column)), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    url = F.coalesce(F.col(url_column), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)
    blocks = [rules[k : k + max_rules] for k in range(0, len(rules), max_rules)] or [[]]
    context = df.sparkSession.sparkContext

    now = df.select(F.col(id_column), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).cast("long").alias("labels"), F.lit(-1).cast("long").alias("depth"))
    for block in blocks:
        tries = context.broadcast(Trie(block))

        def run(batches, tries=tries):
            trie = tries.value
            for batch in batches:
                c = [batch.column(k).to_pylist() for k in range(1, 7)]
                for k, (h, p, labels, depth) in enumerate(zip(c[0], c[1], c[4], c[5], strict=True)):
                    hit = trie.match(h, p)
                    if hit and (hit[2], hit[3]) > (labels, depth):
                        c[3][k], c[2][k], c[4][k], c[5][k] = hit
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in c[:4]), *(pa.array(x, pa.int64()) for x in c[4:])], batch.schema.names)

        now = now.mapInArrow(run, now.schema)
    return now.select(*out.names)
