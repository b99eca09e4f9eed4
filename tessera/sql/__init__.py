"""SQL front-end: a small dialect with strict names and types, planned as DataFrames.

Statements: SELECT, INSERT, UPDATE and DELETE. Text is cut into tokens, parsed by recursive descent and bound
at once to columns, so that Catalyst sees one declarative plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import functions as X
from tessera import operators as O


class SqlError(ValueError):
    pass


TOKEN = re.compile(r"\s*(?:(\d+)|[xX]'((?:[0-9A-Fa-f]{2})*)'|'((?:[^']|'')*)'|([A-Za-z_]\w*)|(<>|!=|<=|>=|\|\||[-+*/%(),.;=<>]))")
RESERVED = set("select from where group by having order limit offset join left right inner full on using as and or not is null like insert into values update set delete asc desc cross".split())


def tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    sql = sql.rstrip()
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"can't read {sql[at:at + 20]!r}")
        kind = ("int", "str", "str", "name", "op")[m.lastindex - 1]  # a hexadecimal literal is the string of its digits
        word = m[m.lastindex].replace("''", "'") if kind == "str" else m[m.lastindex]
        out.append((kind, word))
        at = m.end()
    return [*out, ("end", "")]


@dataclass
class Typed:
    """A bound expression: its column, its kind (int, str, bool or other), its text.

    key tells expressions apart that look alike; loose names the columns it takes from outside of aggregates and group keys.
    """

    column: Column
    kind: str
    text: str
    key: str
    aggregate: bool = False
    loose: frozenset[str] = field(default_factory=frozenset)


@dataclass
class Field:
    qualifier: str
    name: str
    column: str  # the unique name in the frame
    type: T.DataType


@dataclass
class Relation:
    df: DataFrame
    fields: list[Field]

    def find(self, qualifier: str | None, name: str) -> Field:
        found = [f for f in self.fields if f.name.lower() == name.lower() and (qualifier is None or f.qualifier == qualifier)]
        if not found:
            raise SqlError(f"column {name!r} not found")
        if len(found) > 1:
            raise SqlError(f"column {name!r} is ambiguous")
        return found[0]


def escaped(text: str) -> str:
    """A literal as it stands in a form."""
    return repr(text).replace("{", "{{").replace("}", "}}")


def kind_of(t: T.DataType) -> str:
    return "int" if isinstance(t, T.NumericType) else "str" if isinstance(t, T.StringType) else "bool" if isinstance(t, T.BooleanType) else "other"


@dataclass
class Change:
    """A bound statement: its kind, the table it changes, the rows it returns or the table's new rows, and the rows that it affects, for updates and deletes with `_row`."""

    kind: str
    table: str | None
    rows: DataFrame
    affected: DataFrame | None = None


def identified(df: DataFrame) -> DataFrame:
    """The rows with `_row`, which tells each apart from the others: its file and place there, which stay the same however often it is read; of other relations, its place."""
    try:
        return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_row"))
    except AnalysisException:
        return df.withColumn("_row", F.monotonically_increasing_id())


class Parser:
    def __init__(self, engine: Engine, sql: str):
        self.engine, self.words, self.at, self.serial = engine, tokens(sql), 0, 0
        self.aggregates: dict[str, Column] | None = None
        self.keys: dict[str, str] = {}
        self.groups: dict[str, str] = {}

    def peek(self, *words: str) -> bool:
        return all(self.words[min(self.at + k, len(self.words) - 1)][0] in ("name", "op") and self.words[min(self.at + k, len(self.words) - 1)][1].lower() == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"expected {' '.join(words)!r} at {self.words[self.at][1]!r}")

    def name(self) -> str:
        kind, word = self.words[self.at]
        if kind != "name" or word.lower() in RESERVED:
            raise SqlError(f"expected a name at {word!r}")
        self.at += 1
        return word

    def integer(self) -> int:
        kind, word = self.words[self.at]
        if kind != "int":
            raise SqlError("LIMIT and OFFSET take integer literals")
        self.at += 1
        return int(word)

    def fits(self, name: str, wanted: T.DataType, kind: str) -> None:
        if kind not in ("other", "null") and kind_of(wanted) not in (kind, "other"):
            raise SqlError(f"column {name!r} takes another type")

    def listed(self, item):
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    # Relations.

    def relation(self, df: DataFrame, qualifier: str) -> Relation:
        self.serial += 1
        fields = [Field(qualifier, f.name, f"{f.name}__{self.serial}", f.dataType) for f in df.schema]
        return Relation(df.toDF(*(f.column for f in fields)), fields)

    def source(self) -> Relation:
        left = self.primary()
        while True:
            kind = "inner"
            if self.take("cross", "join"):
                kind = "cross"
            elif self.peek("left") or self.peek("right") or self.peek("full"):
                kind = self.words[self.at][1].lower()
                self.at += 1
                self.take("outer")
                self.need("join")
            elif self.take("inner", "join") or self.take("join"):
                pass
            elif self.peek("natural") or self.peek("straight_join"):
                raise SqlError("this kind of join isn't supported")
            else:
                return left
            right = self.primary()
            fields = left.fields + right.fields
            on = None
            both = Relation(left.df, fields)
            if kind != "cross" and self.take("using"):
                self.need("(")
                equal = []
                for c in self.listed(self.name):
                    a, b = left.find(None, c), right.find(None, c)
                    if kind_of(a.type) != kind_of(b.type):
                        raise SqlError(f"column {c!r} has different types")
                    equal.append(F.col(a.column) == F.col(b.column))
                self.need(")")
                on = X.all_of(equal)
            elif kind != "cross":
                self.need("on")
                on = self.predicate(both)
            left = Relation(O.join(left.df, right.df, on, kind), fields)

    def primary(self) -> Relation:
        if self.take("("):
            if self.peek("select"):
                df = self.select()
                self.need(")")
                self.take("as")
                return self.relation(df, self.name())
            inner = self.sources()
            self.need(")")
            return inner
        name = self.name()
        df = self.engine.table(name)
        alias = name
        if self.take("as"):
            alias = self.name()
        elif self.words[self.at][0] == "name" and self.words[self.at][1].lower() not in RESERVED | {"natural", "straight_join", "outer"}:
            alias = self.name()
        return self.relation(df, alias)

    def sources(self) -> Relation:
        parts = self.listed(self.source)
        out = parts[0]
        for p in parts[1:]:
            out = Relation(out.df.crossJoin(p.df), out.fields + p.fields)
        return out

    # Expressions.

    def made(self, column: Column, kind: str, form: str, *parts: Typed) -> Typed:
        """An expression over others; one that the statement groups by is the group's key."""
        key = form.format(*(p.key for p in parts))
        text = form.format(*(p.text for p in parts))
        if key in self.groups:
            return Typed(F.col(self.groups[key]), kind, text, key)
        return Typed(column, kind, text, key, any(p.aggregate for p in parts), frozenset().union(*(p.loose for p in parts)))

    def predicate(self, rel: Relation) -> Column:
        return self.boolean(self.either(rel))

    def boolean(self, e: Typed) -> Column:
        if e.kind not in ("bool", "int", "null"):
            raise SqlError(f"{e.text} isn't a condition")
        return e.column.cast("boolean") if e.kind == "null" else X.truth(e.column, e.kind == "bool")

    def either(self, rel: Relation) -> Typed:
        e = self.both(rel)
        while self.take("or"):
            r = self.both(rel)
            e = self.made(self.boolean(e) | self.boolean(r), "bool", "({} OR {})", e, r)
        return e

    def both(self, rel: Relation) -> Typed:
        e = self.negated(rel)
        while self.take("and"):
            r = self.negated(rel)
            e = self.made(self.boolean(e) & self.boolean(r), "bool", "({} AND {})", e, r)
        return e

    def negated(self, rel: Relation) -> Typed:
        if self.take("not"):
            e = self.negated(rel)
            return self.made(~self.boolean(e), "bool", "NOT {}", e)
        return self.compared(rel)

    def compared(self, rel: Relation) -> Typed:
        e = self.sum(rel)
        if self.take("is"):
            no = self.take("not")
            self.need("null")
            return self.made(e.column.isNotNull() if no else e.column.isNull(), "bool", f"{{}} IS {'NOT ' * no}NULL", e)
        no = self.take("not")
        if self.take("like"):
            r = None
            kind, pattern = self.words[self.at]
            if kind == "str" and self.words[self.at + 1] != ("op", "||"):
                self.at += 1
                p = X.like(e.column, pattern)
            else:
                r = self.sum(rel)
                p = F.like(e.column, F.regexp_replace(r.column, r"\\(?![%_])", r"\\\\\\\\"))
            for x in (e, r):
                if x is not None and x.kind not in ("str", "null"):
                    raise SqlError(f"LIKE takes strings, not {x.text}")
            parts = [e] if r is None else [e, r]
            return self.made(~p if no else p, "bool", "{} " + "NOT " * no + "LIKE " + (escaped(pattern) if r is None else "{}"), *parts)
        if no:
            raise SqlError("expected LIKE behind NOT")
        for op in ("<>", "!=", "<=", ">=", "=", "<", ">"):
            if self.take(op):
                r = self.sum(rel)
                if e.kind != r.kind and not {"other", "null"} & {e.kind, r.kind}:
                    raise SqlError(f"{e.text} and {r.text} have different types")
                a, b = e.column, r.column
                p = {"=": a == b, "<>": a != b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
                return self.made(p, "bool", f"({{}} {op} {{}})", e, r)
        return e

    def numbers(self, e: Typed, r: Typed, op: str) -> None:
        if not {e.kind, r.kind} <= {"int", "null"}:
            raise SqlError(f"{op} takes integers, not {e.text} and {r.text}")

    def sum(self, rel: Relation) -> Typed:
        e = self.product(rel)
        while True:
            op = next((o for o in ("+", "-", "||") if self.take(o)), None)
            if op is None:
                return e
            r = self.product(rel)
            if op == "||":
                if not {e.kind, r.kind} <= {"str", "null"}:
                    raise SqlError(f"|| takes strings, not {e.text} and {r.text}")
                e = self.made(F.concat(e.column, r.column), "str", "{} || {}", e, r)
                continue
            self.numbers(e, r, op)
            e = self.made(e.column + r.column if op == "+" else e.column - r.column, "int", f"({{}} {op} {{}})", e, r)

    def product(self, rel: Relation) -> Typed:
        e = self.unit(rel)
        while True:
            op = next((o for o in "*/%" if self.take(o)), None)
            if op is None:
                return e
            r = self.unit(rel)
            self.numbers(e, r, op)
            column = e.column * r.column if op == "*" else X.divide(e.column, r.column) if op == "/" else X.modulo(e.column, r.column)
            e = self.made(column, "int", f"({{}} {op} {{}})", e, r)

    def unit(self, rel: Relation) -> Typed:
        kind, word = self.words[self.at]
        if self.take("("):
            e = self.either(rel)
            self.need(")")
            return e
        if self.take("-"):
            e = self.unit(rel)
            if e.kind not in ("int", "null"):
                raise SqlError(f"- takes an integer, not {e.text}")
            return self.made(-e.column, e.kind, "-{}", e)
        if kind == "int":
            self.at += 1
            return self.made(F.lit(int(word)).cast("long"), "int", word)
        if kind == "str":
            self.at += 1
            return self.made(F.lit(word), "str", escaped(word))
        if self.take("null"):
            return self.made(F.lit(None), "null", "NULL")
        name = self.name()
        if self.take("("):
            return self.aggregate(rel, name)
        qualifier = None
        if self.take("."):
            qualifier, name = name, self.name()
            self.qualified(rel, qualifier)
        return self.reference(rel.find(qualifier, name))

    def qualified(self, rel: Relation, qualifier: str) -> None:
        if not any(f.qualifier == qualifier for f in rel.fields):
            raise SqlError(f"no table {qualifier!r}")

    def reference(self, f: Field) -> Typed:
        if f.column in self.groups:
            return Typed(F.col(self.groups[f.column]), kind_of(f.type), f.name, f.column)
        return Typed(F.col(f.column), kind_of(f.type), f.name, f.column, loose=frozenset([f.name]))

    def aggregate(self, rel: Relation, name: str) -> Typed:
        kind = name.lower()
        if kind not in O.AGGREGATES or self.aggregates is None:
            raise SqlError(f"function {name!r} isn't supported here")
        groups, aggregates, self.groups, self.aggregates = self.groups, self.aggregates, {}, None  # arguments see the rows, and no other aggregate
        try:
            if self.take("*"):
                if kind != "count":
                    raise SqlError(f"{name}(*) isn't supported")
                arg, form, inner, result = F.lit(1), "COUNT(1)", "1", "int"
            else:
                if self.peek("distinct"):
                    raise SqlError("DISTINCT isn't supported")
                e = self.either(rel)
                arg, form, inner = e.column, f"{kind.upper()}({e.text})", e.key
                result = "int" if kind in ("count", "sum") else e.kind
                if kind == "sum" and e.kind not in ("int", "null"):
                    raise SqlError("SUM takes numbers")
            self.need(")")
        finally:
            self.groups, self.aggregates = groups, aggregates
        key = next((k for k, v in self.keys.items() if v == f"{kind} {inner}"), None)
        if key is None:
            key = f"agg__{len(self.aggregates)}"
            self.keys[key] = f"{kind} {inner}"
            self.aggregates[key] = getattr(F, kind)(arg).alias(key)
        return Typed(F.col(key), result, form, f"{kind} {inner}", True)

    # Statements.

    def item(self, rel: Relation):
        if self.take("*"):
            return [(f.name, self.reference(f)) for f in rel.fields]
        if self.words[self.at][0] == "name" and self.words[self.at + 1][1] == "." and self.words[self.at + 2][1] == "*":
            q = self.name()
            self.at += 2
            self.qualified(rel, q)
            return [(f.name, self.reference(f)) for f in rel.fields if f.qualifier == q]
        e = self.either(rel)
        return [(self.name() if self.take("as") else e.text, e)]

    def select(self) -> DataFrame:
        self.need("select")
        outer = (self.aggregates, self.keys, self.groups)
        items_at = self.at
        depth = 0
        while not (depth == 0 and self.peek("from")):  # names are bound behind FROM
            word = self.words[self.at]
            if word[0] == "end":
                raise SqlError("SELECT without FROM")
            depth += {"(": 1, ")": -1}.get(word[1], 0) if word[0] == "op" else 0
            self.at += 1
        self.need("from")
        self.aggregates, self.keys, self.groups = None, {}, {}
        rel = self.sources()
        if self.take("where"):
            rel = Relation(rel.df.where(self.predicate(rel)), rel.fields)
        grouped = self.take("group", "by")
        groups = self.listed(lambda: self.either(rel)) if grouped else []
        self.aggregates = {}
        self.groups = {g.key: f"group__{k}" for k, g in enumerate(groups)}
        having_at = self.at
        self.at = items_at
        items = [x for some in self.listed(lambda: self.item(rel)) for x in some]
        if not self.peek("from"):
            raise SqlError(f"unexpected {self.words[self.at][1]!r}")
        self.at = having_at
        having = self.either(rel) if self.take("having") else None
        order = []
        if self.take("order", "by"):
            order = self.listed(lambda: self.order_key(rel, dict(items)))
        n, offset = None, 0
        if self.take("limit"):
            n = self.integer()
        if self.take("offset"):
            offset = self.integer()
        df = rel.df
        if grouped or self.aggregates:
            for e in [e for _, e in items] + [having] * (having is not None) + [e for e, _ in order]:
                if e.loose:
                    raise SqlError(f"column {min(e.loose)!r} of {e.text} is neither grouped nor aggregated")
            made = list(self.aggregates.values())
            keys = [g.column.alias(f"group__{k}") for k, g in enumerate(groups)]
            df = df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()
            if having is not None:
                df = df.where(self.boolean(having))
        elif having is not None:
            raise SqlError("HAVING without aggregation")
        if order:
            df = O.sort(df, *((e.column, up) for e, up in order))
        if n is not None or offset:
            df = df.offset(offset) if offset else df
            df = df.limit(n) if n is not None else df
        self.aggregates, self.keys, self.groups = outer
        return df.select(*((X.as_integer(e.column) if e.kind == "bool" else e.column).alias(name) for name, e in items))

    def order_key(self, rel: Relation, items: dict[str, Typed]) -> tuple[Typed, bool]:
        kind, word = self.words[self.at]
        following = self.words[self.at + 1]
        if kind == "name" and word in items and following[1] not in (".", "(") and not any(f.name.lower() == word.lower() for f in rel.fields):
            self.at += 1
            e = items[word]
        else:
            e = self.either(rel)
        up = not self.take("desc")
        if up:
            self.take("asc")
        return e, up

    def statement(self) -> Change:
        """What the statement asks for, bound to columns."""
        if self.peek("select"):
            out = Change("select", None, self.select())
        elif self.take("insert", "into"):
            name = self.name()
            target = self.engine.table(name)
            columns = None
            if self.peek("(") and not self.peek("(", "select"):
                self.need("(")
                columns = self.listed(self.name)
                self.need(")")
            for c in columns or []:
                if c not in target.columns:
                    raise SqlError(f"column {c!r} not found")
            if self.take("values"):
                one = Relation(self.engine.spark.range(1), [])

                def row():
                    self.need("(")
                    got = self.listed(lambda: self.either(one))
                    self.need(")")
                    return got

                rows = self.listed(row)
                if any(e.loose for r in rows for e in r):
                    raise SqlError("VALUES takes constants")
                width = len(columns or target.columns)
                if any(len(r) != width for r in rows):
                    raise SqlError(f"INSERT takes {width} values")
                names = columns or target.columns
                source = None
                for r in rows:
                    for c, e in zip(names, r, strict=True):
                        self.fits(c, target.schema[c].dataType, e.kind)
                    part = one.df.select(*(e.column.cast(target.schema[c].dataType).alias(c) for c, e in zip(names, r, strict=True)))
                    source = part if source is None else source.unionAll(part)
            else:
                wrapped = self.take("(")
                source = self.select()
                if wrapped:
                    self.need(")")
                for c, f in zip(columns or target.columns, source.schema, strict=False):
                    self.fits(c, target.schema[c].dataType, kind_of(f.dataType))
            try:
                made = O.aligned(target, source, columns)
            except ValueError as e:
                raise SqlError(str(e)) from e
            out = Change("insert", name, target.unionByName(made), made)
        elif self.take("update"):
            name = self.name()
            base = identified(self.engine.table(name))
            rel = self.relation(base.drop("_row"), name)
            self.need("set")

            def change():
                c = rel.find(None, self.name())
                self.need("=")
                e = self.either(rel)
                self.fits(c.name, c.type, e.kind)
                return c.column, e.column

            changes = dict(self.listed(change))
            where = self.predicate(rel) if self.take("where") else None
            rows = base.toDF(*(f.column for f in rel.fields), "_row")
            out = Change("update", name, O.update(rel.df, changes, where).toDF(*(f.name for f in rel.fields)), rows if where is None else rows.where(where))
        elif self.take("delete", "from"):
            name = self.name()
            base = identified(self.engine.table(name))
            rel = self.relation(base.drop("_row"), name)
            rows = base.toDF(*(f.column for f in rel.fields), "_row")
            where = self.predicate(rel) if self.take("where") else None
            order = self.listed(lambda: self.order_key(rel, {})) if self.take("order", "by") else []
            kept, hit = O.delete(rows, where), rows if where is None else rows.where(where)
            if self.take("limit"):
                hit = O.sort(hit, *((e.column, up) for e, up in order), (F.col("_row"), True)).limit(self.integer())
                kept = rows.join(hit.select("_row"), "_row", "left_anti")
            out = Change("delete", name, kept.drop("_row").toDF(*(f.name for f in rel.fields)), hit)
        else:
            raise SqlError(f"statement {self.words[self.at][1]!r} isn't supported")
        self.take(";")
        if self.words[self.at][0] != "end":
            raise SqlError(f"unexpected {self.words[self.at][1]!r}")
        return out


class Engine:
    """Named tables and the statements over them. `tables` maps names to DataFrames or to functions that read them."""

    def __init__(self, spark: SparkSession, tables: dict):
        self.spark, self.tables = spark, tables

    @classmethod
    def on_folder(cls, spark: SparkSession, folder: str) -> Engine:
        names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
        return cls(spark, {n: (lambda n=n: O.scan(spark, f"{folder}/{n}.parquet")) for n in names})

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise SqlError(f"no table {name!r}")
        t = self.tables[name]
        return t() if callable(t) else t

    def sql(self, statement: str) -> DataFrame:
        """A SELECT's rows."""
        out = Parser(self, statement).statement()
        if out.kind != "select":
            raise SqlError("changes need a transaction; see tessera.storage")
        return out.rows
