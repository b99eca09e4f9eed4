"""Registered queries of the relational engine, each with its SQL counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions as X
from tessera import operators as O
from tessera.sources import Index, IndexedTable, Table, shared_folder
from tessera.sql import Engine
from tessera.streaming import tumbling_counts

C, L = F.col, F.lit
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return O.scan(spark, f"{d}/{name}.parquet")


def query(sql: str):
    def register(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return register


def text(name: str, ours: str, oracle: str | None = None) -> None:
    """A query given to the SQL front-end; the oracle's text differs where dialects do."""
    _QUERIES[name] = lambda spark, d: Engine.on_folder(spark, d).sql(ours)
    _SQL[name] = oracle or ours


FLAGSHIP = "SELECT o_custkey, COUNT(*) AS n_orders, SUM(o.o_orderkey) AS sum_keys FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c_acctbal > 0 GROUP BY o_custkey ORDER BY n_orders DESC, o_custkey LIMIT 10"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return Engine.on_folder(spark, d).sql(FLAGSHIP)


text("flagship", FLAGSHIP, FLAGSHIP.replace("SUM(o.o_orderkey)", "CAST(SUM(o.o_orderkey) AS BIGINT)"))
text("seq_scan", "SELECT * FROM nation")
text("filter_cmp", "SELECT c_custkey, c_name FROM customer WHERE NOT (c_nationkey > 5) OR c_custkey <= 20")
text("truthy_int", "SELECT n_name FROM nation WHERE n_regionkey", "SELECT n_name FROM nation WHERE n_regionkey <> 0")
text("project_arith", "SELECT c_custkey, c_custkey / c_nationkey AS q, c_custkey % c_nationkey AS r, c_custkey * 2 - 1 AS m FROM customer", "SELECT c_custkey, c_custkey // nullif(c_nationkey, 0) AS q, c_custkey % nullif(c_nationkey, 0) AS r, c_custkey * 2 - 1 AS m FROM customer")
text("like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%'", "SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%' ESCAPE '\\'")
text("concat_text", "SELECT n_name || '-' || n_name AS twice FROM nation")
text("null_check", "SELECT n_nationkey FROM nation WHERE n_name IS NOT NULL")
text("predicate_column", "SELECT n_nationkey, n_regionkey > 2 AS late FROM nation", "SELECT n_nationkey, CAST(n_regionkey > 2 AS BIGINT) AS late FROM nation")
text("hash_join", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
text("join_residual", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal < o_totalprice")
text("left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
text("right_join", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000")
text("theta_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
text("cross_join", "SELECT r_name, n_name FROM region, nation")
text("self_join", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey")
text("three_way", "SELECT c_name, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey")
text("join_using", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b USING (n_regionkey)")
text("agg_all", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_orderkey) AS s, MIN(l_shipdate) AS lo, MAX(l_linestatus) AS hi FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS s, MIN(l_shipdate) AS lo, MAX(l_linestatus) AS hi FROM lineitem GROUP BY l_returnflag")
text("agg_empty", "SELECT COUNT(*) AS n, MIN(n_name) AS lo FROM nation WHERE n_nationkey < 0")
text("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15")
text("group_no_agg", "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
text("agg_expression", "SELECT n_regionkey, SUM(n_nationkey) + 1 AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(SUM(n_nationkey) + 1 AS BIGINT) AS s FROM nation GROUP BY n_regionkey")
text("group_by_expression", "SELECT n_regionkey + 1 AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey + 1", "SELECT CAST(n_regionkey + 1 AS BIGINT) AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey + 1")
text("group_by_predicate", "SELECT c_nationkey % 3 AS k, c_custkey > 50 AS late, MAX(c_custkey) AS hi FROM customer GROUP BY c_nationkey % 3, c_custkey > 50", "SELECT CAST(c_nationkey % 3 AS BIGINT) AS k, CAST(c_custkey > 50 AS BIGINT) AS late, MAX(c_custkey) AS hi FROM customer GROUP BY ALL")
text("like_column", "SELECT a.n_name AS x, b.r_name AS y FROM nation a JOIN region b ON a.n_name LIKE '%' || b.r_name OR NOT b.r_name LIKE a.n_name")
text("hex_literal", "SELECT x'4A4b' AS h, n_nationkey FROM nation WHERE n_nationkey = 3", "SELECT '4A4b' AS h, n_nationkey FROM nation WHERE n_nationkey = 3")
text("qualified_star", "SELECT b.*, a.n_name AS n FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
text("topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
text("topn_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 40")
text("subquery", "SELECT sub.k FROM (SELECT n_nationkey AS k FROM nation WHERE n_regionkey > 1) AS sub WHERE sub.k < 20")
text("index_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 400")
text("index_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 7 OR l_orderkey > 50000")
text("index_lookup", "SELECT * FROM part WHERE p_partkey = 77")


@query("SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation ORDER BY k NULLS FIRST, n_nationkey")
def sort_nulls(spark, d):
    return O.sort(_t(spark, d, "nation").select("n_nationkey", F.nullif(C("n_regionkey"), L(2)).alias("k")), (C("k"), True), (C("n_nationkey"), True))


@query("SELECT nullif(n_regionkey, 2) AS k, CAST(SUM(n_nationkey) AS BIGINT) AS s, COUNT(nullif(n_regionkey, 2)) AS n FROM nation GROUP BY 1")
def agg_null_key(spark, d):
    k = F.nullif(C("n_regionkey"), L(2))
    return O.aggregate(_t(spark, d, "nation"), [k.alias("k")], {"s": ("sum", C("n_nationkey")), "n": ("count", k)})


@query("SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) <> 4")
def filter_3vl(spark, d):
    return O.select(_t(spark, d, "customer"), F.nullif(C("c_nationkey"), L(3)) != 4).select("c_custkey")


def _strategy(kind: str):
    def f(spark, d):
        o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
        return O.join(o, c, o.o_custkey == c.c_custkey, "inner", kind).select("o_orderkey", "c_name")

    return f


for _kind in ("hash", "merge", "loop"):
    _QUERIES[f"join_{_kind}_hint"] = _strategy(_kind)
    _SQL[f"join_{_kind}_hint"] = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey AND c_nationkey < 10")
def full_join(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders").where("o_totalprice > 400000")
    return O.join(c, o, (c.c_custkey == o.o_custkey) & (c.c_nationkey < 10), "full").select("c_custkey", "o_orderkey")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, NULL)) t(x, y)")
def values(spark, d):
    return O.values(spark, [(1, "a"), (2, None)], "x long, y string")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE n_name END AS n_name, n_regionkey FROM nation")
def update_rows(spark, d):
    return O.update(_t(spark, d, "nation"), {"n_name": L("moved")}, C("n_regionkey") == 1)


@query("SELECT * FROM nation WHERE NOT coalesce(nullif(n_regionkey, 2) = 1, false)")
def delete_rows(spark, d):
    return O.delete(_t(spark, d, "nation"), F.nullif(C("n_regionkey"), L(2)) == 1)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def insert_select(spark, d):
    return O.insert(_t(spark, d, "nation"), _t(spark, d, "region").select("r_regionkey", "r_name"), ["n_nationkey", "n_name"])


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    return tumbling_counts(_t(spark, d, "events"))


def _layouts(spark, d, name: str, kind: str, key: list[str]) -> IndexedTable:
    df = _t(spark, d, name)
    table = IndexedTable(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", Table(1, name, [], [Index(2, f"by_{kind}", kind, key)]))
    table.write(df, partitions=8)
    return table


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 4 OR o_custkey >= 100 AND o_custkey < 130")
def index_layout_range(spark, d):
    wanted = (C("o_custkey") == 4) | ((C("o_custkey") >= 100) & (C("o_custkey") < 130))
    return _layouts(spark, d, "orders", "btree", ["o_custkey", "o_orderkey"]).scan(wanted, set(), {"o_custkey"}).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 4")
def index_layout_lookup(spark, d):
    return _layouts(spark, d, "orders", "hash", ["o_custkey"]).scan(C("o_custkey") == 4, {"o_custkey"}).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE nullif(p_size, 5) IS NULL")
def index_layout_nulls(spark, d):
    df = _t(spark, d, "part").select("p_partkey", F.nullif(C("p_size"), L(5)).alias("size"))
    table = IndexedTable(spark, f"{shared_folder(spark)}/part-{uuid.uuid4().hex}", Table(1, "part", [], [Index(2, "by_size", "btree", ["size"])]))
    table.write(df, partitions=8)
    return table.scan(C("size").isNull(), {"size"}).select("p_partkey")


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0")
def index_join(spark, d):
    few = _t(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", "c_name")
    return _layouts(spark, d, "orders", "btree", ["o_custkey"]).probe(few, {"o_custkey": "c_custkey"}).select("c_name", "o_orderkey")


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def materialized(spark, d):
    kept = O.materialize(_t(spark, d, "nation"))
    a, b = kept.alias("a"), kept.alias("b")
    return O.join(a, b, C("a.n_regionkey") == C("b.n_regionkey")).select(C("a.n_nationkey").alias("x"), C("b.n_nationkey").alias("y"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
