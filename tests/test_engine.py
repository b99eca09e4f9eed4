"""Operators, front-end and snapshot tables on small rows, and registered queries against DuckDB."""

import io

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalogue_queries as Q
from tessera import operators as O
from tessera.functions import all_of, divide, key_hash, like, modulo
from tessera.plans import estimated_bytes, explain
from tessera.shell import Shell, create_tables, load_files
from tessera.sources import Catalog, CatalogError, Index, IndexedTable, Table, matching_index, read_csv
from tessera.sql import Engine, SqlError
from tessera.storage import ConflictError, Database

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_duckdb(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    order = sorted(range(len(df.columns)), key=lambda k: df.columns[k])
    ours = sorted(repr([r[k] for k in order]) for r in df.collect())
    found = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert ours == sorted(repr([r[k] for k in order]) for r in found.fetchall())
    assert sorted(names) == sorted(df.columns)


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(i, 200 * i, 100 * i, "EU" if i % 2 else "US") for i in range(8)]
    return spark.createDataFrame(rows, "id long, revenue long, cost long, region string")


@pytest.mark.parametrize("strategy", ["auto", "hash", "merge", "loop"])
def test_join_matrix(spark, strategy):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (3,), (None,)], "x long")
    b = spark.createDataFrame([(1,), (1,), (2,), (4,), (None,)], "y long")
    assert O.join(a, b, a.x == b.y, "inner", strategy).count() == 7
    assert O.join(a, b, a.x == b.y, "left", strategy).count() == 9
    assert O.join(a, b.limit(0), a.x == b.y, "inner", strategy).count() == 0


def test_arithmetic_and_like(spark):
    row = spark.sql("select 10L a, 0L z, -7L n, 2L t, '100%' p, 'a\\\\b' s").select(divide(F.col("a"), F.col("z")), divide(F.col("n"), F.col("t")), modulo(F.col("n"), F.col("t")), modulo(F.col("a"), F.col("z")), like(F.col("p"), r"100\%"), like(F.col("s"), r"a\b")).first()
    assert tuple(row) == (None, -3, -1, None, True, True)


def test_aggregates_ignore_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5), (None, 7)], "k long, v long")
    out = O.aggregate(df, ["k"], {"n": ("count", F.col("v")), "all": ("count", None), "s": ("sum", F.col("v"))})
    assert {tuple(r) for r in out.collect()} == {(1, 0, 2, None), (2, 1, 1, 5), (None, 1, 1, 7)}


def test_update_swaps_old_values(sales):
    out = O.update(sales, {"revenue": F.col("cost"), "cost": F.col("revenue")}, F.col("id") == 3)
    assert tuple(out.where("id = 3").first())[:3] == (3, 300, 600)
    assert O.top_n(sales, 3, (F.col("revenue"), False)).collect()[0].id == 7


@pytest.mark.parametrize("text", ["SELECT * FROM ghost", "SELECT missing FROM t", "SELECT a.id FROM t", "SELECT * FROM t AS a JOIN t AS b ON id = id", "SELECT * FROM t JOIN t AS b USING (missing)", "SELECT id FROM t WHERE region = 1", "SELECT SUM(*) FROM t", "SELECT id FROM t LIMIT id", "SELECT id FROM t NATURAL JOIN t", "DROP TABLE t", "INSERT INTO t (id) VALUES (1, 2)", "INSERT INTO t (id) VALUES ('x')", "SELECT z.* FROM t", "SELECT id FROM t WHERE region", "SELECT id FROM t WHERE NOT region", "SELECT id, COUNT(*) FROM t GROUP BY cost", "SELECT id + cost FROM t GROUP BY id", "SELECT id, SUM(cost) FROM t", "SELECT cost FROM t GROUP BY cost ORDER BY id", "SELECT cost FROM t GROUP BY cost HAVING id > 1", "SELECT id FROM t GROUP BY COUNT(*)", "SELECT SUM(COUNT(*)) FROM t", "SELECT id || region FROM t", "SELECT id FROM t WHERE id LIKE 'a%'", "SELECT -region FROM t", "INSERT INTO t (id) SELECT region FROM t", "INSERT INTO t (id) VALUES (id)", "SELECT id FROM t WHERE region = x'4'", "SELECT id FROM t y z"])
def test_rejected(spark, sales, text):
    with pytest.raises(SqlError):
        Engine(spark, {"t": sales}).sql(text)


@pytest.mark.parametrize(("text", "want"), [
    ("SELECT id % 2 AS k, COUNT(*) AS n FROM t GROUP BY id % 2 ORDER BY k", [(0, 4), (1, 4)]),
    ("SELECT id / 4 + 1, SUM(cost) FROM t GROUP BY id / 4 ORDER BY id / 4", [(1, 600), (2, 2200)]),
    ("SELECT region || '!', MIN(id) FROM t GROUP BY region ORDER BY region", [("EU!", 1), ("US!", 0)]),
    ("SELECT id > 5, COUNT(*) FROM t GROUP BY id > 5 ORDER BY COUNT(*)", [(1, 2), (0, 6)]),
    ("SELECT a.id + b.id AS s FROM t a JOIN t b ON a.id = b.id GROUP BY a.id + b.id HAVING a.id + b.id > 11 ORDER BY s", [(12,), (14,)]),
    ("SELECT x'4a4B' AS h FROM t WHERE id = 1", [("4a4B",)]),
    ("SELECT t.* FROM t WHERE NULL OR id = 7", [(7, 1400, 700, "EU")]),
    ("SELECT COUNT(*) AS n, SUM(id) + MAX(id) FROM t HAVING COUNT(*) > 7", [(8, 35)]),
])
def test_grouped_expressions(spark, sales, text, want):
    assert [tuple(r) for r in Engine(spark, {"t": sales}).sql(text).collect()] == want


def test_join_needs_a_condition(sales):
    with pytest.raises(ValueError, match="condition"):
        O.join(sales, sales, kind="left")


@pytest.mark.parametrize("strategy", ["auto", "hash", "merge", "loop"])
def test_joins_of_every_kind(spark, strategy):
    """Each kind against an independent nested loop: basic, empty sides, null keys, duplicates, two keys and a residual."""
    sides = [([(1, 1), (2, 2), (3, 3), (4, 4)], [(1, 1), (3, 3), (6, 6)]), ([], [(1, 1)]), ([(1, 1)], []), ([], []), ([(1, 1), (None, 2)], [(1, 5), (None, 6)]), ([(1, 1), (1, 2), (1, 3), (2, 1)], [(1, 2), (1, 3), (2, 0), (4, 4)])]
    tests = [(lambda p, q: p[0] == q[0], lambda a, b: a.x == b.y), (lambda p, q: p[0] == q[0] and p[1] < q[1], lambda a, b: (a.x == b.y) & (a.v < b.w)), (lambda p, q: p[0] == q[0] and p[1] == q[1], lambda a, b: (a.x == b.y) & (a.v == b.w))]
    for left, right in sides:
        a, b = spark.createDataFrame(left, "x long, v long"), spark.createDataFrame(right, "y long, w long")
        for holds, on in tests:
            ok = lambda p, q, holds=holds: None not in (p[0], q[0]) and holds(p, q)
            inner = [p + q for p in left for q in right if ok(p, q)]
            only_left = [(*p, None, None) for p in left if not any(ok(p, q) for q in right)]
            only_right = [(None, None, *q) for q in right if not any(ok(p, q) for p in left)]
            for kind, want in (("inner", inner), ("left", inner + only_left), ("right", inner + only_right), ("full", inner + only_left + only_right)):
                assert sorted(map(repr, (tuple(r) for r in O.join(a, b, on(a, b), kind, strategy).collect()))) == sorted(map(repr, want)), (kind, left, right)


def scanned(df):
    """Rows that the scan itself read."""
    df.collect()
    plan, todo = None, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().startswith("Scan"):
            return plan.metrics().apply("numOutputRows").value()
        todo += [plan.children().apply(k) for k in range(plan.children().size())] + ([plan.executedPlan()] if "Adaptive" in plan.nodeName() else [])


@pytest.mark.parametrize(("kind", "predicate", "equal", "ranged"), [("btree", "k >= 100 and k < 140", set(), {"k"}), ("hash", "k = 77", {"k"}, set()), ("btree", "k is null", {"k"}, set())])
def test_layouts_prune(spark, tmp_path, kind, predicate, equal, ranged):
    predicate = F.expr(predicate)
    df = spark.range(8000).selectExpr("nullif(id % 2000, 5) as k", "id as v").repartition(4)
    t = IndexedTable(spark, str(tmp_path), Table(1, "t", [("k", 1), ("v", 1)], [Index(2, "i", kind, ["k"])]))
    t.write(df, partitions=16)
    got = t.scan(predicate, equal, ranged)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.where(predicate).collect()), key=str)
    assert scanned(got) <= 1600 < scanned(spark.read.parquet(t.path(None)).where(predicate))


def test_explain_and_pushdown(spark, tmp_path):
    df = O.scan(spark, f"{SF}/lineitem.parquet", ["l_orderkey"], F.col("l_quantity") > 10)
    plan = explain(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert "== Optimized Logical Plan ==" in explain(df, "extended")
    with pytest.raises(ValueError, match="mode"):
        explain(df, "pretty")


def test_join_strategies_are_taken(spark):
    a, b = spark.range(10).toDF("x"), spark.range(10).toDF("y")
    for strategy, node in (("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("loop", "CartesianProduct")):
        assert node in explain(O.join(a, b, a.x == b.y, "inner", strategy), "simple")


def test_loop_of_large_sides_takes_pairs_with_equal_keys_only(spark):
    a = spark.range(60_000).selectExpr("nullif(id % 1500, 7) as x", "id as v")
    b = spark.range(60_000).selectExpr("nullif(id % 3000, 11) as y", "id as w")
    for on in (a.x == b.y, (a.x == b.y) & (a.v < b.w)):
        out = O.join(a, b, on, "inner", "loop")
        plan = explain(out, "simple")
        assert "CartesianProduct" not in plan and "SortMergeJoin" in plan
        sums = [F.count("*"), F.sum(F.xxhash64("x", "v", "y", "w").cast("decimal(38,0)"))]
        assert out.agg(*sums).first() == O.join(a, b, on, "inner", "hash").agg(*sums).first()
    assert "CartesianProduct" in explain(O.join(a, b, a.x < b.y, "inner", "loop"), "simple")


def test_loop_query_ends_on_larger_tables(spark):
    df = Q.queries()["join_loop_hint"](spark, "/root/testdata/sf0.1")
    assert "CartesianProduct" not in explain(df, "simple")
    folder = "/root/testdata/sf0.1"
    want = duckdb.sql(f"select o_orderkey, c_name from '{folder}/orders.parquet' join '{folder}/customer.parquet' on o_custkey = c_custkey").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize(("on", "want"), [("x = y", [(1, 1, 1, 5), (1, 1, 1, 6), (1, 2, 1, 5), (1, 2, 1, 6), (3, 4, 3, 8)]), ("x = y and v < w - 4", [(1, 1, 1, 6)]), ("x > y", [(3, 4, 1, 5), (3, 4, 1, 6)])])
def test_loop_of_small_sides_goes_through_all_pairs(spark, on, want):
    """Sizes of literal rows are known, those of rows from Python aren't."""
    a = spark.sql("select * from values (1L, 1L), (1L, 2L), (null, 3L), (3L, 4L) t(x, v)")
    b = spark.sql("select * from values (1L, 5L), (1L, 6L), (null, 7L), (3L, 8L), (9L, 9L) t(y, w)")
    for left, right in ((a, b), (a.limit(0), b)):
        out = O.join(left, right, F.expr(on), "inner", "loop")
        assert left is not a or "CartesianProduct" in explain(out, "simple")
        assert sorted(map(tuple, out.collect())) == (want if left is a else [])


def test_estimated_bytes(spark, tmp_path):
    assert estimated_bytes(spark.range(1024)) == 8192
    spark.range(300_000).write.parquet(str(tmp_path / "t"))
    stored = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert abs(estimated_bytes(spark.read.parquet(str(tmp_path / "t"))) / stored - 1) < 0.1
    many = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(10**6))).alias("x"))
    for df in (many, many.where("x > 3").groupBy("x").count(), many.persist(), spark.range(3).mapInArrow(lambda it: it, "id long")):
        assert estimated_bytes(df) == float("inf")
    many.unpersist()
    assert estimated_bytes(spark.createDataFrame([(1,)], "x long")) > 1e18
    odd = "x, Statistics(sizeInBytes=1 KB, "
    assert 0 < estimated_bytes(spark.range(1024).select(F.col("id").alias(odd)).where(F.col(f"`{odd}`").cast("string") != odd)) <= 8192


def test_key_hash_and_all_of(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, None)], "x long, y string")
    assert df.select(key_hash("x", "y").alias("h")).distinct().count() == 3
    assert df.where(all_of([])).count() == 4 and df.where(all_of([F.col("x") == 1, F.col("y") == "a"])).count() == 2


def test_matching_index():
    a, b, h = Index(1, "a", "btree", ["x", "y"]), Index(2, "b", "btree", ["y"]), Index(3, "h", "hash", ["x", "y"])
    assert matching_index([a, b, h], {"x", "y"}) is h
    assert matching_index([a, b, h], {"x"}) is a
    assert matching_index([a, b, h], {"x"}, {"y"}) is a
    assert matching_index([a, b, h], set(), {"y"}) is b
    assert matching_index([a, b, h], {"z"}) is None


def test_shell_and_loader(spark, tmp_path):
    c = Catalog()
    c.add_table("kv", [("k", 1), ("v", 2)])
    (tmp_path / "kv.csv").write_text("1,a\n22,\n")
    (tmp_path / "ghost.csv").write_text("1\n")
    db = Database(spark, str(tmp_path / "db"))
    create_tables(db, c)
    out = io.StringIO()
    assert load_files(db, c, [str(tmp_path / "kv.csv"), str(tmp_path / "ghost.csv")], out) == 2
    assert "skipped" in out.getvalue()
    out = io.StringIO()
    shell = Shell(db, out, prompt=False)
    shell.run(["", "help", "SELECT k, v", "FROM kv ORDER BY k;", "INSERT INTO kv VALUES (3, 'c');", "SELECT nope FROM kv;", "quit", "SELECT 1"])
    lines = out.getvalue().splitlines()
    assert lines[1:4] == ["k   v", "1   a", "22  NULL"]
    assert lines[4].startswith("(2 rows)") and lines[5].startswith("(1 rows)") and lines[6].startswith("Error: column 'nope'") and len(lines) == 7
    (tmp_path / "kv.csv").write_text("x,a\n")
    with pytest.raises(Exception, match="(?i)malformed|cast|parse"):
        load_files(db, c, [str(tmp_path / "kv.csv")], io.StringIO())
    assert db.execute("SELECT COUNT(*) AS n FROM kv").first().n == 3


def test_catalog_and_csv(spark, tmp_path):
    c = Catalog()
    t = c.add_table("kv", [("k", 1), ("v", 2)])
    c.add_index("kv", "by_k", "btree", ["k"])
    with pytest.raises(CatalogError):
        c.add_table("kv", [])
    c.save(str(tmp_path / "c.json"))
    again = Catalog.load(str(tmp_path / "c.json"))
    assert again.table("kv") == t and again.tables_with_column("v") == [t] and again.by_oid(2).name == "by_k"
    (tmp_path / "kv.csv").write_text("1,a\n,b\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "kv.csv"), t).collect()] == [(1, "a"), (None, "b")]


@pytest.fixture()
def db(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    t = db.begin()
    t.write("kv", spark.createDataFrame([(k, 100) for k in range(5)], "k long, v long").coalesce(1))
    t.commit()
    return db


def rows(db):
    return sorted(tuple(r) for r in db.execute("SELECT k, v FROM kv").collect())


def test_transactions(spark, db):
    assert db.execute("UPDATE kv SET v = v - 10 WHERE k = 1") == 1
    a, b = db.begin(), db.begin()
    a.execute("DELETE FROM kv WHERE k > 3")
    assert a.execute("SELECT COUNT(*) AS n FROM kv").first().n == 4
    assert b.execute("SELECT COUNT(*) AS n FROM kv").first().n == 5
    b.execute("INSERT INTO kv (v, k) VALUES (1, 9)")
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()
    crashed = db.begin()
    crashed.execute("DELETE FROM kv")
    assert Database(spark, db.folder).execute("SELECT SUM(v) AS s FROM kv").first().s == 390
    assert db.execute("DELETE FROM kv ORDER BY k DESC LIMIT 1") == 1
    crashed.abort()
    assert db.vacuum() >= 2 and db.execute("SELECT COUNT(*) AS n FROM kv").first().n == 3


def test_affected_rows_are_those_found(db):
    assert db.execute("UPDATE kv SET v = 100") == 5
    assert db.execute("UPDATE kv SET v = k, k = v WHERE k < 2") == 2
    assert rows(db) == [(2, 100), (3, 100), (4, 100), (100, 0), (100, 1)]
    assert db.execute("UPDATE kv SET v = 1 WHERE k = 77") == 0
    assert db.execute("INSERT INTO kv SELECT k, v FROM kv") == 5
    assert db.execute("DELETE FROM kv WHERE k = 100 LIMIT 3") == 3
    assert db.execute("DELETE FROM kv LIMIT 0") == 0
    assert db.execute("DELETE FROM kv") == 7 and rows(db) == []


def test_inserts_append(db):
    before = db.manifest()["kv"]["parts"]
    assert db.execute("INSERT INTO kv VALUES (7, 8), (9, NULL)") == 2
    now = db.manifest()["kv"]["parts"]
    assert before.items() <= now.items() and len(now) == 2
    assert (9, None) in [tuple(r) for r in db.execute("SELECT k, v FROM kv").collect()]


def test_changes_write_only_files_with_rows_found(spark, db):
    t = db.begin()
    t.write("kv", spark.range(1000).selectExpr("id as k", "id % 7 as v").repartitionByRange(8, "k"))
    t.commit()
    assert db.execute("UPDATE kv SET v = 70 WHERE k = 500") == 1
    (first, gone), (second, none) = db.manifest()["kv"]["parts"].items()
    assert len(gone) == 1 and none == []
    assert spark.read.parquet(f"{db.folder}/{second}").count() < 200
    assert db.execute("DELETE FROM kv WHERE v = 70 OR k < 3") == 4
    assert db.execute("DELETE FROM kv WHERE v = 6 ORDER BY k DESC LIMIT 5") == 5
    want = sorted((k, k % 7) for k in range(1000) if k not in (0, 1, 2, 500))
    want = [r for r in want if r not in [x for x in want if x[1] == 6][-5:]]
    assert rows(db) == want
    before = len(db.manifest()["kv"]["parts"])
    db.compact("kv")
    assert before > 1 and len(db.manifest()["kv"]["parts"]) == 1 and rows(db) == want
    assert db.execute("DELETE FROM kv") == len(want) and db.execute("DELETE FROM kv") == 0 and rows(db) == []
    assert db.execute("INSERT INTO kv VALUES (1, 2)") == 1 and rows(db) == [(1, 2)]


def test_crash_between_staging_and_manifest(spark, db, monkeypatch):
    t = db.begin()
    t.execute("DELETE FROM kv WHERE k = 0")
    monkeypatch.setattr(Database, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        t.commit()
    monkeypatch.undo()
    again = Database(spark, db.folder)
    assert len(rows(again)) == 5
    assert again.vacuum() == 1 and len(rows(again)) == 5


def test_torn_manifest(spark, db):
    db.execute("INSERT INTO kv VALUES (5, 5)")
    with open(f"{db.folder}/_manifest/2.json", "r+", encoding="utf-8") as f:
        f.truncate(20)
    again = Database(spark, db.folder)
    assert len(rows(again)) == 5
    assert again.execute("INSERT INTO kv VALUES (6, 6)") == 1
    assert (6, 6) in rows(again) and len(rows(again)) == 6


def test_closed_transactions_and_vacuum(db):
    reader = db.begin()
    t = db.begin()
    t.execute("DELETE FROM kv WHERE k = 1")
    t.commit()
    for use in (lambda: t.execute("SELECT * FROM kv"), lambda: t.table("kv"), t.commit):
        with pytest.raises(RuntimeError):
            use()
    assert db.vacuum() == 0  # an open transaction reads what was there at its begin
    assert reader.execute("SELECT COUNT(*) AS n FROM kv").first().n == 5
    reader.abort()
    assert db.vacuum() == 1


def test_aborts_leave_nothing(db):
    for k in range(3):
        t = db.begin()
        t.execute(f"INSERT INTO kv VALUES ({90 + k}, 1)")
        t.execute(f"UPDATE kv SET v = 0 WHERE k = {k}")
        t.abort()
    assert rows(db) == [(k, 100) for k in range(5)] and db.vacuum() == 0


def test_bank_keeps_its_total(db):
    """Transfers from several threads; those that conflict are tried again; no money comes or goes."""
    from concurrent.futures import ThreadPoolExecutor

    def transfer(k):
        for _ in range(20):
            t = db.begin()
            t.execute(f"UPDATE kv SET v = v - 7 WHERE k = {k % 5}")
            t.execute(f"UPDATE kv SET v = v + 7 WHERE k = {(k + 1) % 5}")
            try:
                t.commit()
                return True
            except ConflictError:
                continue
        return False

    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(transfer, range(6)))
    assert all(done) and sum(v for _, v in rows(db)) == 500


def test_tables_change_side_by_side(spark, db):
    t = db.begin()
    t.write("other", spark.createDataFrame([(1,)], "x long"))
    db.execute("UPDATE kv SET v = 0")
    t.commit()  # neither read nor wrote kv
    assert db.execute("SELECT * FROM other").count() == 1
