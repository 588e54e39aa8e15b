import io
import random
import sqlite3
import subprocess
import sys

import pytest

from quern.engine import connect
from quern.errors import IntegrityError, ParseError, QuernError, SchemaError, StorageError, TransactionError, TypeMismatchError
from quern.operators import syntax as X
from quern.shell import Shell, as_csv, as_list, as_table, literal, main
from quern.sources.tables import spelled


@pytest.fixture
def db(spark):
    with connect(":memory:", spark) as found:
        yield found


def test_syntax():
    tree = X.parse("SELECT a, t.b beta FROM x AS t WHERE NOT a = 1 OR b AND 2 < c < 3 GROUP BY a HAVING 1 ORDER BY b DESC LIMIT 1, 2;;")[0]
    assert tree.where.op == "OR" and tree.where.left == X.Unary("NOT", X.Binary("=", X.Name(None, "a"), X.Literal(1)))
    assert tree.where.right.right == X.Binary("<", X.Binary("<", X.Literal(2), X.Name(None, "c")), X.Literal(3))
    assert (tree.limit, tree.offset) == (X.Literal(2), X.Literal(1)) and tree.items[1].alias == "beta"
    assert [i.expr for i in X.parse("SELECT ?, -2 || ?")[0].items] == [X.Param(0), X.Binary("||", X.Unary("-", X.Literal(2)), X.Param(1))]
    assert X.Literal(1) != X.Literal(1.0) and len(X.parse("BEGIN; COMMIT TRANSACTION; ROLLBACK")) == 3
    for wrong in ("SELECT", "SELECT 1 FROM", "SELECT (1", "SELECT CASE END", "SELECT a NOT 5", "SELECT 1 2", "SELECT 'x", 'SELECT "x', "SELECT /* x", "SELECT x'0'", "SELECT #", "INSERT INTO t (a)", "CREATE TABLE t ()", "CREATE TABLE t (a INT(", "UPDATE t SET", "DELETE t", "DROP t", "FOO", "SELECT TRUE FROM SELECT"):
        with pytest.raises(ParseError):
            X.parse(wrong)


def test_constants(db):
    # Statement by statement against literal expectations.
    for sql, want in {
        "1 IS 1.0": 0, "NULL IS NULL": 1, "5 = '5'": 0, "'a' < x'00'": 1, "2 < 'a' ": 1, "1 = 1.0": 1, "NULL = NULL": None, "NULL AND 0": 0, "NULL OR 1": 1, "NOT NULL": None,
        "5 NOT BETWEEN 10 AND NULL": None, "2 IN (1, NULL)": None, "NULL NOT IN ()": None, "CASE NULL WHEN NULL THEN 'y' END": "y", "CASE WHEN NULL THEN 1 END": None,
        "-7 / 2": -3, "-7 % 3": -1, "7 / 2.0": 3.5, "1 % 0": None, "5.5 % 0": None, "' 12 ' + 1": 13, "'1e2' + 1": 101.0, "'-3x' * 2": -6, "x'31' + 1": 1, "'5' / '2'": 2, "- '2.5'": -2.5, "1 + (2 > 1)": 2,
        "1.0 || ''": "1", "1e15 || ''": "1000000000000000", "1e16 || ''": "1e+16", "123456789.125 || ''": "123456789.125", "0.0001 || ''": "0.0001", "0.00001 || ''": "1e-05", "1.5e-7 || ''": "1.5e-07", "1e300 || ''": "1e+300",
        "0.1 + 0.2 || ''": "0.30000000000000004", "2e-3 || ''": "0.002", "-0.5 || ''": "-0.5", "1e23 || ''": "1e+23", "(1 = 1) || ''": "1", "x'c3a9' || ''": "é",
        "'é' LIKE 'É'": 1, "'a\\b' LIKE 'a\\B'": 1, "'a%' LIKE 'a\\%'": 0, "'a\nb' LIKE 'a_b'": 1, "12 LIKE '1_'": 1, "SUBSTR('abcdef', -2)": "ef", "SUBSTR('abc', 0)": "abc", "SUBSTR('abc', 5)": "", "SUBSTR(12345, 2, 2)": "23",
        "SUBSTR('abc', 2, 9999999999)": "bc", "SUBSTR('abc', NULL)": None, "LENGTH(x'00ff')": 2, "LENGTH(1.0)": 1, "UPPER('ß')": "SS", "ROUND(2.5)": 3.0, "ROUND(-2.5)": -3.0, "ROUND('2.567', 2)": 2.57, "TRIM('xxaxx', 'x')": "a",
        "LTRIM('  a ')": "a ", "RTRIM('abc', 'cb')": "a", "REPLACE('aXa', 'a', '')": "X", "REPLACE('abc', '', 'x')": "abc", "INSTR('abc', '')": 1, "INSTR('abc', 'd')": 0, "TYPEOF(NULL)": "null", "TYPEOF(1 = 1)": "integer", "HEX('é')": "C3A9",
        "HEX(1.0)": "31", "MIN(2, 'a')": 2, "MAX(2, 1.5)": 2, "MIN(1, NULL)": None, "COALESCE(NULL, 'x', 1)": "x", "NULLIF(1, '1')": 1, "NULLIF(1, 1.0)": None, "IFNULL(NULL, 2.5)": 2.5, "ABS('-3')": 3, "ABS(-2.5)": 2.5, "TYPEOF(COALESCE(NULL, 1, 2.5))": "integer",
    }.items():
        found = db.scalar(f"SELECT {sql}")
        assert (found, type(found)) == (want, type(want)), sql
    for sql in ("9223372036854775807 + 1", "99999999999999999999", "COUNT(1, 2, x)", "MIN()", "ROUND(1, 2, 3)", "LENGTH(*)"):
        with pytest.raises(QuernError):
            db.scalar(f"SELECT {sql}")
    with pytest.raises(TypeMismatchError):
        db.execute("SELECT ?", ([],))


def test_text_of_reals_is_shortest(db):
    rng = random.Random(2)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 22) for _ in range(500)] + [round(rng.uniform(0, 10**k), 2) for k in range(9) for _ in range(20)] + [2.5e-300, 1.7976931348623157e308]
    db.execute("CREATE TABLE r (x REAL)")
    db.executemany("INSERT INTO r VALUES (?)", [(v,) for v in values])
    assert [t for _, t in db.query("SELECT x, x || '' FROM r")] == [spelled(v) for v in values]


def test_any_columns(db):
    db.execute("CREATE TABLE m (v); INSERT INTO m VALUES (2), ('b'), (NULL), (1.5), ('a'), (2.0), (x'01')")
    assert db.query("SELECT v FROM m ORDER BY v DESC") == [(b"\x01",), ("b",), ("a",), (2,), (2.0,), (1.5,), (None,)]
    assert db.query("SELECT v, COUNT(*) FROM m WHERE v = 2 GROUP BY v ORDER BY TYPEOF(v)") == [(2, 1), (2.0, 1)]
    assert db.query("SELECT SUM(v), COUNT(DISTINCT v), MIN(v), MAX(v), GROUP_CONCAT(DISTINCT v) FROM m WHERE v < 'b'") == [(5.5, 4, 1.5, "a", "2,1.5,a,2")]
    assert db.query("SELECT v + 1, -v, v || '!' FROM m WHERE TYPEOF(v) = 'integer'") == [(3, -2, "2!")]
    assert db.query("SELECT DISTINCT v IS 2 FROM m ORDER BY 1") == [(0,), (1,)]
    assert db.execute("SELECT v FROM m").df.dtypes == [("v", "string")]


def test_names(db):
    db.execute('CREATE TABLE t (a INTEGER, B TEXT, "odd name" REAL); INSERT INTO t VALUES (1, \'x\', 2)')
    result = db.execute("SELECT *, T.b, a+1, COUNT(*) FROM t")
    assert result.columns == ["a", "B", "odd name", "T.b", "a + 1", "COUNT(*)"] and result.rows == [(1, "x", 2.0, "x", 2, 1)]
    assert db.execute("SELECT u.*, t.a AS z FROM t JOIN t u").dicts() == [{"a": 1, "B": "x", "odd name": 2.0, "z": 1}]
    assert db.scalar("SELECT [odd name] FROM t WHERE `b` = 'x'") == 2.0
    assert db.query("SELECT t.rowid, u.rowid, rowid FROM t LEFT JOIN t u ON u.a = 9") == [(1, None, 1)]
    assert len(db.execute("SELECT a FROM t")) == 1 and [r for r in db.execute("SELECT a FROM t")] == [(1,)]


def test_order_of_rows(db):
    db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(i % 3, f"r{i}") for i in range(9)])
    assert [b for (b,) in db.query("SELECT b FROM t")] == [f"r{i}" for i in range(9)]
    assert db.query("SELECT b FROM t ORDER BY a DESC LIMIT 3") == [("r2",), ("r5",), ("r8",)]
    assert db.query("SELECT a, b, MAX(b) FROM t GROUP BY a") == [(0, "r0", "r6"), (1, "r1", "r7"), (2, "r2", "r8")]
    assert db.query("SELECT DISTINCT a FROM t ORDER BY -rowid") == db.query("SELECT DISTINCT a FROM t ORDER BY a DESC")
    assert db.scalar("SELECT GROUP_CONCAT(b, '-') FROM t WHERE a = 1") == "r1-r4-r7"
    assert db.query("SELECT x.b, y.b FROM t x JOIN t y ON x.a = y.a AND x.a = 2 LIMIT 2") == [("r2", "r2"), ("r2", "r5")]


def test_unknown_things_are_found_before_any_row(db):
    db.execute("CREATE TABLE t (a INTEGER)")
    for sql in ("SELECT nope FROM t", "SELECT a FROM t WHERE nope", "SELECT a FROM t ORDER BY nope", "SELECT a FROM t GROUP BY nope", "SELECT x.a FROM t", "UPDATE t SET nope = 1", "UPDATE t SET a = nope", "DELETE FROM t WHERE nope", "INSERT INTO t (nope) VALUES (1)"):
        with pytest.raises(SchemaError):
            db.execute(sql)


def test_transactions(db):
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b INTEGER UNIQUE)")
    with db.transaction():
        db.execute("INSERT INTO t VALUES (1, 1)")
        with pytest.raises(IntegrityError):
            db.execute("INSERT INTO t VALUES (2, 2), (3, 1)")
        db.execute("INSERT INTO t VALUES (2, NULL), (3, NULL)")
        assert db.scalar("SELECT COUNT(*) FROM t") == 3
        db.execute("INSERT INTO t VALUES (4, 4)")
        with pytest.raises(IntegrityError):
            db.execute("INSERT INTO t VALUES (5, 4)")
    with pytest.raises(ValueError), db.transaction():
        db.execute("INSERT INTO t VALUES (9, 9); UPDATE t SET b = 7 WHERE a = 1; CREATE TABLE u (x)")
        raise ValueError
    assert db.query("SELECT a, b FROM t ORDER BY a") == [(1, 1), (2, None), (3, None), (4, 4)] and db.table_names == ["t"]
    # Keys are judged on the state after the statement.
    assert db.execute("UPDATE t SET a = a + 1").rowcount == 4
    with pytest.raises(IntegrityError):
        db.execute("UPDATE t SET a = 2 WHERE a = 3")
    with pytest.raises(TransactionError):
        db.commit()


def test_folder_outlives_the_database(spark, tmp_path):
    path = str(tmp_path / "d")
    with connect(path, spark) as db:
        db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b BLOB DEFAULT x'0aff', c TEXT DEFAULT 'é🎉')")
        db.execute("INSERT INTO t (a) VALUES (1), (2)")
        db.execute("BEGIN; INSERT INTO t (a) VALUES (3)")
    with connect(path, spark) as db, connect(path, spark) as other:
        assert db.query("SELECT * FROM t") == [(1, b"\x0a\xff", "é🎉"), (2, b"\x0a\xff", "é🎉")]
        db.execute("UPDATE t SET c = 'x' WHERE a = 1")
        # The other one read before that commit.
        with pytest.raises(TransactionError):
            other.execute("DELETE FROM t")
        with pytest.raises(IntegrityError):
            db.execute("INSERT INTO t (a) VALUES (2)")
        db.execute("DELETE FROM t WHERE a = 2; INSERT INTO t (a) VALUES (2)")
        db.vacuum()
        assert db.query("SELECT a, c FROM t ORDER BY a") == [(1, "x"), (2, "é🎉")]
    (tmp_path / "d" / "manifest" / "999999999999.json").write_text("{")
    with pytest.raises(StorageError):
        connect(path, spark)


def test_folder_of_another_store(spark, tmp_path):
    # Hadoop's file system instead of the operating system's.
    def far():
        db = connect(f"file://{tmp_path}/far", spark)
        db.store.files.local = None
        db.store.tables.clear()
        db.store.version = 0
        names = db.store.files.names("manifest")
        if names:
            db.store._load(names[-1])
        return db

    with far() as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT DEFAULT 'é'); INSERT INTO t (a) VALUES (1), (2); DELETE FROM t WHERE a = 1")
    with far() as db, far() as other:
        assert db.query("SELECT a, b FROM t") == [(2, "é")]
        other.execute("INSERT INTO t VALUES (3, 'x')")
        with pytest.raises(TransactionError):
            db.execute("INSERT INTO t VALUES (4, 'y')")
        other.vacuum()
        assert other.query("SELECT a FROM t") == [(2,), (3,)] and len(db.store.files.names("manifest")) == 1


CRASH = """
import os, sys
from pyspark.sql import SparkSession
from quern.engine import connect
from quern.sources.files import Files
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
db = connect(sys.argv[1], spark)
db.execute("CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1), (2)")
Files.publish = lambda *a: os._exit(7)
db.execute("DELETE FROM t WHERE a = 1")
"""


def test_crash_before_publishing_leaves_the_old_state(spark, tmp_path):
    assert subprocess.run([sys.executable, "-c", CRASH, str(tmp_path / "d")], capture_output=True, timeout=120).returncode == 7
    with connect(str(tmp_path / "d"), spark) as db:
        assert db.query("SELECT a FROM t") == [(1,), (2,)]
        db.vacuum()
        assert db.execute("DELETE FROM t WHERE a = 1").rowcount == 1 and db.query("SELECT a FROM t") == [(2,)]


def test_sets_are_merged_and_indexes_lay_out_files(db):
    db.execute("CREATE TABLE t (a INTEGER, b TEXT); CREATE INDEX i ON t (a); CREATE INDEX j ON t (b)")
    for k in range(18):
        db.execute("INSERT INTO t VALUES (?, ?)", (18 - k, f"b{k}"))
    assert len(db.table("t").sets) < 18
    assert db.query("SELECT a FROM t") == [(18 - k,) for k in range(18)]
    assert db.execute("EXPLAIN SELECT a FROM t WHERE b = 'b3' AND a > 1").rows == [("SCAN t USING INDEX j (b=?)",)]
    plan = db.execute("SELECT b FROM t WHERE a = 3").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c0,3)" in plan and "PythonUDF" not in plan


def test_churn_against_a_model(db):
    rng = random.Random(11)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, k INTEGER, v TEXT)")
    model = {i: (rng.randrange(9), f"v{i}") for i in range(300)}
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, *x) for i, x in model.items()])
    for step in range(16):
        k, victim = rng.randrange(9), rng.choice(list(model))
        if step % 4 == 0:
            gone = [i for i, x in model.items() if x[0] == k]
            assert db.execute("DELETE FROM t WHERE k = ?", (k,)).rowcount == len(gone)
            model = {i: x for i, x in model.items() if i not in gone}
        elif step % 4 == 1:
            db.execute("UPDATE t SET k = k + 1, v = v || '+' WHERE id = ?", (victim,))
            if victim in model:
                model[victim] = (model[victim][0] + 1, model[victim][1] + "+")
        elif step % 4 == 2:
            db.execute("INSERT INTO t VALUES (?, ?, 'new')", (1000 + step, k))
            model[1000 + step] = (k, "new")
        else:
            db.execute("INSERT INTO t SELECT id + ?, k, v FROM t WHERE k = ?", (5000 * step, k))
            model |= {i + 5000 * step: x for i, x in list(model.items()) if x[0] == k}
    assert {i: (k, v) for i, k, v in db.query("SELECT * FROM t")} == model


SHARED = (
    "SELECT name, age FROM person WHERE age > 30 AND town IS NOT NULL ORDER BY age DESC, id", "SELECT town, COUNT(*), SUM(age), MIN(name) FROM person GROUP BY town ORDER BY town", "SELECT DISTINCT town FROM person ORDER BY town DESC",
    "SELECT p.name, s.item FROM person p LEFT JOIN sale s ON s.buyer = p.id AND s.n > 5 ORDER BY p.id, s.id", "SELECT p.id FROM person p LEFT JOIN sale s ON s.buyer = p.id WHERE s.id IS NULL ORDER BY p.id",
    "SELECT a.id, b.id FROM person a JOIN person b ON a.town = b.town AND a.id < b.id ORDER BY 1, 2", "SELECT item, SUM(n * price), AVG(n) FROM sale GROUP BY item HAVING COUNT(*) > 10 ORDER BY item",
    "SELECT id, age / 7, age % 7, -age, age * 1.5 FROM person ORDER BY id", "SELECT id, name || '/' || COALESCE(town, '?'), LENGTH(name), SUBSTR(name, 2, 2), UPPER(name) FROM person ORDER BY id",
    "SELECT id FROM person WHERE town NOT IN ('oslo', 'rome') OR age BETWEEN 20 AND 25 ORDER BY id", "SELECT id, CASE WHEN age < 30 THEN 'a' WHEN age < 50 THEN 'b' END FROM person ORDER BY id LIMIT 20 OFFSET 5",
    "SELECT COUNT(*), COUNT(town), COUNT(DISTINCT town), TOTAL(age) FROM person WHERE name LIKE '%a%'", "SELECT buyer, MAX(price) FROM sale GROUP BY buyer ORDER BY 2 DESC, 1 LIMIT 7", "SELECT id FROM sale WHERE NOT (n = 3 OR price > 50) ORDER BY price, id LIMIT 9",
    "SELECT s.item, COUNT(*) FROM sale s JOIN person p ON p.id = s.buyer WHERE p.age > 40 GROUP BY s.item ORDER BY COUNT(*) DESC, s.item", "SELECT INSTR(name, 'a'), REPLACE(name, 'a', 'A'), TRIM(name, 'a'), ABS(age - 40), NULLIF(town, 'oslo'), ROUND(age / 4.0, 1) FROM person ORDER BY id",
)
CHANGES = ("UPDATE person SET age = age + 1 WHERE town = 'oslo'", "DELETE FROM sale WHERE n > 7", "UPDATE sale SET price = price / 2, n = n + 1 WHERE item LIKE 'b%'", "DELETE FROM person WHERE age IS NULL")


def test_against_sqlite(db):
    rng, lite = random.Random(4), sqlite3.connect(":memory:")
    people = [(i, rng.choice(["ann", "bob", "cara", "dan"]), rng.choice([None, *range(18, 70)]), rng.choice(["oslo", "rome", "lima", None])) for i in range(80)]
    sales = [(i, rng.randrange(100), rng.choice(["bolt", "bun", "cup"]), rng.randrange(10), rng.randrange(400) / 4) for i in range(150)]
    for script in ("CREATE TABLE person (id INTEGER PRIMARY KEY, name TEXT, age INTEGER, town TEXT)", "CREATE TABLE sale (id INTEGER PRIMARY KEY, buyer INTEGER, item TEXT, n INTEGER, price REAL)"):
        db.execute(script)
        lite.execute(script)
    for sql, rows in (("INSERT INTO person VALUES (?, ?, ?, ?)", people), ("INSERT INTO sale VALUES (?, ?, ?, ?, ?)", sales)):
        db.executemany(sql, rows)
        lite.executemany(sql, rows)
    for change in (None, *CHANGES):
        if change:
            assert db.execute(change).rowcount == lite.execute(change).rowcount
        for sql in SHARED if change in (None, CHANGES[-1]) else SHARED[:3]:
            rounded = lambda rows: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]
            assert rounded(db.query(sql)) == rounded(lite.execute(sql).fetchall()), sql


def test_formats():
    columns, rows = ["id", "name"], [(1, "ada"), (2, None), (3, 'a,"b"'), (4.0, b"\x00\xff"), (1e16, True)]
    assert as_table(columns, rows[:2]).split("\n") == ["id | name", "---+-----", "1  | ada", "2  | NULL"]
    assert as_table(columns, rows[:1], headers=False) == "1 | ada"
    assert as_csv(columns, rows[:3]) == 'id,name\n1,ada\n2,\n3,"a,""b"""'
    assert as_list(columns, rows[1:], headers=False) == "2|\n3|a,\"b\"\n4|x'00ff'\n1e+16|1"
    assert [literal(x) for x in (None, 3, 1.5, "it's", b"\x00\xff")] == ["NULL", "3", "1.5", "'it''s'", "x'00ff'"]
    assert [literal(x) for x in (7.0, 1e22, float("inf"), -float("inf"), float("nan"))] == ["7.0", "1e+22", "1e999", "-1e999", "1e999 - 1e999"]


def test_dump_keeps_values_and_their_classes(spark):
    rows = [(-(2**63), float("inf"), "a\nb;--'x", -(2**63), b""), (2**63 - 1, -float("inf"), "", 7.0, b"\x00"), (None, -0.0, "\x00z", 7, None), (1, 1e-320, "é", "7", b"a"), (0, 1e22, "NULL", -float("inf"), b"'")]
    with connect(":memory:", spark) as db, connect(":memory:", spark) as other:
        db.execute("CREATE TABLE t (i INTEGER DEFAULT -9223372036854775808, r REAL DEFAULT 7.0, s TEXT, x DEFAULT 2.0, b BLOB)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
        db.execute("INSERT INTO t (r) SELECT SUM(r) FROM t")
        other.execute("\n".join(Shell(db, io.StringIO()).dump()))
        assert other.schema() == db.schema()
        asked = "SELECT i, r, s, x, b, TYPEOF(x) FROM t"
        assert repr(other.query(asked)) == repr(db.query(asked)) and repr(db.query("SELECT r, x FROM t")[-1]) == "(nan, 2.0)"
        assert db.query("SELECT -9223372036854775808, x FROM t WHERE i = -9223372036854775808 AND s LIKE 'a%'") == [(-(2**63), -(2**63))]
        with pytest.raises(QuernError):
            db.query("SELECT 9223372036854775808")


def test_shell(spark, tmp_path, monkeypatch, capsys):
    with connect(":memory:", spark) as db, connect(":memory:", spark) as other:
        shell = Shell(db, io.StringIO())

        def said(*lines):
            shell.out = io.StringIO()
            for line in lines:
                assert shell.feed(line)
            return shell.out.getvalue()

        said("CREATE TABLE t (a INTEGER,", " b TEXT DEFAULT 'it''s', c UNIQUE, PRIMARY KEY (a, b));", "CREATE INDEX ix ON t (b);")
        assert said("INSERT INTO t VALUES (1, 'x', 1.5), (2, 'it''s', NULL);") == "2 rows inserted\n"
        assert said("SELECT * FROM t ORDER BY a;").endswith("(2 rows)\n")
        assert said(".mode csv", "SELECT a, b FROM t WHERE a = 1;") == "a,b\n1,x\n"
        assert said(".headers off", ".mode list", "SELECT a, c FROM t ORDER BY a;") == "1|1.5\n2|\n"
        assert "Error: no such table" in said("SELECT * FROM missing;") and "Error:" in said("SELECT nonsense from;")
        assert said(".tables") == "t\n" and "ix" in said(".indexes t") and "2 rows" in said(".stats") and ".dump" in said(".help")
        assert "unknown command" in said(".nope") and "usage" in said(".mode x") and "no such file" in said(".read /none") and "usage" in said(".read")
        assert "Run time" in said(".timer on", "SELECT 1;")
        script = tmp_path / "s.sql"
        script.write_text("CREATE TABLE r (x INTEGER); INSERT INTO r VALUES (9);")
        said(f".read {script}", ".timer off")
        other.execute("\n".join(shell.dump()))
        assert other.schema() == db.schema()
        assert other.query("SELECT * FROM t ORDER BY a") == db.query("SELECT * FROM t ORDER BY a") and other.scalar("SELECT x FROM r") == 9
        said("SELECT 1")
        shell.flush()
        assert shell.out.getvalue() == "1\n" and not shell.feed(".quit")
    folder = str(tmp_path / "m")
    assert main([folder, "CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1)"], spark) == 0
    monkeypatch.setattr("sys.stdin", io.StringIO("SELECT a + 1\nFROM t;\n.tables\n"))
    assert main([folder], spark) == 0 and main(["--help"]) == 0 and main(["--version"]) == 0
    assert "a + 1\n-----\n2\n(1 row)\nt\n" in capsys.readouterr().out
