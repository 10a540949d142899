import pytest

from lumenquarry.operators.builder import series, table
from lumenquarry.operators.engine import ConstraintError, Engine, SqlError
from lumenquarry.plans.parser import parse


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.sql("CREATE TABLE boss (id INT PRIMARY KEY, name TEXT NULL DEFAULT 'x', rank INT NULL); INSERT INTO boss VALUES (1, 'a', 5), (2, 'b', NULL), (3, NULL, 5)")
    return e


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("text", [
    "SELECT 1 UNION SELECT 2", "SELECT a FROM t, u", "SELECT a FROM t RIGHT JOIN u ON 1 = 1", "SELECT SUM(a) OVER () FROM t", "SELECT a FROM t GROUP BY ALL", "SELECT DISTINCT ON (a) a FROM t",
    "SELECT a FROM t ORDER BY a NULLS FIRST", "SELECT a FROM t JOIN u USING (a)", "SELECT a FROM (SELECT 1)", "SELECT a LIKE 'x' ESCAPE 'y' FROM t", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT a.b.c FROM t",
])
def test_refused(text):
    with pytest.raises(SqlError):
        parse(text)


@pytest.mark.parametrize("text, want", [
    ("1 / 2", 0.5), ("7 / CAST(2 AS INT)", 3), ("3 NOT IN (1, NULL)", True), ("SUBSTR('World', 0, 3)", "Wo"), ("SUBSTR('World', -1, 3)", "W"), ("INITCAP('h/i jk')", "H/I Jk"), ("GCD(12, 18)", 6), ("LCM(4, 6)", 12),
    ("5 ! ", 120), ("NULL XOR TRUE", None), ("LOG(8, 2)", 3.0), ("CONCAT_WS(',', DEDUP([1, 1, 2, 1]))", "1,2,1"), ("'a_b' LIKE 'a\\_b'", False), ("POSITION('' IN 'a')", 0), ("FORMAT(DATE '2020-02-03', '%d.%m.%Y')", "03.02.2020"),
])
def test_expressions(spark, text, want):
    got = Engine(spark).query(f"SELECT {text} AS v").first()[0]
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_strict_nulls(spark):
    e = Engine(spark)
    assert e.query("SELECT NULL OR TRUE AS a, NULL AND FALSE AS b, 1 IS NULL OR TRUE AS c").first() == (None, None, True)
    assert Engine(spark, strict=False).query("SELECT NULL OR TRUE AS v").first()[0] is True
    for bad in ("GREATEST(1, NULL)", "CAST(NULL AS TEXT) LIKE 'a%'", "1 << CAST(64 AS INT)", "CAST(1 AS INT) >> CAST(-1 AS INT)"):
        with pytest.raises(Exception, match="of a NULL|more bits"):
            e.query(f"SELECT {bad} AS v").collect()


def test_null_order_and_bare_columns(engine):
    assert [r[0] for r in engine.query("SELECT id FROM boss ORDER BY rank DESC, id").collect()] == [2, 1, 3]
    assert rows(engine.query("SELECT rank, COUNT(name) AS n FROM boss GROUP BY rank")) == [(5, 1), (None, 1)]


def test_changes_and_constraints(engine):
    assert engine.sql("UPDATE boss SET rank = rank + 1 WHERE rank = 5; DELETE FROM boss WHERE id = 2") == [2, 1]
    assert rows(engine.query("SELECT id, rank FROM boss")) == [(1, 6), (3, 6)]
    for bad in ("INSERT INTO boss VALUES (1, 'z', 1)", "INSERT INTO boss (name) VALUES ('z')", "UPDATE boss SET id = 9"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    engine.sql("CREATE TABLE item (k INT, boss_id INT NULL, FOREIGN KEY (boss_id) REFERENCES boss (id)); INSERT INTO item VALUES (1, 1), (2, NULL)")
    for bad in ("INSERT INTO item VALUES (3, 77)", "DELETE FROM boss WHERE id = 1", "DROP TABLE boss"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)


def test_transaction_alter_index_function(engine):
    engine.sql("BEGIN; DELETE FROM boss; ROLLBACK")
    assert engine.query("SELECT COUNT(*) AS n FROM boss").first()[0] == 3
    engine.sql("ALTER TABLE boss ADD COLUMN tag TEXT NULL DEFAULT 't'; ALTER TABLE boss RENAME COLUMN tag TO label; CREATE INDEX by_rank ON boss (rank + 1)")
    assert engine.query("SELECT label FROM boss WHERE id = 1").first()[0] == "t"
    assert rows(engine.query("SELECT INDEX_NAME FROM CATALOG_INDEXES")) == [("PRIMARY",), ("by_rank",)]
    engine.sql("CREATE FUNCTION twice(x INT, y INT DEFAULT 2) RETURN x * y")
    assert engine.query("SELECT twice(4) AS a, twice(4, 3) AS b").first() == (8, 12)
    assert engine.sql("SHOW FUNCTIONS") == [["TWICE(x: INT, y: INT)"]]


def test_rollback_of_an_index(engine):
    engine.sql("BEGIN; CREATE INDEX gone ON boss (rank); ROLLBACK")
    assert engine.sql("SHOW INDEXES FROM boss") == [[]]


def test_foreign_key_to_the_own_table(engine):
    engine.sql("CREATE TABLE staff (id INT PRIMARY KEY, chief INT NULL, FOREIGN KEY (chief) REFERENCES staff (id)); INSERT INTO staff VALUES (1, NULL), (2, 1), (3, 3)")
    for bad in ("INSERT INTO staff VALUES (4, 9)", "DELETE FROM staff WHERE id = 1", "UPDATE staff SET chief = 7 WHERE id = 2"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    assert engine.sql("DELETE FROM staff WHERE id >= 2; DELETE FROM staff") == [2, 1]


def test_storage_names(engine):
    engine.sql("CREATE TABLE here (id INT) ENGINE = parquet")
    with pytest.raises(SqlError):
        engine.sql("CREATE TABLE there (id INT) ENGINE = elsewhere")


def test_random_number_of_a_seed(engine):
    got = [r[0] for r in engine.query("SELECT RAND(1) AS r FROM boss").collect()]
    assert len(set(got)) == 1 and 0 <= got[0] < 1 and got[0] != engine.query("SELECT RAND(2) AS r").first()[0]


def test_schemaless(engine):
    engine.sql("""CREATE TABLE docs; INSERT INTO docs VALUES ('{"a": 1, "b": {"c": 2}}'), ('{"a": 5}')""")
    assert rows(engine.query("SELECT a AS a, zz AS zz FROM docs WHERE a = '5'")) == [("5", None)]


def test_builder(engine):
    q = table("boss").select().filter("rank = 5").filter("id > 1").project("id, rank + 1 AS r").order_by("id DESC").limit(1)
    assert rows(q.run(engine)) == [(3, 6)]
    assert rows(series(3).project("N AS k").run(engine)) == [(1,), (2,), (3,)]


def test_lists_and_maps(engine):
    engine.sql("""CREATE TABLE bag (id INT, m MAP, l LIST); INSERT INTO bag VALUES (1, '{"b": 1, "a": [5, {"c": "x"}]}', '[2, 1, 1]'), (2, '{"a": [5, {"c": "x"}], "b": 1}', '[2, 1, 1]'), (3, '{}', '[]')""")
    got = rows(engine.query("SELECT id, LENGTH(m) AS a, IS_EMPTY(l) AS b, CONCAT_WS(',', KEYS(m)) AS c, CONCAT_WS(',', SORT(DEDUP(l))) AS d, CONCAT_WS(',', PREPEND(l, 9)) AS e, UNWRAP(m, 'a.1.c') AS f FROM bag WHERE id <> 2"))
    assert got == [(1, 2, False, "a,b", "1,2", "9,2,1,1", "x"), (3, 0, True, "", "", "9", None)]
    assert engine.query("SELECT DISTINCT m, l FROM bag").count() == 2 and engine.query("SELECT DISTINCT * FROM (SELECT m, l FROM bag) AS t").count() == 2
    engine.sql("""UPDATE bag SET l = '[7]' WHERE id = 3""")
    assert rows(engine.query("SELECT l[0] AS x FROM bag")) == [("2",), ("2",), ("7",)]


def test_only_named_tables_are_read(spark, tmp_path):
    e = Engine(spark, str(tmp_path)).folder("/nowhere", "missing").register("here", spark.range(3))
    assert e.query("SELECT COUNT(*) AS n FROM here").first()[0] == 3
    with pytest.raises(SqlError):
        e.query("SELECT * FROM elsewhere")
    with pytest.raises(Exception, match="(?i)path"):
        e.query("SELECT * FROM missing")


def test_insert_adds_folders(engine):
    before = engine.tables["boss"].paths
    assert engine.sql("INSERT INTO boss VALUES (4, 'd', 1); INSERT INTO boss SELECT * FROM boss WHERE id > 9") == [1, 0]
    after = engine.tables["boss"].paths
    assert after[: len(before)] == before and len(after) == len(before) + 2
    for bad in ("INSERT INTO boss VALUES (4, 'e', 1)", "INSERT INTO boss VALUES (5, 'e', 1), (5, 'f', 1)"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    engine.sql("BEGIN; INSERT INTO boss VALUES (6, 'g', 1); ROLLBACK")
    assert engine.tables["boss"].paths == after and [r[0] for r in engine.query("SELECT id FROM boss ORDER BY id").collect()] == [1, 2, 3, 4]
    engine.register("given", engine.query("SELECT id FROM boss"))
    assert engine.sql("INSERT INTO given VALUES (9)") == [1] and engine.query("SELECT COUNT(*) AS n FROM given").first()[0] == 5
