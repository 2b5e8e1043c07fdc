"""Definitions, changes, constraints, actions, triggers, transactions and introspection through the SQL front."""

import pytest
from siltstone.operators.database import Database, bind, split_statements
from siltstone.operators.tables import ConstraintViolation, Exists, NotFound
from siltstone.types import TypeMismatch


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_select_order_and_null(db):
    db.script("CREATE TABLE users (id INT PRIMARY KEY, name TEXT NOT NULL, age INT); INSERT INTO users VALUES (1, 'Alice', 30), (2, 'Bob', NULL), (3, 'Cy', 25)")
    assert [tuple(r) for r in db.query("SELECT name, age FROM users ORDER BY age, id").collect()] == [("Bob", None), ("Cy", 25), ("Alice", 30)]
    assert rows(db.query("SELECT COUNT(*), COUNT(age), SUM(age), AVG(age) FROM users")) == [(3, 2, 55, 27.5)]
    assert db.query("SELECT * FROM users LIMIT 0").collect() == []
    assert rows(db.query("SELECT id FROM users WHERE age > $1 AND name = $2", (20, "Cy"))) == [(3,)]
    assert db.execute("DELETE FROM users WHERE age IS NULL") == 1
    assert db.execute("UPDATE users SET age = age + 1 WHERE id = 1") == 1
    assert rows(db.query("SELECT id, age FROM users")) == [(1, 31), (3, 25)]


def test_strict_types(db):
    db.execute("CREATE TABLE t (a INT, b TEXT, c FLOAT)")
    for values in ("('x', 'y', 1.0)", "(1, 2, 1.0)", "(1, 'y', 2)", "(1.5, 'y', 1.0)"):
        with pytest.raises(TypeMismatch):
            db.execute(f"INSERT INTO t VALUES {values}")
    db.execute("INSERT INTO t VALUES (1, 'y', 1.0), (NULL, NULL, NULL)")
    assert db.query("SELECT * FROM t").count() == 2


def test_failed_statement_changes_nothing(db):
    db.script("CREATE TABLE t (a INT PRIMARY KEY); INSERT INTO t VALUES (1)")
    for s in ("INSERT INTO t VALUES (2), (1)", "INSERT INTO t VALUES (NULL)", "UPDATE t SET a = NULL", "INSERT INTO nope VALUES (1)", "UPDATE t SET zz = 1", "SELEKT 1", "DROP TABLE nope", "CREATE TABLE t (b INT)"):
        with pytest.raises((ConstraintViolation, NotFound, Exists, SyntaxError)):
            db.execute(s)
    assert rows(db.query("SELECT * FROM t")) == [(1,)]


def test_fk_actions_over_two_levels_and_two_children(db):
    db.script("""
      CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE b (id INT PRIMARY KEY, a INT REFERENCES a(id) ON DELETE CASCADE ON UPDATE CASCADE);
      CREATE TABLE c (id INT PRIMARY KEY, b INT, FOREIGN KEY (b) REFERENCES b(id) ON DELETE CASCADE); CREATE TABLE d (id INT, a INT REFERENCES a(id) ON DELETE SET NULL ON UPDATE SET NULL);
      INSERT INTO a VALUES (1), (2), (3); INSERT INTO b VALUES (10, 1), (20, 2), (30, NULL); INSERT INTO c VALUES (100, 10), (200, 20); INSERT INTO d VALUES (5, 1), (6, 2), (7, 3)""")
    assert db.execute("DELETE FROM a WHERE id = 1") == 1
    assert rows(db.query("SELECT id FROM b")) == [(20,), (30,)] and rows(db.query("SELECT id FROM c")) == [(200,)]
    db.execute("UPDATE a SET id = 22 WHERE id = 2")
    assert (20, 22) in rows(db.query("SELECT id, a FROM b WHERE a IS NOT NULL"))
    assert rows(db.query("SELECT id FROM d WHERE a IS NULL")) == [(5,), (6,)]
    with pytest.raises(ConstraintViolation):
        db.execute("DROP TABLE a")


def test_self_reference(db):
    db.script("CREATE TABLE n (id INT PRIMARY KEY, up INT REFERENCES n(id) ON DELETE CASCADE); INSERT INTO n VALUES (1, NULL), (2, 1), (3, 2), (4, NULL)")
    db.execute("DELETE FROM n WHERE id = 1")
    assert rows(db.query("SELECT id FROM n")) == [(4,)]


def test_restrict_and_no_action(db):
    for action in ("RESTRICT", "NO ACTION"):
        db.script(f"CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE q (p INT REFERENCES p(id) ON DELETE {action} ON UPDATE {action}); INSERT INTO p VALUES (1), (2); INSERT INTO q VALUES (1)")
        for s in ("DELETE FROM p", "UPDATE p SET id = 9 WHERE id = 1"):
            with pytest.raises(ConstraintViolation):
                db.execute(s)
        assert db.execute("DELETE FROM p WHERE id = 2") == 1
        db.script("DROP TABLE q; DROP TABLE p")


def test_upsert(db):
    db.script("CREATE TABLE t (k INT PRIMARY KEY, v TEXT, n INT DEFAULT 1); INSERT INTO t (k, v) VALUES (1, 'a'), (2, 'b')")
    assert db.execute("INSERT INTO t (k, v) VALUES (1, 'x'), (3, 'c'), (3, 'd') ON CONFLICT (k) DO NOTHING") == 1
    assert db.execute("INSERT INTO t (k, v) VALUES (2, 'y'), (4, 'e') ON CONFLICT (k) DO UPDATE SET v = excluded.v, n = n + 1") == 2
    assert rows(db.query("SELECT k, v, n FROM t")) == [(1, "a", 1), (2, "y", 2), (3, "c", 1), (4, "e", 1)]
    with pytest.raises(ConstraintViolation):
        db.execute("INSERT INTO t (k, v) VALUES (1, 'x') ON CONFLICT (v) DO NOTHING")


def test_defaults_checks_and_autoincrement(db):
    db.script("CREATE TABLE t (id INT AUTOINCREMENT PRIMARY KEY, score INT DEFAULT 7 CHECK (score > 0), note TEXT DEFAULT 'none'); INSERT INTO t (note) VALUES ('a'), ('b'); INSERT INTO t VALUES (DEFAULT, DEFAULT, DEFAULT)")
    assert rows(db.query("SELECT * FROM t")) == [(1, 7, "a"), (2, 7, "b"), (3, 7, "none")]
    db.execute("INSERT INTO t (score) VALUES (NULL)")
    with pytest.raises(ConstraintViolation):
        db.execute("INSERT INTO t (score) VALUES (0)")
    db.execute("TRUNCATE TABLE t")
    db.execute("INSERT INTO t (note) VALUES ('c')")
    assert db.query("SELECT id FROM t").first()[0] >= 5


def test_triggers(db):
    db.script("""
      CREATE TABLE acc (id INT PRIMARY KEY, bal INT); CREATE TABLE log (id INT, what TEXT); CREATE TABLE total (k INT, n INT); INSERT INTO total VALUES (1, 0);
      CREATE TRIGGER a AFTER INSERT ON acc WHEN NEW.bal > 10 BEGIN INSERT INTO log VALUES (NEW.id, 'big'); UPDATE total SET n = 1 WHERE k = 1; END;
      CREATE TRIGGER b BEFORE DELETE ON acc BEGIN DELETE FROM log WHERE log.id = OLD.id; END;
      INSERT INTO acc VALUES (1, 5), (2, 50), (3, 60)""")
    assert rows(db.query("SELECT id FROM log")) == [(2,), (3,)] and rows(db.query("SELECT n FROM total")) == [(1,)]
    db.execute("DELETE FROM acc WHERE id = 2")
    assert rows(db.query("SELECT id FROM log")) == [(3,)]
    db.execute("DROP TRIGGER a")
    db.execute("INSERT INTO acc VALUES (9, 99)")
    assert db.query("SELECT * FROM log").count() == 1


def test_endless_triggers_stop(db):
    db.script("CREATE TABLE t (a INT); CREATE TRIGGER x AFTER INSERT ON t BEGIN INSERT INTO t VALUES (NEW.a + 1); END")
    with pytest.raises(ConstraintViolation):
        db.execute("INSERT INTO t VALUES (1)")
    assert db.query("SELECT * FROM t").count() == 0


def test_transactions(db):
    db.script("CREATE TABLE t (a INT); BEGIN; INSERT INTO t VALUES (1); SAVEPOINT s; INSERT INTO t VALUES (2); SAVEPOINT u; DELETE FROM t; ROLLBACK TO SAVEPOINT s; INSERT INTO t VALUES (3); COMMIT")
    assert rows(db.query("SELECT a FROM t")) == [(1,), (3,)]
    db.script("BEGIN; DROP TABLE t; ROLLBACK")
    assert db.query("SELECT * FROM t").count() == 2
    for s in ("COMMIT", "ROLLBACK", "SAVEPOINT x", "RELEASE x"):
        with pytest.raises((ConstraintViolation, NotFound)):
            db.execute(s)


def test_snapshots_stay_readable(db):
    db.script("CREATE TABLE t (a INT); INSERT INTO t VALUES (1)")
    before = db.query("SELECT * FROM t")
    db.execute("UPDATE t SET a = 2")
    assert rows(before) == [(1,)] and rows(db.query("SELECT * FROM t")) == [(2,)]


def test_views_ctas_and_set_operations(db):
    db.script("CREATE TABLE t (id INT, name TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd'); CREATE VIEW v AS SELECT id FROM t WHERE id > 1; CREATE VIEW w AS SELECT id FROM v WHERE id < 4; CREATE TABLE u AS SELECT id, name FROM t WHERE id < 3")
    assert rows(db.query("SELECT * FROM w")) == [(2,), (3,)] and rows(db.query("SELECT COUNT(*) FROM u")) == [(2,)]
    assert rows(db.query("SELECT id FROM t EXCEPT SELECT id FROM v EXCEPT SELECT id FROM w")) == [(1,), (2,), (3,)]
    assert [r[0] for r in db.query("SELECT id FROM t UNION SELECT id FROM v UNION ALL SELECT id FROM w ORDER BY id LIMIT 3").collect()] == [1, 2, 3]
    assert rows(db.query("SELECT id FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.id = t.id) FOR UPDATE SKIP LOCKED")) == [(1,), (2,)]
    assert rows(db.query("WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 150) SELECT COUNT(*) FROM n")) == [(150,)]
    db.execute("DROP VIEW w")
    with pytest.raises(Exception):
        db.query("SELECT * FROM w").collect()


def test_indexes_and_pragma(db):
    db.script("CREATE TABLE t (id INT PRIMARY KEY, name TEXT); INSERT INTO t VALUES (1, 'A'), (2, 'b'); CREATE UNIQUE INDEX i ON t (LOWER(name))")
    with pytest.raises(ConstraintViolation):
        db.execute("INSERT INTO t VALUES (3, 'B')")
    db.execute("DROP INDEX i ON t")
    db.execute("INSERT INTO t VALUES (3, 'B')")
    assert rows(db.query("PRAGMA table_info(t)"))[0][:3] == (0, "id", "INT") and db.query("PRAGMA database_list").count() == 1
    assert "Rows: 3" in db.query("EXPLAIN ANALYZE SELECT * FROM t").first()[0]


def test_functions(db):
    db.execute("CREATE FUNCTION half(x INT) RETURNS INT AS $$ x / 2 $$ LANGUAGE SQL")
    db.execute("CREATE FUNCTION factorial(n INT) RETURNS INT AS $$CASE WHEN n <= 1 THEN 1 ELSE n * factorial(n - 1) END$$")
    assert tuple(db.query("SELECT half(7), factorial(5)").first()) == (3, 120)
    db.execute("DROP FUNCTION half")
    with pytest.raises(Exception):
        db.query("SELECT half(7)").collect()


def test_full_text(db):
    db.script("CREATE VIRTUAL TABLE a USING fts5(title, body) tokenize='porter'; INSERT INTO a VALUES ('x', 'Walking in the rain'), ('y', 'rainy walks'), ('z', 'sun')")
    assert rows(db.query("SELECT title FROM a WHERE a MATCH 'walked AND rain'")) == [("x",)]
    assert rows(db.query("SELECT title FROM a WHERE body MATCH 'sun OR walked NOT rainy'")) == [("x",), ("z",)]


def test_prepared_and_binding(db):
    db.execute("CREATE TABLE t (a INT, b TEXT)")
    insert = db.prepare("INSERT INTO t VALUES ($1, $2)")
    insert.execute(1, "it's")
    insert.execute(2, None)
    assert rows(db.prepare("SELECT b FROM t WHERE a = ?").execute(1)) == [("it's",)]
    assert bind("SELECT '?' , ?", (5,)) == "SELECT '?' , 5"
    with pytest.raises(ValueError):
        db.query("SELECT $2", (1,))


def test_splitting():
    assert split_statements("SELECT ';'; CREATE FUNCTION f() RETURNS INT AS $$ a; b $$; -- x;\nSELECT CASE WHEN 1 THEN 2 END;") == ["SELECT ';'", "CREATE FUNCTION f() RETURNS INT AS $$ a; b $$", "SELECT CASE WHEN 1 THEN 2 END"]


def test_changes_do_not_depend_on_splits(spark, tmp_path, monkeypatch):
    """Rows are found again though every read deals the files out anew."""
    db = Database(spark, f"{tmp_path}/db")
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    db.insert("t", spark.range(200_000).repartition(7).selectExpr("id", "id AS v"))
    read, sizes = db.read, iter(["1m", "40k", "200k", "10k"] * 50)

    def other_splits(name):
        db.spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return read(name)

    monkeypatch.setattr(db, "read", other_splits)
    assert db.execute("DELETE FROM t WHERE id = 100000") == 1
    assert db.execute("UPDATE t SET v = -1 WHERE MOD(id, 50000) = 7") == 4
    assert db.execute("INSERT INTO t VALUES (5, 0), (200000, 1) ON CONFLICT (id) DO UPDATE SET v = -2") == 2
    got = db.query("SELECT COUNT(*), COUNT(DISTINCT id), MIN(CASE WHEN id = 100000 THEN 0 ELSE 1 END) FROM t").first()
    assert tuple(got) == (200_000, 200_000, 1)
    assert rows(db.query("SELECT id, v FROM t WHERE v < 0")) == [(5, -2), (7, -1), (50007, -1), (100007, -1), (150007, -1)]
