"""Statements that change tables; the result is the final state, over small copies of the test tables."""

from pyspark.sql import functions as F

from ..operators.database import Database
from ..operators.tables import ConstraintViolation, Exists, NotFound
from ..session import table
from ..types import TypeMismatch
from .registry import query

_NATION = "CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey INT)"
_REGION = "CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name TEXT UNIQUE)"


def _db(spark, d, *tables, nation=_NATION, region=_REGION):
    """A database that holds copies of region and nation, as far as they are asked for."""
    db = Database(spark)
    if "region" in tables:
        db.execute(region)
        db.insert("region", table(db.spark, d, "region").select("r_regionkey", "r_name"))
    if "nation" in tables:
        db.execute(nation)
        db.insert("nation", table(db.spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return db


def _dml(name, sql, statements, result, *tables, **defs):
    @query(name, sql)
    def run(spark, d):
        db = _db(spark, d, *tables, **defs)
        for s in statements:
            try:
                db.execute(s.removeprefix("!"))
                if s.startswith("!"):
                    raise AssertionError(f"no violation: {s}")
            except ConstraintViolation:
                if not s.startswith("!"):
                    raise
        return db.query(result)

    run.__name__ = name


_ALL = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_BASE = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"
_dml("q_dml_insert_values", f"{_BASE} UNION ALL VALUES (100, 'ATLANTIS', 9), (101, 'MU', NULL)", ["INSERT INTO nation VALUES (100, 'ATLANTIS', 9)", "INSERT INTO nation (n_name, n_nationkey) VALUES ('MU', 101)"], _ALL, "nation")
_dml("q_dml_insert_select", f"{_BASE} UNION ALL SELECT n_nationkey + 100, upper(n_name) || '2', n_regionkey FROM nation WHERE n_regionkey = 1", ["INSERT INTO nation SELECT n_nationkey + 100, CONCAT(UPPER(n_name), '2'), n_regionkey FROM nation WHERE n_regionkey = 1"], _ALL, "nation")
_dml("q_dml_update", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 2 THEN 'ASIAN' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 2 THEN n_nationkey ELSE n_regionkey END::BIGINT AS n_regionkey FROM nation", ["UPDATE nation SET n_name = 'ASIAN', n_regionkey = n_nationkey WHERE n_regionkey = 2"], _ALL, "nation")
_dml("q_dml_delete", f"{_BASE} WHERE NOT (n_regionkey IN (0, 3) OR n_name LIKE 'U%')", ["DELETE FROM nation WHERE n_regionkey IN (0, 3) OR n_name LIKE 'U%'"], _ALL, "nation")
_dml("q_dml_delete_subquery", f"{_BASE} WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')", ["DELETE FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')"], _ALL, "nation", "region")
_dml("q_dml_upsert_nothing", f"{_BASE} UNION ALL VALUES (200, 'NEW', 1)", ["INSERT INTO nation VALUES (3, 'OTHER', 1), (200, 'NEW', 1), (200, 'AGAIN', 2) ON CONFLICT (n_nationkey) DO NOTHING"], _ALL, "nation")
_dml(
    "q_dml_upsert_update",
    "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'SEEN' ELSE n_name END AS n_name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL VALUES (200, 'NEW', 1)",
    ["INSERT INTO nation VALUES (3, 'OTHER', 1), (200, 'NEW', 1) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = 'SEEN'"], _ALL, "nation",
)
_dml("q_dml_ctas", "SELECT n_regionkey::BIGINT AS k, count(*) AS n FROM nation GROUP BY n_regionkey", ["CREATE TABLE t AS SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey"], "SELECT k, n FROM t", "nation")
_dml("q_dml_cte_insert", f"{_BASE} UNION ALL SELECT n_nationkey + 500, n_name, 7 FROM nation WHERE n_nationkey < 3", ["WITH few AS (SELECT * FROM nation WHERE n_nationkey < 3) INSERT INTO nation SELECT n_nationkey + 500, n_name, 7 FROM few"], _ALL, "nation")
_dml("q_dml_alter_add", "SELECT n_nationkey::BIGINT AS n_nationkey, 5::BIGINT AS grade, NULL::VARCHAR AS note FROM nation", ["ALTER TABLE nation ADD COLUMN grade INT DEFAULT 5", "ALTER TABLE nation ADD COLUMN note TEXT"], "SELECT n_nationkey, grade, note FROM nation", "nation")
_dml("q_dml_alter_drop", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation", ["ALTER TABLE nation DROP COLUMN n_regionkey"], "SELECT * FROM nation", "nation")
_dml("q_dml_alter_rename", "SELECT n_nationkey::BIGINT AS id, n_name FROM nation", ["ALTER TABLE nation RENAME COLUMN n_nationkey TO id", "ALTER TABLE nation RENAME TO countries"], "SELECT id, n_name FROM countries", "nation")
_dml("q_dml_truncate", "SELECT 0::BIGINT AS n", ["TRUNCATE TABLE nation"], "SELECT COUNT(*) AS n FROM nation", "nation")
_dml(
    "q_dml_check_violations", f"{_BASE} UNION ALL VALUES (90, 'OK', NULL)",
    ["!INSERT INTO nation VALUES (91, 'BAD', -1)", "!UPDATE nation SET n_regionkey = 99 WHERE n_nationkey = 1", "INSERT INTO nation VALUES (90, 'OK', NULL)"], _ALL, "nation",
    nation="CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT CHECK (n_regionkey >= 0), CHECK (n_regionkey < 10))",
)
_dml("q_dml_not_null_violations", _BASE, ["!INSERT INTO nation VALUES (90, NULL, 1)", "!INSERT INTO nation (n_name) VALUES ('X')", "!UPDATE nation SET n_name = NULL"], _ALL, "nation")
_dml(
    "q_dml_unique_violations", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL VALUES (50, NULL), (51, NULL)",
    ["!INSERT INTO region VALUES (1, 'X')", "!INSERT INTO region VALUES (60, 'ASIA')", "!INSERT INTO region VALUES (60, 'Y'), (60, 'Z')", "INSERT INTO region VALUES (50, NULL), (51, NULL)"], "SELECT r_regionkey, r_name FROM region", "region",
)
_CHILD = "CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT REFERENCES region(r_regionkey) {})"
_dml("q_dml_fk_violations", f"{_BASE} UNION ALL VALUES (90, 'OK', NULL)", ["!INSERT INTO nation VALUES (90, 'X', 77)", "!UPDATE nation SET n_regionkey = 77 WHERE n_nationkey = 0", "!DELETE FROM region WHERE r_regionkey = 1", "INSERT INTO nation VALUES (90, 'OK', NULL)"], _ALL, "region", "nation", nation=_CHILD.format(""))
_dml("q_dml_fk_cascade", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE n_regionkey WHEN 2 THEN 20 ELSE n_regionkey END::BIGINT AS n_regionkey FROM nation WHERE n_regionkey <> 1", ["DELETE FROM region WHERE r_regionkey = 1", "UPDATE region SET r_regionkey = 20 WHERE r_regionkey = 2"], "SELECT n_nationkey, n_regionkey FROM nation", "region", "nation", nation=_CHILD.format("ON DELETE CASCADE ON UPDATE CASCADE"))
_dml("q_dml_fk_set_null", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey > 2 THEN n_regionkey END::BIGINT AS n_regionkey FROM nation", ["DELETE FROM region WHERE r_regionkey < 2", "UPDATE region SET r_regionkey = 20 WHERE r_regionkey = 2"], "SELECT n_nationkey, n_regionkey FROM nation", "region", "nation", nation=_CHILD.format("ON DELETE SET NULL ON UPDATE SET NULL"))
_dml(
    "q_dml_trigger_audit", "SELECT 'ins' AS what, NULL::VARCHAR AS old, 'NEW' AS new UNION ALL SELECT 'upd', r_name, 'A:' || r_name FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'del', r_name, NULL FROM region WHERE r_regionkey = 4",
    [
        "CREATE TABLE audit (what TEXT, old TEXT, new TEXT)",
        "CREATE TRIGGER ti AFTER INSERT ON region BEGIN INSERT INTO audit VALUES ('ins', NULL, NEW.r_name); END",
        "CREATE TRIGGER tu AFTER UPDATE ON region WHEN OLD.r_regionkey < 2 BEGIN INSERT INTO audit VALUES ('upd', OLD.r_name, NEW.r_name); END",
        "CREATE TRIGGER td BEFORE DELETE ON region BEGIN INSERT INTO audit VALUES ('del', OLD.r_name, NULL); END",
        "INSERT INTO region VALUES (70, 'NEW')", "UPDATE region SET r_name = CONCAT('A:', r_name) WHERE r_regionkey < 3", "DELETE FROM region WHERE r_regionkey = 4",
    ], "SELECT what, old, new FROM audit", "region",
)
_dml(
    "q_dml_savepoint", f"{_BASE} WHERE n_regionkey <> 0 UNION ALL VALUES (300, 'KEPT', 1)",
    ["BEGIN", "DELETE FROM nation WHERE n_regionkey = 0", "SAVEPOINT a", "DELETE FROM nation", "ROLLBACK TO a", "INSERT INTO nation VALUES (300, 'KEPT', 1)", "RELEASE SAVEPOINT a", "COMMIT", "BEGIN", "TRUNCATE TABLE nation", "ROLLBACK"], _ALL, "nation",
)
_dml(
    "q_dml_autoincrement", "VALUES (1, 'a'), (2, 'b'), (10, 'c'), (11, 'd') ORDER BY 1",
    ["CREATE TABLE u (id INT AUTOINCREMENT PRIMARY KEY, name TEXT)", "INSERT INTO u (name) VALUES ('a'), ('b')", "INSERT INTO u VALUES (10, 'c')", "INSERT INTO u (name) VALUES ('d')"], "SELECT id AS col0, name AS col1 FROM u",
)
_dml("q_pragma_table_info", "SELECT * FROM (VALUES (0, 'n_nationkey', 'INT', 1, NULL, 1), (1, 'n_name', 'TEXT', 1, NULL, 0), (2, 'n_regionkey', 'INT', 0, NULL::VARCHAR, 0)) t(cid, name, type, \"notnull\", dflt_value, pk)", [], "PRAGMA table_info(nation)", "nation")
_dml("q_pragma_table_list", "SELECT * FROM (VALUES ('main', 'nation', 'table', 3), ('main', 'region', 'table', 2), ('main', 'v', 'view', NULL)) t(schema, name, type, ncol)", ["CREATE VIEW v AS SELECT r_name FROM region"], "PRAGMA table_list", "nation", "region")
_dml("q_pragma_index_list", "SELECT * FROM (VALUES (0, 'region_r_regionkey_key', 1, 'pk'), (1, 'region_r_name_key', 1, 'u'), (2, 'ix', 0, 'c')) t(seq, name, \"unique\", origin)", ["CREATE INDEX ix ON region (r_name)"], "PRAGMA index_list(region)", "region")
def _explained(name, statement, sql, *tests):
    @query(name, sql)
    def run(spark, d):
        """Whether the plan names what must be in it."""
        plan = _db(spark, d, "nation").query(statement)
        return plan.select(*[F.col("plan").rlike(pattern).alias(column) for column, pattern in tests])

    run.__name__ = name


_explained("q_explain", "EXPLAIN SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT true AS scan, true AS pushed, true AS pruned", ("scan", "Scan parquet"), ("pushed", r"PushedFilters: \[[^\]]*EqualTo\(n_regionkey,1\)"), ("pruned", "ReadSchema: struct<n_name:string,n_regionkey:bigint>"))
_explained("q_explain_analyze", "EXPLAIN ANALYZE SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT true AS rows, true AS seconds FROM (SELECT count(*) AS n FROM nation WHERE n_regionkey = 1) WHERE n = 5", ("rows", "Rows: 5"), ("seconds", r"Seconds: \d"))
_dml("q_fts_virtual_table", "SELECT title FROM (VALUES ('a'), ('c')) t(title)", ["CREATE VIRTUAL TABLE articles USING fts5(title, body)", "INSERT INTO articles VALUES ('a', 'The quick, brown fox'), ('b', 'A slow fox'), ('c', 'quick don''t stop')"], "SELECT title FROM articles WHERE articles MATCH 'quick AND fox OR dont'")


@query("q_sql_front", "SELECT n_regionkey::BIGINT AS k, count(*) AS n, max(strlen(n_name))::BIGINT AS m, (sum(n_nationkey) // count(*))::BIGINT AS mean FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def q_sql_front(spark, d):
    """Dialect calls in a query: LENGTH in bytes, whole division."""
    return _db(spark, d, "nation").query("SELECT n_regionkey AS k, COUNT(*) AS n, MAX(LENGTH(n_name)) AS m, SUM(n_nationkey) / COUNT(*) AS mean FROM nation GROUP BY n_regionkey HAVING COUNT(*) > 1")


_dml("q_dml_cte_delete", f"{_BASE} WHERE n_regionkey NOT IN (0, 1)", ["WITH gone AS (SELECT r_regionkey FROM region WHERE r_regionkey < 2) DELETE FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM gone)"], _ALL, "nation", "region")
_dml("q_dml_cte_update", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_regionkey = 3 THEN 33 ELSE n_regionkey END::BIGINT AS n_regionkey FROM nation", ["WITH a AS (SELECT r_regionkey AS k FROM region WHERE r_name = 'EUROPE'), b AS (SELECT k FROM a) UPDATE nation SET n_regionkey = 33 WHERE n_regionkey IN (SELECT k FROM b)"], _ALL, "nation", "region")
_dml(
    "q_dml_rename_fk", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 2 THEN 20 ELSE n_regionkey END::BIGINT AS n_regionkey FROM nation WHERE n_regionkey <> 1",
    ["ALTER TABLE region RENAME COLUMN r_regionkey TO id", "CREATE UNIQUE INDEX ix ON region (r_name)", "ALTER TABLE region RENAME COLUMN r_name TO title", "!INSERT INTO region VALUES (60, 'ASIA')", "!INSERT INTO nation VALUES (90, 'X', 77)", "DELETE FROM region WHERE id = 1", "UPDATE region SET id = 20 WHERE id = 2"],
    "SELECT n_nationkey, n_regionkey FROM nation", "region", "nation", nation=_CHILD.format("ON DELETE CASCADE ON UPDATE CASCADE"),
)
_dml("q_sql_to_char", "SELECT '2024-03-09 13:42:07' AS a, '13h42, 09.03.' AS b, '01:42' AS c", [], "SELECT TO_CHAR('2024-03-09 13:42:07', 'YYYY-MM-DD HH24:MI:SS') AS a, TO_CHAR('2024-03-09 13:42:07', 'HH24hMI, DD.MM.') AS b, TO_CHAR('2024-03-09 13:42:07', 'HH12:MI') AS c")
_dml("q_sql_setop_chain_cte", "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey <= 5 OR n_nationkey > 15", [], "WITH c AS (SELECT n_nationkey AS k FROM nation) SELECT k FROM (SELECT k FROM c EXCEPT SELECT k FROM c WHERE k > 5 EXCEPT SELECT k FROM c WHERE k > 15) AS t", "nation")
_dml(
    "q_sql_int_div_shadow", "SELECT n_nationkey::BIGINT AS k, (n_nationkey // 2)::BIGINT AS half, (n_nationkey * 0.5)::DOUBLE AS real_half, (n_nationkey // 4)::BIGINT AS quarter FROM nation",
    ["CREATE TABLE other (n_nationkey FLOAT, half TEXT)"],
    "SELECT n_nationkey AS k, half, x / 2 AS real_half, half / 2 AS quarter FROM (SELECT n_nationkey, n_nationkey / 2 AS half, CAST(n_nationkey AS FLOAT) AS x FROM nation) AS t", "nation",
)
_dml("q_sql_substring_bytes", "SELECT 'straße' AS a, 'e'::VARCHAR AS b, 7::BIGINT AS n", [], "SELECT SUBSTRING('die straße', 5) AS a, SUBSTRING('straße', STRPOS('straße', 'e'), 1) AS b, LENGTH('straße') AS n")
_dml("q_dml_drop_table", "SELECT 'main' AS schema, 'region' AS name, 'table' AS type, 2 AS ncol", ["CREATE INDEX ix ON nation (n_name)", "DROP TABLE nation", "DROP TABLE IF EXISTS nation"], "PRAGMA table_list", "nation", "region")
_dml("q_dml_drop_index", "SELECT 0 AS seq, 'nation_n_nationkey_key' AS name, 1 AS \"unique\", 'pk' AS origin", ["CREATE UNIQUE INDEX ix ON nation (n_name)", "INSERT INTO nation VALUES (90, 'X', 1)", "!INSERT INTO nation VALUES (91, 'X', 1)", "DROP INDEX ix ON nation", "INSERT INTO nation VALUES (91, 'X', 1)"], "PRAGMA index_list(nation)", "nation")


@query("q_pragma_database_list", "SELECT 0 AS seq, 'main' AS name, true AS there")
def q_pragma_database_list(spark, d):
    return _db(spark, d).query("PRAGMA database_list").select("seq", "name", (F.length("file") > 0).alias("there"))


@query("q_dml_insert_params", f"{_BASE} UNION ALL VALUES (100, 'O''HARE', NULL), (101, 'Ü', 2)")
def q_dml_insert_params(spark, d):
    """The same prepared INSERT with values of its own each time."""
    db = _db(spark, d, "nation")
    insert = db.prepare("INSERT INTO nation VALUES ($1, $2, $3)")
    insert.execute(100, "O'HARE", None)
    insert.execute(101, "Ü", 2)
    return db.query(_ALL)


@query("q_sql_params_not_finite", "SELECT 'Infinity'::DOUBLE AS a, true AS b")
def q_sql_params_not_finite(spark, d):
    return _db(spark, d).query("SELECT ? AS a, ? < 0 AS b", (float("inf"), float("-inf")))


@query("q_errors", "SELECT * FROM (VALUES ('exists'), ('missing column'), ('missing table'), ('syntax'), ('type')) t(error)")
def q_errors(spark, d):
    """Each kind of error by its own class; none of the statements changes anything."""
    db, out = _db(spark, d, "nation"), []
    for error, kind, statement in (("exists", Exists, _NATION), ("missing table", NotFound, "DELETE FROM nowhere"), ("missing column", NotFound, "UPDATE nation SET nothing = 1"), ("type", TypeMismatch, "INSERT INTO nation VALUES ('x', 'y', 1)"), ("syntax", SyntaxError, "FROB nation")):
        try:
            db.execute(statement)
        except kind:
            out.append((error,))
    return spark.createDataFrame(out, "error string")


@query("q_udf_drop", "SELECT true AS before, false AS after")
def q_udf_drop(spark, d):
    """A function is there until it is dropped."""
    db = _db(spark, d)
    db.execute("CREATE FUNCTION sil_twice(a INT) RETURNS INT AS $$ a * 2 $$ LANGUAGE SQL")
    before = db.query("SELECT sil_twice(4) = 8 AS v").first()[0]
    db.execute("DROP FUNCTION sil_twice")
    try:
        after = db.query("SELECT sil_twice(4) AS v").first()[0] is not None
    except Exception:  # noqa: BLE001 - any analysis error means it is gone
        after = False
    return spark.createDataFrame([(before, after)], "before boolean, after boolean")


@query("q_dml_delete_large", "SELECT count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS orders, max(CASE WHEN l_partkey % 7 = 3 THEN 9 ELSE l_linenumber END)::BIGINT AS top, sum(CASE WHEN l_partkey % 7 = 3 THEN 9 ELSE l_linenumber END)::BIGINT AS lines FROM lineitem WHERE l_suppkey % 5 <> 1")
def q_dml_delete_large(spark, d):
    """Changes of a table of many splits, which each read of it may deal out in another way."""
    db = _db(spark, d)
    db.execute("CREATE TABLE lineitem (l_orderkey INT, l_partkey INT, l_suppkey INT, l_linenumber INT)")
    db.insert("lineitem", table(db.spark, d, "lineitem").selectExpr(*[f"CAST({c} AS BIGINT) AS {c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]))
    size = db.spark.conf.get("spark.sql.files.maxPartitionBytes")
    db.execute("DELETE FROM lineitem WHERE MOD(l_suppkey, 5) = 1")
    db.spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # of this database's own session
    db.execute("UPDATE lineitem SET l_linenumber = 9 WHERE MOD(l_partkey, 7) = 3")
    db.spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return db.query("SELECT COUNT(*) AS n, SUM(l_orderkey) AS orders, MAX(l_linenumber) AS top, SUM(l_linenumber) AS lines FROM lineitem")
