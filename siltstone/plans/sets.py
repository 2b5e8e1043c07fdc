"""Set operations, subqueries, derived tables, CTEs and views."""

from pyspark.sql import functions as F

from ..session import load, table
from .registry import query

c = F.col


def _keys(spark, d, where):
    return table(spark, d, "customer").where(where).select(c("c_nationkey").alias("k"))


_A, _B, _C = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0", "SELECT s_nationkey AS k FROM supplier"


@query("q_union_all", f"{_A} UNION ALL {_B}")
def q_union_all(spark, d):
    return _keys(spark, d, "c_acctbal > 5000").union(_keys(spark, d, "c_acctbal < 0"))


@query("q_union", f"{_A} UNION {_B}")
def q_union(spark, d):
    return _keys(spark, d, "c_acctbal > 5000").union(_keys(spark, d, "c_acctbal < 0")).distinct()


@query("q_intersect", f"{_A} INTERSECT {_C}")
def q_intersect(spark, d):
    return _keys(spark, d, "c_acctbal > 5000").intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("q_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20")
def q_except(spark, d):
    return table(spark, d, "nation").select(c("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_suppkey < 20").select("s_nationkey"))


@query("q_setop_nulls", "SELECT * FROM (VALUES (1), (CAST(NULL AS INT)), (1)) t(x) UNION SELECT * FROM (VALUES (CAST(NULL AS INT)), (2)) u(x)")
def q_setop_nulls(spark, d):
    """Nulls are equal to each other."""
    return spark.createDataFrame([(1,), (None,), (1,)], "x int").union(spark.createDataFrame([(None,), (2,)], "x int")).distinct()


@query("q_setop_chain", "SELECT n_nationkey AS k FROM nation EXCEPT (SELECT n_nationkey FROM nation WHERE n_nationkey > 5 EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey > 15)")
def q_setop_chain(spark, d):
    """Chains group to the right, as documented: A EXCEPT (B EXCEPT C)."""
    n = table(spark, d, "nation").select(c("n_nationkey").alias("k"))
    return n.subtract(n.where("k > 5").subtract(n.where("k > 15")))


def _same(name, sql, *tables, spark_sql=None):
    """A query whose text both engines share; subqueries are decorrelated by Catalyst."""

    @query(name, sql)
    def q(spark, d):
        return load(spark, d, *tables).sql(spark_sql or sql)

    q.__name__ = name


_same("q_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", "orders")
_same("q_scalar_subquery_empty", "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = 99) AS r FROM nation", "nation", "region")
_same("q_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "customer", "orders")
_same("q_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)", "customer", "orders")
_same("q_not_in_null_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey > 3 THEN o_custkey END FROM orders)", "customer", "orders")
_same("q_exists_corr", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)", "nation", "supplier")
_same("q_not_exists_corr", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)", "nation", "supplier")
_same("q_scalar_corr", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", "orders")
_same("q_scalar_corr_select", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS k FROM customer", "customer", "orders")
_same("q_derived_table", "SELECT t.o_orderstatus, max(t.n) AS m FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) AS t GROUP BY t.o_orderstatus", "orders")
_same("q_cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderpriority, count(*) AS n FROM big GROUP BY o_orderpriority", "orders")
_same("q_cte_multi", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT k, n FROM a WHERE n > 5) SELECT c_name, n FROM b JOIN customer ON k = c_custkey ORDER BY n DESC, c_name LIMIT 30", "orders", "customer")
_same("q_cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 200) SELECT n, n * n AS sq FROM t")
_same(
    "q_cte_recursive_tree",
    "WITH RECURSIVE t(depth, name, path) AS (SELECT 0, r_name, r_name FROM region UNION ALL SELECT depth + 1, n_name, t.path || '/' || n_name FROM t JOIN region ON r_name = t.name JOIN nation ON n_regionkey = r_regionkey WHERE depth < 1) SELECT depth, name, path FROM t",
    "region", "nation",
)
_same("q_nested_subquery", "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500))", "region", "nation", "supplier")


@query("q_view", "SELECT n_name, n FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) WHERE n > 3")
def q_view(spark, d):
    load(spark, d, "customer", "nation").sql("CREATE OR REPLACE TEMP VIEW siltstone_nation_count AS SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
    return spark.sql("SELECT n_name, n FROM siltstone_nation_count WHERE n > 3")
