"""Joins. Physical strategies are left to Spark: broadcast below its size threshold, else sort-merge with skew handling."""

from pyspark.sql import functions as F

from ..session import table
from .registry import query

c = F.col


@query("q_join_inner", "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
def q_join_inner(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 200000"), c("c_custkey") == c("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


@query("q_join_left", "SELECT p_partkey, l_orderkey, l_linenumber FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 49")
def q_join_left(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity > 49"), c("p_partkey") == c("l_partkey"), "left").select("p_partkey", "l_orderkey", "l_linenumber")


@query("q_join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def q_join_right(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("q_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def q_join_cross(spark, d):
    """5 by 25 rows, whatever the scale."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("q_join_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND n_regionkey = 1")
def q_join_theta(spark, d):
    """The inequality is tested against the 25 rows of nation."""
    return table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation").where("n_regionkey = 1")), c("s_nationkey") < c("n_nationkey")).select("s_suppkey", "n_nationkey")


@query("q_join_equi_residual", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")
def q_join_equi_residual(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), (c("o_orderkey") == c("l_orderkey")) & (c("l_extendedprice") > c("o_totalprice") / 2)).select("o_orderkey", "l_linenumber")


@query("q_join_left_residual", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 5000")
def q_join_left_residual(spark, d):
    """A row whose key matches but whose residual fails stays, with nulls."""
    return table(spark, d, "customer").join(table(spark, d, "nation"), (c("c_nationkey") == c("n_nationkey")) & (c("c_acctbal") > 5000), "left").select("c_custkey", "n_name")


@query(
    "q_join_chain",
    "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name",
)
def q_join_chain(spark, d):
    t = lambda n: table(spark, d, n)
    big = t("orders").join(t("customer"), c("c_custkey") == c("o_custkey")).join(t("nation"), c("n_nationkey") == c("c_nationkey")).join(t("region"), c("r_regionkey") == c("n_regionkey"))
    return big.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("q_join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_join_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey")


@query("q_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("q_join_self_derived", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def q_join_self_derived(spark, d):
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    return a.join(b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("left_name"), c("b.n_name").alias("right_name"))


@query("q_join_group_order", "SELECT n_name, count(*) AS n, round(avg(s_acctbal), 2) AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10")
def q_join_group_order(spark, d):
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 2).alias("bal")).orderBy(F.desc("n"), "n_name").limit(10)


@query("q_join_subquery_in_on", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def q_join_subquery_in_on(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity = 50").select("l_orderkey")
    orders = table(spark, d, "orders").join(keys, c("o_orderkey") == c("l_orderkey"), "left_semi")
    return table(spark, d, "customer").join(orders, c("c_custkey") == c("o_custkey")).select("c_custkey", "o_orderkey")


@query("q_join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 5")
def q_join_full(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "supplier"), c("c_custkey") == c("s_suppkey") + 5, "full").select("c_custkey", "s_suppkey")
