"""Scans, filters, projections, predicates, sort and limit."""

from pyspark.sql import functions as F

from ..functions import conditional, maths
from ..session import prepare, table
from .registry import query


@query("q_scan_count", "SELECT count(*) AS n FROM lineitem")
def q_scan_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("q_scan_covering", "SELECT DISTINCT l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01'")
def q_scan_covering(spark, d):
    """Only the filtered column is read."""
    return table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1998-06-01'").select("l_shipdate").distinct()


@query("q_scan_point", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 33")
def q_scan_point(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderkey") == 33).select("o_orderkey", "o_custkey", "o_totalprice")


@query("q_project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def q_project_expr(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"))


@query("q_filter_compare", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F' AND o_orderkey < 100000")
def q_filter_compare(spark, d):
    return table(spark, d, "orders").where((F.col("o_totalprice") >= 200000) & (F.col("o_orderstatus") != "F") & (F.col("o_orderkey") < 100000)).select("o_orderkey", "o_totalprice")


@query("q_filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 300000) AND NOT (o_orderpriority = '1-URGENT' OR o_custkey < 20)")
def q_filter_and_or_not(spark, d):
    c = F.col
    return table(spark, d, "orders").where(((c("o_orderstatus") == "O") | (c("o_totalprice") > 300000)) & ~((c("o_orderpriority") == "1-URGENT") | (c("o_custkey") < 20))).select("o_orderkey")


@query("q_filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_filter_in(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("q_filter_not_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def q_filter_not_in(spark, d):
    return table(spark, d, "orders").where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("q_filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def q_filter_between(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber")


@query("q_filter_not_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 3 AND 48")
def q_filter_not_between(spark, d):
    return table(spark, d, "lineitem").where(~F.col("l_quantity").between(3, 48)).select("l_orderkey", "l_linenumber")


@query("q_like_prefix", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def q_like_prefix(spark, d):
    """Reaches the scan as StringStartsWith."""
    return table(spark, d, "customer").where(F.col("c_name").like("Customer#00000001%")).select("c_custkey", "c_name")


@query("q_like_infix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A_%E%'")
def q_like_infix(spark, d):
    return table(spark, d, "part").where(F.col("p_type").like("%A_%E%")).select("p_partkey", "p_type")


@query("q_not_like", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%e%'")
def q_not_like(spark, d):
    return table(spark, d, "part").where(~F.col("p_name").like("%e%")).select("p_partkey", "p_name")


_OUTER = "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000"


def _outer(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 350000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("q_is_null", f"SELECT c_custkey FROM ({_OUTER}) WHERE o_orderkey IS NULL")
def q_is_null(spark, d):
    return _outer(spark, d).where(F.col("o_orderkey").isNull()).select("c_custkey")


@query("q_is_not_null", f"SELECT c_custkey, o_orderkey FROM ({_OUTER}) WHERE o_orderkey IS NOT NULL")
def q_is_not_null(spark, d):
    return _outer(spark, d).where(F.col("o_orderkey").isNotNull())


_TRUTH = "(VALUES (1, true, true), (2, true, false), (3, true, NULL), (4, false, false), (5, false, NULL), (6, CAST(NULL AS BOOLEAN), NULL)) AS t(id, a, b)"
_TRUTH_SQL = f"SELECT id, CAST(a AND b AS INT) AS and_, CAST(a OR b AS INT) AS or_, CAST(NOT b AS INT) AS not_ FROM {_TRUTH}"


@query("q_three_valued_logic", _TRUTH_SQL)
def q_three_valued_logic(spark, d):
    return spark.sql(_TRUTH_SQL)


@query("q_arith_int_div", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, mod(l_orderkey, 7) AS r, -l_orderkey // 7 AS nq, l_orderkey * 2 + l_linenumber - 1 AS m FROM lineitem")
def q_arith_int_div(spark, d):
    k, seven = F.col("l_orderkey"), F.lit(7)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", maths.int_div(k, seven).alias("q"), maths.mod(k, seven).alias("r"), maths.int_div(-k, seven).alias("nq"), (k * 2 + F.col("l_linenumber") - 1).alias("m")
    )


@query("q_case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'F' THEN 1 END AS done FROM orders")
def q_case_when(spark, d):
    p = F.col("o_totalprice")
    size = conditional.case((p > 300000, F.lit("large")), (p > 100000, F.lit("middle")), otherwise=F.lit("small"))
    return table(spark, d, "orders").select("o_orderkey", size.alias("size"), conditional.case((F.col("o_orderstatus") == "F", F.lit(1))).alias("done"))


@query("q_coalesce", f"SELECT c_custkey, coalesce(o_orderkey, -c_custkey, 0) AS k FROM ({_OUTER})")
def q_coalesce(spark, d):
    return _outer(spark, d).select("c_custkey", conditional.coalesce(F.col("o_orderkey"), -F.col("c_custkey"), F.lit(0)).alias("k"))


@query("q_nullif", f"SELECT c_custkey, nullif(c_custkey, 5) AS a, nullif(c_custkey, o_orderkey) AS b FROM ({_OUTER})")
def q_nullif(spark, d):
    c = F.col("c_custkey")
    return _outer(spark, d).select("c_custkey", conditional.nullif(c, F.lit(5)).alias("a"), conditional.nullif(c, F.col("o_orderkey")).alias("b"))


@query("q_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def q_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


_LITERALS = "SELECT 1 + 2 * 3 AS a, 'x' AS b, CAST(NULL AS STRING) AS c, -(4 - 6) AS d, CAST(1.5 AS DOUBLE) AS e"


@query("q_select_no_from", _LITERALS)
def q_select_no_from(spark, d):
    return spark.sql(_LITERALS)


@query("q_order_multi", "SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders WHERE o_totalprice > 250000 ORDER BY o_orderpriority DESC, o_orderstatus, o_orderkey")
def q_order_multi(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 250000").select("o_orderpriority", "o_orderstatus", "o_orderkey").orderBy(F.desc("o_orderpriority"), "o_orderstatus", "o_orderkey")


@query("q_order_desc_limit", f"SELECT c_custkey, o_orderkey FROM ({_OUTER}) ORDER BY o_orderkey DESC NULLS LAST, c_custkey LIMIT 20")
def q_order_desc_limit(spark, d):
    return _outer(spark, d).orderBy(F.desc("o_orderkey"), "c_custkey").limit(20)


@query("q_order_nulls_first", f"SELECT c_custkey, o_orderkey FROM ({_OUTER}) ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 20")
def q_order_nulls_first(spark, d):
    return _outer(spark, d).orderBy("o_orderkey", "c_custkey").limit(20)


@query("q_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30")
def q_limit_offset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(30).limit(15)


@query("q_limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
def q_limit_zero(spark, d):
    return table(spark, d, "orders").select("o_orderkey").limit(0)


@query("q_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def q_topk(spark, d):
    """Planned as TakeOrderedAndProject: each task keeps 25 rows."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


_PARAM = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ? AND o_totalprice > ?"


@query("q_param_query", _PARAM.replace("?", "7", 1).replace("?", "1000.0"))
def q_param_query(spark, d):
    prepare(spark)
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = :c AND o_totalprice > :p", args={"c": 7, "p": 1000.0}, orders=table(spark, d, "orders"))
