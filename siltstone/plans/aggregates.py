"""Aggregates and windows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table
from .registry import query

PRICING = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
"""


@query("q_pricing_summary", PRICING)
def q_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return (
        li.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query("q_agg_scalar", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_returnflag) AS hi, min(l_extendedprice) AS lop FROM lineitem")
def q_agg_scalar(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("s"), F.round(F.avg("l_quantity"), 6).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_returnflag").alias("hi"), F.min("l_extendedprice").alias("lop")
    )


@query("q_agg_empty", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, avg(l_quantity) AS a, min(l_returnflag) AS lo FROM lineitem WHERE l_quantity < 0")
def q_agg_empty(spark, d):
    """No rows: a count of 0, else nulls."""
    return table(spark, d, "lineitem").where("l_quantity < 0").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"), F.avg("l_quantity").alias("a"), F.min("l_returnflag").alias("lo"))


@query("q_agg_count_col", "SELECT count(*) AS n, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def q_agg_count_col(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.agg(F.count("*").alias("n"), F.count("o_orderkey").alias("k"))


@query("q_group_multi_key", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus, o_orderpriority")
def q_group_multi_key(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last"))


@query("q_group_expr", "SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
def q_group_expr(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count("*").alias("n"))


@query("q_group_null_key", "SELECT k, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS k FROM orders) GROUP BY k")
def q_group_null_key(spark, d):
    return table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("q_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 1000000")
def q_having(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return g.where("n > 12 AND t > 1000000").select("o_custkey", "n", F.round("t", 2).alias("total"))


@query("q_array_agg", "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS names FROM nation GROUP BY n_regionkey")
def q_array_agg(spark, d):
    """A JSON array as text, nulls left out, in a fixed order."""
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("names"))


@query("q_string_agg", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def q_string_agg(spark, d):
    return spark.sql("SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", nation=table(spark, d, "nation"))


@query("q_string_agg_empty", "SELECT n_regionkey, coalesce(string_agg(CASE WHEN n_regionkey > 2 THEN n_name END, ',' ORDER BY n_name), '') AS names FROM nation GROUP BY n_regionkey")
def q_string_agg_empty(spark, d):
    """Only nulls in a group: an empty text."""
    return spark.sql("SELECT n_regionkey, coalesce(listagg(CASE WHEN n_regionkey > 2 THEN n_name END, ',') WITHIN GROUP (ORDER BY n_name), '') AS names FROM {nation} GROUP BY n_regionkey", nation=table(spark, d, "nation"))


@query("q_agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
def q_agg_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n"))


@query("q_agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def q_agg_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# Windows: a total order wherever the result depends on it, and explicit ROWS frames.
_BY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_RUN = f"{_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
by = lambda: W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
run = lambda: by().rowsBetween(W.unboundedPreceding, W.currentRow)


def _orders(spark, d, *cols):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", *cols)


def _window(name, sql, col):
    @query(name, f"SELECT o_orderkey, {sql} FROM orders")
    def q(spark, d):
        return table(spark, d, "orders").select("o_orderkey", *(col() if isinstance(col(), list) else [col()]))

    q.__name__ = name


_window("q_win_row_number", f"row_number() OVER ({_BY}) AS r", lambda: F.row_number().over(by()).cast("long").alias("r"))
_PRIO = lambda: W.partitionBy("o_custkey").orderBy("o_orderpriority")
_window("q_win_rank", "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r", lambda: F.rank().over(_PRIO()).cast("long").alias("r"))
_window("q_win_rank_multi", "rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_custkey DESC) AS r", lambda: F.rank().over(W.partitionBy("o_orderstatus").orderBy("o_orderpriority", F.desc("o_custkey"))).cast("long").alias("r"))
_window("q_win_dense_rank", "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r", lambda: F.dense_rank().over(_PRIO()).cast("long").alias("r"))
_window("q_win_lag", f"lag(o_orderkey) OVER ({_BY}) AS a, lag(o_orderkey, 2, -1) OVER ({_BY}) AS b", lambda: [F.lag("o_orderkey").over(by()).alias("a"), F.lag("o_orderkey", 2, -1).over(by()).alias("b")])
_window("q_win_lead", f"lead(o_orderkey) OVER ({_BY}) AS a, lead(o_orderkey, 2, -1) OVER ({_BY}) AS b", lambda: [F.lead("o_orderkey").over(by()).alias("a"), F.lead("o_orderkey", 2, -1).over(by()).alias("b")])
_window("q_win_first_value", f"first_value(o_orderkey) OVER ({_RUN}) AS a", lambda: F.first("o_orderkey").over(run()).alias("a"))
_AHEAD = lambda: by().rowsBetween(W.currentRow, W.unboundedFollowing)
_window("q_win_last_value", f"last_value(o_orderkey) OVER ({_RUN}) AS a, last_value(o_orderkey) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b", lambda: [F.last("o_orderkey").over(run()).alias("a"), F.last("o_orderkey").over(_AHEAD()).alias("b")])
_window("q_win_sum_running", f"round(sum(o_totalprice) OVER ({_RUN}), 2) AS s, (sum(o_orderkey) OVER ({_RUN}))::BIGINT AS k", lambda: [F.round(F.sum("o_totalprice").over(run()), 2).alias("s"), F.sum("o_orderkey").over(run()).alias("k")])
_NEAR = lambda: by().rowsBetween(-2, 1)
_window("q_win_avg_frame", f"round(avg(o_totalprice) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a", lambda: F.round(F.avg("o_totalprice").over(_NEAR()), 4).alias("a"))
_PAST = lambda: by().rowsBetween(-3, -1)
_window("q_win_frame_before", f"count(*) OVER ({_BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n, max(o_orderkey) OVER ({_BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m", lambda: [F.count("*").over(_PAST()).alias("n"), F.max("o_orderkey").over(_PAST()).alias("m")])
_window("q_win_count", f"count(*) OVER ({_RUN}) AS n, count(nullif(o_orderstatus, 'F')) OVER ({_RUN}) AS k", lambda: [F.count("*").over(run()).alias("n"), F.count(F.nullif(F.col("o_orderstatus"), F.lit("F"))).over(run()).alias("k")])
_window("q_win_min_max", f"min(o_totalprice) OVER ({_RUN}) AS lo, max(o_orderpriority) OVER ({_RUN}) AS hi", lambda: [F.min("o_totalprice").over(run()).alias("lo"), F.max("o_orderpriority").over(run()).alias("hi")])
_ALL = lambda: W.partitionBy("o_custkey")
_window("q_win_partition_only", "count(*) OVER (PARTITION BY o_custkey) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s", lambda: [F.count("*").over(_ALL()).alias("n"), F.round(F.sum("o_totalprice").over(_ALL()), 2).alias("s")])
_window("q_win_ntile", f"ntile(4) OVER ({_BY}) AS t", lambda: F.ntile(4).over(by()).cast("long").alias("t"))
