"""Sources, sinks and event-time windows."""

import uuid

from ..session import prepare, table
from ..sources import files
from ..streaming import events
from .registry import query


def _folder(spark):
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/siltstone_{uuid.uuid4().hex}"


@query("q_source_scan", "SELECT p_partkey, p_name FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 1000000")
def q_source_scan(spark, d):
    return files.scan(spark, f"{d}/part.parquet", ["p_partkey", "p_name"], "p_size > 25")


@query("q_sink_bulk_load", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
def q_sink_bulk_load(spark, d):
    folder = _folder(spark)
    files.bulk_load(table(spark, d, "orders").select("o_orderkey", "o_custkey"), folder, "o_orderkey", files=4)
    return files.key_range(spark, folder, 100, 300, key="o_orderkey")


@query("q_sink_append_snapshot", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def q_sink_append_snapshot(spark, d):
    folder, nation = _folder(spark), table(spark, d, "nation")
    nation.select("n_nationkey", "n_name").write.parquet(f"{folder}/a")
    files.append(nation.where("n_regionkey = 1").selectExpr("n_nationkey + 100 AS n_nationkey", "n_name"), f"{folder}/a")
    files.snapshot(spark, f"{folder}/a", f"{folder}/b")
    return spark.read.parquet(f"{folder}/b")


@query("q_kv_delete_range", "SELECT n_nationkey, n_name FROM nation WHERE NOT (n_nationkey >= 5 AND n_nationkey < 15)")
def q_kv_delete_range(spark, d):
    return files.without_range(spark, f"{d}/nation.parquet", 5, 15, "n_nationkey").select("n_nationkey", "n_name")


@query("q_events_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_events_tumbling(spark, d):
    return events.tumbling(table(prepare(spark), d, "events"))


_SESSIONS = """
SELECT user_id, min(ts) AS start, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, s
"""


@query("q_events_sessions", _SESSIONS)
def q_events_sessions(spark, d):
    return events.sessions(table(prepare(spark), d, "events"))
