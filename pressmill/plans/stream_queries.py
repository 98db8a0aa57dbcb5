"""Queries on windows, grouping sets and frames over the event and order tables (additions of this engine), with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.sources.tables import table
from pressmill.streaming import windows

_Q: dict = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _ms(df, *cols):
    """Times as text, to the second."""
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


_TUMBLING = "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS win_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"


@_register(_TUMBLING)
def ext_tumbling_windows(spark, d):
    return _ms(windows.tumbling(table(spark, d, "events"), "1 hour"), "win_start")


@_register(_TUMBLING)
def ext_streamed_windows(spark, d):
    """The same through Structured Streaming, with a watermark."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return _ms(windows.latest_of_stream(windows.tumbling(stream, "1 hour", "2 hours")), "win_start")


@_register("SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS win_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events WHERE ts IS NOT NULL) GROUP BY w")
def ext_sliding_windows(spark, d):
    return _ms(windows.sliding(table(spark, d, "events"), "60 minutes", "30 minutes"), "win_start")


@_register("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS win_start, strftime(max(ts) + INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S') AS win_end, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session_windows(spark, d):
    return _ms(windows.sessions(table(spark, d, "events"), "30 minutes"), "win_start", "win_end")


@_register("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    g = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    return g.agg((F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("bigint").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).cast("double").alias("qty"))


@_register("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@_register("SELECT o_custkey, o_orderkey, rank() OVER w AS rk, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ext_rank_and_lag(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("bigint").alias("rk"), F.lag("o_orderkey").over(w).alias("before"))


@_register("SELECT n.n_name, count(*) AS orders, CAST(round(sum(o.o_totalprice), 2) AS DOUBLE) AS price FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name")
def ext_orders_by_nation(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).cast("double").alias("price"))


@_register()
def ext_approx_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
