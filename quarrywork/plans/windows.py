"""Ordered analytics and top rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import ranking, usage
from ..session import table
from . import query


@query("W01", """SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def latest_active(spark, sf_dir):
    active = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return ranking.latest(active, "o_custkey", F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("W02", """SELECT o_orderkey, row_number() OVER w AS version, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lineage(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(w).cast("long").alias("version"), F.lag("o_orderkey").over(w).alias("previous")
    )


@query("W05", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def history(spark, sf_dir):
    last = ranking.top_in_groups(table(spark, sf_dir, "events"), 100, "event_type", F.desc("ts"), F.desc("event_id"))
    return last.select("event_type", "event_id")


@query("W06", """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), 2) AS used FROM events""")
def budget(spark, sf_dir):
    found = usage.budget(table(spark, sf_dir, "events"), "user_id", "ts", "value", 3600)
    return found.select("event_id", F.round("used", 2).alias("used"))


@query("W09", """SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 10""")
def job_order(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    order = (rank, F.col("o_orderpriority"), F.desc("o_orderdate"), F.col("o_orderkey"))
    return ranking.top(table(spark, sf_dir, "orders"), 10, *order).select("o_orderkey")


@query("T03", """SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 60 AS has_more FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40)""")
def pagination(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.page(orders, 40, 20, F.desc("o_totalprice"), F.col("o_orderkey")).drop("o_totalprice")


@query("T04", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20")
def multi_key(spark, sf_dir):
    return ranking.top(table(spark, sf_dir, "customer"), 20, F.desc("c_acctbal"), F.col("c_name")).select("c_custkey")


@query("T05", "SELECT o_orderkey FROM orders ORDER BY CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END, o_orderkey LIMIT 50")
def custom_rank(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    rank = F.when(first == "1", 0).when(first == "2", 1).otherwise(2)
    return ranking.top(table(spark, sf_dir, "orders"), 50, rank, F.col("o_orderkey")).select("o_orderkey")
