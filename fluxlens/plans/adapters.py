"""Flows derived from tables of orders and events, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import ipv4_from_number

LINES = """
SELECT l_orderkey * 8 + l_linenumber AS flow_id,
 CAST(167772160 + l_suppkey AS BIGINT) AS src_ip,
 CAST(3221225984 + l_partkey % 256 AS BIGINT) AS dst_ip,
 CAST(1024 + l_orderkey % 60000 AS INT) AS src_port,
 CAST(CASE l_partkey % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 ELSE 0 END AS INT) AS dst_port,
 CAST(CASE l_linenumber WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 17 WHEN 4 THEN 17 WHEN 5 THEN 1 WHEN 6 THEN 47 ELSE 50 END AS INT) AS protocol,
 CAST(l_orderkey % 64 AS INT) AS tcp_flags,
 CAST(l_quantity AS BIGINT) AS packets,
 CAST(floor(l_extendedprice) AS BIGINT) AS octets,
 CAST(l_orderkey % 100000 AS BIGINT) AS flow_start,
 CAST(l_orderkey % 100000 + l_partkey * l_linenumber * 17 AS BIGINT) AS flow_finish,
 l_shipdate AS recv_time
FROM lineitem"""
EVENTS = """
SELECT event_id AS flow_id, ts AS recv_time,
 CAST(167772160 + user_id AS BIGINT) AS src_ip,
 CAST(167772160 + user_id % 8 AS BIGINT) AS agent_ip,
 CAST(CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 17 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 47 ELSE 89 END AS INT) AS protocol,
 CAST(floor(value * 100) AS BIGINT) AS octets,
 CAST(1 + event_id % 16 AS BIGINT) AS packets
FROM events"""


def _table(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def line_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _table(spark, sf_dir, "lineitem", LINES)
    return flows.withColumns({"src_addr": ipv4_from_number(F.col("src_ip")), "dst_addr": ipv4_from_number(F.col("dst_ip"))})


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = _table(spark, sf_dir, "events", EVENTS)
    return flows.withColumns({"src_addr": ipv4_from_number(F.col("src_ip")), "agent_addr": ipv4_from_number(F.col("agent_ip"))})
