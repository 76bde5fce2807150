"""Scan suspects, exporters, admission, and order within logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.addresses import in_network, order_key


def scan_suspects(df: DataFrame, source: str = "src_addr", n: int = 10) -> DataFrame:
    """(source, protocol, dst_port, flows, percent): the ``n`` commonest, and a row OTHER for the rest.

    Protocol and port are text; zero or absent ones are ``???``.  Ties: by source, protocol, port.
    """
    name = lambda c: F.coalesce(F.nullif(F.col(c).cast("bigint"), F.lit(0)).cast("string"), F.lit("???"))
    grouped = df.groupBy(F.col(source).cast("string").alias("source"), name("protocol").alias("protocol"), name("dst_port").alias("dst_port")).agg(F.count("*").alias("flows"))
    listed = grouped.orderBy(F.desc("flows"), "source", "protocol", "dst_port").limit(n)
    whole = grouped.agg(F.sum("flows").alias("whole"))  # reuses the counts of the list
    top = listed.crossJoin(F.broadcast(whole))  # n rows and one
    rest = whole.crossJoin(F.broadcast(listed.agg(F.coalesce(F.sum("flows"), F.lit(0)).alias("shown"))))
    other = rest.select(F.lit("OTHER").alias("source"), (F.coalesce("whole", F.lit(0)) - F.col("shown")).alias("flows"), "whole")
    both = top.unionByName(other, allowMissingColumns=True)
    return both.select("source", "protocol", "dst_port", "flows", (F.col("flows") * 100.0 / F.col("whole")).alias("percent"))


def peer_stats(packets: DataFrame, agent: str = "agent", time: str = "recv_time") -> DataFrame:
    """Per exporter: packets, flows, invalid, no_template, first_seen, last_valid, last_version.

    ``packets`` has flows, invalid and no_template (counts) and version for each packet.
    """
    valid = F.col("invalid") == 0
    return packets.groupBy(agent).agg(
        F.count("*").alias("packets"),
        F.sum("flows").alias("flows"),
        F.sum("invalid").alias("invalid"),
        F.sum("no_template").alias("no_template"),
        F.min(time).alias("first_seen"),
        F.max(F.when(valid, F.col(time))).alias("last_valid"),
        F.max_by("version", F.when(valid, F.struct(F.col(time), F.col("version")))).alias("last_version"),
    )


def in_address_order(stats: DataFrame, agent: str = "agent_addr") -> DataFrame:
    """Exporters by address, IPv4 first."""
    return stats.orderBy(*order_key(F.col(agent)))


def admitted(address: Column, networks: Sequence[str] | None) -> Column:
    """True if the exporter is in one of the networks; an empty list admits all, ``any`` too."""
    if not networks or "any" in networks:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [in_network(address, n) for n in networks])


def admit(packets: DataFrame, networks: Sequence[str] | None, address: str = "agent_addr") -> DataFrame:
    """Packets of admitted exporters, filtered before anything is decoded."""
    return packets.where(admitted(F.col(address), networks))


def no_longer_admitted(peers: DataFrame, networks: Sequence[str] | None, address: str = "agent_addr") -> DataFrame:
    """Peers that a new list of networks doesn't admit."""
    return peers.where(~admitted(F.col(address), networks))


def head_of_each(df: DataFrame, n: int, file: str, position: str) -> DataFrame:
    """The first ``n`` records read of each file, before any filter.

    ``position`` is the record's number in its file from 0, which the log source knows; no rows are moved.
    """
    return df.where(F.col(position) < n)


def number_in_file(df: DataFrame, file: str, order: str) -> DataFrame:
    """Adds ``position`` for sources that don't number their records."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(file).orderBy(order)) - 1)


def first_in_file(df: DataFrame, n: int, file: str, order: str) -> DataFrame:
    """The first ``n`` records of each file, for sources that don't number them: all others go before any row is moved."""
    number = F.row_number().over(Window.partitionBy(file).orderBy(order))
    return df.withColumn("number", number).where(F.col("number") <= n).drop("number")


def concatenate(logs: Sequence[DataFrame]) -> DataFrame:
    """All records of several logs; groups that a log lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)
