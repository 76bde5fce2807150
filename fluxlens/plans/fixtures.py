"""Export packets laid out byte by byte from flows, in DataFrame functions: known answers for the decoders.

Nothing of the decoders' layouts is used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_C = "src_ip dst_ip src_port dst_port protocol tcp_flags packets octets".split()


def digits(x: Column | str | int, size: int) -> Column:
    """A number as ``size`` bytes, in hexadecimal."""
    if isinstance(x, int):
        return F.lit(f"{x:0{2 * size}x}")
    c = F.col(x) if isinstance(x, str) else x
    return F.lpad(F.hex(c.cast("long")), 2 * size, "0")


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def records(version: int) -> Column:
    """A flow as a record of a fixed version."""
    head = joined(digits("src_ip", 4), digits("dst_ip", 4), "00000000", "0003", "0004", digits("packets", 4), digits("octets", 4),
                  "00000000", "00000000", digits("src_port", 2), digits("dst_port", 2))
    if version == 1:
        return joined(head, "0000", digits("protocol", 1), "00", digits("tcp_flags", 1), "00" * 7)
    tail = joined("00", digits("tcp_flags", 1), digits("protocol", 1), "00", "0001", "0002", "18", "08", "0000")
    return joined(head, tail, "00000000" if version == 7 else "")


def packed(flows: DataFrame, record: Column, head, most: int = 24) -> DataFrame:
    """(recv_time, agent_addr, seq, payload): up to ``most`` flows of an exporter (eight of them) in a packet.

    ``head`` gets the number of records and the exporter's number; the records follow it.
    """
    agent, block = (F.col("flow_id") % 8).alias("agent"), F.floor(F.col("flow_id") / (8 * most)).alias("block")
    # where numbers of flows repeat, a block has more than one packet of them
    grouped = flows.groupBy(agent, block).agg(F.array_sort(F.collect_list(F.struct("flow_id", record.alias("r")))).alias("all"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / most).cast("int")), lambda i: F.struct(i.alias("i"), F.slice("all", i * most + 1, most).alias("rows")))
    grouped = grouped.select("agent", "block", F.explode(parts).alias("p")).select("agent", "block", "p.*")
    body = F.array_join(F.transform("rows", lambda x: x["r"]), "")
    return grouped.select(
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("recv_time"),
        F.unhex(joined("0a0000", digits("agent", 1))).alias("agent_addr"),
        (F.col("block") * 1000 + F.col("i")).cast("long").alias("seq"),
        F.unhex(head(F.size("rows"), body, F.col("agent"))).alias("payload"),
    )


def fixed_packets(flows: DataFrame, version: int) -> DataFrame:
    def head(n: Column, body: Column, agent: Column) -> Column:
        rest = {1: "", 5: "000000070102" + "0000", 7: "0000000700000000"}[version]
        return joined(f"{version:04x}", digits(n, 2), "000003e8", "65900000", "00000005", rest, body)

    return packed(flows, records(version), head)


# fixed values: (field type, bytes) of the columns
V9 = {"src_ip": (8, 4), "dst_ip": (12, 4), "src_port": (7, 2), "dst_port": (11, 2), "protocol": (4, 1), "tcp_flags": (6, 1),
      "packets": (2, 4), "octets": (1, 4)}


def template(number: int, fields: list[tuple[int, int]]) -> str:
    """A flowset that announces a template, in hexadecimal."""
    return f"0000{8 + 4 * len(fields):04x}{number:04x}{len(fields):04x}" + "".join(f"{k:04x}{w:04x}" for k, w in fields)


def data(number: int, n: Column, body: Column, size: int) -> Column:
    """A data flowset of ``n`` records of ``size`` bytes, padded to four."""
    spare = (4 - (n * size) % 4) % 4
    return joined(f"{number:04x}", digits(n * size + spare + 4, 2), body, F.repeat(F.lit("00"), spare))


def v9_head(sets: Column | int = 2) -> Column:
    return joined("0009", digits(sets, 2), "000003e8", "65900000", "00000007", "00000007")


def v9_packets(flows: DataFrame, before: str | Column = "", fields: dict[str, tuple[int, int]] | None = None, number: int = 300) -> DataFrame:
    """Packets that each announce their template; ``before`` stands in front of it."""
    fields = V9 if fields is None else fields
    record = joined(*[digits(c, w) for c, (_, w) in fields.items()])
    size = sum(w for _, w in fields.values())
    start = F.lit(before) if isinstance(before, str) else before

    def head(n: Column, body: Column, agent: Column) -> Column:
        return joined(v9_head(), start, template(number, list(fields.values())), data(number, n, body, size))

    return packed(flows, record, head)


def v9_changing_packets(flows: DataFrame, number: int = 300) -> DataFrame:
    """Packets of which an exporter's first in each ten blocks announces the template; every fifty blocks its fields change their order."""
    orders = [list(V9.items()), list(V9.items())[::-1]]
    block = F.floor(F.col("flow_id") / (8 * 24))
    record = F.when(F.floor(block / 50) % 2 == 0, joined(*[digits(c, w) for c, (_, w) in orders[0]])).otherwise(joined(*[digits(c, w) for c, (_, w) in orders[1]]))
    first = F.min("block").over(Window.partitionBy("agent", F.floor(F.col("block") / 10)))
    announced = F.when(F.floor(F.col("block") / 50) % 2 == 0, template(number, [x for _, x in orders[0]])).otherwise(template(number, [x for _, x in orders[1]]))

    def head(n: Column, body: Column, agent: Column) -> Column:
        start = F.when((F.col("block") == first) & (F.col("i") == 0), announced).otherwise("")
        return joined(v9_head(), start, data(number, n, body, sum(w for _, w in V9.values())))

    return packed(flows, record, head)
