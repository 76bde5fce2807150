"""Flows as text, CSV, rows of an SQL table, and a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import text as address_text
from ..functions.times import interval_time_ms, iso_time
from ..operators.summary import top_lists, totals
from ..schema import BRIEF, BY_NAME, MASKS

# fixed values: columns of the CSV form, with the flow's columns
CSV = (
    ("unix_secs", "agent_sec"), ("unix_nsecs", "agent_nsec"), ("sysuptime", "sys_uptime_ms"), ("exaddr", "agent_addr"),
    ("dpkts", "packets"), ("doctets", "octets"), ("first", "flow_start"), ("last", "flow_finish"),
    ("engine_type", "engine_type"), ("engine_id", "engine_id"), ("srcaddr", "src_addr"), ("dstaddr", "dst_addr"),
    ("nexthop", "gateway_addr"), ("input", "if_index_in"), ("output", "if_index_out"), ("srcport", "src_port"),
    ("dstport", "dst_port"), ("prot", "protocol"), ("tos", "tos"), ("tcp_flags", "tcp_flags"), ("src_mask", "src_mask"),
    ("dst_mask", "dst_mask"), ("src_as", "src_as"), ("dst_as", "dst_as"),
)
CSV_HEADER = "#:" + ",".join(name for name, _ in CSV)


def _hex(c: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(c.cast("long"))), digits, "0")


def format_flow(df: DataFrame, mask: int = BRIEF, utc: bool = True, to_text: Callable[[Column], Column] = address_text) -> Column:
    """A flow as a line of text: one expression.  Groups that are absent or masked are left out."""
    have = set(df.columns)

    def group(name: str, *parts: object) -> Column | None:
        used = [p for p in parts if isinstance(p, str) and p.startswith("@")]
        if not MASKS[name] & mask or any(p[1:] not in have for p in used):
            return None
        first = F.col(used[0][1:]) if used else F.col(BY_NAME[name].columns[0])
        shown = F.concat(*[p if isinstance(p, Column) else F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p) for p in parts])
        return F.when(first.isNotNull(), shown).otherwise("")

    def address(name: str, label: str, column: str, port: str | None) -> Column | None:
        if not MASKS[name] & mask or column not in have:
            return None
        tail = F.lit("")
        if port and MASKS["SRCDST_PORT"] & mask and port in have:
            tail = F.when(F.col(port).isNotNull(), F.concat(F.lit(":"), F.col(port).cast("string"))).otherwise("")
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{label} ["), to_text(F.col(column)), F.lit("]"), tail, F.lit(" "))).otherwise("")

    def when_have(columns: str, make: Callable[[], Column | None]) -> Column | None:
        return make() if set(columns.split()) <= have else None

    parts = [
        group("TAG", "tag ", "@tag", " "),
        when_have("recv_sec recv_usec", lambda: group("RECV_TIME", "recv_time ", iso_time(F.col("recv_sec"), utc), ".", _padded("recv_usec", 5), " ")),
        when_have("protocol tcp_flags tos", lambda: group("PROTO_FLAGS_TOS", "proto ", "@protocol", " tcpflags ", _hex(F.col("tcp_flags"), 2), " tos ", _hex(F.col("tos"), 2), " ")),
        address("AGENT_ADDR", "agent", "agent_addr", None),
        address("SRC_ADDR", "src", "src_addr", "src_port"),
        address("DST_ADDR", "dst", "dst_addr", "dst_port"),
        address("GATEWAY_ADDR", "gateway", "gateway_addr", None),
        group("PACKETS", "packets ", "@packets", " "),
        group("OCTETS", "octets ", "@octets", " "),
        group("IF_INDICES", "in_if ", "@if_index_in", " out_if ", "@if_index_out", " "),
        when_have("sys_uptime_ms agent_sec agent_nsec netflow_version", lambda: group(
            "AGENT_INFO", "sys_uptime_ms ", interval_time_ms(F.col("sys_uptime_ms")), " time_sec ", iso_time(F.col("agent_sec"), utc),
            " time_nanosec ", "@agent_nsec", " netflow ver ", "@netflow_version", " ")),
        when_have("flow_start flow_finish", lambda: group(
            "FLOW_TIMES", "flow_start ", interval_time_ms(F.col("flow_start")), " flow_finish ", interval_time_ms(F.col("flow_finish")), " ")),
        group("AS_INFO", "src_AS ", "@src_as", " src_masklen ", "@src_mask", " dst_AS ", "@dst_as", " dst_masklen ", "@dst_mask", " "),
        group("FLOW_ENGINE_INFO", "engine_type ", "@engine_type", " engine_id ", "@engine_id", " seq ", "@flow_sequence", " source ", "@source_id", " "),
        when_have("crc32", lambda: group("CRC32", "crc32 ", _hex(F.col("crc32"), 8), " ")),
    ]
    return F.concat(F.lit("FLOW "), *[p for p in parts if p is not None])


def _padded(name: str, digits: int) -> Column:
    """At least so many digits: longer numbers are whole."""
    x = F.col(name).cast("string")
    return F.when(F.length(x) < digits, F.lpad(x, digits, "0")).otherwise(x)


def csv_rows(df: DataFrame, to_text: Callable[[Column], Column] = address_text) -> DataFrame:
    """The columns of the CSV form, whatever mask was used to read; absent numbers are 0, absent addresses empty."""
    out, kinds = [], dict(df.dtypes)
    for name, column in CSV:
        if column.endswith("_addr"):
            value = F.coalesce(to_text(F.col(column)), F.lit("")) if column in df.columns else F.lit("")
        else:
            kind = kinds.get(column, "long")
            value = F.coalesce(F.col(column), F.lit(0)) if column in kinds else F.lit(0)
            value = value.cast(kind if kind.startswith("decimal") else "long")
        out.append(value.alias(name))
    return df.select(*out)


def csv_lines(df: DataFrame, to_text: Callable[[Column], Column] = address_text) -> DataFrame:
    """Lines without the header, which :data:`CSV_HEADER` holds."""
    rows = csv_rows(df, to_text)
    return rows.select(F.concat_ws(",", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))


def sql_rows(df: DataFrame, to_text: Callable[[Column], Column] = address_text) -> DataFrame:
    """The ten columns of the relational image: tag (0 without one), received, addresses as text, ports, counters, protocol."""
    have = df.columns
    number = lambda c, kind="long": (F.col(c) if c in have else F.lit(None)).cast(kind)
    address = lambda c: to_text(F.col(c)) if c in have else F.lit(None).cast("string")
    return df.select(
        F.coalesce(number("tag"), F.lit(0)).alias("tag"),
        F.col("recv_time").alias("received"),
        *[address(f"{x}_addr").alias(f"{x}_addr") for x in ("agent", "src", "dst")],
        number("src_port", "int").alias("src_port"),
        number("dst_port", "int").alias("dst_port"),
        number("octets").alias("octets"),
        number("packets").alias("packets"),
        number("protocol", "int").alias("protocol"),
    )


def write_sql(df: DataFrame, url: str, table: str = "flows", **options: str) -> None:
    sql_rows(df).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def report(df: DataFrame, n: int = 10) -> str:
    """Totals and the largest keys by octets, packets and flows; only the ``n`` rows of a list reach the driver."""
    t = totals(df).first()
    lines = [f"flows {t['flows']}, octets {t['octets']}, packets {t['packets']}", f"from {t['first_time']} to {t['last_time']}"]
    lists = ((("src_port",), "source ports"), (("dst_port",), "destination ports"), (("protocol",), "protocols"),
             (("src_addr",), "sources"), (("dst_addr",), "destinations"), (("src_addr", "dst_addr"), "pairs"))
    lists = [(keys, title) for keys, title in lists if set(keys) <= set(df.columns)]
    ranked = top_lists(df, [keys for keys, _ in lists], n)
    shown = ranked.withColumns({k: address_text(F.col(k)) for k in ("src_addr", "dst_addr") if k in ranked.columns})
    found: dict[tuple[str, str], list] = {}
    for r in sorted(shown.collect(), key=lambda r: r["rank"]):
        found.setdefault((r["kind"], r["which"]), []).append(r)
    for keys, title in lists:
        for which in ("octets", "packets", "flows"):
            lines.append(f"top {title} by {which}")
            for r in found.get(("_".join(keys), which), []):
                lines.append(f"  {' -> '.join(str(r[k]) for k in keys)}: flows {r['flows']} octets {r['octets']} packets {r['packets']}")
    return "\n".join(lines)
