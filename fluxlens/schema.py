"""The flow record: groups of fields, their columns and binary layouts, and masks over them.

A flow is one flat row.  Each record has some of the groups; columns of an absent group are NULL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Group:
    """``layout`` and ``legacy``: struct codes (big-endian, x = padding) of the current and the old log format."""

    bit: int
    name: str
    columns: tuple[str, ...]
    layout: str
    legacy: str
    legacy_columns: tuple[str, ...] | None = None

    @property
    def mask(self) -> int:
        return 1 << self.bit


# fixed values: field groups in the order in which they stand in a record
GROUPS = (
    Group(0, "TAG", ("tag",), "I", "I"),
    Group(1, "RECV_TIME", ("recv_sec", "recv_usec"), "II", "I", ("recv_sec",)),
    Group(2, "PROTO_FLAGS_TOS", ("tcp_flags", "protocol", "tos"), "BBBx", "BBBx"),
    Group(3, "AGENT_ADDR4", ("agent_addr",), "4s", "4s"),
    Group(4, "AGENT_ADDR6", ("agent_addr",), "16s", "16s"),
    Group(5, "SRC_ADDR4", ("src_addr",), "4s", "4s"),
    Group(6, "SRC_ADDR6", ("src_addr",), "16s", "16s"),
    Group(7, "DST_ADDR4", ("dst_addr",), "4s", "4s"),
    Group(8, "DST_ADDR6", ("dst_addr",), "16s", "16s"),
    Group(9, "GATEWAY_ADDR4", ("gateway_addr",), "4s", "4s"),
    Group(10, "GATEWAY_ADDR6", ("gateway_addr",), "16s", "16s"),
    Group(11, "SRCDST_PORT", ("src_port", "dst_port"), "HH", "HH"),
    Group(12, "PACKETS", ("packets",), "Q", "Q"),
    Group(13, "OCTETS", ("octets",), "Q", "Q"),
    Group(14, "IF_INDICES", ("if_index_in", "if_index_out"), "II", "HH"),
    Group(15, "AGENT_INFO", ("sys_uptime_ms", "agent_sec", "agent_nsec", "netflow_version"), "IIIHxx", "IIIHxx"),
    Group(16, "FLOW_TIMES", ("flow_start", "flow_finish"), "II", "II"),
    Group(17, "AS_INFO", ("src_as", "dst_as", "src_mask", "dst_mask"), "IIBBxx", "HHBBxx"),
    Group(18, "FLOW_ENGINE_INFO", ("engine_type", "engine_id", "flow_sequence", "source_id"), "HHII", "BBxxI",
          ("engine_type", "engine_id", "flow_sequence")),
    Group(30, "CRC32", ("crc32",), "I", "I"),
)
BY_NAME = {g.name: g for g in GROUPS}
CRC32 = BY_NAME["CRC32"].mask


def _either(*names: str) -> int:
    return reduce(lambda a, n: a | BY_NAME[n].mask, names, 0)


ALL = _either(*BY_NAME)
#: Names by which groups are chosen: each group, both families of an address, and combinations.
MASKS = {name: g.mask for name, g in BY_NAME.items()} | {
    role: _either(f"{role}4", f"{role}6") for role in ("AGENT_ADDR", "SRC_ADDR", "DST_ADDR", "GATEWAY_ADDR")
}
MASKS["SRCDST_ADDR"] = MASKS["SRC_ADDR"] | MASKS["DST_ADDR"]
MASKS["ALL"] = ALL
BRIEF = _either("TAG", "RECV_TIME", "PROTO_FLAGS_TOS", "SRCDST_PORT", "PACKETS", "OCTETS") | (
    MASKS["SRCDST_ADDR"] | MASKS["AGENT_ADDR"]
)

_BIG = T.DecimalType(20, 0)  # unsigned 64-bit counters don't fit a long
FLOW = T.StructType(
    [T.StructField("fields", T.LongType()), T.StructField("flow_ver", T.ShortType())]
    + [
        T.StructField(name, kind)
        for kind, names in (
            (T.LongType(), "tag recv_sec"),
            (T.IntegerType(), "recv_usec"),
            (T.ShortType(), "tcp_flags protocol tos"),
            (T.BinaryType(), "agent_addr src_addr dst_addr gateway_addr"),
            (T.IntegerType(), "src_port dst_port"),
            (_BIG, "packets octets"),
            (T.LongType(), "if_index_in if_index_out sys_uptime_ms agent_sec agent_nsec"),
            (T.IntegerType(), "netflow_version"),
            (T.LongType(), "flow_start flow_finish src_as dst_as"),
            (T.ShortType(), "src_mask dst_mask"),
            (T.IntegerType(), "engine_type engine_id"),
            (T.LongType(), "flow_sequence source_id crc32"),
        )
        for name in names.split()
    ]
)


def mask_of(names: str | list[str]) -> int:
    """Mask of group names, in any case."""
    names = names.replace(",", " ").split() if isinstance(names, str) else names
    try:
        return reduce(lambda a, n: a | MASKS[n.upper()], names, 0)
    except KeyError as e:
        raise ValueError(f"unknown field group {e.args[0]!r}") from None


def columns_of(mask: int) -> list[str]:
    """Columns of the groups in ``mask``, in the order of the record."""
    return list(dict.fromkeys(c for g in GROUPS if g.mask & mask for c in g.columns))


def project(df: DataFrame, mask: int) -> DataFrame:
    """The columns of the groups in ``mask``, and those that belong to no group."""
    kept, all_columns = set(columns_of(mask)), set(columns_of(ALL))
    return df.select(*[c for c in df.columns if c in kept or c not in all_columns])


def has_fields(mask: int, columns: list[str] | None = None) -> Column:
    """True if every group of ``mask`` is there.  A role's two address groups tell the address's length."""
    if not mask:
        raise ValueError("no field given")
    tests = []
    for g in GROUPS:
        if g.mask & mask:
            first = F.col(g.columns[0])
            if "s" in g.layout:
                tests.append(F.coalesce(F.length(first) == int(g.layout[:-1]), F.lit(False)))
            else:
                tests.append(first.isNotNull())
    return reduce(lambda a, b: a & b, tests)


def bitmap() -> Column:
    """The mask of the groups that a row has, from its columns."""
    return reduce(lambda a, b: a + b, [F.when(has_fields(g.mask), F.lit(g.mask)).otherwise(0) for g in GROUPS]).cast("long")
