"""Export packets: versions 1, 5 and 7 stand for themselves; version 9 needs the templates sent before."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import BY_NAME, FLOW
from .columns import Table, dtype_of

PACKET = T.StructType(
    [
        T.StructField("recv_time", T.TimestampNTZType()),
        T.StructField("agent_addr", T.BinaryType()),
        T.StructField("seq", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


class PacketError(ValueError):
    """A packet that is no valid export packet."""


@dataclass(frozen=True)
class Layout:
    """Struct codes of a fixed version: what its header and records hold, by column."""

    most: int
    header: str
    header_columns: tuple[str, ...]
    record: str
    columns: tuple[str, ...]


# fixed values: layouts of the fixed versions after the common head (version, count)
LAYOUTS = {
    1: Layout(24, "III", ("sys_uptime_ms", "agent_sec", "agent_nsec"), "4s4s4sHHIIIIHH2xBBB3x4x",
              ("src_addr", "dst_addr", "gateway_addr", "if_index_in", "if_index_out", "packets", "octets", "flow_start",
               "flow_finish", "src_port", "dst_port", "protocol", "tos", "tcp_flags")),
    5: Layout(30, "IIIIBBxx", ("sys_uptime_ms", "agent_sec", "agent_nsec", "flow_sequence", "engine_type", "engine_id"),
              "4s4s4sHHIIIIHHxBBBHHBBxx",
              ("src_addr", "dst_addr", "gateway_addr", "if_index_in", "if_index_out", "packets", "octets", "flow_start",
               "flow_finish", "src_port", "dst_port", "tcp_flags", "protocol", "tos", "src_as", "dst_as", "src_mask",
               "dst_mask")),
    7: Layout(30, "IIII4x", ("sys_uptime_ms", "agent_sec", "agent_nsec", "flow_sequence"), "4s4s4sHHIIIIHHxBBBHHBBxx4x",
              ("src_addr", "dst_addr", "gateway_addr", "if_index_in", "if_index_out", "packets", "octets", "flow_start",
               "flow_finish", "src_port", "dst_port", "tcp_flags", "protocol", "tos", "src_as", "dst_as", "src_mask",
               "dst_mask")),
}
# fixed values: version 9 field types: the column and its widest form in bytes
TYPES = {
    1: ("octets", 8), 2: ("packets", 8), 4: ("protocol", 1), 5: ("tos", 1), 6: ("tcp_flags", 1), 7: ("src_port", 2),
    8: ("src_addr", 4), 9: ("src_mask", 1), 10: ("if_index_in", 4), 11: ("dst_port", 2), 12: ("dst_addr", 4),
    13: ("dst_mask", 1), 14: ("if_index_out", 4), 15: ("gateway_addr", 4), 16: ("src_as", 4), 17: ("dst_as", 4),
    21: ("flow_finish", 4), 22: ("flow_start", 4), 27: ("src_addr", 16), 28: ("dst_addr", 16), 29: ("src_mask", 1),
    30: ("dst_mask", 1), 38: ("engine_type", 2), 39: ("engine_id", 2), 62: ("gateway_addr", 16),
}
# fixed values: limits of templates
MOST_WIDTH, MOST_TEMPLATE, MOST_SOURCES, MOST_TEMPLATES = 0x4000, 1024, 64, 8
_ADDRESS = {"src_addr", "dst_addr", "gateway_addr"}
#: Groups of which several columns come from different field types: one brings the others as zero.
_TOGETHER = [BY_NAME[n].columns for n in ("PROTO_FLAGS_TOS", "SRCDST_PORT", "IF_INDICES", "FLOW_TIMES", "AS_INFO")]


def version_of(payload: bytes) -> int:
    if len(payload) < 4:
        raise PacketError("too short")
    return int.from_bytes(payload[:2], "big")


def decode_fixed(payload: bytes) -> list[dict]:
    """Flows of a version 1, 5 or 7 packet, whose size must be that of its records."""
    version, count = struct.unpack_from(">HH", payload)
    layout = LAYOUTS[version]
    head, record = struct.Struct(">HH" + layout.header), struct.Struct(">" + layout.record)
    if not 1 <= count <= layout.most:
        raise PacketError(f"{count} records")
    if len(payload) != head.size + count * record.size:
        raise PacketError("size doesn't match the number of records")
    common = dict(zip(layout.header_columns, head.unpack_from(payload)[2:], strict=True), netflow_version=version)
    if version == 7:
        common |= {"engine_type": 0, "engine_id": 0}
    if version != 1:
        common["source_id"] = 0
    return [
        common | dict(zip(layout.columns, record.unpack_from(payload, head.size + i * record.size), strict=True))
        for i in range(count)
    ]


@dataclass
class Templates:
    """Templates of one exporter: by source, then by template id, in the order of their first announcement.

    The oldest source or template goes when there are too many; announcing one again keeps its place.
    """

    sources: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)

    def get(self, source: int, template: int) -> list[tuple[int, int]] | None:
        return self.sources.get(source, {}).get(template)

    def put(self, source: int, template: int, what: list[tuple[int, int]]) -> None:
        if source not in self.sources and len(self.sources) >= MOST_SOURCES:
            del self.sources[next(iter(self.sources))]
        mine = self.sources.setdefault(source, {})
        if template not in mine and len(mine) >= MOST_TEMPLATES:
            del mine[next(iter(mine))]
        mine[template] = what

    def dump(self) -> bytes:
        """All templates in their order, as bytes for :meth:`load`."""
        each = ((source, template, what) for source, mine in self.sources.items() for template, what in mine.items())
        return b"".join(struct.pack(">III", source, template, len(what)) + b"".join(struct.pack(">HH", *x) for x in what) for source, template, what in each)

    def load(self, blob: bytes) -> Templates:
        """Announces what ``dump`` wrote."""
        at = 0
        while at < len(blob):
            source, template, n = struct.unpack_from(">III", blob, at)
            at += 12
            self.put(source, template, [struct.unpack_from(">HH", blob, at + 4 * i) for i in range(n)])
            at += 4 * n
        return self


@dataclass
class Decoded:
    flows: list[dict] = field(default_factory=list)
    no_template: int = 0
    error: str | None = None
    version: int | None = None


@lru_cache(maxsize=256)
def _announced(data: bytes) -> tuple[list[tuple[int, list[tuple[int, int]]]], str | None]:
    """Templates of a template flowset, and what is wrong behind them: exporters repeat the same flowset again and again."""
    found, at = [], 0
    while at + 4 <= len(data):
        template, count = struct.unpack_from(">HH", data, at)
        at += 4
        if not count:  # padding
            continue
        if at + 4 * count > len(data):
            return found, "template is cut off"
        what = [struct.unpack_from(">HH", data, at + 4 * i) for i in range(count)]
        at += 4 * count
        for kind, width in what:
            if not 1 <= width <= MOST_WIDTH or kind in TYPES and not _fits(kind, width):
                return found, f"field {kind} has width {width}"
        if sum(w for _, w in what) > MOST_TEMPLATE:
            return found, "template is too long"
        found.append((template, what))
    return found, None


def _template_set(data: bytes, source: int, templates: Templates) -> None:
    found, error = _announced(data)
    for template, what in found:
        templates.put(source, template, what)
    if error:
        raise PacketError(error)


@lru_cache(maxsize=1024)
def _fields(what: tuple[tuple[int, int], ...]) -> bytes:
    return b"".join(struct.pack(">HH", *x) for x in what)


def _fits(kind: int, width: int) -> bool:
    column, widest = TYPES[kind]
    return width == widest if column in _ADDRESS else width <= widest


def _records_in(data: bytes, what: list[tuple[int, int]]) -> tuple[int, int]:
    """(number of records in a flowset, bytes of one)."""
    size = sum(w for _, w in what)
    count = len(data) // size
    if not 1 <= count <= 0x4000:
        raise PacketError(f"{count} records in a flowset")
    return count, size


def _data_set(data: bytes, what: list[tuple[int, int]], common: dict) -> Iterator[dict]:
    count, size = _records_in(data, what)
    for i in range(count):
        at, row = i * size, dict(common)
        engine = False
        for kind, width in what:
            if kind in TYPES:
                column, _ = TYPES[kind]
                value = data[at : at + width]
                row[column] = value if column in _ADDRESS else int.from_bytes(value, "big")
                engine |= kind in (38, 39)
            at += width
        for group in _TOGETHER:
            if any(c in row for c in group):
                for c in group:
                    row.setdefault(c, 0)
        if engine:
            row.setdefault("engine_type", 0)
            row.setdefault("engine_id", 0)
        else:
            row.pop("flow_sequence")
            row.pop("source_id")
        yield row


def decode_v9(payload: bytes, templates: Templates, out: Decoded, take: Callable[[bytes, list[tuple[int, int]], dict], None] | None = None) -> None:
    """Flows of a version 9 packet, or each of its data flowsets to ``take``.  What came before an error is kept."""
    if len(payload) < 20:
        raise PacketError("too short")
    _, _, uptime, sec, sequence, source = struct.unpack_from(">HHIIII", payload)
    common = {
        "sys_uptime_ms": uptime, "agent_sec": sec, "agent_nsec": 0, "netflow_version": 9, "flow_sequence": sequence,
        "source_id": source,
    }
    at = 20
    while at < len(payload):
        if at + 4 > len(payload):
            raise PacketError("flowset is cut off")
        kind, size = struct.unpack_from(">HH", payload, at)
        if size < 4 or at + size > len(payload):
            raise PacketError(f"flowset of {size} bytes")
        data = payload[at + 4 : at + size]
        at += size
        if kind == 0:
            _template_set(data, source, templates)
        elif kind >= 256:  # 1 holds options, other low numbers are reserved: skipped
            what = templates.get(source, kind)
            if what is None:
                out.no_template += 1
            elif take is None:
                out.flows.extend(_data_set(data, what, common))
            else:
                take(data, what, common)


def decode_packet(payload: bytes, templates: Templates | None = None) -> Decoded:
    """Any packet; ``error`` says what is wrong with an invalid one."""
    out = Decoded()
    try:
        out.version = version_of(payload)
        if out.version == 9:
            decode_v9(payload, templates if templates is not None else Templates(), out)
        elif out.version in LAYOUTS:
            out.flows = decode_fixed(payload)
        else:
            raise PacketError(f"version {out.version} is unknown")
    except PacketError as e:
        out.error = str(e)
    except struct.error as e:
        out.error = f"cut off: {e}"
    return out


COLUMNS = [c for c in FLOW.names if c not in ("fields", "flow_ver", "recv_sec", "recv_usec", "tag", "crc32", "agent_addr")]
FLOW_ROW = T.StructType(
    [f for f in PACKET.fields if f.name != "payload"] + [FLOW[c] for c in COLUMNS]
)


def _same_family(row: dict) -> bool:
    return len(row.get("src_addr") or b"") == len(row.get("dst_addr") or b"")


_HEADERS = {v: dtype_of([("HH" + x.header, ("version", "count", *x.header_columns))]) for v, x in LAYOUTS.items()}
_RECORDS = {v: dtype_of([(x.record, x.columns)]) for v, x in LAYOUTS.items()}


def _valid_fixed(payload: bytes) -> int:
    """Version of a packet of a fixed version that is whole, else 0."""
    if len(payload) < 4:
        return 0
    version, count = payload[1], int.from_bytes(payload[2:4], "big")
    if payload[0] or version not in LAYOUTS or not 1 <= count <= LAYOUTS[version].most:
        return 0
    return version if len(payload) == _HEADERS[version].itemsize + count * _RECORDS[version].itemsize else 0


class Flows:
    """Collects what packets hold, and decodes all records of one layout at once."""

    def __init__(self) -> None:
        self.times: list = []
        self.agents: list[bytes] = []
        self.seqs: list[int] = []
        self.fixed: dict[int, list[tuple[int, bytes]]] = {}
        self.sets: dict[tuple, list[tuple[int, int, bytes, dict]]] = {}

    def add(self, time, agent: bytes, seq: int, payload: bytes, templates: Templates | None, counts: list[int] | None = None) -> Decoded:
        """Takes a packet; without ``templates`` those of version 9 are left out.  ``flows`` of the result stays empty.

        With ``counts``, the numbers of its records are only added there.
        """
        out = Decoded()
        packet = len(self.times)
        self.times.append(time)
        self.agents.append(agent)
        self.seqs.append(seq)
        if payload[:2] == b"\0\x09" and len(payload) >= 4:
            out.version = 9
            if templates is None:
                return out

            def take(data: bytes, what: list[tuple[int, int]], common: dict) -> None:
                count, size = _records_in(data, what)
                if counts is not None:
                    counts.append(count)
                    return
                self.sets.setdefault(tuple(what), []).append((packet, count, data[: count * size], common))

            try:
                decode_v9(payload, templates, out, take)
            except PacketError as e:
                out.error = str(e)
            except struct.error as e:
                out.error = f"cut off: {e}"
        elif version := _valid_fixed(payload):
            out.version = version
            if counts is not None:
                counts.append(int.from_bytes(payload[2:4], "big"))
            else:
                self.fixed.setdefault(version, []).append((packet, payload))
        else:
            out = decode_packet(payload)  # says what is wrong
        return out

    def batch(self) -> pa.RecordBatch:
        """The flows of all packets taken; those whose addresses are of two families are left out."""
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(FLOW_ROW)
        parts: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
        for version, held in self.fixed.items():
            head, record = _HEADERS[version], _RECORDS[version]
            counts = np.array([int.from_bytes(p[2:4], "big") for _, p in held])
            heads = np.repeat(np.frombuffer(b"".join(p[: head.itemsize] for _, p in held), head), counts)
            found = np.frombuffer(b"".join(p[head.itemsize :] for _, p in held), record)
            made: dict = {c: heads[c] for c in LAYOUTS[version].header_columns} | {c: found[c] for c in record.names}
            made["netflow_version"] = version
            made |= {"engine_type": 0, "engine_id": 0} if version == 7 else {}
            made |= {"source_id": 0} if version != 1 else {}
            parts.append((np.repeat([i for i, _ in held], counts), made))
        for what, held in self.sets.items():
            counts = np.array([n for _, n, _, _ in held])
            size = sum(w for _, w in what)
            found = np.frombuffer(b"".join(d for _, _, d, _ in held), np.uint8).reshape(-1, size)
            made = {}
            at = 0
            for kind, width in what:
                if kind in TYPES:
                    column = TYPES[kind][0]
                    value = found[:, at : at + width]
                    if column not in _ADDRESS:
                        value = np.pad(value, ((0, 0), (8 - width, 0))).view(">u8")[:, 0]
                    made[column] = value
                at += width
            width = {c: made[c].shape[1] for c in ("src_addr", "dst_addr") if c in made}
            if width.get("src_addr", 0) != width.get("dst_addr", 0):
                continue
            for group in _TOGETHER:
                if any(c in made for c in group):
                    made |= {c: 0 for c in group if c not in made}
            engine = any(kind in (38, 39) for kind, _ in what)
            if engine:
                made |= {c: 0 for c in ("engine_type", "engine_id") if c not in made}
            for c in ("sys_uptime_ms", "agent_sec", "agent_nsec", "netflow_version", *(("flow_sequence", "source_id") if engine else ())):
                made[c] = np.repeat([common[c] for *_, common in held], counts)
            parts.append((np.repeat([i for i, *_ in held], counts), made))
        owner = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int64)
        table = Table(len(owner), schema)
        at = 0
        for rows, made in parts:
            places = np.arange(at, at + len(rows))
            for c, values in made.items():
                table.put(c, places, values)
            at += len(rows)
        of_packet = pa.array(owner)
        more = {
            "recv_time": pa.array(self.times, schema.field("recv_time").type).take(of_packet),
            "agent_addr": pa.array(self.agents, pa.binary()).take(of_packet),
            "seq": pa.array(self.seqs, pa.int64()).take(of_packet),
        }
        return table.batch(more)


def _packets_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


def decode_packets(packets: DataFrame) -> DataFrame:
    """Flows of version 1, 5 and 7 packets: a narrow map, no shuffle.  Other and invalid packets give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flows = Flows()
            for time, agent, seq, payload in _packets_of(batch):
                flows.add(time, agent, seq, payload or b"", None)
            yield flows.batch()

    return packets.select(*PACKET.names).mapInArrow(run, FLOW_ROW)


#: Packets of a source are decoded in buckets of so many numbers of ``seq``, each in any task.
BUCKET = 65536
_KEY = ("agent_key", "source", "bucket")


def source_of(payload: Column, seq: Column | None = None) -> Column:
    """The four bytes of a version 9 packet that name its source; empty for others, or one of 16 bytes by ``seq`` to deal them out."""
    others = F.lit(b"") if seq is None else F.substring(F.hex(F.pmod(seq, F.lit(16))), -1, 1).cast("binary")
    return F.when(F.substring(payload, 1, 2) == F.lit(b"\0\x09"), F.substring(payload, 17, 4)).otherwise(others)


def _keyed(packets: DataFrame) -> DataFrame:
    """Packets with exporter, source (of version 9; others have none) and bucket."""
    bucket = F.coalesce(F.floor(F.col("seq") / BUCKET), F.lit(-1)).cast("long")
    return packets.select(*PACKET.names, F.coalesce("agent_addr", F.lit(b"")).alias("agent_key"), source_of(F.col("payload")).alias("source"), bucket.alias("bucket"))


class _Recorder(Templates):
    """Notes what a packet announces, and the data flowsets before that: (template, fields, bytes of data)."""

    def __init__(self) -> None:
        super().__init__()
        self.steps: list[tuple[int, bytes | None, int]] = []

    def put(self, source: int, template: int, what: list[tuple[int, int]]) -> None:
        self.steps.append((template, _fields(tuple(what)), 0))

    def get(self, source: int, template: int) -> list[tuple[int, int]]:
        return [(template, 1)]

    def take(self, data: bytes, what: list[tuple[int, int]], common: dict) -> None:
        self.steps.append((what[0][0], None, len(data)))

    def of(self, payload: bytes) -> list[tuple[int, bytes | None, int]]:
        self.steps = []
        try:
            decode_v9(payload, self, Decoded(), self.take)
        except (PacketError, struct.error):
            pass  # what came before it holds
        while self.steps and self.steps[-1][1] is None:
            self.steps.pop()
        return self.steps


def _replay(steps: list[dict], source: int, templates: Templates) -> None:
    """What a packet's steps do to the templates: data that its template doesn't fit ends the packet."""
    for step in steps:
        if step["fields"] is not None:
            templates.put(source, step["template"], list(struct.iter_unpack(">HH", step["fields"])))
        elif (what := templates.get(source, step["template"])) is not None and not 1 <= step["size"] // sum(w for _, w in what) <= 0x4000:
            return


def announcements(packets: DataFrame) -> DataFrame:
    """Of each version 9 packet that announces templates its steps; and a row without steps for each bucket that has packets.

    ``in_turn`` marks packets with data before an announcement, which whether it counts depends on that data.
    """
    steps = T.ArrayType(T.StructType([T.StructField("template", T.IntegerType()), T.StructField("fields", T.BinaryType()), T.StructField("size", T.IntegerType())]))
    keyed = _keyed(packets).where(F.length("source") > 0).select(*_KEY, "seq", "payload")
    schema = T.StructType([*keyed.schema.fields[:4], T.StructField("steps", steps), T.StructField("in_turn", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, recorder = to_arrow_schema(schema), _Recorder()
        for batch in batches:
            seen, rows = {}, []
            for agent, source, bucket, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (agent, source, bucket) not in seen:
                    seen[agent, source, bucket] = None
                    rows.append((agent, source, bucket, None, None, False))
                if found := recorder.of(payload):
                    data = [f is None for _, f, _ in found]
                    rows.append((agent, source, bucket, seq, [{"template": t, "fields": f, "size": n} for t, f, n in found], any(data)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return keyed.mapInArrow(run, schema)


def template_intervals(events: DataFrame) -> DataFrame:
    """(agent_key, source, template, bucket, blob): the templates that :func:`announcements` leave after a bucket.

    A source with no more templates than it may have never loses one, so of each bucket the last announcement of each
    template is all that counts.  A source with more, or with packets whose announcements depend on data
    before them, is followed in order through its announcements, never its data; its rows have template -1 and all
    that is held then.
    """
    told = events.where("steps is not null")
    each = told.select("agent_key", "source", "bucket", "seq", "in_turn", F.posexplode("steps").alias("pos", "s")).where("s.fields is not null")
    kinds = each.groupBy("agent_key", "source").agg((F.max("in_turn") | (F.count_distinct("s.template") > MOST_TEMPLATES)).alias("whole"))
    alone, whole = (kinds.where(w).select("agent_key", "source") for w in ("not whole", "whole"))
    last = each.join(alone, ["agent_key", "source"]).groupBy("agent_key", "source", "bucket", F.col("s.template").alias("template"))
    last = last.agg(F.max_by("s.fields", F.struct("seq", "pos")).alias("fields"))
    number = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    blob = F.concat(F.col("source"), number(F.col("template")), number(F.length("fields") / 4), F.col("fields"))
    simple = last.select("agent_key", "source", "template", "bucket", blob.alias("blob"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, templates = None, Templates()
        for batch in batches:
            rows = []
            for agent, source, bucket, _, steps in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (agent, source, bucket) != now:
                    if now is not None:
                        rows.append((*now[:2], -1, now[2], templates.dump()))
                    if now is None or now[:2] != (agent, source):
                        templates = Templates()
                    now = agent, source, bucket
                _replay(steps, int.from_bytes(source, "big"), templates)
            yield made(rows)
        if now is not None:
            yield made([(*now[:2], -1, now[2], templates.dump())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["agent_key", "source", "template", "bucket", "blob"])

    ordered = told.join(whole, ["agent_key", "source"]).select(*_KEY, "seq", "steps").repartition("agent_key", "source").sortWithinPartitions("agent_key", "source", "bucket", "seq")
    return simple.unionByName(ordered.mapInArrow(follow, "agent_key binary, source binary, template int, bucket long, blob binary"))


def templates_before(events: DataFrame) -> DataFrame:
    """(agent_key, source, bucket, blob): for each bucket the templates that hold when it begins, as of the buckets before."""
    held = template_intervals(events)
    buckets = events.where("steps is null").select(*_KEY).distinct()
    grid = buckets.join(held.select("agent_key", "source", "template").distinct(), ["agent_key", "source"])  # MOST_TEMPLATES rows of a bucket at most
    before = Window.partitionBy("agent_key", "source", "template").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(held, [*_KEY, "template"], "left").withColumn("blob", F.last("blob", ignorenulls=True).over(before))
    return filled.where("blob is not null").select(*_KEY, "blob")


def _in_buckets(packets: DataFrame) -> DataFrame:
    """Packets dealt by exporter, source and bucket, in the order of ``seq``, behind rows ``held`` with the templates before.

    What packets announce is written once to the folder that executors share: it is read several times and far
    smaller than the packets.
    """
    from ..scratch import new_folder

    spark = packets.sparkSession
    folder = new_folder(spark, "announcements")
    announcements(packets).write.parquet(folder)
    seeds = templates_before(spark.read.parquet(folder))
    keyed = _keyed(packets).withColumn("held", F.lit(False))
    both = keyed.unionByName(seeds.select(*_KEY, F.col("blob").alias("payload"), F.lit(True).alias("held")), allowMissingColumns=True)
    dealt = both.repartition(*_KEY).sortWithinPartitions(*_KEY, F.desc("held"), "seq")
    return dealt.select(*PACKET.names, *_KEY, "held")


def _each_in_turn(batch: pa.RecordBatch, state: list) -> Iterator[tuple]:
    """(recv_time, agent_addr, seq, payload, templates) of the packets of a batch; ``state`` is [key, templates]."""
    for time, agent, seq, payload, *key, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if key != state[0]:
            state[:] = key, Templates()
        if held:
            state[1].load(payload)
        else:
            yield time, agent, seq, payload or b"", state[1]


def decode_v9_packets(packets: DataFrame) -> DataFrame:
    """Flows of version 9 packets, as decoding each exporter's source in the order of ``seq`` gives them.

    Templates hold from where they are sent; data before its template is lost, as in a live exporter's
    stream.  First only the announcements are looked at: they tell which templates hold when each bucket of
    a source begins.  Then buckets are decoded apart from each other, each from those templates on, so one
    exporter's packets are dealt to all tasks; a task streams through them and holds one source's
    templates at a time, never its packets.  The limit on the sources of an exporter, which would need all
    of them in one task, isn't kept here; the limit on a source's templates is.
    """
    v9 = packets.select(*PACKET.names).where(F.substring("payload", 1, 2) == F.lit(b"\0\x09"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = [None, Templates()]
        for batch in batches:
            flows = Flows()
            for time, agent, seq, payload, templates in _each_in_turn(batch, state):
                flows.add(time, agent, seq, payload, templates)
            yield flows.batch()

    return _in_buckets(v9).mapInArrow(run, FLOW_ROW)


def packet_facts(packets: DataFrame) -> DataFrame:
    """recv_time, agent_addr, seq, version, flows, invalid, no_template of each packet, for exporter statistics."""
    schema = "recv_time timestamp_ntz, agent_addr binary, seq long, version int, flows long, invalid int, no_template long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = [None, Templates()]
        for batch in batches:
            flows, rows, taken = Flows(), [], []
            for time, agent, seq, payload, templates in _each_in_turn(batch, state):
                taken.clear()
                d = flows.add(time, agent, seq, payload, templates, taken)
                rows.append((time, agent, seq, d.version, 0 if d.error else sum(taken), int(d.error is not None), d.no_template))
            types = (pa.timestamp("us"), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            names = ["recv_time", "agent_addr", "seq", "version", "flows", "invalid", "no_template"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return _in_buckets(packets.select(*PACKET.names)).mapInArrow(run, schema)


def encoder(version: int) -> Callable[[list[dict]], bytes]:
    """Packet of a fixed version from rows (columns missing in a row are zero)."""
    layout = LAYOUTS[version]
    head, record = struct.Struct(">HH" + layout.header), struct.Struct(">" + layout.record)
    zero = {c: bytes(4) for c in _ADDRESS}

    def encode(rows: list[dict]) -> bytes:
        first = rows[0]
        out = head.pack(version, len(rows), *(int(first.get(c) or 0) for c in layout.header_columns))
        for r in rows:
            out += record.pack(*(bytes(r.get(c) or zero[c]) if c in _ADDRESS else int(r.get(c) or 0) for c in layout.columns))
        return out

    return encode


def encode_v9(rows: list[dict], template: int, what: list[tuple[int, int]], source: int = 0, with_template: bool = True, first: dict | None = None) -> bytes:
    """A version 9 packet with a template flowset (if wanted) and a data flowset of ``rows``."""
    first = first or {}
    out = struct.pack(">HHIIII", 9, len(rows) + with_template, first.get("sys_uptime_ms", 0), first.get("agent_sec", 0), first.get("flow_sequence", 0), source)
    if with_template:
        body = struct.pack(">HH", template, len(what)) + b"".join(struct.pack(">HH", *x) for x in what)
        out += struct.pack(">HH", 0, 4 + len(body)) + body
    if rows:
        body = b"".join(
            bytes(r[TYPES[k][0]]) if TYPES[k][0] in _ADDRESS else int(r.get(TYPES[k][0]) or 0).to_bytes(w, "big")
            for r in rows
            for k, w in what
        )
        body += bytes(-len(body) % 4) if sum(w for _, w in what) > 3 else b""
        out += struct.pack(">HH", template, 4 + len(body)) + body
    return out
