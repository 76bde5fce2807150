"""Datagrams as a stream, ``format("flowpackets")``: packets from a UDP port or records from a local socket."""

from __future__ import annotations

import datetime as dt
import ipaddress
import os
import pickle
import socket
from collections.abc import Iterator, Sequence

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .packets import PACKET

#: Datagrams that are taken at a time, the longest one, and the receive buffers that are tried.  Fixed values.
DRAIN, LONGEST, BUFFERS = 512, 2048, (512 << 10, 256 << 10, 128 << 10)


class _Listener(SimpleDataSourceStreamReader):
    """What a socket holds when a batch begins, up to DRAIN datagrams.

    Datagrams come once: what a failed batch had taken is kept for its repetition as long as the query runs,
    and is gone after that, as with any collector.  With a folder to ``land`` them in, each batch is written there before it
    is given out, so that a query which starts again has what it had taken; batches that are done are deleted.
    """

    def __init__(self, where: str, join: Sequence[str] = (), land: str | None = None):
        self.scheme, _, self.rest = where.partition("://")
        if self.scheme not in ("udp", "unix"):
            raise ValueError(f"listen on udp://host:port or unix://path, not on {where!r}")
        self.join, self.land = join, land
        self.held: dict[int, list[tuple]] = {}
        self._open: socket.socket | None = None

    def __getstate__(self) -> dict:  # tasks get what was read, the port is open once only
        return self.__dict__ | {"_open": None}

    @property
    def socket(self) -> socket.socket:
        """The socket, opened when it is first asked for."""
        if self._open is None:
            self._open = self._listening()
            self._open.setblocking(False)
        return self._open

    def _listening(self) -> socket.socket:
        if self.scheme == "unix":
            if os.path.exists(self.rest):
                os.unlink(self.rest)
            s = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM)
            s.bind(self.rest)
            return s
        host, _, port = self.rest.rpartition(":")
        s = socket.socket(socket.AF_INET6 if ":" in host else socket.AF_INET, socket.SOCK_DGRAM)
        for size in BUFFERS:
            try:
                s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, size)
                break
            except OSError:
                continue
        s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        s.bind((host.strip("[]"), int(port)))
        for group in self.join:
            joined(s, group)
        return s

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows: list[tuple] = []
        while len(rows) < DRAIN:
            try:
                data, sender = self.socket.recvfrom(LONGEST)
            except BlockingIOError:
                break
            host = sender[0] if isinstance(sender, tuple) else ""
            agent = socket.inet_pton(socket.AF_INET6 if ":" in host else socket.AF_INET, host) if host else b""
            now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)  # the stamp of receipt
            rows.append((now, agent, start["seq"] + len(rows), data))
        self.held[start["seq"]] = rows
        if self.land and rows:
            os.makedirs(self.land, exist_ok=True)
            path = self._path(start["seq"])
            with open(f"{path}.part", "wb") as f:
                pickle.dump(rows, f)
                f.flush()
                os.fsync(f.fileno())
            os.rename(f"{path}.part", path)
        return iter(rows), {"seq": start["seq"] + len(rows)}

    def _path(self, seq: int) -> str:
        return os.path.join(self.land, f"{seq:020d}.packets")

    def _landed(self) -> list[int]:
        return sorted(int(x.split(".")[0]) for x in os.listdir(self.land) if x.endswith(".packets")) if self.land and os.path.isdir(self.land) else []

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for seq in self._landed():
            if seq < end["seq"] and seq not in self.held:
                with open(self._path(seq), "rb") as f:
                    self.held[seq] = pickle.load(f)
        return iter(r for _, rows in sorted(self.held.items()) for r in rows if start["seq"] <= r[2] < end["seq"])

    def commit(self, end: dict) -> None:
        done = [k for k, rows in self.held.items() if not rows or rows[-1][2] < end["seq"]]
        for k in done:
            if self.land and self.held[k]:
                os.unlink(self._path(k))
            del self.held[k]


def joined(s: socket.socket, group: str) -> None:
    """Makes the socket a member of a multicast group."""
    packed = ipaddress.ip_address(group)
    if not packed.is_multicast:
        raise ValueError(f"{group} is no multicast group")
    if packed.version == 4:
        s.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, packed.packed + socket.inet_aton("0.0.0.0"))
    else:
        s.setsockopt(socket.IPPROTO_IPV6, socket.IPV6_JOIN_GROUP, packed.packed + bytes(4))


class FlowPackets(DataSource):
    """``spark.readStream.format("flowpackets").option("listen", "udp://127.0.0.1:9995")``.

    Further options: ``join``, multicast groups with commas between them; ``land``, a folder in which datagrams are kept
    until their batch is done.

    A socket is one place, so this reads on the driver, at most DRAIN datagrams a batch.  At scale, exporters send to
    collectors that land packets as files, which ``packets_from`` streams without that limit.
    """

    @classmethod
    def name(cls) -> str:
        return "flowpackets"

    def schema(self) -> T.StructType:
        return PACKET

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        groups = [x.strip() for x in self.options.get("join", "").split(",") if x.strip()]
        return _Listener(self.options["listen"], groups, self.options.get("land"))


def register(spark) -> None:
    spark.dataSource.register(FlowPackets)
