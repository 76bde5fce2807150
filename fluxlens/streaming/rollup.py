"""Streaming roll-ups and relays."""

from __future__ import annotations

import errno
import os
import socket
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.exporters import admit
from ..operators.series import rollup
from ..plans.policy import Policy, PolicyError, apply_policy, apply_store, counter_columns, parse
from ..schema import ALL
from ..sources.packets import FLOW_ROW, PACKET, Flows, Templates, _Recorder, _replay, source_of


def rollup_stream(flows: DataFrame, delay: str = "1 hour", time: str = "recv_time") -> DataFrame:
    """The five-minute roll-up by time of receipt; flows later than ``delay`` behind the newest are dropped.

    Zone-less times are taken as UTC, since a watermark needs a time zone; the session's should be UTC.
    """
    if dict(flows.dtypes)[time] == "timestamp_ntz":
        flows = flows.withColumn(time, F.col(time).cast("timestamp"))
    return rollup(flows.withWatermark(time, delay), time)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs what is available now into a table in memory (for tests and reports)."""
    return (
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


#: Packets that are handled at once.
_PACKETS = 1000


def _with_templates(frames: Iterator[pd.DataFrame], templates: Templates) -> Iterator[pd.DataFrame]:
    """Packets of a source in the order of ``seq``, each with the templates that hold before it; ``templates`` gets what they announce.

    Payloads wait in a file; memory has some 30 bytes for each packet.
    """
    with tempfile.TemporaryFile() as kept:
        held, agent = [], None
        for frame in frames:
            payloads = [bytes(p) if p is not None else b"" for p in frame["payload"]]
            kept.write(b"".join(payloads))
            held.append((frame["recv_time"].to_numpy(), frame["seq"].to_numpy(), np.fromiter(map(len, payloads), np.int64, len(payloads))))
            agent = frame["agent_addr"].iloc[0] if len(frame) else agent
        kept.flush()
        times, seqs, sizes = (np.concatenate(x) for x in zip(*held, strict=True)) if held else [np.zeros(0)] * 3
        starts, order = np.cumsum(sizes) - sizes, np.argsort(seqs, kind="stable")
        recorder, blob = _Recorder(), templates.dump()
        for at in range(0, len(order), _PACKETS):
            rows, payloads, blobs = order[at : at + _PACKETS], [], []
            for size, start in zip(sizes[rows].tolist(), starts[rows].tolist(), strict=True):
                payload = os.pread(kept.fileno(), size, start)
                payloads.append(payload)
                blobs.append(blob)
                if payload[:2] == b"\0\x09" and (steps := recorder.of(payload)):
                    _replay([{"template": t, "fields": f, "size": n} for t, f, n in steps], int.from_bytes(payload[16:20], "big"), templates)
                    blob = templates.dump()
            numbers = pd.array(seqs[rows], dtype="Int64")
            yield pd.DataFrame({"recv_time": times[rows], "agent_addr": [bytes(agent)] * len(rows), "seq": numbers, "payload": payloads, "blob": blobs})


def decode_stream(packets: DataFrame, policy: Policy | None = None, idle: str | None = None) -> DataFrame:
    """Flows of a stream of packets, version 9 templates kept as state of each exporter's source.

    Exporters that the policy doesn't admit are dropped before anything is decoded.  A source's
    templates go after ``idle`` without a packet (if given: not for queries that end by themselves, since
    Spark runs batches for as long as a timeout may come); a limit over all exporters, which a single
    process could keep, would need one task for all of them.  Packets of one batch are taken in the order
    of ``seq``.  A source's task only follows what they announce, in order, and holds their payloads on its disk; they
    are decoded in any task, each with the templates that held when it came.
    """
    admitted = admit(packets, policy.sources if policy else None)
    state = T.StructType([T.StructField("blob", T.BinaryType())])
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        templates = Templates().load(held.get[0]) if held.exists else Templates()
        yield from _with_templates(frames, templates)
        held.update((templates.dump(),))
        if idle:
            held.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PACKETS):
                flows = Flows()
                for time, agent, seq, payload, blob in zip(*(c.to_pylist() for c in batch.slice(at, _PACKETS).columns), strict=True):
                    flows.add(time, agent, seq, payload, Templates().load(blob))
                yield flows.batch()

    told = (
        admitted.select(*PACKET.names, source_of(F.col("payload"), F.col("seq")).alias("source"))
        .groupBy("agent_addr", "source")
        .applyInPandasWithState(run, T.StructType([*PACKET.fields, T.StructField("blob", T.BinaryType())]), state, "append", timeout)
    )
    rows = told.select(*PACKET.names, F.coalesce("blob", F.lit(b"")).alias("blob"))  # an exchange can't take the rows as they come out
    flows = rows.repartition("agent_addr", "seq").mapInArrow(decode, FLOW_ROW)
    return apply_policy(flows, policy) if policy else flows


_RELAYS: dict[tuple, DatagramRelay] = {}


class DatagramRelay:
    """Sends records to a datagram socket, as ``send`` of :func:`relay`; gives (sent, lost) of each call.

    A full buffer loses the record and isn't an error.  A success takes an error back.  With more than ERRORS errors,
    more than WAIT seconds after the first of them, the socket is opened again before the next records.  Copies that
    reach the same worker process of an executor are one relay: its connection and errors outlive tasks and batches.
    """

    ERRORS, WAIT = 128, 60.0  # fixed values

    def __init__(self, path: str, connect: Callable | None = None, clock: Callable[[], float] = time.monotonic, name: str | None = None):
        self.path, self.connect, self.clock = path, connect, clock
        self.name = name or uuid.uuid4().hex
        self.errors = self.lost = self.sent = 0
        self.first_error: float | None = None
        self.socket = None

    def _connect(self):
        s = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM)
        s.connect(self.path)
        s.setblocking(False)  # a reader that doesn't keep up loses records, it doesn't hold up the stream
        return s

    def __reduce__(self) -> tuple:
        return _relay_here, (self.path, self.connect, self.clock, self.name)

    def _open(self) -> None:
        if self.socket is not None and self.errors > self.ERRORS and self.clock() > self.first_error + self.WAIT:
            self.socket.close()
            self.socket, self.first_error, self.errors = None, None, 0
        if self.socket is None:
            try:
                self.socket = (self.connect or self._connect)()
            except OSError:
                pass  # what comes is lost until it can be opened

    def __call__(self, records: Sequence[bytes]) -> tuple[int, int]:
        self._open()
        sent = lost = 0
        for record in records:
            try:
                if self.socket is not None:
                    self.socket.send(record)
                    sent += 1
                else:
                    lost += 1
                self.errors = max(0, self.errors - 1)
                if not self.errors:
                    self.first_error = None
            except OSError as e:
                lost += 1
                if e.errno != errno.ENOBUFS:
                    self.first_error = self.clock() if self.first_error is None else self.first_error
                    self.errors += 1
        self.sent, self.lost = self.sent + sent, self.lost + lost
        return sent, lost


def _relay_here(path: str, connect: Callable | None, clock: Callable[[], float], name: str) -> DatagramRelay:
    if (path, name) not in _RELAYS:
        _RELAYS[path, name] = DatagramRelay(path, connect, clock, name)
    return _RELAYS[path, name]


def relay(
    flows: DataFrame, send: Callable[[Sequence[bytes]], tuple[int, int] | None], checkpoint: str, policy: Policy | None = None,
    report: Callable[[int, int, int], None] | None = None,
) -> StreamingQuery:
    """Sends the record of each flow with ``send(list of records)``, a thousand or so at a time, on the executors.

    With a policy, only the groups that it stores are in the records.  ``report(batch, sent, lost)`` is called on the driver
    with the sums of what ``send`` gave, if anything.  Like any relay of datagrams this sends a batch again that failed.
    """
    from ..sources.flowlog import encode_records

    def sent_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [0, 0]
            for at in range(0, batch.num_rows, 1000):
                for i, n in enumerate(send(batch.column(0).slice(at, 1000).to_pylist()) or (0, 0)):
                    sums[i] += n
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in sums], names=["sent", "lost"])

    def each(batch: DataFrame, number: int) -> None:
        done = encode_records(batch, policy.store if policy else ALL).mapInArrow(sent_in, "sent long, lost long")
        sums = done.agg(F.coalesce(F.sum("sent"), F.lit(0)), F.coalesce(F.sum("lost"), F.lit(0))).first()
        if report:
            report(number, *sums)

    return flows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Counters:
    """What the rules of a stream have done so far, kept by their text, so that a rule keeps its counts when others change.

    Counts of a batch come back with it; a batch that is run again is counted once.
    """

    def __init__(self) -> None:
        self.batch, self.rules, self.last = -1, {}, {}

    def add(self, batch: int, policy: Policy, row: dict) -> None:
        if batch == self.batch:  # again
            for text, n in self.last.items():
                self.rules[text] = tuple(x - y for x, y in zip(self.rules[text], n, strict=True))
        self.batch, self.last = batch, {}
        for i, rule in enumerate(policy.rules):
            n = tuple(row[f"{what}_{i}"] for what in ("evaluations", "matches", "wins"))
            self.last[str(rule)] = tuple(map(sum, zip(n, self.last.get(str(rule), (0, 0, 0)), strict=True)))
        for text, n in self.last.items():
            self.rules[text] = tuple(map(sum, zip(n, self.rules.get(text, (0, 0, 0)), strict=True)))

    def report(self, policy: Policy) -> list[str]:
        """The policy's rules with their counts, as they are at this moment."""
        zero = (0, 0, 0)
        return ["{} # evaluations {} matches {} wins {}".format(r, *self.rules.get(str(r), zero)) for r in policy.rules]


@dataclass
class Running:
    """A stream whose policy is read for each batch: the query, the policy that holds, and what its rules have done."""

    query: StreamingQuery | None = None
    policy: Policy | None = None
    counters: Counters = field(default_factory=Counters)

    def report(self) -> list[str]:
        return self.counters.report(self.policy) if self.policy else []


def filtered_by_file(
    flows: DataFrame, policy_path: str, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, running: Running | None = None,
) -> StreamingQuery:
    """Each batch goes through the policy that the file holds by then, and what it stores to ``write(batch, number)``.

    So a policy is changed without stopping the stream.  While a file can't be parsed, the last good policy holds.
    Flows of exporters that the policy doesn't admit are left out first.  With ``running``, rules are counted
    as a by-product of the batch's own pass over the flows, and can be asked for at any time.
    """
    state = running or Running()

    def each(batch: DataFrame, number: int) -> None:
        text = "\n".join(r[0] for r in batch.sparkSession.read.text(policy_path, wholetext=True).collect())  # one small file
        try:
            state.policy = parse(text)
        except PolicyError:
            if state.policy is None:
                raise
        policy = state.policy
        admitted = admit(batch, policy.sources) if "agent_addr" in batch.columns else batch
        seen = Observation()
        if running and policy.rules:
            admitted = admitted.observe(seen, *counter_columns(policy, admitted.columns))
        write(apply_store(apply_policy(admitted, policy), policy), number)
        if running and policy.rules:
            state.counters.add(number, policy, seen.get)

    writer = flows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    state.query = (writer.trigger(availableNow=True) if once else writer).start()
    return state.query


def scrubbed(peers: DataFrame, policy: Policy) -> DataFrame:
    """Exporters (of :func:`~..operators.exporters.peer_stats`, say) that a policy still admits, after a change."""
    return admit(peers, policy.sources)


def packets_from(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of packets landed as Parquet files."""
    return spark.readStream.schema(PACKET).parquet(folder)
