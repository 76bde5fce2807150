"""Flow logs as a Spark data source, ``format("flowlog")``, and as functions over Spark's own file access."""

from __future__ import annotations

import glob
import heapq
import json
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from ..schema import ALL, FLOW, columns_of, mask_of
from . import columns, records

LOG = T.StructType([*FLOW.fields, T.StructField("input_file", T.StringType()), T.StructField("row_index", T.LongType())])
_ROWS = 10_000
#: Bytes of a log that are read at once from an open file.
PIECE = 8 << 20
#: Bytes of a log for a task, where logs are dealt out.
TASK = 32 << 20


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def decoded(data: bytes | memoryview, name: str, old: bool, verify: bool, mode: str, schema: pa.Schema, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Records of a log with input_file and row_index.  PERMISSIVE ends a log at its first bad record."""
    if old:
        next(records.scan(data, True), None)  # checks the head of the log
    whole, at = np.frombuffer(data, np.uint8), records.OLD_HEADER.size if old else 0
    while at < len(data):
        starts = columns.walk(data, old, at, _ROWS + 1)
        at = int(starts[_ROWS]) if len(starts) > _ROWS else len(data)
        part = starts[:_ROWS]
        table, good, fault = columns.decode(whole, part, np.r_[part[1:], at] - part if len(part) else part, schema, old, verify)
        if fault is not None and mode.upper() != "PERMISSIVE":
            fault()
        more = {"input_file": pa.array([name] * len(part), pa.string()), "row_index": pa.array(np.arange(len(part)) + first)}
        yield table.batch(more).slice(0, good)
        if fault is not None:
            return
        first += len(part)


def read_log(spark: SparkSession, paths: str | Sequence[str], old: bool = False, verify: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Flows of logs, read through Spark's binary file source, so from any store that Spark reads.

    A log has no sync marks and is decoded from its start, so a file is a row of its own; records come
    with their file and number.
    """
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return decode_logs(files.select("path", "content"), old, verify, mode)


def decode_logs(files: DataFrame, old: bool = False, verify: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Flows of whole logs given as rows (name, content)."""
    schema = _arrow(LOG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                yield from decoded(memoryview(data).cast("B") if data is not None else b"", name, old, verify, mode, schema)

    return files.mapInArrow(run, LOG)


def read_handle(spark: SparkSession, handle: BinaryIO, old: bool = False, verify: bool = True) -> DataFrame:
    """Flows of a log that comes through an open file, such as ``sys.stdin.buffer``: cut at records into rows of PIECE bytes."""
    held, rows, first = b"", [], True
    while chunk := handle.read(PIECE):
        held += chunk
        starts = columns.walk(held, old) if first or not old else columns.walk(rows[0][1][:16] + held, old) - 16
        if not len(starts):
            continue
        last = int(starts[-1])  # the last one may go on
        if last:
            rows.append((f"-{len(rows)}", held[:last] if first or not old else rows[0][1][:16] + held[:last]))
            held, first = held[last:], False
    if held:
        rows.append((f"-{len(rows)}", held if first or not old else rows[0][1][:16] + held))
    return decode_logs(spark.createDataFrame(rows, "path string, content binary"), old, verify)


def decode_records(df: DataFrame, column: str = "record", verify: bool = True, old: bool = False) -> DataFrame:
    """Flows of single records in a binary column (as a relay sends them)."""
    schema = _arrow(FLOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).drop_null()
            table, _, fault = columns.decode(*columns.view(found), schema, old, verify)
            if fault is not None:
                fault()
            yield table.batch()

    return df.select(column).mapInArrow(run, FLOW)


def encode_records(df: DataFrame, mask: int = ALL, keep: Sequence[str] = (), old: bool = False, checksum: bool | None = None) -> DataFrame:
    """``keep`` and ``record``, the binary record of each flow under a mask.

    ``checksum``: True gives every record one, False none; by default those whose bitmap ``fields`` has it.
    """
    have = [c for c in ["fields", *columns_of(mask)] if c in df.columns and c not in keep]
    chosen = df.select(*keep, *have)
    out = T.StructType([*[chosen.schema[k] for k in keep], T.StructField("record", T.BinaryType())])
    schema = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = columns.encode(batch.select(list(set([*have, *(k for k in keep if k in FLOW.names)]))), mask, old, checksum)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), made], schema=schema)

    return chosen.mapInArrow(run, out)


def log_of(df: DataFrame, by: str, mask: int = ALL, old: bool = False, checksum: bool | None = None) -> DataFrame:
    """(path, content): a whole log for each value of ``by``, which should have a bounded number of flows."""
    each = encode_records(df, mask, (by,), old, checksum).groupBy(by).agg(F.collect_list("record").alias("records"))
    head = F.lit(records.old_header() if old else b"")
    whole = F.unhex(F.array_join(F.transform("records", F.hex), ""))
    return each.select(F.col(by).cast("string").alias("path"), F.concat(head, whole).alias("content"))


#: Longest record; bytes that are looked back at first for where a record begins.
LONGEST, LOOK_BACK = records.HEADER.size + records.MOST, 1 << 16


def first_record(read: Callable[[int, int], bytes], at: int, look_back: int = LOOK_BACK) -> int:
    """Where the first record at or behind byte ``at`` of a log begins, found without going through the log.

    ``read(start, stop)`` gives bytes of it.  A record begins at one of the 257 words behind any byte that is a
    multiple of four, so walks along the length words are begun at all of them.  Walks that meet go on as one;
    if only one is left, it is the true one whichever that was.  If several are, they are begun further back.
    """
    while at:
        begin = max(0, at - look_back) & ~3
        data = read(begin, at + 1)  # a word before ``at`` may have its length behind it
        walks = [0] if not begin else list(range(0, LONGEST, 4))  # a heap
        while walks[0] < at - begin:
            least = walks[0]
            while walks and walks[0] == least:
                heapq.heappop(walks)
            heapq.heappush(walks, least + records.HEADER.size + 4 * data[least + 1])
        if len(set(walks)) == 1:
            return begin + walks[0]
        look_back *= 4
    return 0


def _range_of(path: str) -> Callable[[int, int], bytes]:
    def read(start: int, stop: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(stop - start)

    return read


def records_of_block(path: str, start: int, stop: int) -> tuple[int, bytes]:
    """Where the first record that begins in a block begins, and the bytes of all that do, the last one whole if the log has it."""
    read = _range_of(path)
    begin = first_record(read, start)
    if begin >= stop:
        return begin, b""
    data = read(begin, stop + LONGEST)
    at, inside = 0, stop - begin
    while at < inside:
        at = at + records.HEADER.size + 4 * data[at + 1] if at + 1 < len(data) else len(data)
    return begin, data[:at]


def end_of_records(path: str) -> int:
    """Where the last whole record of a log ends, found from its end."""
    size = os.path.getsize(path)
    begin = first_record(_range_of(path), max(0, size - 2 * LONGEST) & ~3)
    data = _range_of(path)(begin, size)
    starts = columns.walk(data, False)
    return begin + (int(starts[-1]) + records.HEADER.size + 4 * data[starts[-1] + 1] if len(starts) else 0)


def join_logs(spark: SparkSession, folder: str, path: str) -> str:
    """All logs of a folder, in the order of their names, as one log of the new format: tasks copy parts of TASK bytes to their places.

    The folder and ``path`` are on a file system that all executors see; the log gets its name when it is whole.
    """
    rows, size, hidden = [], 0, os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}")
    for p in sorted(glob.glob(os.path.join(folder, "*.flow"))):
        length = os.path.getsize(p)
        rows += [(p, at, min(at + TASK, length), size + at) for at in range(0, length, TASK)]
        size += length
    with open(hidden, "wb") as f:
        f.truncate(size)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, start, stop, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(source, "rb") as f, open(hidden, "r+b") as out:
                    f.seek(start)
                    out.seek(to)
                    for at in range(start, stop, PIECE):
                        out.write(f.read(min(PIECE, stop - at)))
                yield pa.RecordBatch.from_arrays([pa.array([stop - start], pa.int64())], names=["copied"])

    parts = spark.createDataFrame(rows, "path string, start long, stop long, to long").repartition(max(1, len(rows)))
    copied = parts.mapInArrow(copy, "copied long").agg(F.coalesce(F.sum("copied"), F.lit(0))).first()[0]
    if copied != size:
        raise OSError(f"{copied} of {size} bytes of {folder} were copied")
    os.rename(hidden, path)
    return path


def read_split_log(spark: SparkSession, paths: str, splitbytes: int = 128 << 20, verify: bool = True) -> DataFrame:
    """Flows of logs of the new format of any length, each decoded by many tasks; a bad record is an error.

    Tasks find where the records of their block begin and count them; the driver gets a row for each block,
    and adds up the numbers of the first records.  Neither it nor any task goes through a whole log.  Paths are on a
    file system that all executors see.
    """
    found = sorted(glob.glob(os.path.join(paths, "*.flow")) if os.path.isdir(paths) else glob.glob(paths))
    most = max(4, splitbytes & ~3)
    blocks = [(p, at, min(at + most, size)) for p in found for size in [os.path.getsize(p)] for at in range(0, size, most)]
    tasks = max(1, min(len(blocks), -(-sum(stop - at for _, at, stop in blocks) // TASK)))
    spread = spark.createDataFrame(blocks, "path string, start long, stop long").repartition(tasks)
    counted_as = "path string, start long, stop long, records long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin, data = records_of_block(path, start, stop)
                if data:
                    rows.append((path, begin, begin + len(data), len(columns.walk(data, False))))
            made = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.string(), *[pa.int64()] * 3), strict=True)], names=["path", "start", "stop", "records"])

    parts, first = [], {}
    for r in sorted(spread.mapInArrow(count, counted_as).collect()):  # a row for each block
        parts.append((r["path"], r["start"], r["stop"], first.get(r["path"], 0)))
        first[r["path"]] = parts[-1][3] + r["records"]
    schema = _arrow(LOG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from decoded(_range_of(path)(start, stop), path, False, verify, "FAILFAST", schema, number)

    dealt = spark.createDataFrame(parts, "path string, start long, stop long, first long").repartition(tasks)
    return dealt.mapInArrow(run, LOG)


@dataclass
class _File(InputPartition):
    path: str
    first: int
    start: int
    stop: int


def byte_ranges(path: str, most: int) -> Iterator[tuple[int, int, int]]:
    """(first record's number, start, stop) of parts of about ``most`` bytes, found by walking the length words."""
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        at = start = number = first = 0
        while at + records.HEADER.size <= size:
            f.seek(at)
            head = f.read(records.HEADER.size)
            at += records.HEADER.size + 4 * head[1]
            number += 1
            if at - start >= most:
                yield first, start, min(at, size)
                start, first = at, number
        if start < size:
            yield first, start, size


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options
        self.old = options.get("version", "3") == "2"

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        found = sorted(glob.glob(os.path.join(path, "*.flow")) if os.path.isdir(path) else glob.glob(path))
        most = int(self.options.get("splitbytes", 128 << 20))
        if self.old:
            return [_File(p, 0, 0, os.path.getsize(p)) for p in found]
        return [_File(p, *r) for p in found for r in byte_ranges(p, most)]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            f.seek(part.start)
            data = f.read(part.stop - part.start)
        verify = self.options.get("verify_crc", "true").lower() == "true"
        yield from decoded(data, part.path, self.old, verify, self.options.get("mode", "FAILFAST"), _arrow(self.schema), part.first)


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


def _paths(messages: list) -> list[str]:
    return [path for m in messages if m is not None for path in m.paths]


class _Writer(DataSourceArrowWriter):
    """Files of some ``filebytes`` bytes, one for each task at least, made visible by their names when the job commits.

    A log that isn't split is read by one task, so none should be long.

    Logs of the old format in the folder are never added to.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.mask = mask_of(options.get("fields", "ALL"))
        self.crc = options.get("crc", "true").lower() == "true"
        self.most = int(options.get("filebytes", TASK))
        self.job = uuid.uuid4().hex
        if "://" in self.folder and not self.folder.startswith("file://"):
            raise ValueError(f"flowlog writes to file systems that all executors see, not to {self.folder}")
        self.folder = self.folder.removeprefix("file://")
        for path in [] if overwrite else glob.glob(os.path.join(self.folder, "*.flow")):
            with open(path, "rb") as f:
                if f.read(8) == records.old_header()[:8]:
                    raise ValueError(f"{path} is a log of the old format: nothing is appended")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        task = TaskContext.get()
        stem = os.path.join(self.folder, f".{self.job}-{task.partitionId()}-{task.taskAttemptId()}")
        paths = [f"{stem}-0"]
        f = open(paths[0], "wb")
        try:
            for batch in batches:
                if f.tell() >= self.most:
                    f.close()
                    paths.append(f"{stem}-{len(paths)}")
                    f = open(paths[-1], "wb")
                known = [c for c in batch.schema.names if c in FLOW.names]
                f.write(columns.encode(batch.select(known), self.mask, checksum=self.crc or None).buffers()[2] or b"")
        finally:
            f.close()
        return _Written(paths)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for old in glob.glob(os.path.join(self.folder, "*.flow")):
                os.remove(old)
        for i, path in enumerate(_paths(messages)):
            os.rename(path, os.path.join(self.folder, f"part-{i:05d}-{self.job}.flow"))

    def abort(self, messages: list) -> None:
        for path in _paths(messages):
            if os.path.exists(path):
                os.remove(path)


class _StreamWriter(DataSourceStreamArrowWriter):
    """Each batch of a stream once in the log, whatever fails: two steps in place of cutting a file back.

    Tasks write hidden files.  ``commit`` first writes down which of them make up the batch, under a name that only
    one writer can give, and then gives them their names.  A batch that comes again after a restart finds
    what was written down: those files get their names, and what its tasks have written now goes.  Without that,
    nothing of the batch had been seen, and the files of its lost tasks go when the next batch is committed.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.files = _Writer(options, False)
        self.name = options.get("name", "stream")
        self.noted = os.path.join(self.files.folder, f".{self.name}-batches")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        return self.files.write(batches)

    def commit(self, messages: list, batchId: int) -> None:
        os.makedirs(self.noted, exist_ok=True)
        note = os.path.join(self.noted, str(batchId))
        mine = _paths(messages)
        if not os.path.exists(note):
            named = [(p, os.path.join(self.files.folder, f"{self.name}-{batchId:09d}-{i:05d}.flow")) for i, p in enumerate(p for p in mine if os.path.getsize(p))]
            draft = os.path.join(self.noted, f".{batchId}-{uuid.uuid4().hex}")
            with open(draft, "w") as f:
                json.dump(named, f)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, note)  # fails if another writer was first
            except FileExistsError:
                pass
            os.unlink(draft)
        with open(note) as f:
            named = json.load(f)
        for hidden, path in named:
            if os.path.exists(hidden):
                os.rename(hidden, path)
        for path in mine:
            if os.path.exists(path):
                os.unlink(path)

    def abort(self, messages: list, batchId: int) -> None:
        self.files.abort(messages)


class _Stream(DataSourceStreamReader):
    """New records of a growing log: the offset is a number of bytes; a record that isn't whole yet waits.

    The driver only looks at the end of the log.  A batch is all that is new, in blocks of ``maxbytes``: tasks find
    where the records of their block begin and read them.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = max(4, int(options.get("maxbytes", 8 << 20)) & ~3)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": end_of_records(self.path) if os.path.exists(self.path) else 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(self.path, 0, at, min(at + self.most, end["at"])) for at in range(start["at"], end["at"], self.most)]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        begin, data = records_of_block(part.path, part.start, part.stop)
        yield from decoded(data, part.path, False, True, "FAILFAST", _arrow(FLOW), begin)


class FlowLog(DataSource):
    """``spark.read.format("flowlog")``; options path, version (3 or 2), verify_crc, mode, splitbytes.

    ``df.write.format("flowlog").mode("append")`` and ``df.writeStream.format("flowlog")``; options path, fields, crc, filebytes, and
    for streams name (of the query, if several write to one folder).  Paths are on a file system
    that all executors see; :func:`read_log` reads from other stores.
    """

    @classmethod
    def name(cls) -> str:
        return "flowlog"

    def schema(self) -> T.StructType:
        return LOG if self.options.get("streaming", "false") == "false" else FLOW

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(dict(self.options), overwrite)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FlowLog)


def with_recv_time(df: DataFrame) -> DataFrame:
    """Adds recv_time, the time of receipt as a zone-less timestamp."""
    at = F.timestamp_add("MICROSECOND", F.coalesce(F.col("recv_usec"), F.lit(0)).cast("long"),
                         F.timestamp_add("SECOND", F.col("recv_sec"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    return df.withColumn("recv_time", at)
