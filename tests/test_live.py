import errno
import glob
import io
import os
import pickle
import socket
import threading
import time

import numpy as np
import pytest

from fluxlens.plans.policy import parse
from fluxlens.sources import flowlog, listener, packets, records
from fluxlens.streaming.rollup import Counters, DatagramRelay, Running, decode_stream, filtered_by_file, relay, scrubbed

FLOW = {"src_addr": bytes([10, 0, 0, 1]), "dst_addr": bytes([10, 0, 0, 2]), "src_port": 5, "dst_port": 6, "protocol": 17, "tcp_flags": 0,
        "tos": 0, "packets": 1, "octets": 2}


def test_listener():
    r = listener._Listener("udp://127.0.0.1:0")
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    sent = [packets.encoder(5)([FLOW]) for _ in range(600)]
    for p in sent[:100]:
        out.sendto(p, r.socket.getsockname())
    rows, end = r.read(r.initialOffset())
    rows = list(rows)
    assert end == {"seq": 100} and [x[2] for x in rows] == list(range(100)) and rows[3][3] == sent[3] and rows[0][1] == bytes([127, 0, 0, 1])
    assert list(r.readBetweenOffsets({"seq": 10}, {"seq": 12})) == rows[10:12]
    r.commit(end)
    assert not r.held and list(r.read(end)[0]) == []
    with pytest.raises(ValueError):
        listener._Listener("tcp://x:1")


def test_local_socket(tmp_path):
    path = str(tmp_path / "s")
    r = listener._Listener(f"unix://{path}")
    assert r.socket  # opened when it is first asked for
    send = DatagramRelay(path)
    send([records.encode(FLOW)] * 3)
    rows = list(r.read({"seq": 0})[0])
    assert send.sent == 3 and records.decode(rows[2][3])[0]["dst_port"] == 6


def test_relay_opens_again():
    now, opened, failing = [0.0], [], [errno.ECONNREFUSED]

    class Line:
        def send(self, _):
            if failing[0]:
                raise OSError(failing[0], "x")

        def close(self):
            opened.append("closed")

    def connect():
        opened.append(now[0])
        return Line()

    send = DatagramRelay("x", connect, lambda: now[0])
    assert send([b"r"] * 100) == (0, 100) and send.errors == 100
    now[0] = 30.0
    failing[0] = errno.ENOBUFS  # a full buffer is no error
    assert send([b"r"] * 50) == (0, 50) and send.errors == 100
    failing[0] = 0  # a success takes one back
    assert send([b"r"] * 40) == (40, 0) and send.errors == 60
    failing[0] = errno.ECONNREFUSED
    send([b"r"] * 69)
    assert send.errors == 129 and send.first_error == 0.0
    now[0] = 60.0  # not more than a minute after the first error
    send([b"r"])
    assert opened == [0.0]
    now[0] = 60.5
    send([b"r"])
    assert opened == [0.0, "closed", 60.5] and send.errors == 1 and send.first_error == 60.5
    failing[0] = 0
    send([b"r"])
    assert send.errors == 0 and send.first_error is None


def test_copies_of_a_relay_are_one():
    send = DatagramRelay("/nowhere", name="a")
    one, two = (pickle.loads(pickle.dumps(send)) for _ in range(2))
    one.errors = 100
    assert two is one and two.errors == 100
    assert pickle.loads(pickle.dumps(DatagramRelay("/nowhere", name="b"))) is not one


def test_relay_of_two_batches_in_two_partitions(spark, tmp_path):
    path = str(tmp_path / "s")
    here = listener._Listener(f"unix://{path}")
    assert here.socket
    got, ended = [], threading.Event()

    def listen():
        while not ended.is_set():
            got.extend(records.decode(r[3])[0]["octets"] for r in here.read({"seq": 0})[0])

    reader = threading.Thread(target=listen, daemon=True)
    reader.start()

    for batch in range(2):
        spark.createDataFrame([(batch * 100 + i,) for i in range(60)], "octets long").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("octets long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    told = []

    def waits():  # a connection that waits where the reader is behind
        s = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM)
        s.connect(path)
        s.settimeout(5)
        return s

    relay(stream, DatagramRelay(path, waits), str(tmp_path / "c"), report=lambda *x: told.append(x)).awaitTermination()
    ended.set()
    reader.join()
    assert told == [(0, 60, 0), (1, 60, 0)] and sorted(got) == [*range(60), *range(100, 160)]
    here.socket.close()
    os.unlink(path)
    told.clear()
    relay(stream, DatagramRelay(path), str(tmp_path / "c2"), report=lambda *x: told.append(x)).awaitTermination()
    assert [x[1:] for x in told] == [(0, 60)] * 2  # nobody listens: lost, and the stream goes on


def test_policy_is_read_for_each_batch(spark, tmp_path):
    spark.createDataFrame([(1, 6), (2, 17)], "flow_id long, protocol int").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("flow_id long, protocol int").parquet(str(tmp_path / "in"))
    policy = tmp_path / "p.conf"
    for k, (text, want) in enumerate((("discard proto tcp", [2]), ("discard proto udp", [1]))):
        policy.write_text(text)
        got = []
        filtered_by_file(stream(), str(policy), lambda batch, _: got.extend(r["flow_id"] for r in batch.collect()), str(tmp_path / f"c{k}")).awaitTermination()
        assert got == want


def test_relay_stream(spark, tmp_path):
    spark.createDataFrame([(7, 6)], "octets long, src_port int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("octets long, src_port int").parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")

    def send(rows):
        for r in rows:
            with open(target, "ab") as f:
                f.write(r)

    relay(stream, send, str(tmp_path / "c"), parse("store OCTETS")).awaitTermination()
    assert [r["octets"] for r in records.scan(open(target, "rb").read())] == [7]


def test_log_from_a_handle(spark, monkeypatch):
    monkeypatch.setattr(flowlog, "PIECE", 100)
    log = b"".join(records.encode(FLOW | {"tag": i}) for i in range(40))
    assert sorted(r["tag"] for r in flowlog.read_handle(spark, io.BytesIO(log)).collect()) == list(range(40))
    old = records.old_header() + b"".join(records.encode_old(FLOW | {"tag": i}) for i in range(40))
    assert sorted(r["tag"] for r in flowlog.read_handle(spark, io.BytesIO(old), old=True).collect()) == list(range(40))


def test_old_logs_are_not_appended_to(spark, tmp_path):
    flowlog.register(spark)
    (tmp_path / "a.flow").write_bytes(records.old_header() + records.encode_old(FLOW))
    df = spark.createDataFrame([(1,)], "octets long")
    with pytest.raises(Exception, match="old format"):
        df.write.format("flowlog").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="file systems"):
        df.write.format("flowlog").mode("append").save("s3a://bucket/x")


# logs written by streams, logs read in blocks


def test_a_batch_is_in_the_log_once(spark, tmp_path):
    flowlog.register(spark)
    log, data, checkpoint = str(tmp_path / "log"), str(tmp_path / "in"), str(tmp_path / "c")
    for k in range(3):
        spark.createDataFrame([(k * 10 + i,) for i in range(10)], "octets long").coalesce(1).write.mode("append").parquet(data)

    def run():
        stream = spark.readStream.schema("octets long").option("maxFilesPerTrigger", 1).parquet(data)
        stream.writeStream.format("flowlog").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["octets"] for r in flowlog.read_log(spark, f"{log}/*.flow").collect())

    assert run() == list(range(30))
    # the query ended after the last batch was written, but before Spark noted that
    for path in glob.glob(f"{checkpoint}/commits/*2") + glob.glob(f"{checkpoint}/commits/.*2.crc"):
        os.unlink(path)
    assert run() == list(range(30))
    assert not glob.glob(f"{log}/.[0-9a-f]*-*-*")


def test_a_commit_that_was_cut_off_is_ended(tmp_path):
    import pyarrow as pa

    from pyspark import TaskContext

    options = {"path": str(tmp_path)}
    TaskContext._taskContext = type("Task", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 7})()
    try:
        first = flowlog._StreamWriter(options, False)
        written = first.write(iter([pa.RecordBatch.from_pydict({"octets": pa.array([1, 2], pa.decimal128(20, 0))})]))
        rename, os.rename = os.rename, None
        try:
            first.commit([written, None], 4)
        except TypeError:
            pass  # ended between the two steps
        finally:
            os.rename = rename
        assert not glob.glob(f"{tmp_path}/*.flow")
        again = flowlog._StreamWriter(options, False)
        more = again.write(iter([pa.RecordBatch.from_pydict({"octets": pa.array([1, 2], pa.decimal128(20, 0))})]))
        again.commit([more], 4)
        again.commit([], 4)
    finally:
        TaskContext._taskContext = None
    (path,) = glob.glob(f"{tmp_path}/*.flow")
    assert [r["octets"] for r in records.scan(open(path, "rb").read())] == [1, 2]


@pytest.mark.parametrize("look_back", [8, 64, 4096])
def test_records_are_found_from_any_byte(look_back):
    rng = np.random.default_rng(look_back)
    names = ["src_addr", "dst_addr", "src_port", "octets", "tag", "packets", "protocol"]
    log, starts = b"", []
    for i in range(300):
        row = {c: (rng.bytes(16 if rng.random() < 0.5 else 4) if c.endswith("addr") else int(rng.integers(0, 255))) for c in names if rng.random() < 0.5}
        if {"src_port", "protocol"} & row.keys():
            row |= {"src_port": 1, "dst_port": 2} if "src_port" in row else {}
            row |= {"protocol": 1, "tos": 2, "tcp_flags": 3} if "protocol" in row else {}
        starts.append(len(log))
        log += records.encode(row)
    for at in range(0, starts[-1], 4):
        want = next(s for s in starts if s >= at)
        assert flowlog.first_record(lambda a, b: log[a:b], at, look_back) == want


def test_log_in_blocks(spark, tmp_path):
    log = b"".join(records.encode(FLOW | {"tag": i} if i % 3 else {"octets": i}) for i in range(500))
    (tmp_path / "a.flow").write_bytes(log)
    (tmp_path / "b.flow").write_bytes(log[:-5])  # the last record isn't whole
    (tmp_path / "c.flow").write_bytes(b"")
    want = sorted((r["input_file"][-6:], r["row_index"], r["tag"]) for r in flowlog.read_log(spark, f"{tmp_path}/*.flow").collect())
    for size in (40, 1000, 1 << 20):
        got = flowlog.read_split_log(spark, str(tmp_path), size).collect()
        assert sorted(((r["input_file"][-6:], r["row_index"], r["tag"]) for r in got), key=str) == sorted(want, key=str)


def test_counts_are_kept_when_the_policy_changes(spark, tmp_path):
    for k in range(2):
        rows = [(bytes([10, 0, 0, i % 2 + 1]), 6 if i % 3 else 17, i) for i in range(30)]
        spark.createDataFrame(rows, "agent_addr binary, protocol int, octets long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    texts = ["accept tag 1 proto tcp\ndiscard proto udp", "flow source 10.0.0.1/32\naccept tag 2 all\ndiscard proto udp"]
    policy, got, reports, running = tmp_path / "p.conf", [], [], Running()
    policy.write_text(texts[0])

    def write(batch, number):
        got.append(sorted(r["octets"] for r in batch.collect()))
        policy.write_text(texts[1])  # read by the next batch

    stream = spark.readStream.schema("agent_addr binary, protocol int, octets long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    filtered_by_file(stream, str(policy), write, str(tmp_path / "c"), running=running).awaitTermination()
    assert got == [[i for i in range(30) if i % 3], [i for i in range(30) if i % 3 and i % 2 == 0]]
    # ten of thirty flows are udp; half of all come from the exporter that is still admitted
    assert running.report() == ["accept tag 2 all # evaluations 15 matches 15 wins 10", "discard proto 17 # evaluations 45 matches 15 wins 15"]
    peers = spark.createDataFrame([(bytes([10, 0, 0, 1]),), (bytes([10, 0, 0, 2]),)], "agent_addr binary")
    assert [bytes(r[0])[3] for r in scrubbed(peers, running.policy).collect()] == [1]


def test_a_batch_is_counted_once():
    policy = parse("accept all\ndiscard proto tcp")
    row = {"evaluations_0": 5, "matches_0": 5, "wins_0": 3, "evaluations_1": 5, "matches_1": 2, "wins_1": 2}
    counters = Counters()
    for batch in (0, 0, 1):
        counters.add(batch, policy, row)
    assert counters.report(policy)[1].endswith("evaluations 10 matches 4 wins 4")


def test_landed_datagrams_outlive_the_listener(tmp_path):
    land = str(tmp_path / "land")
    r = listener._Listener("udp://127.0.0.1:0", land=land)
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for k in range(2):
        for i in range(5):
            out.sendto(bytes([k, i]), r.socket.getsockname())
        rows, end = r.read({"seq": 5 * k})
    r.socket.close()
    again = listener._Listener("udp://127.0.0.1:0", land=land)
    assert [x[3] for x in again.readBetweenOffsets({"seq": 3}, {"seq": 10})] == [bytes([0, 3]), bytes([0, 4]), *(bytes([1, i]) for i in range(5))]
    again.commit({"seq": 5})
    assert os.listdir(land) == ["00000000000000000005.packets"]
    again.commit(end)
    assert not os.listdir(land)


def test_multicast_groups():
    try:
        r = listener._Listener("udp://0.0.0.0:0", ["239.1.2.3"])
        assert r.socket
    except OSError as e:
        pytest.skip(f"no multicast here: {e}")
    with pytest.raises(ValueError, match="multicast"):
        listener.joined(r.socket, "10.0.0.1")


def test_packets_from_a_port_into_the_decoder(spark, tmp_path):
    """From the socket through decoder and policy, while the query runs."""
    listener.register(spark)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    stream = spark.readStream.format("flowpackets").options(listen=f"udp://127.0.0.1:{port}", land=str(tmp_path / "land")).load()
    flows = decode_stream(stream, parse("flow source 127.0.0.0/8\ndiscard proto tcp"))
    query = flows.select("src_port", "dst_port", "octets").writeStream.format("memory").queryName("from_a_port").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        what = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4)]
        ended = time.time() + 60
        sent = [packets.encode_v9([FLOW], 300, what), packets.encode_v9([FLOW | {"octets": 9}], 300, what, with_template=False), packets.encoder(5)([FLOW | {"protocol": 6}])]
        while time.time() < ended and (query.lastProgress is None):
            time.sleep(0.3)
        for p in sent:
            out.sendto(p, ("127.0.0.1", port))
        while time.time() < ended and spark.table("from_a_port").count() < 2:
            time.sleep(0.5)
        assert sorted(map(tuple, spark.table("from_a_port").collect())) == [(5, 6, 2), (5, 6, 9)]
    finally:
        query.stop()
