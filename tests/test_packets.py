import datetime as dt
import decimal
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlens.sources import packets as P

FLOW = {"src_addr": bytes([10, 0, 0, 1]), "dst_addr": bytes([10, 0, 0, 2]), "gateway_addr": bytes(4), "src_port": 5, "dst_port": 6,
        "protocol": 17, "tos": 3, "tcp_flags": 2, "packets": 9, "octets": 2**32 - 1, "if_index_in": 1, "if_index_out": 2,
        "flow_start": 11, "flow_finish": 12}
TEMPLATE = [(8, 4), (12, 4), (4, 1), (1, 8), (99, 3)]


@pytest.mark.parametrize("version", [1, 5, 7])
def test_fixed_versions(version):
    more = {"engine_type": 1, "engine_id": 2} if version == 5 else {}
    row = FLOW | {"sys_uptime_ms": 1, "agent_sec": 2, "agent_nsec": 3} | more
    if version != 1:
        row |= {"src_as": 1, "dst_as": 2, "src_mask": 24, "dst_mask": 8, "flow_sequence": 4}
    data = P.encoder(version)([row, row])
    assert len(data) == {1: 16 + 96, 5: 24 + 96, 7: 24 + 104}[version]
    d = P.decode_packet(data)
    assert d.error is None and len(d.flows) == 2 and d.version == version
    assert all(d.flows[1][k] == v for k, v in row.items())
    most = P.LAYOUTS[version].most
    assert len(P.decode_packet(P.encoder(version)([row] * most)).flows) == most
    assert P.decode_packet(P.encoder(version)([row] * (most + 1))).error
    assert P.decode_packet(data + b"\0").error and P.decode_packet(data[:-1]).error
    assert P.decode_packet(data[:2] + b"\0\0" + data[4:]).error


def test_bad_heads():
    assert P.decode_packet(b"\0\5").error == "too short"
    assert "unknown" in P.decode_packet(b"\0\x08\0\1" + bytes(50)).error
    assert P.decode_packet(b"\0\x05\0\1").error


def v9(*flowsets, source=1):
    return struct.pack(">HHIIII", 9, len(flowsets), 7, 8, 9, source) + b"".join(flowsets)


def template(tid, fields):
    body = struct.pack(">HH", tid, len(fields)) + b"".join(struct.pack(">HH", *f) for f in fields)
    return struct.pack(">HH", 0, 4 + len(body)) + body


def data_set(tid, body):
    return struct.pack(">HH", tid, 4 + len(body)) + body


RECORD = bytes([10, 0, 0, 1]) + bytes([10, 0, 0, 2]) + b"\x11" + (2**40).to_bytes(8, "big") + b"xyz"


def test_v9():
    t = P.Templates()
    assert P.decode_packet(v9(data_set(256, RECORD)), t).no_template == 1
    d = P.decode_packet(v9(template(256, TEMPLATE), data_set(256, RECORD * 2 + b"\0\0")), t)
    assert d.error is None and len(d.flows) == 2
    assert d.flows[0]["octets"] == 2**40 and d.flows[0]["protocol"] == 17 and d.flows[0]["tos"] == 0
    assert "flow_sequence" not in d.flows[0] and d.flows[0]["netflow_version"] == 9
    assert len(P.decode_packet(v9(data_set(256, RECORD)), t).flows) == 1
    assert P.decode_packet(v9(data_set(256, RECORD), source=2), t).no_template == 1
    P.decode_packet(v9(template(256, [(1, 2)])), t)
    assert P.decode_packet(v9(data_set(256, b"\1\2")), t).flows[0]["octets"] == 258


def test_v9_faults_keep_what_came_before():
    t = P.Templates()
    d = P.decode_packet(v9(template(256, TEMPLATE), data_set(256, RECORD), struct.pack(">HH", 256, 3)), t)
    assert d.error and len(d.flows) == 1
    assert P.decode_packet(v9(struct.pack(">HH", 1, 0)), t).error
    assert P.decode_packet(v9(data_set(1, bytes(8)), data_set(200, bytes(4))), t).error is None
    for fields in ([(1, 9)], [(8, 5)], [(99, 0)], [(99, 0x4001)], [(99, 1000), (98, 100)]):
        assert P.decode_packet(v9(template(300, fields)), t).error, fields
    assert P.decode_packet(v9(template(300, []) + b""), t).error is None and t.get(1, 300) is None


def test_template_limits():
    t = P.Templates()
    for i in range(10):
        t.put(1, 256 + i, [(1, 4)])
    assert sorted(t.sources[1]) == list(range(258, 266))
    t.put(1, 258, [(2, 4)])  # keeps its place
    t.put(1, 900, [(1, 4)])
    assert t.get(1, 258) is None and t.get(1, 900)
    for s in range(70):
        t.put(s + 10, 256, [(1, 4)])
    assert len(t.sources) == P.MOST_SOURCES


ROWS = [
    (dt.datetime(2024, 1, 1), b"\x0a\0\0\1", 1, v9(data_set(256, RECORD))),
    (dt.datetime(2024, 1, 1), b"\x0a\0\0\1", 2, v9(template(256, TEMPLATE))),
    (dt.datetime(2024, 1, 1), b"\x0a\0\0\1", 3, v9(data_set(256, RECORD * 3))),
    (dt.datetime(2024, 1, 1), b"\x0a\0\0\2", 4, v9(data_set(256, RECORD))),
    (dt.datetime(2024, 1, 1), b"\x0a\0\0\2", 5, P.encoder(5)([FLOW])),
    (dt.datetime(2024, 1, 1), b"\x0a\0\0\2", 6, b"\0"),
    (dt.datetime(2024, 1, 1), b"\x0a\0\0\2", 7, None),
]


def test_frames(spark):
    df = spark.createDataFrame(ROWS, P.PACKET)
    assert [r["octets"] for r in P.decode_packets(df).collect()] == [2**32 - 1]
    assert [(r["seq"], int(r["octets"])) for r in P.decode_v9_packets(df).collect()] == [(3, 2**40)] * 3
    facts = {(r["agent_addr"][3], r["flows"], r["invalid"], r["no_template"]) for r in P.packet_facts(df).collect()}
    assert facts == {(1, 0, 0, 1), (1, 0, 0, 0), (1, 3, 0, 0), (2, 0, 0, 1), (2, 1, 0, 0), (2, 0, 1, 0)}
    assert P.decode_packets(df.limit(0)).count() == 0


def test_families_must_agree(spark):
    mixed = [(8, 4), (28, 16)]
    row = (dt.datetime(2024, 1, 1), b"\x0a\0\0\1", 1, v9(template(256, mixed), data_set(256, bytes(20))))
    assert P.decode_v9_packets(spark.createDataFrame([row], P.PACKET)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from fluxlens.plans.policy import parse
    from fluxlens.streaming.rollup import decode_stream, packets_from, run_once

    df = spark.createDataFrame(ROWS, P.PACKET)
    df.where("seq < 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = decode_stream(packets_from(spark, str(tmp_path / "in")), parse("flow source 10.0.0.0/8\naccept tag 4 all"))
    run_once(stream, "decoded", str(tmp_path / "cp")).awaitTermination()
    assert spark.table("decoded").count() == 0
    df.where("seq >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = decode_stream(packets_from(spark, str(tmp_path / "in")), parse("flow source 10.0.0.0/8\naccept tag 4 all"))
    out = []

    def keep(batch, _):
        out.extend(batch.select("seq", "octets", "tag").collect())

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["seq"], int(r["octets"]), r["tag"]) for r in out) == [(3, 2**40, 4)] * 3 + [(5, 2**32 - 1, 4)]


# version 9 in buckets


def _random_packets(rng, n, ids, agents=(b"\x0a\0\0\1",) * 9 + (b"\x0a\0\0\2",)):
    """Packets of an exporter with nine tenths of all, and another: templates that change, data that doesn't fit, broken flowsets."""
    fields = [(1, 4), (2, 4), (7, 2), (11, 2), (4, 1), (200, 3), (8, 4), (12, 4)]
    out = []
    for seq in range(n):
        body = b""
        for _ in range(int(rng.integers(0, 5))):
            template, kind = int(rng.choice(ids)), rng.random()
            if kind < 0.25:
                what = [fields[i] for i in rng.choice(len(fields), int(rng.integers(1, 5)), replace=False)]
                part = struct.pack(">HH", template, len(what)) + b"".join(struct.pack(">HH", *f) for f in what)
                body += struct.pack(">HH", 0, 4 + len(part)) + part
            elif kind < 0.95:
                data = rng.bytes(int(rng.choice([0, 1, 12, 40])))
                body += struct.pack(">HH", template, 4 + len(data)) + data
            elif kind < 0.97:
                body += struct.pack(">HHHHHH", 0, 12, template, 1, 8, 3)  # an address of three bytes
            else:
                body += struct.pack(">HH", template, int(rng.integers(0, 999)))
        head = struct.pack(">HHIIII", 9, 1, 5, 6, seq, int(rng.choice([1, 1, 1, 2])))
        out.append((agents[int(rng.integers(len(agents)))], seq, (head + body)[: int(rng.choice([9, 2000, 2000, 2000, 2000]))]))
    return out


@pytest.mark.parametrize("ids", [(300, 301, 302), tuple(range(300, 312))])
def test_buckets_give_what_decoding_in_turn_gives(spark, monkeypatch, tmp_path, ids):
    monkeypatch.setattr(P, "BUCKET", 16)
    rng = np.random.default_rng(len(ids))
    made = _random_packets(rng, 400, ids)
    held, want, facts = {}, [], []
    for agent, seq, payload in made:
        d = P.decode_packet(payload, held.setdefault((agent, payload[16:20]), P.Templates()))
        facts.append((agent, seq, 0 if d.error else len(d.flows), int(d.error is not None), d.no_template))
        want += [(agent, seq, *(row.get(c) for c in ("octets", "packets", "src_port", "dst_port", "protocol", "src_addr"))) for row in d.flows if P._same_family(row)]
    rows = [(None, agent, seq, payload) for agent, seq, payload in made]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, P.PACKET).repartition(3)
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else int(x) if isinstance(x, decimal.Decimal) else x
    got = P.decode_v9_packets(df).select("agent_addr", "seq", "octets", "packets", "src_port", "dst_port", "protocol", "src_addr").collect()
    assert len(want) > 300
    assert sorted((tuple(map(plain, r)) for r in got), key=str) == sorted(want, key=str)
    got = P.packet_facts(df).select("agent_addr", "seq", "flows", "invalid", "no_template").collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(facts)


def test_one_exporter_is_dealt_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 16)
    made = [(None, a, s, p) for a, s, p in _random_packets(np.random.default_rng(3), 800, (300, 301))]
    dealt = P._in_buckets(spark.createDataFrame(made, P.PACKET)).where("not held").withColumn("task", F.spark_partition_id())
    with_conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["count"] for r in dealt.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_conf)
    assert len(tasks) == 4 and max(tasks) < 400
