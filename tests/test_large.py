"""Work that no task, group or driver holds whole."""

import os

from fluxlens.sources import flowlog, records

FLOW = {"src_addr": bytes([10, 0, 0, 1]), "dst_addr": bytes([10, 0, 0, 2]), "src_port": 5, "dst_port": 6, "packets": 1, "octets": 2}


# logs


def test_a_growing_log_is_read_by_tasks(spark, tmp_path):
    log = b"".join(records.encode(FLOW | {"tag": i} if i % 3 else {"octets": i}) for i in range(500))
    path = tmp_path / "a.flow"
    path.write_bytes(log[: len(log) // 2 + 3])  # ends within a record
    reader = flowlog._Stream({"path": str(path), "maxbytes": "1000"})
    seen, at = [], reader.initialOffset()
    for _ in range(2):
        new = reader.latestOffset()
        parts = reader.partitions(at, new)
        assert len(parts) > 5
        for part in parts:
            assert part.stop - part.start <= 1000
            for batch in reader.read(part):
                seen += batch.to_pylist()
        assert new["at"] <= os.path.getsize(path) < new["at"] + 60 and not reader.partitions(new, new)
        at = new
        path.write_bytes(log)
    want = list(records.scan(log))
    assert [(r["tag"], r["octets"]) for r in seen] == [(r.get("tag"), r["octets"]) for r in want]


def test_end_of_a_log(tmp_path):
    path, one = tmp_path / "a.flow", records.encode(FLOW)
    for n, more in ((0, b""), (0, one[:9]), (1, b""), (1, one[:1]), (400, one[:-1])):
        path.write_bytes(one * n + more)
        assert flowlog.end_of_records(str(path)) == n * len(one)


def test_parts_become_one_log(spark, tmp_path, monkeypatch):
    flowlog.register(spark)
    monkeypatch.setattr(flowlog, "TASK", 1000)
    monkeypatch.setattr(flowlog, "PIECE", 300)
    (tmp_path / "parts").mkdir()
    logs = [b"".join(records.encode(FLOW | {"tag": k * 100 + i}) for i in range(n)) for k, n in enumerate((70, 0, 1, 50))]
    for k, log in enumerate(logs):
        (tmp_path / "parts" / f"part-{k}.flow").write_bytes(log)
    path = flowlog.join_logs(spark, str(tmp_path / "parts"), str(tmp_path / "whole.flow"))
    assert open(path, "rb").read() == b"".join(logs)
    found = flowlog.read_split_log(spark, path, 256)
    assert found.rdd.getNumPartitions() == -(-sum(map(len, logs)) // 1000)  # not one for each block
    assert [r["tag"] for r in found.orderBy("row_index").collect()] == [r["tag"] for r in records.scan(b"".join(logs))]


# streams of packets


def test_a_source_hands_its_packets_on(monkeypatch):
    """A source's task decodes nothing: packets leave it a few at a time, in order, with the templates before them."""
    import datetime as dt

    import pandas as pd

    from fluxlens.sources import packets
    from fluxlens.streaming import rollup

    monkeypatch.setattr(rollup, "_PACKETS", 10)
    what = [[(8, 4), (12, 4), (1, 4)], [(1, 4), (12, 4), (8, 4)]]
    sent = [packets.encode_v9([FLOW | {"octets": i}] * 3, 300, what[i // 30], source=7, with_template=i in (2, 30)) for i in range(50)]
    rows = [(dt.datetime(2024, 1, 1), b"\x0a\0\0\1", i, p) for i, p in enumerate(sent)]
    frames = [pd.DataFrame(rows[k::3][::-1], columns=["recv_time", "agent_addr", "seq", "payload"]) for k in range(3)]
    templates = packets.Templates()
    out = list(rollup._with_templates(iter(frames), templates))
    assert max(map(len, out)) == 10
    whole = pd.concat(out)
    assert list(whole["seq"]) == list(range(50)) and list(whole["payload"]) == sent
    flows = packets.Flows()
    for time, agent, seq, payload, blob in whole.itertuples(index=False):
        flows.add(time, agent, seq, payload, packets.Templates().load(blob))
    assert [int(r["octets"]) for r in flows.batch().sort_by("seq").to_pylist()] == [i for i in range(2, 50) for _ in range(3)]
    assert templates.get(7, 300) == what[1]


def test_a_task_writes_several_logs(spark, tmp_path):
    flowlog.register(spark)
    df = spark.range(30000).selectExpr("id AS octets").coalesce(1)
    df.write.format("flowlog").option("filebytes", "1000").mode("append").save(str(tmp_path / "log"))
    assert len(list((tmp_path / "log").glob("*.flow"))) > 1 and not list((tmp_path / "log").glob(".*"))
    for folder in ("log", "streamed"):
        if folder == "streamed":
            df.write.parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("octets long").parquet(str(tmp_path / "in"))
            out = stream.writeStream.format("flowlog").options(path=str(tmp_path / folder), filebytes="1000", checkpointLocation=str(tmp_path / "c"))
            out.trigger(availableNow=True).start().awaitTermination()
            assert len(list((tmp_path / folder).glob("*.flow"))) > 1
        assert [int(r["octets"]) for r in flowlog.read_log(spark, f"{tmp_path}/{folder}/*.flow").orderBy("octets").collect()] == list(range(30000))


def test_a_log_is_walked_a_piece_at_a_time(monkeypatch):
    monkeypatch.setattr(flowlog, "_ROWS", 7)
    walked, walk = [], flowlog.columns.walk
    monkeypatch.setattr(flowlog.columns, "walk", lambda *a: walked.append(walk(*a)) or walked[-1])
    for old, log in ((False, b"".join(records.encode(FLOW | {"tag": i}) for i in range(50))), (True, records.old_header() + b"".join(records.encode_old(FLOW | {"tag": i}) for i in range(50)))):
        for data in (log, memoryview(log), log[:-1], log[:20], b""):
            rows = [r for b in flowlog.decoded(data, "a", old, True, "FAILFAST", flowlog._arrow(flowlog.LOG)) for r in b.to_pylist()]
            want = list(records.scan(bytes(data), old))
            assert [r["tag"] for r in rows] == [r["tag"] for r in want] and [r["row_index"] for r in rows] == list(range(len(want)))
    assert max(map(len, walked)) <= 8


# addresses


def test_texts_as_the_library_has_them():
    import ipaddress

    import numpy as np

    from fluxlens.functions import addresses

    rng = np.random.default_rng(1)
    some = [bytes(x) for x in rng.integers(0, 256, (300, 16), np.uint8) * (rng.random((300, 16)) < 0.3).astype(np.uint8)]
    some += [bytes(10) + b"\xff\xff" + x[:4] for x in some[:50]] + [bytes(12) + x[:4] for x in some[:50]] + [bytes(16), bytes(15) + b"\1", bytes(10) + b"\xff\xff" + bytes(4)]
    for a in some + [x[:4] for x in some]:
        ip, shown = ipaddress.ip_address(a), addresses.ntop(a)
        assert addresses.packed(shown) == addresses.packed(str(ip)) == addresses.packed(ip.exploded) == a
        assert "." in shown or shown == str(ip)
    for bad in ("", "x", "1.2.3", "1.2.3.256", "::1::", "1:2", "01.2.3.4", "1.2.3.4 ", ":::", "\0::1", "١::1"):
        assert addresses.packed(bad) is None
    assert addresses.packed("fe80::1%eth0") == ipaddress.ip_address("fe80::1").packed and addresses.packed(None) is None


def test_algebra_works_halves_out_once(spark):
    """The plan of all operations on one address has a bounded number of conversions from text; results are as by bytes."""
    from pyspark.sql import functions as F

    from fluxlens.functions import addresses as A

    rows = [(a, b, n) for a in (b"\x0a\1\2\3", bytes(4), b"\xff" * 4, bytes(range(16)), bytes(16), b"\xff" * 16) for b in (b"\xc0\xa8\0\x7f", bytes(range(240, 256))) for n in (-1, 0, 1, 31, 32, 33, 63, 64, 65, 127, 128, 129)]
    df = spark.createDataFrame(rows, "a binary, b binary, n int")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    made = df.select("a", "b", "n", A.both_columns(a, b).alias("both"), A.either_columns(a, b).alias("either"), A.invert_column(a).alias("inverted"),
                     A.first_of(a, n).alias("first"), A.last_of(a, n).alias("last"), A.is_unspecified_column(a).alias("unspecified"))
    for r in made.collect():
        x, y, k = bytes(r["a"]), bytes(r["b"]), r["n"]
        same, fits = len(x) == len(y), 0 <= k <= 8 * len(x)
        assert r["both"] == (A.both(x, y) if same else None) and r["either"] == (A.either(x, y) if same else None) and r["inverted"] == A.invert(x)
        assert (r["first"], r["last"]) == (A.network_range(x, k) if fits else (None, None)) and r["unspecified"] == A.is_unspecified(x)
    one = df.select(A.host_is_zeros_column(a, n).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert one.count("conv(") == 2  # the address only: masks come as numbers


# packets and heads of files


def test_packets_are_laid_out_once(spark, tmp_path):
    from fluxlens.plans.queries import QUERIES

    for name in ("netflow_v9_evicted", "netflow_v9_fields", "netflow_v9_changing", "netflow_v9_families", "netflow_v9_decode"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan, name  # what is decoded comes from files


def test_the_rest_of_a_file_is_not_moved(spark):
    from fluxlens.operators import exporters

    df = spark.range(0, 4000, 1, 4).selectExpr("id", "id % 3 AS file")
    found = exporters.first_in_file(df, 5, "file", "id")
    assert sorted(map(tuple, found.collect())) == [(i, i % 3) for i in range(15)]
    from fluxlens.plans.queries import QUERIES

    plan = QUERIES["head_per_file"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the exchange and behind it


def test_lists_are_cut_in_each_task(spark):
    from fluxlens.operators import summary

    df = spark.range(0, 9000, 1, 3).selectExpr("CASE WHEN id % 50 > 0 THEN id * 7919 % 3001 END AS a", "cast(id % 7 AS int) AS b", "cast(id % 11 AS decimal(20, 0)) AS octets", "id % 5 AS packets")
    grouped = summary.by_each(df, [["a"], ["b"], ["a", "b"]])
    best = summary._best(grouped, ["a", "b"], 4, ["octets", "packets", "flows"])
    assert best.count() <= 3 * 3 * 4 * grouped.rdd.getNumPartitions() < grouped.count()
    rows = grouped.collect()
    for r in summary.top_lists(df, [["a"], ["b"], ["a", "b"]], 4).collect():
        ranked = sorted((x for x in rows if x["kind"] == r["kind"]), key=lambda x: (-x[r["which"]], x["a"] or 0, x["b"] or 0))
        want = ranked[r["rank"] - 1]
        assert tuple(r[c] for c in want.asDict()) == tuple(want)
    assert summary.top_lists(df.limit(0), [["a"]]).count() == 0
