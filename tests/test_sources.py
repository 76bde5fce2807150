import pytest
from pyspark.sql import functions as F

from fluxlens.schema import ALL, BRIEF, bitmap, has_fields, MASKS
from fluxlens.sources import export, flowlog, records

ROW = {"tag": 1, "recv_sec": 86400, "recv_usec": 42, "protocol": 6, "tcp_flags": 18, "tos": 255, "src_addr": bytes([10, 0, 0, 1]),
       "dst_addr": bytes(15) + b"\1", "src_port": 1, "dst_port": 65535, "packets": 3, "octets": 2**63 + 1, "flow_start": 61000,
       "flow_finish": 3723004, "fields": 1 << 30}


@pytest.fixture()
def log(tmp_path):
    p = tmp_path / "a.flow"
    p.write_bytes(b"".join(records.encode(ROW | {"tag": i}) for i in range(50)) + b"\x60")
    return str(p)


def test_read_both_ways(spark, log):
    flowlog.register(spark)
    a = flowlog.read_log(spark, log).orderBy("row_index").collect()
    b = spark.read.format("flowlog").option("splitbytes", "300").load(log).orderBy("row_index").collect()
    assert len(a) == len(b) == 50 and [r["tag"] for r in b] == list(range(50)) == [r["row_index"] for r in b]
    assert int(a[7]["octets"]) == 2**63 + 1 and bytes(a[7]["dst_addr"]) == ROW["dst_addr"]
    assert spark.read.format("flowlog").option("splitbytes", "300").load(log).rdd.getNumPartitions() > 5
    df = flowlog.read_log(spark, log)
    assert df.select(bitmap().alias("b")).distinct().collect() == df.select("fields").distinct().collect()
    assert df.where(has_fields(MASKS["SRC_ADDR4"] | MASKS["TAG"])).count() == 50
    assert df.where(has_fields(MASKS["SRC_ADDR"])).count() == 0
    with pytest.raises(ValueError):
        has_fields(0)
    assert str(flowlog.with_recv_time(df).first()["recv_time"]) == "1970-01-02 00:00:00.000042"


def test_faults(spark, tmp_path):
    good = records.encode(ROW)
    (tmp_path / "bad.flow").write_bytes(good + good[:9] + b"\xff" + good[10:] + good)
    with pytest.raises(Exception, match="checksum"):
        flowlog.read_log(spark, str(tmp_path / "bad.flow")).count()
    assert flowlog.read_log(spark, str(tmp_path / "bad.flow"), mode="PERMISSIVE").count() == 1
    assert flowlog.read_log(spark, str(tmp_path / "bad.flow"), verify=False).count() == 3


def test_write(spark, log, tmp_path):
    flowlog.register(spark)
    df = flowlog.read_log(spark, log).repartition(3)
    out = str(tmp_path / "out")
    df.write.format("flowlog").option("fields", "TAG OCTETS").mode("append").save(out)
    df.write.format("flowlog").option("fields", "TAG OCTETS").mode("append").save(out)
    back = spark.read.format("flowlog").load(out)
    assert back.count() == 100 and back.where("src_port is not null or crc32 is not null").count() == 0
    df.write.format("flowlog").mode("overwrite").save(out)
    assert spark.read.format("flowlog").load(out).where("crc32 is not null").count() == 50


def test_old_log(spark, tmp_path):
    (tmp_path / "old.flow").write_bytes(records.old_header() + records.encode_old(ROW))
    assert flowlog.read_log(spark, str(tmp_path / "old.flow"), old=True).first()["recv_usec"] == 0


def test_stream(spark, log, tmp_path):
    flowlog.register(spark)
    stream = spark.readStream.format("flowlog").option("streaming", "true").load(log)
    q = stream.writeStream.format("memory").queryName("logged").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.table("logged").count() == 50
    finally:
        q.stop()


def test_text_and_csv(spark, log):
    df = flowlog.read_log(spark, log).where("tag = 3")
    line = df.select(export.format_flow(df, BRIEF)).first()[0]
    assert line == (
        "FLOW tag 3 recv_time 1970-01-02T00:00:00.00042 proto 6 tcpflags 12 tos ff src [10.0.0.1]:1 dst [::1]:65535 "
        "packets 3 octets 9223372036854775809 "
    )
    whole = df.select(export.format_flow(df, ALL)).first()[0]
    assert "flow_start 1m1s.000 flow_finish 1h2m3s.004 crc32 " in whole and "in_if" not in whole
    csv = export.csv_lines(df).first()[0].split(",")
    assert len(csv) == len(export.CSV) == export.CSV_HEADER.count(",") + 1 and csv[10:12] == ["10.0.0.1", "::1"]
    row = export.sql_rows(flowlog.with_recv_time(df).withColumn("octets", F.lit(5))).first()
    assert row["tag"] == 3 and row["src_addr"] == "10.0.0.1" and len(row) == 10
    assert "top pairs by flows" in export.report(flowlog.with_recv_time(df))
