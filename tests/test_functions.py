import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxlens.functions import addresses as A
from fluxlens.functions import times


def test_networks():
    assert A.parse_network("10.0.0.0/8") == (bytes([10, 0, 0, 0]), 8)
    assert A.parse_network("::1")[1] == 128
    with pytest.raises(ValueError, match="host bits"):
        A.parse_network("10.0.0.1/8")
    assert A.parse_network("10.0.0.1/8", strict=False)[1] == 8
    with pytest.raises(ValueError, match="range"):
        A.parse_network("10.0.0.0/33")
    assert A.netmask(4, 25) == bytes([255, 255, 255, 128]) and A.hostmask(4, 0) == b"\xff" * 4
    assert A.network_range(A.pton("192.0.2.77"), 24) == (A.pton("192.0.2.0"), A.pton("192.0.2.255"))
    assert A.host_is_zeros(A.pton("10.1.0.0"), 16) and A.host_is_ones(A.pton("10.1.255.255"), 16)
    assert A.compare(A.pton("255.0.0.0"), A.pton("::")) == -1 and A.is_unspecified(bytes(16))
    with pytest.raises(ValueError, match="families"):
        A.both(bytes(4), bytes(16))


@given(st.binary(min_size=4, max_size=4), st.integers(0, 32))
def test_range_holds_the_address(a, n):
    low, high = A.network_range(a, n)
    assert low <= a <= high and A.either(low, A.hostmask(4, n)) == high and A.both(a, A.netmask(4, n)) == low


def test_ntop_forms():
    assert A.ntop(A.pton("2001:db8::1")) == "2001:db8::1"
    assert A.ntop(bytes(10) + b"\xff\xff" + bytes([1, 2, 3, 4])) == "::ffff:1.2.3.4"
    assert A.ntop(bytes(12) + bytes([1, 2, 3, 4])) == "::1.2.3.4"
    assert A.ntop(bytes(16)) == "::" and A.ntop(None) is None


def test_columns(spark):
    rows = [(A.pton("10.0.0.9"),), (A.pton("11.0.0.9"),), (A.pton("::1"),), (None,)]
    df = spark.createDataFrame(rows, "a binary")
    got = df.select(A.text(F.col("a")), A.in_network(F.col("a"), "10.0.0.0/8"), A.family(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("10.0.0.9", True, 4), ("11.0.0.9", False, 4), ("::1", False, 6), (None, False, 0)]
    assert "PythonUDF" not in df.select(A.text(F.col("a"), True))._jdf.queryExecution().toString()
    texts = spark.createDataFrame([("1.2.3.4",), ("1.2.3",), ("256.1.1.1",), ("255.255.255.255",)], "t string")
    assert [r[0] for r in texts.select(A.ipv4_text_number(F.col("t"))).collect()] == [16909060, None, None, 2**32 - 1]


def test_networks_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(A.pton("10.0.0.9"),)], "a binary").write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x")).where((F.length("a") == 4) & A.in_network(F.col("a"), "10.0.0.0/8"))
    assert "GreaterThanOrEqual(a" in df._jdf.queryExecution().toString()


def test_times(spark):
    df = spark.createDataFrame([(0,), (59,), (31449600 + 604800 + 86400 + 3661,), (120,)], "s long")
    assert [r[0] for r in df.select(times.interval_time(F.col("s"))).collect()] == ["0s", "59s", "1y1w1d1h1m1s", "2m0s"]
    assert df.select(times.iso_time(F.lit(86400 * 365))).first()[0] == "1971-01-01T00:00:00"
    big = spark.createDataFrame([(999,), (1000,), (10**12 * 5,), (10**15,), (10**18 * 2,)], "x long")
    assert [r[0] for r in big.select(times.iso_units(F.col("x"))).collect()] == ["999", "1K", "5T", "1000T", "2E"]
    assert [times.parse_number(x) for x in ("0x1f", "010", "0", "99")] == [31, 8, 0, 99]
