import datetime as dt

from pyspark.sql import functions as F

from fluxlens.operators import series, store


def _flows(spark, rows):
    return spark.createDataFrame([(f, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), p, o) for f, m, p, o in rows], "input_file string, recv_time timestamp_ntz, protocol int, octets long").withColumn("packets", F.lit(1))


def _rows(df):
    if "tcp_bytes" in df.columns:  # means, whose sums may be made in any order
        df = df.withColumn("tcp_bytes", F.round("tcp_bytes", 9))
    return sorted(map(str, df.collect()))


def test_runs_that_overlap_give_what_one_gives(spark, tmp_path):
    logs = {f: [(f, 7 * i + 90 * k, (6, 17, 1)[i % 3], 100 + i) for i in range(60)] for k, f in enumerate("abc")}
    all_ = _flows(spark, sum(logs.values(), []))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    store.update(one, all_)
    for names in ("ab", "bc", "c", "a"):
        store.update(two, all_.where(F.col("input_file").isin(*names)))
    assert _rows(store.stored_steps(spark, two)) == _rows(store.stored_steps(spark, one)) == _rows(series.rollup(all_))
    assert _rows(store.stored_archives(spark, two, ["tcp_bytes"])) == _rows(series.archives(series.rollup(all_), ["tcp_bytes"]))
    # an input that has changed takes the place of what it gave
    store.update(two, _flows(spark, [("a", 3, 6, 5)]))
    assert _rows(store.stored_steps(spark, two)) == _rows(series.rollup(all_.where("input_file <> 'a'").unionByName(_flows(spark, [("a", 3, 6, 5)]))))


def test_old_months_are_taken_out(spark, tmp_path):
    folder = str(tmp_path / "s")
    flows = _flows(spark, [(str(k), 60 * 24 * 31 * k, 6, k) for k in range(6)])
    store.update(folder, flows)
    kinds = ((1, 2000, 0.75), (6, 2900, 0.5))  # some sixty days
    before = _rows(store.stored_archives(spark, folder, ["tcp_bytes"], kinds))
    assert store.retire(spark, folder, kinds) == ["2024-01", "2024-02", "2024-03"]
    assert _rows(store.stored_archives(spark, folder, ["tcp_bytes"], kinds)) == before
    assert store.retire(spark, folder, kinds) == []
