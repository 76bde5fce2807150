"""Every registered flow query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from fluxlens.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def canonical(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["history_interpolated", "history_interpolated_compat", "history_cropped", "netflow_v9_changing", "exporters_evicted", "policy_rule_table"])
def test_query_on_more_rows(spark, name):
    """Where rounding, or state over many rows, may tell."""
    data = DATA.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(queries.SQL[name]).df()
    assert canonical(got) == canonical(want)


def test_interpolation_of_large_flows_leaves_empty_bins_empty(spark):
    from fractions import Fraction

    import numpy as np
    from pyspark.sql import functions as F

    from fluxlens.operators import histograms

    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(1, 10**12)), int(a), int(a + rng.integers(0, 3_000_000))) for a in rng.integers(0, 37_000_000, 3000)]
    rows.append((7, 90_000_000, 90_900_000))
    df = spark.createDataFrame(rows, "x long, a long, b long")
    want: dict[int, Fraction] = {}
    for x, a, b in rows:
        for k in range(a // 300_000, b // 300_000 + 1):
            share = Fraction(min(b, (k + 1) * 300_000) - max(a, k * 300_000), b - a) if b > a else Fraction(1)
            want[k] = want.get(k, Fraction(0)) + x * share / 300
    got = {r["bin"]: r["rate"] for r in histograms.interpolated_history(df, F.col("x"), F.col("a"), F.col("b")).collect()}
    assert sorted(got) == list(range(min(want), max(want) + 1))
    for k, rate in got.items():
        exact = float(want.get(k, 0))
        assert rate == exact == 0 or abs(rate - exact) <= 1e-14 * abs(exact)
    assert min(got.values()) == 0 and abs(got[301] - 7 / 900) < 1e-15


def test_running_totals_over_gaps(spark):
    from fluxlens.operators.histograms import running_totals

    numbers = [-9_000_000, -5, 0, 1, 4095, 4096, 20_000_000, 20_000_001]
    df = spark.createDataFrame([(n, k + 1, "x") for k, n in enumerate(numbers)], "at long, n long, other string")
    got = {r["at"]: (r["n"], r["other"]) for r in running_totals(df, "at", ["n"]).collect()}
    assert got == {n: (sum(range(1, k + 2)), "x") for k, n in enumerate(numbers)}


def test_interpolation_keeps_the_sum(spark):
    from pyspark.sql import functions as F

    from fluxlens.operators.histograms import interpolated_history

    df = spark.createDataFrame([(10, 0, 1_000_000), (7, 299_000, 301_000), (5, 10, 10)], "x long, a long, b long")
    h = interpolated_history(df, F.col("x"), F.col("a"), F.col("b"))
    assert abs(h.agg(F.sum("rate")).first()[0] * 300 - 22) < 1e-9
    bad = spark.createDataFrame([(1, 5, 4)], "x long, a long, b long")
    with pytest.raises(Exception, match="before it starts"):
        interpolated_history(bad, F.col("x"), F.col("a"), F.col("b")).collect()


def test_entry_without_the_corpus_modules(tmp_path):
    """In a copy of the repository that lacks them, all flow queries are there and nothing else."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("fluxlens", "__spark_entry__.py"):
        source, target = os.path.join(root, name), tmp_path / name
        shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, target)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.split(maxsplit=2) == [str(len(queries.QUERIES)), str(len(queries.SQL)), "[]\n"], done.stderr


def test_entry(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
