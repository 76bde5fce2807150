"""Vectors in Arrow batches as numpy matrices, joins of rows with their classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a matrix product: more would wake a second BLAS thread, which only waits beside the task's own.
STEP = 256
#: Classes that hold more than this share of all rows (and LEAST rows) count as heavy: there are HEAVY of them at most.
HEAVY, LEAST = 10_000, 1000


def usable(vector: Column) -> Column:
    """Neither the vector nor a component is null, and all components are finite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix_of(column: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """Vectors of a list column as rows of ``width``; shorter ones are padded with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(column), width).astype(dtype)
    out = np.zeros((len(column), width), dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, a few rows at a time."""
    out = np.empty((len(a), len(b)), np.result_type(a, b))
    for i in range(0, len(a), STEP):
        np.matmul(a[i : i + STEP], b.T, out=out[i : i + STEP])
    return out


def joined_to_classes(rows: DataFrame, classes: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with one row for each ``key``, whose number of rows is ``classes[size]``.

    The rows of heavy classes meet them in a broadcast of HEAVY rows at most, all others in a shuffle in
    which no key has more than a ten-thousandth of all rows (or LEAST rows).  Rows whose key is null go.
    """
    whole = classes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    heavy = F.col(size) > max(LEAST, whole // HEAVY)
    known, mark = classes.columns, "is_heavy"
    while mark in {*rows.columns, *known}:
        mark += "_"
    hot = F.broadcast(classes.where(heavy).withColumn(mark, F.lit(True)))
    met = rows.join(hot, key, "left")
    rest = met.where(F.col(mark).isNull()).select(*rows.columns).join(classes.where(~heavy), key)
    out = [*rows.columns, *(c for c in known if c != key)]
    return met.where(F.col(mark)).select(*out).unionByName(rest.select(*out))
