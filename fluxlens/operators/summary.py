"""Totals, counts by key, and the largest keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("bigint")


def counters(df: DataFrame) -> list[Column]:
    """flows, octets and packets of a group; what a flow lacks adds nothing."""
    return [
        F.count("*").alias("flows"),
        F.coalesce(F.sum(_has(df, "octets")), F.lit(0)).alias("octets"),
        F.coalesce(F.sum(_has(df, "packets")), F.lit(0)).alias("packets"),
    ]


def totals(df: DataFrame, time: str = "recv_time") -> DataFrame:
    """One row: flows, octets and packets (null if no flow has them), first and last time of receipt."""
    return df.agg(
        F.count("*").alias("flows"),
        F.sum(_has(df, "octets")).alias("octets"),
        F.sum(_has(df, "packets")).alias("packets"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """flows, octets, packets for each key; flows that lack a key are left out."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(*counters(df))


def top(df: DataFrame, keys: Sequence[str], which: str = "octets", n: int | None = 10, by_key_order: bool = False) -> DataFrame:
    """The ``n`` groups (all if None) with most of ``which``, ties by key; or the first by key."""
    order = [F.col(k) for k in keys] if by_key_order else [F.desc(which), *keys]
    grouped = by_key(df, *keys).orderBy(*order)
    return grouped if n is None else grouped.limit(n)


def by_each(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """:func:`by_key` for several keys in one pass: ``kind`` names the key, the columns of other keys are null.

    Grouping sets expand each row once for every set before the partial aggregation, which leaves one row
    for each key and task.
    """
    names = list(dict.fromkeys(k for s in sets for k in s))
    marks = {tuple(s): "_".join(s) for s in sets}
    kind = F.lit(None).cast("string")
    for s, name in marks.items():
        # grouping_id has a bit, the first column's highest, for each column that isn't in the set
        out = sum(1 << (len(names) - 1 - i) for i, k in enumerate(names) if k not in s)
        kind = F.when(F.grouping_id(*names) == out, F.lit(name)).otherwise(kind)
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *names).agg(kind.alias("kind"), *counters(df))
    present = F.lit(False)
    for s, name in marks.items():
        test = F.col("kind") == name
        for k in s:
            test = test & F.col(k).isNotNull()
        present = present | test
    return grouped.where(present).select("kind", *names, "flows", "octets", "packets")


def _best(grouped: DataFrame, names: Sequence[str], n: int, orders: Sequence[str]) -> DataFrame:
    """Of each partition and kind the ``n`` rows with most of each of ``orders``; a task holds one batch and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([*(held.to_batches() if held else []), batch]).combine_chunks()
            kinds, places = held["kind"].combine_chunks().dictionary_encode().indices.to_numpy(), np.arange(len(held))
            keep = np.zeros(len(held), bool)
            for o in orders:
                rows = pc.sort_indices(held, [("kind", "ascending"), (o, "descending"), *((k, "ascending") for k in names)]).to_numpy()
                begins = np.r_[True, kinds[rows][1:] != kinds[rows][:-1]]
                keep[rows[places - np.maximum.accumulate(np.where(begins, places, 0)) < n]] = True
            held = held.filter(pa.array(keep))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return grouped.mapInArrow(run, grouped.schema)


def top_lists(df: DataFrame, sets: Sequence[Sequence[str]], n: int = 10, orders: Sequence[str] = ("octets", "packets", "flows")) -> DataFrame:
    """The ``n`` groups of each key with most of each of ``orders``: kind, which, rank, the keys, and the counters.

    One pass over the flows for all lists.  Each task keeps its own best only, without sorting all; ties by key.
    """
    names = list(dict.fromkeys(k for s in sets for k in s))
    grouped = _best(by_each(df, sets), names, n, orders)
    each = grouped.withColumn("which", F.explode(F.array(*[F.lit(o) for o in orders])))
    amount = F.coalesce(*[F.when(F.col("which") == o, F.col(o)) for o in orders])
    by = Window.partitionBy("kind", "which").orderBy(amount.desc(), *names)
    ranked = each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
    return ranked.select("kind", "which", "rank", *names, "flows", "octets", "packets")


def state(df: DataFrame, sets: Sequence[Sequence[str]], time: str = "recv_time") -> DataFrame:
    """What a summary has to keep: the counters of each key, and the totals as kind ``all``; can be written and merged."""
    each = by_each(df, sets).withColumns({"first_time": F.lit(None).cast(df.schema[time].dataType), "last_time": F.lit(None).cast(df.schema[time].dataType)})
    whole = df.agg(F.lit("all").alias("kind"), *counters(df), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    return each.unionByName(whole, allowMissingColumns=True)


def merged(states: Sequence[DataFrame]) -> DataFrame:
    """The state of all the flows of several states."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), states)
    keys = [c for c in both.columns if c not in ("flows", "octets", "packets", "first_time", "last_time")]
    return both.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("flows", "octets", "packets")], F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time")
    )
