"""Exponential histograms and rate histories."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exponent(x: Column, base: int = 2, most: int = 2**63 - 1) -> Column:
    """Largest k with base ** k <= x, in whole numbers; 0 for 0."""
    if base < 2:
        raise ValueError("base must be 2 or more")
    powers = [base**k for k in range(1, int(math.log(most, base)) + 2) if base**k <= most]
    return sum((F.when(x >= p, 1).otherwise(0) for p in powers), F.lit(0))


def in_order(histogram: DataFrame) -> DataFrame:
    """Bins from the least to the greatest."""
    return histogram.orderBy("bin")


#: Bins of a range, which is what one row stands for while empty bins are made, and one task sums up.
RANGE = 4096


def _range_of(number: Column) -> Column:
    return F.floor(number / RANGE).cast("long")


def _filled(counted: DataFrame, bin_: str, values: dict[str, Column]) -> DataFrame:
    """Rows for every bin from the first to the last; ``values`` where there was none.

    Ranges of bins are listed first and dealt out, and each makes its own bins.
    """
    edges = counted.agg(F.min(bin_).alias("a"), F.max(bin_).alias("b")).where("a is not null")
    ranges = edges.select("a", "b", F.explode(F.sequence(_range_of(F.col("a")), _range_of(F.col("b")))).alias("r")).repartition("r")
    first, last = F.greatest("a", F.col("r") * RANGE), F.least("b", (F.col("r") + 1) * RANGE - 1)
    bins = ranges.select(F.explode(F.sequence(first, last)).alias(bin_))
    joined = bins.join(counted, bin_, "left")
    return joined.select(bin_, *[F.coalesce(F.col(k), v).alias(k) for k, v in values.items()])


def running_totals(df: DataFrame, at: str, columns: Sequence[str], levels: int = 2) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its sum over all rows up to the row's own whole number ``at`` (unique).

    A range of numbers is summed in its task; the totals of the ranges before it are found in the same way, range
    by range of ranges, so that no task goes through all rows.  Only the last of ``levels`` steps, over at most
    one row for RANGE ** levels numbers, is a single task's.
    """
    if not levels:
        order = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*[F.sum(c).over(order).alias(c) if c in columns else F.col(c) for c in df.columns])
    range_, own = f"range_{levels}", {c: f"{c}_of_range_{levels}" for c in columns}
    marked = df.withColumn(range_, _range_of(F.col(at)))
    sums = marked.groupBy(range_).agg(*[F.sum(c).alias(c) for c in columns])
    whole = running_totals(sums.withColumns({n: F.col(c) for c, n in own.items()}), range_, columns, levels - 1)
    before = whole.select(range_, *[(F.col(c) - F.col(n)).alias(n) for c, n in own.items()])  # without the range's own
    order = Window.partitionBy(range_).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    both = marked.withColumns({c: F.sum(c).over(order) for c in columns}).join(before, range_)
    made = {c: (F.col(c) + F.col(n)).alias(c) for c, n in own.items()}
    return both.select(*[made.get(c, F.col(c)) for c in df.columns])


def exponential(df: DataFrame, value: Column, base: int = 10) -> DataFrame:
    """(bin, low, count): flows with base ** bin <= value < base ** (bin + 1); bins between with 0.

    Flows without the value are left out.
    """
    counted = df.where(value.isNotNull()).groupBy(exponent(value, base).cast("long").alias("bin")).agg(F.count("*").alias("count"))
    low = F.round(F.pow(F.lit(float(base)), F.col("bin"))).cast("long").alias("low")
    return _filled(counted, "bin", {"count": F.lit(0).cast("long")}).select("bin", low, "count")


def octets_histogram(df: DataFrame) -> DataFrame:
    return exponential(df, F.col("octets"))


def packets_histogram(df: DataFrame) -> DataFrame:
    return exponential(df, F.col("packets"))


def duration_histogram(df: DataFrame) -> DataFrame:
    """By whole seconds between start and finish."""
    return exponential(df, F.floor((F.col("flow_finish") - F.col("flow_start")) / 1000).cast("long"))


def rate_history(df: DataFrame, when_ms: Column, amount: Column | None = None, resolution_ms: int = 7_200_000) -> DataFrame:
    """(bin, rate): amount a second in each bin of ``resolution_ms``, numbered from the epoch; empty bins 0."""
    amount = F.lit(1) if amount is None else amount
    number = F.floor(when_ms / resolution_ms).cast("long").alias("bin")
    counted = df.where(when_ms.isNotNull()).groupBy(number).agg((F.sum(amount) * 1000.0 / resolution_ms).alias("rate"))
    return _filled(counted, "bin", {"rate": F.lit(0.0)})


def interpolated_history(
    df: DataFrame, amount: Column, start_ms: Column, finish_ms: Column, resolution_ms: int = 300_000, strict_compat: bool = False
) -> DataFrame:
    """(bin, rate): each flow's amount spread evenly from its start to its finish, a second; empty bins 0.

    A flow gives each bin the share of its time that it spends there, so sums are kept.  With
    ``strict_compat`` the last bin of a flow over several bins gets nothing, and the one before it only
    as much as the last would get.  A finish before the start is an error.  Amounts are whole numbers, times whole
    milliseconds; shares are whole parts and fractions of 23 digits, in which what begins and ends a flow cancels.
    """
    whole_number = lambda c, digits: c.cast(f"decimal({digits},0)")
    a, b = F.floor(start_ms).cast("long"), F.floor(finish_ms).cast("long")
    valid = df.where(start_ms.isNotNull() & finish_ms.isNotNull() & amount.isNotNull())
    checked = F.when(b < a, F.raise_error("flow finishes before it starts")).otherwise(F.floor(a / resolution_ms).cast("long"))
    flows = valid.select(whole_number(amount, 20).alias("x"), a.alias("a"), b.alias("b"), checked.alias("first"), F.floor(b / resolution_ms).cast("long").alias("last"))
    stop = F.col("last") - 1 if strict_compat else F.col("last")  # the last bin that gets something
    head = (F.col("first") + 1) * resolution_ms - F.col("a")
    tail = F.col("b") - F.col("last") * resolution_ms
    if strict_compat:
        head = F.when(F.col("first") == stop, tail).otherwise(head)
    none = F.lit(0).cast("long")

    def change(bin_: Column, once: Column, on: Column) -> Column:
        """Milliseconds of the flow that a bin gets, and those that it and all bins after it get."""
        return F.struct(bin_.alias("bin"), once.alias("once"), on.alias("on"))

    # a flow gives its first and its last bin a part each, and all bins between the same: only where that begins and ends is noted
    between = stop > F.col("first") + 1
    full = F.lit(resolution_ms).cast("long")
    several = F.array(
        change(F.col("first"), head, none),
        change(stop, F.when(stop > F.col("first"), tail).otherwise(none), none),
        change(F.least(F.col("first") + 1, stop), none, F.when(between, full).otherwise(none)),
        change(stop, none, F.when(between, -full).otherwise(none)),
    )
    alone = F.array(change(F.col("first"), F.lit(1).cast("long"), none))
    one = F.col("first") == F.col("last")
    lasts = whole_number(F.when(one, 1).otherwise(F.col("b") - F.col("a")), 13)
    noted = flows.select("x", lasts.alias("lasts"), F.explode(F.when(one, alone).otherwise(several)).alias("n")).select("x", "lasts", "n.*")
    sums = []
    for c in ("once", "on"):
        share = F.col("x") * whole_number(F.col(c), 13)
        rest = share % F.col("lasts")
        sums.append(F.sum(((share - rest) / F.col("lasts")).cast("decimal(38,0)")).alias(c))
        sums.append(F.sum(whole_number(rest, 13).cast("decimal(23,10)") / F.col("lasts")).alias(f"{c}_part"))
    counted = noted.groupBy("bin").agg(*sums)
    zero = {c: F.lit(0).cast(t) for c, t in counted.dtypes if c != "bin"}
    running = running_totals(_filled(counted, "bin", zero), "bin", ["on", "on_part"])
    rate = (F.col("once") + F.col("on")).cast("double") + (F.col("once_part") + F.col("on_part")).cast("double")
    return running.select("bin", (rate * 1000.0 / resolution_ms).alias("rate"))


def clock_skew(df: DataFrame, recv_sec: Column, finish_ms: Column) -> DataFrame:
    """One row ``skew``: mean of the time of receipt less the time of finish in seconds, over flows that have both."""
    return df.agg(F.avg(recv_sec - finish_ms / 1000.0).alias("skew"))


def crop(history: DataFrame, first_sec: Column, last_sec: Column, skew: Column, resolution_ms: int) -> DataFrame:
    """Bins between the first and the last time of receipt, both less the skew."""
    at = F.col("bin") * resolution_ms / 1000.0
    return history.where((at >= first_sec - skew) & (at <= last_sec - skew))
