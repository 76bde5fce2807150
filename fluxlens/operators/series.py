"""Roll-ups of protocol classes over time, and their consolidation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: protocol classes of the roll-up
CLASSES = {"icmp": 1, "tcp": 6, "udp": 17, "gre": 47, "esp": 50}
NAMES = (*CLASSES, "other")
#: Steps to a consolidated point, points kept, and the share of a point's steps that may be unknown.
ARCHIVES = ((1, 4800, 0.75), (6, 2400, 0.5), (24, 1200, 0.5), (288, 1500, 0.5))
STEP = 300


def _is(name: str) -> Column:
    protocol = F.coalesce(F.col("protocol"), F.lit(-1))
    return ~protocol.isin(*CLASSES.values()) if name == "other" else protocol == CLASSES[name]


def rollup(df: DataFrame, time: str = "recv_time", seconds: int = STEP, keys: Sequence[str] = ()) -> DataFrame:
    """Per aligned window (and ``keys``): bin_start, then <class>_flows, _bytes and _packets of the six classes.

    Flows without a time are left out.
    """
    window = F.window(F.col(time), f"{seconds} seconds")
    sums = []
    for name in NAMES:
        mine = _is(name)
        sums.append(F.count_if(mine).alias(f"{name}_flows"))
        for column, what in (("octets", "bytes"), ("packets", "packets")):
            sums.append(F.coalesce(F.sum(F.when(mine, F.col(column))), F.lit(0)).cast("bigint").alias(f"{name}_{what}"))
    return df.where(F.col(time).isNotNull()).groupBy(window.alias("w"), *keys).agg(*sums).select(*keys, F.col("w.start").alias("bin_start"), *[f"{n}_{w}" for n in NAMES for w in ("flows", "bytes", "packets")])


def consolidate(steps: DataFrame, per_point: int, unknown: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """Mean rate a second of ``per_point`` steps: point_start, known (steps), and each column's mean.

    A step without a row is unknown; a point with more than the share ``unknown`` of its steps unknown has no
    value (null), as points of a round-robin archive.
    """
    columns = columns or [c for c in steps.columns if c != "bin_start"]
    window = F.window("bin_start", f"{per_point * STEP} seconds")
    enough = F.count("*") >= per_point * (1 - unknown)
    means = [F.when(enough, F.avg(F.col(c) / float(STEP))).alias(c) for c in columns]
    grouped = steps.groupBy(window.alias("w")).agg(F.count("*").alias("known"), *means)
    return grouped.select(F.col("w.start").alias("point_start"), "known", *columns)


def archives(steps: DataFrame, columns: list[str] | None = None, kinds: tuple = ARCHIVES) -> DataFrame:
    """All archives of the roll-up: per_point, point_start, known, and each column's mean rate.

    An archive keeps its newest points only, as many as ``kinds`` says, counted back from the newest step.
    """
    out = None
    newest = steps.agg(F.max("bin_start").alias("m")).scalar()
    for per_point, kept, unknown in kinds:
        points = consolidate(steps, per_point, unknown, columns)
        age = F.timestamp_diff("SECOND", F.col("point_start"), newest)
        mine = points.where(age < kept * per_point * STEP).select(F.lit(per_point).alias("per_point"), "*")
        out = mine if out is None else out.unionByName(mine)
    return out


def last_average_min_max(steps: DataFrame, what: str = "bytes", seconds: int | None = None) -> DataFrame:
    """Per class: last, average, least and greatest value of the steps in the last ``seconds`` (all if None)."""
    if seconds is not None:
        newest = steps.agg(F.max("bin_start").alias("m")).scalar()
        steps = steps.where(F.timestamp_diff("SECOND", F.col("bin_start"), newest) < seconds)
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(f"{n}_{what}").alias("value")) for n in NAMES]))
    long = steps.select("bin_start", listed.alias("x")).select("bin_start", "x.*")
    return long.groupBy("class").agg(
        F.max_by("value", "bin_start").alias("last"),
        F.avg("value").alias("average"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
    )
