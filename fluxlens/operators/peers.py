"""The limit on exporters that are kept: which of them goes when another one comes, over any number of packets.

A collector keeps LIMIT exporters.  A packet with flows brings its exporter to the front; any other packet leaves the
order alone, unless its exporter isn't kept: then it comes in at the front too, and if there are too many, the
one at the back goes, with its templates and counts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import new_folder
from .histograms import running_totals

#: Exporters that are kept.  Fixed value.
LIMIT = 128
#: Packets of so many numbers of ``seq`` are gone through by one task.
RANGE = 65536


def _recent(ranges: DataFrame, limit: int) -> DataFrame:
    """``held`` of each range of ``ranges(number, bucket, recent)``: the exporters brought to the front before it, the latest first.

    ``number`` counts the ranges from 1.  Lists of one, two, four ... ranges are joined to those before them, so there
    are as many steps as the number of ranges has bits.
    """
    last = ranges.agg(F.max("number")).first()[0] or 0
    folder = new_folder(ranges.sparkSession, "recent")
    # what was before: nothing of the range itself
    now = ranges.select("number", "bucket").join(ranges.select((F.col("number") + 1).alias("number"), F.col("recent").alias("held")), "number", "left")
    now = now.withColumn("held", F.coalesce("held", F.array().cast("array<binary>")))
    reach, step = 1, 0
    while reach < last:
        now.write.parquet(f"{folder}/{step}")
        now = ranges.sparkSession.read.parquet(f"{folder}/{step}")
        older = now.select((F.col("number") + reach).alias("number"), F.col("held").alias("older"))
        both = F.slice(F.array_distinct(F.concat("held", F.coalesce("older", F.array().cast("array<binary>")))), 1, limit)
        now = now.join(older, "number", "left").select("number", "bucket", both.alias("held"))
        reach, step = 2 * reach, step + 1
    return now


_OUT = "bucket long, agent_addr binary, seq long, gone binary, held array<binary>"


def _gone_through(packets: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """Goes through each range from its start: a row for each exporter that comes in (and which one goes), and one with ``held`` at the end."""
    first = starts.select("bucket", "held", F.lit(True).alias("start"))
    both = packets.withColumn("start", F.lit(False)).unionByName(first, allowMissingColumns=True)
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", F.desc("start"), "seq", "agent_addr").select("bucket", "start", "agent_addr", "seq", "moves", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.binary()))

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "agent_addr", "seq", "gone", "held"])

        now, kept = None, OrderedDict()  # the latest last
        for batch in batches:
            rows: list[tuple] = []
            for bucket, start, agent, seq, moves, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if now is not None:
                        rows.append((now, None, None, None, list(reversed(kept))))
                    now, kept = bucket, OrderedDict()
                if start:
                    kept = OrderedDict.fromkeys(reversed(held))
                elif agent in kept:
                    if moves:
                        kept.move_to_end(agent)
                else:
                    gone = kept.popitem(last=False)[0] if len(kept) >= limit else None
                    kept[agent] = None
                    rows.append((bucket, agent, seq, gone, None))
            yield made(rows)
        if now is not None:
            yield made([(now, None, None, None, list(reversed(kept)))])

    return dealt.mapInArrow(run, _OUT)


def comings_and_goings(packets: DataFrame, limit: int = LIMIT, agent: str = "agent_addr", seq: str = "seq", flows: str = "flows") -> DataFrame:
    """(agent_addr, seq, gone): each time that an exporter comes in, with the packet that brought it and the one that had to go.

    ``packets`` has the number of flows of each packet; packets are taken in the order of ``seq``, equal ones by
    exporter.  Ranges of ``seq`` are gone through apart from each other, each from the exporters kept when it begins.  Those are
    known beforehand where all packets have flows: the LIMIT exporters with the latest packets before.  Where
    some have none, what they do depends on who is kept, so ranges start from that guess and are gone through
    again until each starts with what the one before it ended with; the order of LIMIT exporters
    is soon settled by what follows it, so this takes few rounds, and never more than there are ranges.
    """
    spark = packets.sparkSession
    folder = new_folder(spark, "peers")
    chosen = packets.select(
        F.floor(F.col(seq) / RANGE).cast("long").alias("bucket"), F.coalesce(F.col(agent), F.lit(b"")).alias("agent_addr"), F.col(seq).cast("long").alias("seq"), (F.col(flows) > 0).alias("moves")
    )
    chosen.write.parquet(f"{folder}/packets")  # some thirty bytes of each packet, read in every round
    chosen = spark.read.parquet(f"{folder}/packets")
    last = chosen.groupBy("bucket", "agent_addr").agg(F.max(F.when(F.col("moves"), F.struct("seq", "agent_addr"))).alias("at"))
    latest = F.slice(F.sort_array(F.collect_list("at"), asc=False), 1, limit)
    ranges = last.groupBy("bucket").agg(F.transform(latest, lambda x: x["agent_addr"]).alias("recent")).withColumn("number", F.lit(1).cast("long"))
    numbered = running_totals(ranges, "bucket", ["number"])
    numbered.write.parquet(f"{folder}/ranges")
    numbered = spark.read.parquet(f"{folder}/ranges")
    starts = _recent(numbered, limit)
    round_ = 0
    while True:
        starts.write.parquet(f"{folder}/starts-{round_}")
        starts = spark.read.parquet(f"{folder}/starts-{round_}")
        _gone_through(chosen, starts, limit).write.parquet(f"{folder}/out-{round_}")
        out = spark.read.parquet(f"{folder}/out-{round_}")
        ends = numbered.select("number", "bucket").join(out.where("held is not null").select("bucket", "held"), "bucket")
        new = starts.select("number", "bucket", F.col("held").alias("before")).join(ends.select((F.col("number") + 1).alias("number"), "held"), "number", "left")
        new = new.withColumn("held", F.coalesce("held", F.array().cast("array<binary>")))
        if new.where(F.col("before") != F.col("held")).isEmpty():
            return out.where("seq is not null").select("agent_addr", "seq", "gone")
        starts, round_ = new.select("number", "bucket", "held"), round_ + 1


def turnover(packets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per exporter: how often it came in, and how often it was made to go."""
    each = comings_and_goings(packets, limit)
    came = each.groupBy("agent_addr").agg(F.count("*").alias("came"))
    went = each.where("gone is not null").groupBy(F.col("gone").alias("agent_addr")).agg(F.count("*").alias("went"))
    return came.join(went, "agent_addr", "left").select("agent_addr", "came", F.coalesce("went", F.lit(0).cast("long")).alias("went"))
