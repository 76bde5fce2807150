"""A policy as a table of rules: any number of them, judged by one plan whose size they don't change.

Networks are looked up by the first address of a flow's network of each prefix length that rules have, so a flow meets
only rules whose network it is in, and those without one.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import family, halves, netmask, network_range, parse_network
from .policy import Policy, Rule

#: Rules that are sent to every task at most; about two hundred bytes each.
MOST_RULES = 100_000
_EPOCH = dt.datetime(1970, 1, 1)
_FIELDS = ("in_ifndx", "out_ifndx", "af", "src_port", "dst_port", "proto", "tos", "tcp_flags", "days", "second", "time")
_SIDES = ("agent", "src", "dst")
_TEST = "array<struct<field:int,mask:bigint,low:bigint,high:bigint,negated:boolean>>"
_NET = "array<struct<side:int,low:binary,high:binary,negated:boolean>>"
_SCHEMA = f"rule int, tag bigint, dropped boolean, quick boolean, side string, length int, bytes int, high bigint, low bigint, tests {_TEST}, nets {_NET}"
_ALL, _LEAST, _MOST = -1, -(2**63), 2**63 - 1


def _parts(address: bytes) -> tuple[int, int]:
    """The upper and the lower 64 bits as signed numbers."""
    whole = address.rjust(16, b"\0")
    return tuple(int.from_bytes(whole[i : i + 8], "big", signed=True) for i in (0, 8))


def _row(number: int, rule: Rule) -> tuple:
    key, tests, nets = (None,) * 5, [], []
    for c in rule.clauses:
        v = c.value
        if c.what in _SIDES:
            address, length = parse_network(v, False)
            low, high = network_range(address, length)
            if key[0] is None and c.what != "agent" and not c.negated:
                key = c.what, length, len(low), *_parts(low)  # found by the join, so it needs no test
            else:
                nets.append((_SIDES.index(c.what), low, high, c.negated))
            continue
        field, mask, low, high = c.what, _ALL, v, v
        match c.what:
            case "af":
                mask = low = high = 1 if v == 4 else 2
            case "tcp_flags":
                mask, low, high = v[0], v[1], v[1]
            case "days":
                mask, low, high = v, 1, 127
            case "after":
                field, high = "second", _MOST
            case "before":
                field, low = "second", _LEAST
            case "after_date":
                field, low, high = "time", (v - _EPOCH) // dt.timedelta(microseconds=1) + 1, _MOST
            case "before_date":
                field, low, high = "time", _LEAST, (v - _EPOCH) // dt.timedelta(microseconds=1) - 1
        tests.append((_FIELDS.index(field), mask, low, high, c.negated))
    return number, rule.tag, rule.action == "discard", rule.quick, *key, tests, nets


def rules_of(spark: SparkSession, policy: Policy) -> DataFrame:
    """The policy's rules as rows."""
    return spark.createDataFrame([_row(i, r) for i, r in enumerate(policy.rules)], _SCHEMA)


def _values(df: DataFrame) -> tuple[Column, Column]:
    """What a flow has: the numbers of _FIELDS, the addresses of _SIDES.  What it lacks is as in compiled policies."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in df.columns else F.lit(0).cast("long")
    address = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("binary")
    if "recv_time" in df.columns:
        at = F.coalesce(F.col("recv_time"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    else:
        at = F.timestamp_seconds(number("recv_sec"))
    families = [F.coalesce(family(address(f"{s}_addr")), F.lit(0)) for s in ("src", "dst")]
    bits = [reduce(lambda a, b: a | b, [f == v for f in families]) for v in (4, 6)]
    af = F.when(bits[0], 1).otherwise(0) + F.when(bits[1], 2).otherwise(0)
    second = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))
    made = {"in_ifndx": number("if_index_in"), "out_ifndx": number("if_index_out"), "af": af, "proto": number("protocol"),
            "days": F.pow(F.lit(2.0), F.dayofweek(at) - 1), "second": second, "time": micros}
    return F.array(*[made.get(f, number(f) if f not in made else None).cast("long") for f in _FIELDS]), F.array(*[address(f"{s}_addr") for s in _SIDES])


def judged(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df`` with ``verdict``, a struct of the deciding rule (rule, tag, dropped), null if none matches.

    Of the rules that match, the first quick one decides, or else the last.  Rules meet flows in broadcast joins, one for
    each side, family and prefix length; they are at most MOST_RULES rows.
    """
    if (count := rules.count()) > MOST_RULES:
        raise ValueError(f"{count} rules; {MOST_RULES} can be sent to the tasks")
    numbers, addresses, parts, found = (_free(df.columns, s) for s in ("numbers_of_flow", "addresses_of_flow", "parts_of_flow", "rules_of_flow"))
    values, sides = _values(df)
    both = [x for side in ("src_addr", "dst_addr") for x in (halves(F.col(side)) if side in df.columns else (F.lit(None).cast("long"),) * 2)]
    out = df.withColumns({numbers: values, addresses: sides, parts: F.array(*both)})
    rule = F.struct("rule", "tag", "dropped", "quick", "tests", "nets")
    out = out.withColumn(found, rules.where("side is null").agg(F.collect_list(rule)).scalar())
    kinds = rules.where("side is not null").select("side", "length", "bytes").distinct().collect()  # 324 at most
    lists = [found]
    for k, (side, length, size) in enumerate(sorted(map(tuple, kinds))):
        mine = rules.where((F.col("side") == side) & (F.col("length") == length) & (F.col("bytes") == size))
        high, low, held = (_free(out.columns, f"{c}_{k}") for c in ("high", "low", "rules"))
        listed = mine.groupBy(F.col("high").alias(high), F.col("low").alias(low)).agg(F.collect_list(rule).alias(held))
        at = _SIDES.index(side)
        of_family = F.length(F.get(F.col(addresses), F.lit(at))) == size
        in_it = [F.get(F.col(parts), F.lit(2 * (at - 1) + i)).bitwiseAND(F.lit(m)) for i, m in enumerate(_parts(netmask(4 if size == 4 else 6, length)))]
        out = out.join(F.broadcast(listed), of_family & (in_it[0] == F.col(high)) & (in_it[1] == F.col(low)), "left").drop(high, low)
        lists.append(held)
    met = F.concat(*[F.coalesce(F.col(c), F.array().cast(out.schema[found].dataType)) for c in lists])

    def holds(r: Column) -> Column:
        def number(t: Column) -> Column:
            v = F.get(F.col(numbers), t["field"]).bitwiseAND(t["mask"])
            return v.between(t["low"], t["high"]) != t["negated"]

        def network(t: Column) -> Column:
            a = F.get(F.col(addresses), t["side"])
            return F.coalesce((F.length(a) == F.length(t["low"])) & a.between(t["low"], t["high"]), F.lit(False)) != t["negated"]

        return F.forall(r["tests"], number) & F.forall(r["nets"], network)

    # quick rules stand before all others and in their order, the others in the reverse of theirs: the least one decides
    order = F.transform(F.filter(met, holds), lambda r: F.struct((~r["quick"]).alias("late"), F.when(r["quick"], r["rule"]).otherwise(-r["rule"]).alias("place"),
                                                                F.struct(r["rule"].alias("rule"), r["tag"].alias("tag"), r["dropped"].alias("dropped")).alias("decided")))
    # as a generator's row the verdict is computed once, whatever is asked of it afterwards
    return out.select(*df.columns, F.explode(F.array(F.array_min(order)["decided"])).alias("verdict"))


def _free(names: list[str], stem: str) -> str:
    while stem in names:
        stem += "_"
    return stem


def apply_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Accepted flows, with the tag of the rule that decided if it has one: :func:`~.policy.apply_policy` for tables of rules."""
    held = df.withColumnRenamed("verdict", _free(df.columns, "verdict_")) if "verdict" in df.columns else df
    out = judged(held, rules)
    own = F.col("tag").cast("long") if "tag" in held.columns else F.lit(None).cast("long")
    kept = out.where(~F.coalesce(F.col("verdict.dropped"), F.lit(False)))
    made = kept.withColumn("tag", F.coalesce(F.col("verdict.tag"), own)).drop("verdict")
    return made.withColumnRenamed(_free(df.columns, "verdict_"), "verdict") if "verdict" in df.columns else made
