"""Registered queries of the flow operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import addresses, times
from ..operators import exporters, histograms, peers, series, store, summary
from ..schema import BRIEF, MASKS, mask_of
from ..scratch import new_folder
from ..sources import export, flowlog, packets
from . import fixtures
from .adapters import EVENTS, LINES, event_flows, line_flows
from .policy import Clause, Policy, Rule, apply_policy, apply_store, parse, rule_counters, rule_report
from .ruletable import apply_rules, rules_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_L, _E = f"({LINES}) f", f"({EVENTS}) f"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# totals and the largest keys

_SUMS = "count(*) AS flows, CAST(coalesce(sum(octets), 0) AS BIGINT) AS octets, CAST(coalesce(sum(packets), 0) AS BIGINT) AS packets"


@query(f"SELECT {_SUMS}, min(recv_time) AS first_time, max(recv_time) AS last_time FROM {_L}")
def totals(spark, d):
    return summary.totals(line_flows(spark, d))


def _top(name: str, keys: list[str], which: str) -> None:
    by = ", ".join(keys)
    query(f"SELECT {by}, {_SUMS} FROM {_L} GROUP BY {by} ORDER BY {which} DESC, {by} LIMIT 10", name)(
        lambda spark, d: summary.top(line_flows(spark, d), keys, which)
    )


for _which in ("octets", "packets", "flows"):
    for _name, _keys in (
        ("dst_port", ["dst_port"]), ("src_port", ["src_port"]), ("protocol", ["protocol"]), ("src_addr", ["src_ip"]),
        ("dst_addr", ["dst_ip"]), ("from_to", ["src_ip", "dst_ip"]),
    ):
        _top(f"top_{_name}" + ("" if _which == "octets" else f"_{_which}"), _keys, _which)


@query(f"SELECT protocol, {_SUMS} FROM {_L} GROUP BY protocol")
def by_protocol(spark, d):
    return summary.top(line_flows(spark, d), ["protocol"], n=None, by_key_order=True)


@query(" UNION ALL ".join(
    f"SELECT '{'_'.join(s)}' AS kind, {', '.join(k if k in s else f'-1 AS {k}' for k in ('src_port', 'dst_port', 'protocol', 'src_ip', 'dst_ip'))}, {_SUMS} FROM {_L} GROUP BY {', '.join(s)}"
    for s in (("src_port",), ("dst_port",), ("protocol",), ("src_ip",), ("dst_ip",), ("src_ip", "dst_ip"))))
def by_each_key(spark, d):
    flows = line_flows(spark, d)
    keys = [["src_port"], ["dst_port"], ["protocol"], ["src_ip"], ["dst_ip"], ["src_ip", "dst_ip"]]
    return summary.by_each(flows, keys).na.fill(-1)


@query(f"SELECT 'src_ip' AS \"key\", count(DISTINCT src_ip) AS num_unique FROM {_L} UNION ALL SELECT 'dst_port', count(DISTINCT dst_port) FROM {_L}")
def unique_keys(spark, d):
    flows = line_flows(spark, d)
    both = flows.agg(F.count_distinct("src_ip").alias("src_ip"), F.count_distinct("dst_port").alias("dst_port"))
    return both.unpivot([], ["src_ip", "dst_port"], "key", "num_unique")


# predicates, each through the policy language


def _filter(name: str, policy: str, where: str, events: bool = False, more=None) -> None:
    """``more`` adds columns to the flows."""

    def run(spark, d):
        flows = (event_flows if events else line_flows)(spark, d)
        return apply_policy(more(flows) if more else flows, parse(policy)).select("flow_id", "octets")

    query(f"SELECT flow_id, octets FROM {_E if events else _L} WHERE {where}", name)(run)


_filter("filter_cidr", "discard quick src ! 10.0.0.0/27\ndiscard all\naccept dst 192.0.2.128/25",
        "src_ip BETWEEN 167772160 AND 167772191 AND dst_ip BETWEEN 3221226112 AND 3221226239")
_filter("filter_port_proto", "discard all\naccept dst any port 443 proto tcp\naccept dst any port 53 proto udp",
        "(dst_port = 443 AND protocol = 6) OR (dst_port = 53 AND protocol = 17)")
_filter("filter_tcp_flags", "discard proto tcp tcp_flags mask 0x12 ! equals 0x12", "NOT (protocol = 6 AND (tcp_flags & 18) <> 18)")
_filter("filter_negated", "discard all\naccept src ! 10.0.0.0/28 proto ! 17", "NOT src_ip BETWEEN 167772160 AND 167772175 AND protocol <> 17")
_filter("filter_missing_fields", "discard all\naccept tos 0 days Mon-Sun\ndiscard in_ifndx ! 3 proto gre", "protocol <> 47")
_filter("filter_days", "discard all\naccept days Sat,Sun", "dayofweek(recv_time) IN (0, 6)", True)
_filter("filter_time_of_day", "discard all\naccept after 08:30:00 before 17:30:00",
        "hour(recv_time) * 3600 + minute(recv_time) * 60 + floor(second(recv_time)) BETWEEN 30600 AND 63000", True)
_filter("filter_absolute_time", "discard all\naccept after date 20240105 before date 20240112083000",
        "recv_time > TIMESTAMP '2024-01-05' AND recv_time < TIMESTAMP '2024-01-12 08:30:00'", True)

_filter("filter_agent", "discard all\naccept agent 10.0.0.0/30\naccept agent ! 10.0.0.5 proto tcp",
        "agent_ip BETWEEN 167772160 AND 167772163 OR (agent_ip <> 167772165 AND protocol = 6)", True)


def _with_interfaces(flows: DataFrame) -> DataFrame:
    numbers = {"if_index_in": F.col("flow_id") % 5 + 1, "if_index_out": F.col("flow_id") % 7 + 1, "tos": F.col("flow_id") % 256}
    return flows.withColumns({k: x.cast("int") for k, x in numbers.items()})


_filter("filter_in_ifndx", "discard all\naccept in_ifndx 3\naccept in_ifndx ! 4 proto gre", "flow_id % 5 = 2 OR (flow_id % 5 <> 3 AND protocol = 47)", more=_with_interfaces)
_filter("filter_out_ifndx", "discard out_ifndx 2\naccept in_ifndx 1 out_ifndx ! 3 proto tcp",
        "flow_id % 7 <> 1 OR (flow_id % 5 = 0 AND protocol = 6)", more=_with_interfaces)
_filter("filter_tos", "discard all\naccept tos 16\naccept proto udp tos ! 0x20", "flow_id % 256 = 16 OR (protocol = 17 AND flow_id % 256 <> 32)", more=_with_interfaces)


def _some_v6(flows: DataFrame) -> DataFrame:
    """Every fourth flow runs between the same hosts in 2001:db8::/96."""
    wide = lambda c: F.unhex(F.concat(F.lit("20010db8" + "0" * 16), F.hex(c)))
    return flows.withColumns({c: F.when(F.col("flow_id") % 4 == 0, wide(F.col(c))).otherwise(F.col(c)) for c in ("src_addr", "dst_addr")})


_filter("filter_family", "discard all\naccept inet6\naccept ! inet6 proto udp", "flow_id % 4 = 0 OR protocol = 17", more=_some_v6)
_filter("filter_cidr_v6", "discard all\naccept src 2001:db8::a00:0/123\naccept inet src ! 10.0.0.0/27 proto gre",
        "(flow_id % 4 = 0 AND src_ip BETWEEN 167772160 AND 167772191) OR (flow_id % 4 <> 0 AND src_ip NOT BETWEEN 167772160 AND 167772191 AND protocol = 47)", more=_some_v6)

POLICY = """
local = "10.0.0.0/26"
discard quick src ! $local proto gre
accept tag 1 src $local dst 192.0.2.0/25
accept tag 0x100 dst any port 80 proto tcp
discard proto tcp tcp_flags mask 0x12 ! equals 0x12
accept quick src any port 2048 proto udp
accept tag 3 dst any port 53 proto udp
"""
_M = f"""
SELECT *, (src_ip NOT BETWEEN 167772160 AND 167772223 AND protocol = 47) AS m0,
 (src_ip BETWEEN 167772160 AND 167772223 AND dst_ip BETWEEN 3221225984 AND 3221226111) AS m1,
 (dst_port = 80 AND protocol = 6) AS m2, (protocol = 6 AND (tcp_flags & 18) <> 18) AS m3,
 (src_port = 2048 AND protocol = 17) AS m4, (dst_port = 53 AND protocol = 17) AS m5 FROM {_L}"""
_W = f"""SELECT *, CASE WHEN m0 THEN 0 WHEN m4 THEN 4 WHEN m5 THEN 5 WHEN m3 THEN 3 WHEN m2 THEN 2 WHEN m1 THEN 1 END AS w,
 CASE WHEN m0 THEN 0 WHEN m4 THEN 4 ELSE 9 END AS q FROM ({_M})"""
# rule 5 stands behind the quick rule 4, so it can only win where rule 4 doesn't match, as the CASE has it


@query(f"""SELECT tag, count(*) AS flows, CAST(sum(octets) AS BIGINT) AS octets FROM (
 SELECT octets, CASE w WHEN 1 THEN 1 WHEN 2 THEN 256 WHEN 5 THEN 3 ELSE 0 END AS tag FROM ({_W}) WHERE w IS NULL OR w NOT IN (0, 3)) GROUP BY tag""")
def policy_tag_counts(spark, d):
    tagged = apply_policy(line_flows(spark, d), parse(POLICY))
    return tagged.groupBy(F.coalesce("tag", F.lit(0).cast("long")).alias("tag")).agg(F.count("*").alias("flows"), F.sum("octets").alias("octets"))


@query(" UNION ALL ".join(
    f"SELECT {i} AS rule, count(*) FILTER (q >= {i}) AS evaluations, count(*) FILTER (m{i} AND q >= {i}) AS matches, count(*) FILTER (w = {i}) AS wins FROM ({_W})"
    for i in range(6)))
def policy_rule_counters(spark, d):
    return rule_counters(line_flows(spark, d), parse(POLICY))


_RULE_TEXTS = """(VALUES (0, 'discard quick src ! 10.0.0.0/26 proto 47'), (1, 'accept tag 1 src 10.0.0.0/26 dst 192.0.2.0/25'),
 (2, 'accept tag 256 dst any port 80 proto 6'), (3, 'discard proto 6 tcp_flags mask 0x12 ! equals 0x12'),
 (4, 'accept quick src any port 2048 proto 17'), (5, 'accept tag 3 dst any port 53 proto 17')) t(rule, text)"""


@query(f"SELECT rule, concat(text, ' # evaluations ', evaluations, ' matches ', matches, ' wins ', wins) AS text FROM ({SQL['policy_rule_counters']}) JOIN {_RULE_TEXTS} USING (rule)")
def policy_text(spark, d):
    """The rules as text, with what has come of them."""
    return rule_report(line_flows(spark, d), parse(POLICY)).select("rule", "text")


CONFIG = """
# a collector: macros, a joined line, numbers in three notations
lan = "10.1.0.0/16"
logfile "/var/log/flows"
listen on 127.0.0.1:12877
{sources}
store SRC_ADDR4   # only this and the
store OCTETS
accept tag 010 src $lan \\
  dst any port 0x35 proto udp
discard quick all
"""


@query(f"""WITH s AS (SELECT DISTINCT agent_ip - 167772160 AS a FROM {_E}),
 t AS (SELECT 0 AS line, 'logfile /var/log/flows' AS text UNION ALL SELECT 1, 'listen on 127.0.0.1:12877' UNION ALL SELECT 2, 'store SRC_ADDR4' UNION ALL SELECT 3, 'store OCTETS'
  UNION ALL SELECT 3 + row_number() OVER (ORDER BY a), concat('flow source 10.0.0.', a, '/32') FROM s
  UNION ALL SELECT 4 + count(*), 'accept tag 8 src 10.1.0.0/16 dst any port 53 proto 17' FROM s UNION ALL SELECT 5 + count(*), 'discard quick all' FROM s)
 SELECT CAST(line AS INT) AS line, text FROM t""")
def policy_config(spark, d):
    """A collector's whole policy, which admits the exporters that the table has."""
    found = event_flows(spark, d).select("agent_ip").distinct().orderBy("agent_ip").collect()  # eight of them
    sources = "\n".join(f"flow source 10.0.0.{r[0] - 167772160}/32" for r in found)
    lines = parse(CONFIG.replace("{sources}", sources), filter_only=False).config().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


@query(f"""SELECT CASE WHEN src_ip & 4294967288 = 167772168 AND dst_port = 53 AND protocol = 17 THEN 77777 ELSE src_ip - 167772160 END AS tag, count(*) AS flows
 FROM {_L} WHERE NOT (dst_ip & 4294967280 = 3221225984 AND protocol = 47) GROUP BY 1""")
def policy_rule_table(spark, d):
    """A rule for each supplier's address and three more, as a table that the flows are joined with."""
    sources = spark.read.parquet(f"{d}/supplier.parquet").select(F.max("s_suppkey")).first()[0]
    rules = [Rule("accept", tag=77777, quick=True, clauses=[Clause("src", "10.0.0.8/29"), Clause("dst_port", 53), Clause("proto", 17)])]
    rules += [Rule("accept", tag=k, clauses=[Clause("src", f"10.0.{k >> 8}.{k & 255}/32")]) for k in range(sources + 1)]
    rules += [Rule("discard", clauses=[Clause("dst", "192.0.2.0/28"), Clause("proto", 47)]), Rule("accept", tag=1, clauses=[Clause("proto", 250)])]
    return apply_rules(line_flows(spark, d), rules_of(spark, Policy(rules))).groupBy("tag").agg(F.count("*").alias("flows"))


@query(f"SELECT flow_id, {{}} AS src, packets FROM {_L} WHERE protocol <> 47".replace("{}", "concat(" + ", '.', ".join(f"CAST((src_ip >> {k}) & 255 AS VARCHAR)" for k in (24, 16, 8, 0)) + ")"))
def policy_store(spark, d):
    """What a policy filters, and then what its store lines let through: anything else would fail here."""
    policy = parse("discard proto gre\nstore SRC_ADDR\nstore PACKETS")
    out = apply_store(apply_policy(line_flows(spark, d), policy), policy)
    assert not {"octets", "dst_addr", "src_port", "recv_sec"} & set(out.columns)
    return out.select("flow_id", addresses.text(F.col("src_addr"), True).alias("src"), "packets")


# histograms and histories


def _histogram(name: str, f, value: str) -> None:
    query(f"""WITH b AS (SELECT CASE WHEN {value} < 1 THEN 0 ELSE length(CAST({value} AS VARCHAR)) - 1 END AS bin FROM {_L} WHERE {value} IS NOT NULL),
 c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
 r AS (SELECT unnest(range((SELECT min(bin) FROM c), (SELECT max(bin) FROM c) + 1)) AS bin)
 SELECT CAST(bin AS BIGINT) AS bin, CAST(power(10, bin) AS BIGINT) AS low, coalesce(n, 0) AS count FROM r LEFT JOIN c USING (bin)""", name)(
        lambda spark, d: f(line_flows(spark, d))
    )


_histogram("hist_octets", histograms.octets_histogram, "octets")
_histogram("hist_packets", histograms.packets_histogram, "packets")
_histogram("hist_duration", histograms.duration_histogram, "CAST(floor((flow_finish - flow_start) / 1000) AS BIGINT)")

_MS = "CAST(epoch_ms(recv_time) AS BIGINT)"
#: A flow of the events lasts up to two hours before it is received.
_LASTS = "(flow_id % 7200) * 1000"


def _ms():
    return times.epoch(F.col("recv_time")) * 1000


_SEC_MS = "CAST(floor(epoch(recv_time)) AS BIGINT) * 1000"


@query(f"""WITH c AS (SELECT CAST(floor({_SEC_MS} / 7200000) AS BIGINT) AS bin, count(*) AS n FROM {_E} GROUP BY 1),
 r AS (SELECT unnest(range((SELECT min(bin) FROM c), (SELECT max(bin) FROM c) + 1)) AS bin)
 SELECT bin, round(coalesce(n * 1000.0 / 7200000, 0), 9) AS rate FROM r LEFT JOIN c USING (bin)""")
def history_flows(spark, d):
    return histograms.rate_history(event_flows(spark, d), _ms()).select("bin", F.round("rate", 9).alias("rate"))


def _history_sql(strict: bool) -> str:
    share = "greatest(0, least(b, (bin + 1) * 300000.0) - greatest(a, bin * 300000.0))"
    if strict:
        share = f"CASE WHEN bin = l - 1 THEN b % 300000 ELSE {share} END"
    return f"""WITH s AS (SELECT CAST(octets AS DOUBLE) AS x, CAST({_SEC_MS} - {_LASTS} AS DOUBLE) AS a, CAST({_SEC_MS} AS DOUBLE) AS b FROM {_E}),
 t AS (SELECT *, CAST(floor(a / 300000) AS BIGINT) AS k, CAST(floor(b / 300000) AS BIGINT) AS l FROM s),
 u AS (SELECT *, unnest(CASE WHEN k = l THEN [k] ELSE range(k, l{'' if strict else ' + 1'}) END) AS bin FROM t),
 c AS (SELECT bin, sum(CASE WHEN k = l THEN x ELSE x * {share} / (b - a) END) * 1000.0 / 300000 AS rate FROM u GROUP BY bin),
 r AS (SELECT unnest(range((SELECT min(bin) FROM c), (SELECT max(bin) FROM c) + 1)) AS bin),
 h AS (SELECT bin, coalesce(rate, 0) AS rate FROM r LEFT JOIN c USING (bin)) """


def _interpolated(spark, d, strict=False):
    flows = event_flows(spark, d).withColumn("ms", _ms())
    return histograms.interpolated_history(flows, F.col("octets"), F.col("ms") - (F.col("flow_id") % 7200) * 1000, F.col("ms"), strict_compat=strict)


@query(_history_sql(False) + "SELECT bin, round(rate, 4) AS rate FROM h")
def history_interpolated(spark, d):
    return _interpolated(spark, d).select("bin", F.round("rate", 4).alias("rate"))


@query(_history_sql(True) + "SELECT bin, round(rate, 4) AS rate FROM h")
def history_interpolated_compat(spark, d):
    return _interpolated(spark, d, True).select("bin", F.round("rate", 4).alias("rate"))


_SKEW = f"(SELECT avg(floor(epoch(recv_time)) - ({_SEC_MS} - flow_id % 4096) / 1000.0) FROM {_E})"


def _skewed(spark, d):
    flows = event_flows(spark, d).withColumn("sec", times.epoch(F.col("recv_time")))
    return flows, histograms.clock_skew(flows, F.col("sec"), F.col("sec") * 1000 - F.col("flow_id") % 4096)


@query(f"SELECT round({_SKEW}, 6) AS skew")
def clock_skew(spark, d):
    return _skewed(spark, d)[1].select(F.round("skew", 6).alias("skew"))


@query(_history_sql(False) + f"""SELECT bin, round(rate, 4) AS rate FROM h, (SELECT min(floor(epoch(recv_time))) AS x, max(floor(epoch(recv_time))) AS y FROM {_E})
 WHERE bin * 300 >= x - {_SKEW} AND bin * 300 <= y - {_SKEW}""")
def history_cropped(spark, d):
    flows, skew = _skewed(spark, d)
    edges = flows.agg(F.min("sec").alias("a"), F.max("sec").alias("b"))
    cropped = histograms.crop(_interpolated(spark, d), edges.select("a").scalar(), edges.select("b").scalar(), skew.scalar(), 300_000)
    return cropped.select("bin", F.round("rate", 4).alias("rate"))


# roll-ups

_CASE = {**{n: f"protocol = {p}" for n, p in series.CLASSES.items()}, "other": f"protocol NOT IN ({', '.join(map(str, series.CLASSES.values()))})"}
_ROLL = f"""SELECT time_bucket(INTERVAL 300 SECONDS, recv_time, TIMESTAMP '1970-01-01') AS bin_start, """ + ", ".join(
    f"count(*) FILTER ({c}) AS {n}_flows, CAST(coalesce(sum(octets) FILTER ({c}), 0) AS BIGINT) AS {n}_bytes, CAST(coalesce(sum(packets) FILTER ({c}), 0) AS BIGINT) AS {n}_packets"
    for n, c in _CASE.items()
) + f" FROM {_E} GROUP BY 1"
_SERIES = [f"{n}_{w}" for n in series.NAMES for w in ("flows", "bytes", "packets")]


@query(_ROLL)
def rrd_5min(spark, d):
    return series.rollup(event_flows(spark, d))


def _consolidated(name: str, per_point: int, unknown: float) -> None:
    means = ", ".join(f"CASE WHEN count(*) >= {per_point * (1 - unknown)} THEN round(avg({c} / 300.0), 6) END AS {c}" for c in _SERIES)
    query(f"SELECT time_bucket(INTERVAL {300 * per_point} SECONDS, bin_start, TIMESTAMP '1970-01-01') AS point_start, count(*) AS known, {means} FROM ({_ROLL}) GROUP BY 1", name)(
        lambda spark, d: series.consolidate(series.rollup(event_flows(spark, d)), per_point, unknown).select(
            "point_start", "known", *[F.round(c, 6).alias(c) for c in _SERIES])
    )


_consolidated("rrd_consolidated", 6, 0.5)
_consolidated("rrd_2h", 24, 0.5)
_consolidated("rrd_daily", 288, 0.5)


def _summary(name: str, seconds: int) -> None:
    query(" UNION ALL ".join(
        f"SELECT '{n}' AS class, max_by({n}_bytes, bin_start) AS last, round(avg({n}_bytes), 6) AS average, min({n}_bytes) AS least, max({n}_bytes) AS greatest FROM ({_ROLL}) s WHERE date_diff('second', bin_start, (SELECT max(bin_start) FROM ({_ROLL}) z)) < {seconds}"
        for n in series.NAMES), name)(
        lambda spark, d: series.last_average_min_max(series.rollup(event_flows(spark, d)), "bytes", seconds).withColumn("average", F.round("average", 6))
    )


_summary("rrd_summary", 192000)
_summary("rrd_summary_long", 1152000)


_KEEP = ((1, 900, 0.75), (6, 150, 0.5), (24, 60, 0.5), (288, 9, 0.5))


@query(" UNION ALL ".join(
    f"""SELECT {n} AS per_point, * FROM (SELECT time_bucket(INTERVAL {300 * n} SECONDS, bin_start, TIMESTAMP '1970-01-01') AS point_start, count(*) AS known,
 CASE WHEN count(*) >= {n * (1 - u)} THEN round(avg(tcp_bytes / 300.0), 6) END AS tcp_bytes FROM ({_ROLL}) GROUP BY 1) x{n}
 WHERE date_diff('second', point_start, (SELECT max(bin_start) FROM ({_ROLL}) y{n})) < {kept * n * 300}""" for n, kept, u in _KEEP))  # fmt: skip
def rrd_archives(spark, d):
    """Four archives, each with its newest points only (fewer than by default, so that these tables fill them)."""
    kept = series.archives(series.rollup(event_flows(spark, d)), ["tcp_bytes"], _KEEP)
    return kept.withColumn("tcp_bytes", F.round("tcp_bytes", 6))


@query(SQL["rrd_archives"])
def rrd_store(spark, d):
    """The same archives from a store that two runs have brought up to date, which share one of three inputs."""
    folder = new_folder(spark, "store")
    flows = event_flows(spark, d).withColumn("input_file", F.concat(F.lit("log-"), F.col("flow_id") % 3))
    store.update(folder, flows.where("flow_id % 3 <= 1"))
    store.update(folder, flows.where("flow_id % 3 >= 1"))
    return store.stored_archives(spark, folder, ["tcp_bytes"], _KEEP).withColumn("tcp_bytes", F.round("tcp_bytes", 6))


_KINDS = (("src_port",), ("dst_port",), ("protocol",), ("src_ip",), ("dst_ip",), ("src_ip", "dst_ip"))
_KEYS = ("src_port", "dst_port", "protocol", "src_ip", "dst_ip")


def _each(k: tuple[str, ...]) -> str:
    return ", ".join(c if c in k else f"-1 AS {c}" for c in _KEYS)


@query(" UNION ALL ".join(
    f"SELECT '{'_'.join(k)}' AS kind, '{w}' AS which, rank, {', '.join(_KEYS)}, flows, octets, packets FROM (SELECT *, CAST(row_number() OVER (ORDER BY {w} DESC, {', '.join(k)}) AS INT) AS rank FROM"
    f" (SELECT {_each(k)}, {_SUMS} FROM {_L} GROUP BY {', '.join(k)})) WHERE rank <= 10"
    for k in _KINDS for w in ("octets", "packets", "flows")))
def report_lists(spark, d):
    return summary.top_lists(line_flows(spark, d), [list(k) for k in _KINDS]).na.fill(-1, list(_KEYS))


@query(" UNION ALL ".join(f"SELECT '{'_'.join(k)}' AS kind, {_each(k)}, {_SUMS}, NULL::TIMESTAMP AS first_time, NULL::TIMESTAMP AS last_time FROM {_L} GROUP BY {', '.join(k)}" for k in (("protocol",), ("dst_port",)))
       + f" UNION ALL SELECT 'all', {_each(())}, {_SUMS}, min(recv_time), max(recv_time) FROM {_L}")
def summary_merged(spark, d):
    """Summaries of three parts of the flows, saved, read again and merged."""
    flows, folder = line_flows(spark, d), new_folder(spark, "summary")
    for k in range(3):
        summary.state(flows.where(F.col("flow_id") % 3 == k), [["protocol"], ["dst_port"]]).write.mode("append").parquet(folder)
    whole = summary.merged([spark.read.parquet(folder)])
    return whole.withColumns({c: F.lit(-1) for c in ("src_port", "src_ip", "dst_ip")}).na.fill(-1, ["protocol", "dst_port"])


@query(f"SELECT CAST(row_number() OVER (ORDER BY bin) AS INT) AS position, bin, count FROM (SELECT length(CAST(octets AS VARCHAR)) - 1 AS bin, count(*) AS count FROM {_L} WHERE octets > 0 GROUP BY 1)")
def hist_in_order(spark, d):
    """Bins as they come out of the sorted histogram."""
    bins = histograms.octets_histogram(line_flows(spark, d).where("octets > 0"))
    return bins.select(F.row_number().over(Window.orderBy("bin")).alias("position"), "bin", "count").where("count > 0")  # some twenty bins


@query(f"SELECT CAST(row_number() OVER (ORDER BY v6, agent_ip) AS INT) AS position, agent_ip, v6 FROM (SELECT DISTINCT agent_ip, (agent_ip % 2 = 0) AS v6 FROM {_E})")
def peers_in_order(spark, d):
    """Exporters by address, IPv4 first; the even ones have IPv6 addresses here."""
    wide = F.unhex(F.concat(F.lit("20010db8" + "0" * 16), F.hex("agent_addr")))
    events = event_flows(spark, d).withColumn("agent_addr", F.when(F.col("agent_ip") % 2 == 0, wide).otherwise(F.col("agent_addr")))
    facts = events.select("agent_ip", "agent_addr", "recv_time", F.lit(1).alias("flows"), F.lit(0).alias("invalid"), F.lit(0).alias("no_template"), F.lit(5).alias("version"))
    stats = exporters.peer_stats(facts, "agent_addr")
    number = F.conv(F.expr("right(hex(agent_addr), 8)"), 16, 10).cast("long")
    position = F.row_number().over(Window.orderBy(*addresses.order_key(F.col("agent_addr"))))  # over exporters, not flows
    return stats.select(position.alias("position"), number.alias("agent_ip"), (F.length("agent_addr") == 16).alias("v6"))


# suspects, exporters, logs

_NAMES = "CAST(src_ip AS VARCHAR) AS source, coalesce(CAST(nullif(protocol, 0) AS VARCHAR), '???') AS protocol, coalesce(CAST(nullif(dst_port, 0) AS VARCHAR), '???') AS dst_port"


@query(f"""WITH g AS (SELECT source, protocol, dst_port, count(*) AS flows FROM (SELECT {_NAMES} FROM {_L}) GROUP BY ALL),
 t AS (SELECT * FROM g ORDER BY flows DESC, source, protocol, dst_port LIMIT 10), n AS (SELECT CAST(sum(flows) AS BIGINT) AS n FROM g),
 o AS (SELECT * FROM t UNION ALL SELECT 'OTHER', NULL, NULL, n - (SELECT CAST(sum(flows) AS BIGINT) FROM t) FROM n)
 SELECT source, protocol, dst_port, flows, round(flows * 100.0 / n, 6) AS percent FROM o, n""")
def scan_suspects(spark, d):
    return exporters.scan_suspects(line_flows(spark, d), "src_ip").withColumn("percent", F.round("percent", 6))


@query(f"""SELECT agent_ip, count(*) AS packets, CAST(sum(packets) AS BIGINT) AS flows, CAST(sum(CASE WHEN flow_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid,
 CAST(sum(flow_id % 3) AS BIGINT) AS no_template, min(recv_time) AS first_seen, max(recv_time) FILTER (flow_id % 13 <> 0) AS last_valid,
 max_by(version, (recv_time, version)) FILTER (flow_id % 13 <> 0) AS last_version FROM (SELECT *, CAST(1 + 2 * (flow_id % 5) AS INT) AS version FROM {_E}) GROUP BY agent_ip""")
def peer_stats(spark, d):
    facts = event_flows(spark, d).select(
        "agent_ip", "recv_time", F.col("packets").alias("flows"), (F.col("flow_id") % 13 == 0).cast("int").alias("invalid"),
        (F.col("flow_id") % 3).alias("no_template"), (1 + 2 * (F.col("flow_id") % 5)).cast("int").alias("version"),
    )
    return exporters.peer_stats(facts, "agent_ip")


_NETS = ["10.0.0.0/30", "10.0.0.6"]


@query(f"SELECT flow_id FROM {_E} WHERE agent_ip BETWEEN 167772160 AND 167772163 OR agent_ip = 167772166")
def admit_sources(spark, d):
    return exporters.admit(event_flows(spark, d), _NETS).select("flow_id")


@query(f"SELECT DISTINCT agent_ip FROM {_E} WHERE NOT (agent_ip BETWEEN 167772160 AND 167772163 OR agent_ip = 167772166)")
def reject_sources(spark, d):
    peers = event_flows(spark, d).select("agent_ip", "agent_addr").distinct()
    return exporters.no_longer_admitted(peers, _NETS).select("agent_ip")


_FILES = "SELECT *, flow_id % 4 AS file FROM "


@query(f"SELECT flow_id, file FROM (SELECT flow_id, file, row_number() OVER (PARTITION BY file ORDER BY flow_id) AS p FROM ({_FILES}{_L})) WHERE p <= 100")
def head_per_file(spark, d):
    flows = line_flows(spark, d).withColumn("file", F.col("flow_id") % 4)
    return exporters.first_in_file(flows.select("flow_id", "file"), 100, "file", "flow_id")


@query(f"SELECT flow_id, src_ip, dst_port, octets FROM {_L} UNION ALL SELECT flow_id, src_ip, 0, octets FROM {_E}")
def concat_logs(spark, d):
    return exporters.concatenate([line_flows(spark, d), event_flows(spark, d)]).select(
        "flow_id", "src_ip", F.coalesce("dst_port", F.lit(0)).alias("dst_port"), "octets"
    )


# projections and text


@query(f"SELECT flow_id, src_port, dst_port, packets, octets FROM {_L}")
def project_mask(spark, d):
    from ..schema import columns_of

    return line_flows(spark, d).select("flow_id", *columns_of(mask_of("srcdst_port PACKETS Octets")))


@query(f"SELECT flow_id, flow_id % 3 = 0 AS has_ports, FALSE AS has_v6 FROM {_L}")
def has_fields(spark, d):
    from ..schema import has_fields as test

    flows = line_flows(spark, d)
    some = flows.withColumns({c: F.when(F.col("flow_id") % 3 == 0, F.col(c)) for c in ("src_port", "dst_port")})
    return some.select("flow_id", test(MASKS["SRCDST_PORT"]).alias("has_ports"), test(MASKS["SRC_ADDR6"]).alias("has_v6"))


def _dotted(c: str) -> str:
    return "concat(" + ", '.', ".join(f"CAST(({c} >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0)) + ")"


def _v4(a):
    return addresses.text(a, ipv4_only=True)


@query(f"""SELECT flow_id, concat('FLOW proto ', CAST(protocol AS VARCHAR), ' tcpflags ', printf('%02x', tcp_flags), ' tos 00 src [', {_dotted('src_ip')}, ']:', CAST(src_port AS VARCHAR),
 ' dst [', {_dotted('dst_ip')}, ']:', CAST(dst_port AS VARCHAR), ' packets ', CAST(packets AS VARCHAR), ' octets ', CAST(octets AS VARCHAR), ' ') AS line FROM {_L}""")
def fmt_text(spark, d):
    flows = line_flows(spark, d).withColumn("tos", F.lit(0))
    return flows.select("flow_id", export.format_flow(flows, BRIEF, to_text=_v4).alias("line"))


@query(f"""SELECT concat_ws(',', '0', '0', '0', '', CAST(packets AS VARCHAR), CAST(octets AS VARCHAR), CAST(flow_start AS VARCHAR), CAST(flow_finish AS VARCHAR), '0', '0',
 {_dotted('src_ip')}, {_dotted('dst_ip')}, '', '0', '0', CAST(src_port AS VARCHAR), CAST(dst_port AS VARCHAR), CAST(protocol AS VARCHAR), '0', CAST(tcp_flags AS VARCHAR), '0', '0', '0', '0') AS value FROM {_L}""")
def fmt_csv(spark, d):
    return export.csv_lines(line_flows(spark, d), _v4)


@query(f"""SELECT CAST(0 AS BIGINT) AS tag, recv_time AS received, CAST(NULL AS VARCHAR) AS agent_addr, {_dotted('src_ip')} AS src_addr, {_dotted('dst_ip')} AS dst_addr,
 src_port, dst_port, octets, packets, protocol FROM {_L}""")
def fmt_sql_image(spark, d):
    return export.sql_rows(line_flows(spark, d), _v4)


@query(f"SELECT flow_id, strftime(recv_time, '%Y-%m-%dT%H:%M:%S') AS iso FROM {_E}")
def iso_time(spark, d):
    return event_flows(spark, d).select("flow_id", times.iso_time(times.epoch(F.col("recv_time"))).alias("iso"))


_I = "(flow_finish * 977)"


def _unit(size: int, over: int | None, name: str) -> str:
    x = f"{_I} % {over} // {size}" if over else f"{_I} // {size}"
    return f"CASE WHEN {x} > 0 THEN CAST({x} AS VARCHAR) || '{name}' ELSE '' END"


@query("SELECT flow_id, " + " || ".join([
    _unit(31449600, None, "y"), _unit(604800, 31449600, "w"), _unit(86400, 604800, "d"), _unit(3600, 86400, "h"), _unit(60, 3600, "m")
]) + f" || CAST({_I} % 60 AS VARCHAR) || 's' AS text FROM {_L}")
def interval_time(spark, d):
    return line_flows(spark, d).select("flow_id", times.interval_time(F.col("flow_finish") * 977).alias("text"))


@query(f"SELECT flow_id, CASE WHEN octets * 997 >= 1000000 THEN CAST(octets * 997 // 1000000 AS VARCHAR) || 'M' WHEN octets * 997 >= 1000 THEN CAST(octets * 997 // 1000 AS VARCHAR) || 'K' ELSE CAST(octets * 997 AS VARCHAR) END AS text FROM {_L}")
def iso_units(spark, d):
    return line_flows(spark, d).select("flow_id", times.iso_units(F.col("octets") * 997).alias("text"))


@query(f"SELECT flow_id, {_dotted('src_ip')} AS text, src_ip AS number FROM {_L}")
def ipv4_text(spark, d):
    shown = line_flows(spark, d).select("flow_id", addresses.text(F.col("src_addr"), True).alias("text"))
    return shown.withColumn("number", addresses.ipv4_text_number(F.col("text")))


_MS_TEXT = " || ".join([
    _unit(31449600, None, "y"), _unit(604800, 31449600, "w"), _unit(86400, 604800, "d"), _unit(3600, 86400, "h"), _unit(60, 3600, "m")
]).replace(_I, "(flow_finish * 977 // 1000)")


@query(f"SELECT flow_id, {_MS_TEXT} || CAST((flow_finish * 977 // 1000) % 60 AS VARCHAR) || 's.' || lpad(CAST(flow_finish * 977 % 1000 AS VARCHAR), 3, '0') AS text FROM {_L}")
def interval_time_ms(spark, d):
    return line_flows(spark, d).select("flow_id", times.interval_time_ms(F.col("flow_finish") * 977).alias("text"))


@query(f"SELECT flow_id, printf('%08x', src_ip) AS text FROM {_L}")
def hex_text(spark, d):
    return line_flows(spark, d).select("flow_id", times.hex_dump(F.col("src_addr")).alias("text"))


@query(f"SELECT flow_id, '2001:db8::' || printf('%x', 1 + flow_id % 65535) AS text, '20010DB8000000000000000000' || '00' || printf('%04X', 1 + flow_id % 65535) AS back FROM {_L}")
def ipv6_text(spark, d):
    address = F.unhex(F.concat(F.lit("20010db8" + "0" * 20), F.lpad(F.hex(F.col("flow_id") % 65535 + 1), 4, "0")))
    shown = line_flows(spark, d).select("flow_id", addresses.text(address).alias("text"))
    return shown.withColumn("back", F.hex(addresses.from_text(F.col("text"))))


_MASK = "(4294967296 - CAST(power(2, 32 - flow_id % 33) AS BIGINT))"
_HEX = "printf('%08X', {})".format


@query(f"""SELECT flow_id, {_HEX('m')} AS netmask, {_HEX('4294967295 - m')} AS hostmask, {_HEX('4294967295 - src_ip')} AS inverted,
 {_HEX('src_ip & m')} AS first, {_HEX('src_ip | (4294967295 - m)')} AS last, {_HEX('src_ip & dst_ip')} AS both, {_HEX('src_ip | dst_ip')} AS either,
 CAST(sign(src_ip - dst_ip) AS INT) AS compared, CAST(32 AS INT) AS single, (src_ip & m) = 0 AS unspecified, (src_ip & m) = src_ip AS zeros, (src_ip | (4294967295 - m)) = src_ip AS ones
 FROM (SELECT *, {_MASK} AS m FROM {_L})""")
def address_algebra(spark, d):
    flows = line_flows(spark, d)
    a, b, n = F.col("src_addr"), F.col("dst_addr"), (F.col("flow_id") % 33).cast("int")
    made = {
        "netmask": addresses.netmask_column(F.lit(4), n), "hostmask": addresses.hostmask_column(F.lit(4), n), "inverted": addresses.invert_column(a),
        "first": addresses.first_of(a, n), "last": addresses.last_of(a, n), "both": addresses.both_columns(a, b), "either": addresses.either_columns(a, b),
    }
    return flows.select(
        "flow_id", *[F.hex(x).alias(k) for k, x in made.items()], addresses.compare_columns(a, b).alias("compared"),
        addresses.unicast_length_column(a).alias("single"), addresses.is_unspecified_column(made["first"]).alias("unspecified"),
        addresses.host_is_zeros_column(a, n).alias("zeros"), addresses.host_is_ones_column(a, n).alias("ones"),
    )


_SIX = "'20010DB8' || '0000000000000000' || "


@query(f"""SELECT flow_id, repeat('F', 24) || {_HEX('m')} AS netmask, repeat('0', 24) || {_HEX('4294967295 - m')} AS hostmask,
 {_SIX}{_HEX('src_ip & m')} AS first, {_SIX}{_HEX('src_ip | (4294967295 - m)')} AS last, 'DFFEF247' || repeat('F', 16) || {_HEX('4294967295 - src_ip')} AS inverted,
 -1 AS compared, 128 AS single, (src_ip & m) = src_ip AS zeros FROM (SELECT *, {_MASK} AS m FROM {_L}) WHERE flow_id % 4 = 0""")
def address_algebra_v6(spark, d):
    flows = line_flows(spark, d).where("flow_id % 4 = 0").withColumn("four", F.col("dst_addr"))
    a, n = F.col("src_addr"), (F.col("flow_id") % 33 + 96).cast("int")
    made = {
        "netmask": addresses.netmask_column(F.lit(6), n), "hostmask": addresses.hostmask_column(F.lit(6), n),
        "first": addresses.first_of(a, n), "last": addresses.last_of(a, n), "inverted": addresses.invert_column(a),
    }
    return _some_v6(flows).select(
        "flow_id", *[F.hex(x).alias(k) for k, x in made.items()], addresses.compare_columns(F.col("four"), a).alias("compared"),
        addresses.unicast_length_column(a).alias("single"), addresses.host_is_zeros_column(a, n).alias("zeros"),
    )


@query(f"SELECT flow_id, CAST(floor(floor(epoch(recv_time)) / 300) * 300 AS BIGINT) AS start FROM {_E}")
def quantise(spark, d):
    return event_flows(spark, d).select("flow_id", times.quantise(times.epoch(F.col("recv_time"))).alias("start"))


# records and packets: encoded, decoded and counted, so that the result is a plain aggregate

_PORTS = f"SELECT dst_port, {_SUMS} FROM {_L} GROUP BY dst_port"


def _counted(flows: DataFrame, *more: Column) -> DataFrame:
    return flows.groupBy("dst_port").agg(
        F.count("*").alias("flows"), F.sum("octets").cast("long").alias("octets"), F.sum("packets").cast("long").alias("packets"), *more
    )


@query(f"SELECT dst_port, {_SUMS}, count(*) AS sums FROM {_L} GROUP BY dst_port")
def log_roundtrip_v3(spark, d):
    """Every flow as a binary record with a checksum, and back; ``sums`` counts the checksums that were there and right."""
    found = flowlog.decode_records(flowlog.encode_records(line_flows(spark, d), checksum=True))
    return _counted(found, F.count("crc32").alias("sums"))


@query(f"SELECT dst_port, {_SUMS}, count(*) AS sums FROM {_L} GROUP BY dst_port")
def log_roundtrip_v2(spark, d):
    """The same in the old format."""
    found = flowlog.decode_records(flowlog.encode_records(line_flows(spark, d), checksum=True, old=True), old=True)
    return _counted(found, F.count("crc32").alias("sums"))


_LINKS = "if_index_in if_index_out src_as dst_as src_mask dst_mask engine_type engine_id flow_sequence".split()


@query(f"SELECT flow_id AS flow_start, recv_usec, source_id, {', '.join(f'(flow_id + {i}) % {128 if i > 3 else 60000} AS {c}' for i, c in enumerate(_LINKS))} FROM (SELECT *, 0 AS recv_usec, 0 AS source_id FROM {_L})")
def log_v2_widened(spark, d):
    """Old records, whose interfaces, systems and engines are narrower and which lack what is zero here, as current ones."""
    numbers = {c: ((F.col("flow_id") + i) % (128 if i > 3 else 60000)).cast("long") for i, c in enumerate(_LINKS)}
    flows = line_flows(spark, d).withColumns({**numbers, "recv_sec": F.lit(7), "flow_start": F.col("flow_id")}).withColumn("source_id", F.lit(0))
    old = flowlog.decode_records(flowlog.encode_records(flows.withColumn("recv_usec", F.lit(9)), old=True), old=True)
    new = flowlog.decode_records(flowlog.encode_records(old, mask=MASKS["ALL"] & ~MASKS["CRC32"]))
    return new.select("flow_start", "recv_usec", "source_id", *[F.col(c).cast("long") for c in _LINKS])


@query(f"SELECT dst_port, count(*) AS flows, sum(octets)::BIGINT AS octets, 0::BIGINT AS packets, 0::BIGINT AS others FROM {_L} GROUP BY dst_port")
def log_masked(spark, d):
    """Records of some groups only: the others aren't in them."""
    found = flowlog.decode_records(flowlog.encode_records(line_flows(spark, d), mask_of("SRCDST_PORT OCTETS")))
    others = sum((F.count(c) for c in ("src_addr", "protocol", "flow_start", "packets", "crc32")), F.lit(0)).cast("long")
    return _counted(found, others.alias("others")).withColumn("packets", F.coalesce("packets", F.lit(0)))


# bytes by the published layouts: head 8 (old: 4), protocol and flags 4, address 4 or 16, ports 4, packets 8, octets 8, interfaces 8 (old: 4), systems 12 (old: 8), engine 12 (old: 8), checksum 4
@query(f"SELECT flow_id % 4 = 0 AS six, flow_id % 3 = 0 AS more, CAST(8 + 4 + CASE WHEN flow_id % 4 = 0 THEN 32 ELSE 8 END + 4 + 16 + CASE WHEN flow_id % 3 = 0 THEN 32 ELSE 0 END + 4 AS INT) AS size, CAST(4 + 4 + CASE WHEN flow_id % 4 = 0 THEN 32 ELSE 8 END + 4 + 16 + CASE WHEN flow_id % 3 = 0 THEN 20 ELSE 0 END + 4 AS INT) AS old_size, count(*) AS flows FROM {_L} GROUP BY ALL")
def log_lengths(spark, d):
    flows = _some_v6(line_flows(spark, d)).drop("flow_start", "flow_finish").withColumn("tos", F.lit(0))
    extra = ("if_index_in", "if_index_out", "src_as", "dst_as", "src_mask", "dst_mask", "engine_type", "engine_id", "flow_sequence", "source_id")
    flows = flows.withColumns({c: F.when(F.col("flow_id") % 3 == 0, F.lit(1)) for c in extra})
    new = flowlog.encode_records(flows, keep=("flow_id",), checksum=True).select("flow_id", F.length("record").alias("size"))
    old = flowlog.encode_records(flows, keep=("flow_id",), checksum=True, old=True).select("flow_id", F.length("record").alias("old_size"))
    kinds = [(F.col("flow_id") % 4 == 0).alias("six"), (F.col("flow_id") % 3 == 0).alias("more")]
    sizes = new.groupBy(*kinds, "size").agg(F.count("*").alias("flows"))
    return sizes.join(old.select(*kinds, "old_size").distinct(), ["six", "more"])


def _logs(spark, d, old: bool) -> DataFrame:
    """Flows as whole logs of at most 512 flows, and read again."""
    flows = line_flows(spark, d).withColumn("log", F.floor(F.col("flow_id") / 512))
    return flowlog.decode_logs(flowlog.log_of(flows, "log", old=old, checksum=True), old=old)


@query(_PORTS)
def log_whole_v2(spark, d):
    """Whole logs of the old format, with their head."""
    return _counted(_logs(spark, d, True))


@query(f"SELECT log AS input_file, count(*) AS flows, count(*) - 1 AS last_index, least(count(*), 10) AS shown FROM (SELECT CAST(flow_id // 512 AS VARCHAR) AS log FROM {_L}) GROUP BY log")
def log_row_index(spark, d):
    """Numbers that the source gives to a log's records; the first ten of each are picked by them."""
    found = _logs(spark, d, False)
    head = exporters.head_of_each(found, 10, "input_file", "row_index").groupBy("input_file").agg(F.count("*").alias("shown"))
    return found.groupBy("input_file").agg(F.count("*").alias("flows"), F.max("row_index").alias("last_index")).join(head, "input_file")


_LOGGED = "src_addr dst_addr src_port dst_port protocol tcp_flags packets octets".split()


@query(_PORTS)
def log_files(spark, d):
    """Written as flow logs by the data source, and read again through the binary file source."""
    flowlog.register(spark)
    folder = new_folder(spark, "log").removeprefix("file:")
    flows = line_flows(spark, d).select(*_LOGGED, F.lit(0).alias("tos"))
    flows.write.format("flowlog").mode("append").save(folder)
    return _counted(flowlog.read_log(spark, f"{folder}/*.flow"))


@query(f"SELECT dst_port, count(*) AS flows, 0::BIGINT AS octets, CAST(sum(packets) AS BIGINT) AS packets, 0::BIGINT AS sums FROM {_L} GROUP BY dst_port")
def log_files_fields(spark, d):
    """The writer's options: some groups, no checksums; read by the data source in small splits."""
    flowlog.register(spark)
    folder = new_folder(spark, "log").removeprefix("file:")
    flows = line_flows(spark, d).select(*_LOGGED)
    flows.write.format("flowlog").options(fields="SRCDST_PORT PACKETS", crc="false").mode("append").save(folder)
    found = spark.read.format("flowlog").option("splitbytes", "65536").load(folder)
    return _counted(found.withColumn("octets", F.coalesce("octets", F.lit(0))), F.count("crc32").alias("sums"))


def _one_log(spark, d, folder: str) -> str:
    """All flows in one log, each part written by a task."""
    line_flows(spark, d).select(*_LOGGED).write.format("flowlog").mode("append").save(f"{folder}/parts")
    return flowlog.join_logs(spark, f"{folder}/parts", f"{folder}/whole.flow")


@query(_PORTS)
def log_split(spark, d):
    """One log read in blocks of 256 KB, whose records are found and numbered without going through the log."""
    flowlog.register(spark)
    folder = new_folder(spark, "log").removeprefix("file:")
    _one_log(spark, d, folder)
    found = flowlog.read_split_log(spark, folder, 1 << 18)
    return _counted(found.withColumn("octets", F.when(F.col("row_index") >= 0, F.col("octets"))))


@query(_PORTS)
def stream_to_log(spark, d):
    """A stream written as flow logs, each batch once."""
    flowlog.register(spark)
    folder, log = new_folder(spark, "stream"), new_folder(spark, "log").removeprefix("file:")
    line_flows(spark, d).select(*_LOGGED).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    stream.writeStream.format("flowlog").option("path", log).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _counted(flowlog.read_log(spark, f"{log}/*.flow"))


@query(_PORTS)
def stream_log(spark, d):
    """A growing log as a stream: all of what is there, in the order in which it was written."""
    flowlog.register(spark)
    folder, folder2 = new_folder(spark, "log").removeprefix("file:"), new_folder(spark, "stream")
    log = _one_log(spark, d, folder)
    stream = spark.readStream.format("flowlog").options(streaming="true", maxbytes=str(16 << 20)).load(log)
    out = stream.writeStream.format("parquet").option("path", f"{folder2}/out").option("checkpointLocation", f"{folder2}/checkpoint").start()
    try:
        out.processAllAvailable()
    finally:
        out.stop()
    return _counted(spark.read.parquet(f"{folder2}/out"))


for _v in (1, 5, 7):
    query(_PORTS, f"netflow_v{_v}_decode")(lambda spark, d, v=_v: _counted(packets.decode_packets(fixtures.fixed_packets(line_flows(spark, d), v))))


def _landed(made: DataFrame) -> DataFrame:
    """Packets as collectors land them, in files: the decoder reads them more than once."""
    folder = new_folder(made.sparkSession, "packets")
    made.write.parquet(folder)
    return made.sparkSession.read.schema(made.schema).parquet(folder)


def _v9(spark, d, **options) -> DataFrame:
    return packets.decode_v9_packets(_landed(fixtures.v9_packets(line_flows(spark, d), **options)))


@query(_PORTS)
def netflow_v9_decode(spark, d):
    return _counted(_v9(spark, d))


@query(f"SELECT src_ip, dst_ip, src_port, dst_port, protocol, tcp_flags, CAST(packets AS BIGINT) AS packets, CAST(octets AS BIGINT) AS octets, 3 AS if_in, 4 AS if_out, 24 AS src_mask, 2 AS dst_as, 7 AS seq FROM {_L}")
def netflow_v5_fields(spark, d):
    """Each field of the decoded flows by itself."""
    found = packets.decode_packets(fixtures.fixed_packets(line_flows(spark, d), 5))
    return found.select(
        addresses.ipv4_number(F.col("src_addr")).alias("src_ip"), addresses.ipv4_number(F.col("dst_addr")).alias("dst_ip"), "src_port", "dst_port",
        F.col("protocol").cast("int"), F.col("tcp_flags").cast("int"), F.col("packets").cast("long"), F.col("octets").cast("long"),
        F.col("if_index_in").cast("int").alias("if_in"), F.col("if_index_out").cast("int").alias("if_out"), F.col("src_mask").cast("int"),
        F.col("dst_as").cast("int"), F.col("flow_sequence").cast("int").alias("seq"),
    )


@query(f"SELECT src_ip, dst_ip, CAST(packets AS BIGINT) AS packets, CAST(octets AS BIGINT) AS octets, flow_start AS uptime_first, flow_finish AS uptime_last, src_as, src_mask, engine FROM (SELECT *, flow_id % 70000 AS src_as, 25 AS src_mask, 9 AS engine FROM {_L})")
def netflow_v9_fields(spark, d):
    """More field types, some of them narrower or wider than usual; a type that isn't known is skipped."""
    flows = line_flows(spark, d).withColumns({"src_as": F.col("flow_id") % 70000, "src_mask": F.lit(25), "engine": F.lit(9), "unknown": F.lit(77)})
    fields = {"src_ip": (8, 4), "unknown": (200, 3), "dst_ip": (12, 4), "packets": (2, 8), "octets": (1, 3), "flow_start": (22, 4), "flow_finish": (21, 4),
              "src_as": (16, 4), "src_mask": (9, 1), "engine": (38, 2)}
    found = packets.decode_v9_packets(_landed(fixtures.v9_packets(flows, fields=fields)))
    return found.select(
        addresses.ipv4_number(F.col("src_addr")).alias("src_ip"), addresses.ipv4_number(F.col("dst_addr")).alias("dst_ip"), F.col("packets").cast("long"),
        F.col("octets").cast("long"), F.col("flow_start").alias("uptime_first"), F.col("flow_finish").alias("uptime_last"), "src_as",
        F.col("src_mask").cast("int"), F.col("engine_type").cast("int").alias("engine"),
    )


@query(_PORTS)
def netflow_v9_options(spark, d):
    """Packets that begin with an options flowset and one of a reserved number, both of which are passed over."""
    return _counted(_v9(spark, d, before="0001" + "000c" + "0100" + "0004" + "0004" + "0001" + "0005" + "0008" + "ffffffff"))


@query(f"SELECT dst_port, {_SUMS} FROM {_L} WHERE flow_id % 8 < 4 GROUP BY dst_port")
def netflow_v9_widths(spark, d):
    """Exporters from 4 on first announce a source address of three bytes in each packet: it is refused, and what follows in the packet with it."""
    flows, refused = line_flows(spark, d), fixtures.template(301, [(8, 3), (1, 4)])
    bad = fixtures.v9_packets(flows.where("flow_id % 8 >= 4"), before=refused)
    return _counted(packets.decode_v9_packets(_landed(fixtures.v9_packets(flows.where("flow_id % 8 < 4")).unionByName(bad))))


@query(_PORTS)
def netflow_v9_changing(spark, d):
    """Few packets announce the template, whose fields change their order now and then: data is read by what held when it was sent."""
    return _counted(packets.decode_v9_packets(_landed(fixtures.v9_changing_packets(line_flows(spark, d)))))


@query(f"SELECT dst_port, {_SUMS} FROM {_L} WHERE flow_id % 8 < 4 GROUP BY dst_port")
def netflow_v9_families(spark, d):
    """Flows between two families are left out: exporters from 4 on report an IPv6 destination next to an IPv4 source."""
    flows = line_flows(spark, d).withColumn("dst_high", F.lit(0))
    odd = {"src_ip": (8, 4), "dst_ip": (28, 16), **{k: v for k, v in fixtures.V9.items() if k not in ("src_ip", "dst_ip")}}
    mixed = fixtures.v9_packets(flows.where("flow_id % 8 >= 4"), fields=odd)
    return _counted(packets.decode_v9_packets(_landed(fixtures.v9_packets(flows.where("flow_id % 8 < 4")).unionByName(mixed))))


@query(f"SELECT CAST(a AS INT) AS agent, CAST(sum(ceil(n / 24.0)) AS BIGINT) AS packets, CAST(sum(n) AS BIGINT) AS flows, CAST(0 AS BIGINT) AS invalid, CAST(sum(ceil(n / 24.0)) AS BIGINT) AS no_template FROM (SELECT flow_id % 8 AS a, count(*) AS n FROM {_L} GROUP BY flow_id % 8, flow_id // 192) GROUP BY a")
def netflow_v9_evicted(spark, d):
    """Nine templates are announced in each packet, one more than a source may have: data of the first is lost."""
    many = "".join(fixtures.template(400 + i, [(1, 4)]) for i in range(8))
    lost = "0190" + "0008" + "00000001"  # template 400, which the ninth pushed out
    made = fixtures.v9_packets(line_flows(spark, d), before=many + fixtures.template(408, [(1, 4)]) + lost)
    stats = exporters.peer_stats(packets.packet_facts(_landed(made)), "agent_addr")
    return stats.select(F.conv(F.hex(F.substring("agent_addr", 4, 1)), 16, 10).cast("int").alias("agent"), "packets", "flows", "invalid", "no_template")


@query(f"SELECT CAST(a AS INT) AS agent, CAST(sum(ceil(n / 24.0)) AS BIGINT) AS packets, CAST(sum(n) AS BIGINT) AS flows, CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS no_template FROM (SELECT flow_id % 8 AS a, count(*) AS n FROM {_L} GROUP BY flow_id % 8, flow_id // 192) GROUP BY a")
def exporter_packets(spark, d):
    stats = exporters.peer_stats(packets.packet_facts(_landed(fixtures.v9_packets(line_flows(spark, d)))), "agent_addr")
    return stats.select(F.conv(F.hex(F.substring("agent_addr", 4, 1)), 16, 10).cast("int").alias("agent"), "packets", "flows", "invalid", "no_template")


@query("""WITH e AS (SELECT event_id AS s, user_id AS u, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
 n AS (SELECT a.s, count(DISTINCT b.u) AS others FROM e a JOIN e b ON b.s > a.p AND b.s < a.s GROUP BY a.s),
 c AS (SELECT u, count(*) AS came, max(s) AS last FROM (SELECT e.*, coalesce(n.others, 0) AS others FROM e LEFT JOIN n USING (s)) WHERE p IS NULL OR others >= 128 GROUP BY u),
 k AS (SELECT u FROM (SELECT u, max(s) AS s FROM e GROUP BY u ORDER BY s DESC LIMIT 128))
 SELECT CAST(u AS BIGINT) AS exporter, came, CAST(came - CASE WHEN k.u IS NULL THEN 0 ELSE 1 END AS BIGINT) AS went FROM c LEFT JOIN k USING (u)""")
def exporters_evicted(spark, d):
    """How often each exporter of a stream of packets came in and had to go, no more than 128 being kept."""
    sent = event_flows(spark, d).select(addresses.ipv4_from_number(F.col("src_ip")).alias("agent_addr"), (F.col("flow_id") * 64).alias("seq"), F.lit(1).alias("flows"))
    return peers.turnover(sent).select((addresses.ipv4_number(F.col("agent_addr")) - 167772160).alias("exporter"), "came", "went")


@query(f"SELECT dst_port, {_SUMS} FROM {_L} WHERE flow_id % 8 BETWEEN 2 AND 3 AND protocol <> 47 GROUP BY dst_port")
def stream_v9(spark, d):
    """A stream of packets from admitted exporters through decoder and policy, templates kept as state."""
    from ..streaming.rollup import decode_stream, packets_from

    folder = new_folder(spark, "packets")
    fixtures.v9_packets(line_flows(spark, d)).write.parquet(f"{folder}/in")
    flows = decode_stream(packets_from(spark, f"{folder}/in"), parse("flow source 10.0.0.2/31\ndiscard proto gre"))
    out = flows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return _counted(spark.read.parquet(f"{folder}/out"))


@query(_ROLL)
def stream_rrd_5min(spark, d):
    """The five-minute roll-up as a stream over the files of the table, all that is there."""
    from ..streaming.rollup import rollup_stream, run_once

    source = spark.read.parquet(f"{d}/events.parquet")
    raw = spark.readStream.schema(source.schema).parquet(f"{d}/events*.parquet")
    flows = spark.sql(EVENTS.replace("FROM events", "FROM {t}"), t=raw)
    folder = new_folder(spark, "stream")
    name = "roll_" + folder[-32:]
    running = run_once(rollup_stream(flows), name, folder, "complete")
    running.awaitTermination()
    # zone-less times went in as times of the session's zone, and come back so
    return spark.table(name).withColumn("bin_start", F.col("bin_start").cast("timestamp_ntz"))
