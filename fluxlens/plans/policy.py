"""Filter policies: an ordered list of rules that accept, discard or tag flows, compiled to Column expressions.

The last rule that matches a flow decides, unless a ``quick`` rule matches before: that one decides at once.
A flow that no rule matches is accepted.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import family, in_network, parse_network
from ..functions.times import parse_number
from ..schema import ALL, GROUPS, mask_of, project

# fixed values: protocol names that a policy may use
PROTOCOLS = {
    "icmp": 1, "igmp": 2, "ipencap": 4, "tcp": 6, "egp": 8, "igp": 9, "udp": 17, "ipv6": 41, "rsvp": 46, "gre": 47,
    "esp": 50, "ah": 51, "ipv6-icmp": 58, "eigrp": 88, "ospf": 89, "pim": 103, "ipcomp": 108, "vrrp": 112, "sctp": 132,
}
DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


class PolicyError(ValueError):
    """Every error of a policy text, one a line."""


@dataclass
class Clause:
    """One condition of a rule: what it looks at, whether it is negated, and its value."""

    what: str
    value: object
    negated: bool = False

    def __str__(self) -> str:
        bang = "! " if self.negated else ""
        v = self.value
        match self.what:
            case "src" | "dst" | "agent" | "in_ifndx" | "out_ifndx":
                return f"{self.what} {bang}{v}"
            case "src_port" | "dst_port":
                return f"port {bang}{v}"
            case "af":
                return f"{bang}{'inet' if v == 4 else 'inet6'}"
            case "proto":
                return f"proto {bang}{v}"
            case "tos":
                return f"tos {bang}0x{v:02x}"
            case "tcp_flags":
                return f"tcp_flags mask 0x{v[0]:02x} {bang}equals 0x{v[1]:02x}"
            case "days":
                return "days " + ",".join(d[:3].capitalize() for i, d in enumerate(DAYS) if v >> i & 1)
            case "after" | "before":
                return f"{self.what} {v // 3600:02d}:{v // 60 % 60:02d}:{v % 60:02d}"
            case _:
                return f"{self.what.split('_')[0]} date {v:%Y%m%d%H%M%S}"


@dataclass
class Rule:
    action: str
    tag: int | None = None
    quick: bool = False
    clauses: list[Clause] = field(default_factory=list)

    def __str__(self) -> str:
        parts = [self.action]
        if self.tag is not None:
            parts.append(f"tag {self.tag}")
        if self.quick:
            parts.append("quick")
        have = {c.what for c in self.clauses}
        for c in self.clauses:
            if c.what in ("src_port", "dst_port") and c.what[:3] not in have:
                parts.append(f"{c.what[:3]} any")
            parts.append(str(c))
        return " ".join(parts if self.clauses else [*parts, "all"])

    def value(self, what: str) -> object:
        return next((c.value for c in self.clauses if c.what == what), None)

    def check(self) -> None:
        """The rule's own consistency."""
        have = {c.what: c.value for c in self.clauses}
        if self.tag is not None and self.action != "accept":
            raise ValueError("a discard rule can't tag")
        if "after" in have and "before" in have and have["after"] >= have["before"]:
            raise ValueError("time of day: start isn't before the end")
        if "after_date" in have and "before_date" in have and have["after_date"] >= have["before_date"]:
            raise ValueError("date: start isn't before the end")
        if {"src_port", "dst_port"} & have.keys() and have.get("proto") not in (6, 17):
            raise ValueError("a port needs proto tcp or udp")
        if "tcp_flags" in have and have.get("proto") != 6:
            raise ValueError("tcp_flags needs proto tcp")
        families = {4 if len(parse_network(have[x])[0]) == 4 else 6 for x in ("src", "dst") if x in have}
        if "af" in have:
            families.add(have["af"])
        if len(families) > 1:
            raise ValueError("address families differ")


@dataclass
class Policy:
    rules: list[Rule] = field(default_factory=list)
    store: int = ALL
    sources: list[str] | None = None
    settings: dict[str, list[str]] = field(default_factory=dict)

    def __str__(self) -> str:
        return "\n".join(map(str, self.rules))

    def config(self) -> str:
        """The whole effective policy: settings, groups that are stored, sources, rules."""
        lines = [f"{word} on {v}" if word == "listen" else f"{word} {v}" for word, values in self.settings.items() for v in values]
        lines += ["store ALL"] if self.store == ALL else [f"store {g.name}" for g in GROUPS if g.mask & self.store]
        lines += [f"flow source {x}" for x in self.sources or []]
        return "\n".join([*lines, *map(str, self.rules)])


# the language

_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([!,=-])|([^\s!,=#"{}-][^\s!,=#"{}]*)')


def _split(line: str) -> Iterator[tuple[str, bool]]:
    """(token, quoted) of a line without its comment."""
    at = 0
    while at < len(line):
        if line[at].isspace():
            at += 1
        elif line[at] == "#":
            return
        elif m := _TOKEN.match(line, at):
            yield (m[1].replace('\\"', '"'), True) if m[1] is not None else (m[2] or m[3], False)
            at = m.end()
        else:
            raise ValueError(f"unexpected character {line[at]!r}")


class _Line:
    """Tokens of a line, macros replaced."""

    def __init__(self, tokens: list[tuple[str, bool]], macros: dict[str, str]):
        self.tokens: list[str] = []
        for token, quoted in tokens:
            if not quoted and token.startswith("$"):
                if token[1:] not in macros:
                    raise ValueError(f"macro {token!r} isn't set")
                self.tokens.append(macros[token[1:]])
            else:
                self.tokens.append(token)
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *words: str) -> str | None:
        """The next token if it is one of ``words``."""
        if (t := self.peek()) is not None and t.lower() in words:
            self.at += 1
            return t.lower()
        return None

    def next(self, what: str) -> str:
        if (t := self.peek()) is None:
            raise ValueError(f"{what} expected at the end")
        self.at += 1
        return t

    def number(self, what: str, low: int, high: int) -> int:
        text = self.next(what)
        try:
            n = parse_number(text)
        except ValueError:
            raise ValueError(f"{what}: {text!r} is no number") from None
        if not low <= n <= high:
            raise ValueError(f"{what} out of range: {text}")
        return n

    def end(self) -> None:
        if (t := self.peek()) is not None:
            raise ValueError(f"syntax error at {t!r}")


def _day(name: str) -> int:
    found = [i for i, d in enumerate(DAYS) if len(name) >= 3 and d.startswith(name.lower())]
    if len(found) != 1:
        raise ValueError(f"unknown day {name!r}")
    return found[0]


def _days(line: _Line) -> int:
    """Mask of ``d``, ``d-d`` (may wrap) or ``d,d,...``; Sunday is bit 0."""
    words = [line.next("day")]
    while line.take(","):
        words.append(line.next("day"))
    mask = 0
    for w in words:
        first, dash, last = w.partition("-")
        if not dash and line.take("-"):
            dash, last = "-", line.next("day")
        a = _day(first)
        b = _day(last) if dash else a
        for k in range((b - a) % 7 + 1):
            mask |= 1 << (a + k) % 7
    return mask


def _time_of_day(text: str) -> int:
    m = re.fullmatch(r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", text)
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3] or 0) > 59:
        raise ValueError(f"bad time of day {text!r}")
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)


def _date(text: str) -> dt.datetime:
    formats = {4: "%Y", 6: "%Y%m", 8: "%Y%m%d", 10: "%Y%m%d%H", 12: "%Y%m%d%H%M", 14: "%Y%m%d%H%M%S"}
    try:
        return dt.datetime.strptime(text, formats[len(text)])
    except (KeyError, ValueError):
        raise ValueError(f"bad date {text!r}") from None


def _rule(line: _Line, action: str) -> Rule:
    rule = Rule(action)
    if line.take("tag"):
        rule.tag = line.number("tag", 0, 2**32 - 1)
    rule.quick = line.take("quick") is not None
    if line.take("all"):
        line.end()
        rule.check()
        return rule
    add = lambda what, value, negated=False: rule.clauses.append(Clause(what, value, negated))
    bang = lambda: line.take("!") is not None

    def network(what: str) -> str:
        text = line.next(what)
        parse_network(text)
        return text

    if line.take("agent"):
        negated = bang()
        add("agent", network("agent"), negated)
    for what in ("in_ifndx", "out_ifndx"):
        if line.take(what):
            negated = bang()
            add(what, line.number(what, 1, 65535), negated)
    negated = bang()
    if af := line.take("inet", "inet6"):
        add("af", 4 if af == "inet" else 6, negated)
    elif negated:
        raise ValueError("inet or inet6 expected after !")
    for what in ("src", "dst"):
        if line.take(what):
            negated = bang()
            if not line.take("any"):
                add(what, network(what), negated)
            elif negated:
                raise ValueError("any can't be negated")
            if line.take("port"):
                negated = bang()
                add(f"{what}_port", line.number("port", 1, 65535), negated)
    if line.take("proto"):
        negated = bang()
        name = line.next("protocol")
        if name.lower() in PROTOCOLS:
            add("proto", PROTOCOLS[name.lower()], negated)
        else:
            line.at -= 1
            add("proto", line.number("protocol", 1, 255), negated)
    if line.take("tos"):
        negated = bang()
        add("tos", line.number("tos", 0, 255), negated)
    if line.take("tcp_flags"):
        mask = line.number("mask", 0, 255) if line.take("mask") else 255
        negated = bang()
        if not line.take("equals"):
            raise ValueError("equals expected in tcp_flags")
        add("tcp_flags", (mask, line.number("flags", 0, 255)), negated)
    if line.take("days"):
        add("days", _days(line))
    for what in ("after", "before"):
        if line.take(what):
            if line.take("date"):
                add(f"{what}_date", _date(line.next("date")))
            else:
                add(what, _time_of_day(line.next("time")))
    line.end()
    rule.check()
    return rule


def parse(text: str, macros: dict[str, str] | None = None, filter_only: bool = True) -> Policy:
    """Policy of a text.  ``macros`` win over assignments in the text.

    All faulty lines are reported together.  Unless ``filter_only``, a log target and a listener are needed.
    """
    policy, errors, given = Policy(), [], dict(macros or {})
    values: dict[str, str] = {}
    store = 0
    joined = re.sub(r"\\\n", " ", text)
    for number, raw in enumerate(joined.split("\n"), 1):
        try:
            tokens = list(_split(raw))
            if not tokens:
                continue
            if len(tokens) == 3 and tokens[1] == ("=", False):
                values[tokens[0][0]] = tokens[2][0]
                continue
            line = _Line(tokens, values | given)
            if action := line.take("accept", "discard"):
                policy.rules.append(_rule(line, action))
            elif line.take("store"):
                store |= mask_of([line.next("field")])
                line.end()
            elif line.take("flow"):
                if not line.take("source"):
                    raise ValueError("source expected")
                if line.take("any"):
                    policy.sources = (policy.sources or []) + ["any"]
                else:
                    source = line.next("network")
                    parse_network(source)
                    policy.sources = (policy.sources or []) + [source]
                line.end()
            elif word := line.take("logfile", "logsock", "pidfile", "listen", "join"):
                if word == "listen":
                    line.take("on")
                policy.settings.setdefault(word, []).append(" ".join(line.tokens[line.at :]))
            else:
                raise ValueError(f"syntax error at {line.peek()!r}")
        except ValueError as e:
            errors.append(f"line {number}: {e}")
    if store:
        policy.store = store
    if not filter_only:
        if not {"logfile", "logsock"} & policy.settings.keys():
            errors.append("no logfile or logsock")
        if "listen" not in policy.settings:
            errors.append("no listen on")
    if errors:
        raise PolicyError("\n".join(errors))
    return policy


# compilation


def _number(name: str, columns: list[str]) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in columns else F.lit(0)


def clause_column(clause: Clause, columns: list[str]) -> Column:
    """Two-valued test.  What a flow lacks is zero, has no address family, and was received at the epoch."""
    address = lambda name: F.col(name) if name in columns else F.lit(None).cast("binary")
    if "recv_time" in columns:
        at = F.coalesce(F.col("recv_time"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    else:
        at = F.timestamp_seconds(_number("recv_sec", columns))
    v = clause.value
    match clause.what:
        case "agent" | "src" | "dst":
            test = in_network(address(f"{clause.what}_addr"), v)
        case "in_ifndx" | "out_ifndx":
            test = _number(f"if_index_{clause.what.split('_')[0]}", columns) == v
        case "af":
            test = (family(address("src_addr")) == v) | (family(address("dst_addr")) == v)
        case "src_port" | "dst_port":
            test = _number(clause.what, columns) == v
        case "proto":
            test = _number("protocol", columns) == v
        case "tos":
            test = _number("tos", columns) == v
        case "tcp_flags":
            test = _number("tcp_flags", columns).cast("int").bitwiseAND(F.lit(v[0])) == v[1]
        case "days":
            test = F.dayofweek(at).isin([i + 1 for i in range(7) if v >> i & 1])
        case "after" | "before":
            second = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
            test = second >= v if clause.what == "after" else second <= v
        case "after_date":
            test = at > F.lit(str(v)).cast("timestamp_ntz")
        case "before_date":
            test = at < F.lit(str(v)).cast("timestamp_ntz")
    return ~test if clause.negated else test


def matches(rule: Rule, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in rule.clauses:
        test = clause_column(c, columns)
        out = test if c is rule.clauses[0] else out & test
    return out


def winner(tests: list[Column], rules: list[Rule]) -> Column:
    """Index of the deciding rule, null if none matches: folded from the last rule to the first."""
    out = F.lit(None).cast("int")
    for i in range(len(rules) - 1, -1, -1):
        out = F.when(tests[i], F.lit(i)).otherwise(out) if rules[i].quick else F.coalesce(out, F.when(tests[i], F.lit(i)))
    return out


def apply_policy(df: DataFrame, policy: Policy) -> DataFrame:
    """Accepted flows, with the tag of the rule that decided if it has one.

    A leading ``discard quick`` rule is applied as a filter of its own, which reaches the scan.
    """
    rules = list(policy.rules)
    while rules and rules[0].quick and rules[0].action == "discard":
        df = df.where(~matches(rules.pop(0), df.columns))
    if not rules:
        return df
    win = winner([matches(r, df.columns) for r in rules], rules)
    dropped = [i for i, r in enumerate(rules) if r.action == "discard"]
    tagged = [(i, r.tag) for i, r in enumerate(rules) if r.tag is not None]
    if not tagged:
        return df.where(~F.coalesce(win.isin(dropped), F.lit(False))) if dropped else df
    # the verdict is computed once, as a column of its own: -1 drops the flow, -2 leaves its tag, others are the new tag
    verdict = _fresh(df.columns, "verdict")
    lookup = F.array(*[F.lit(-1 if r.action == "discard" else -2 if r.tag is None else r.tag).cast("long") for r in rules])
    own = F.col("tag").cast("long") if "tag" in df.columns else F.lit(None).cast("long")
    judged = df.withColumn(verdict, F.coalesce(F.get(lookup, win), F.lit(-2).cast("long")))
    if dropped:
        judged = judged.where(F.col(verdict) != -1)
    return judged.withColumn("tag", F.when(F.col(verdict) >= 0, F.col(verdict)).otherwise(own)).drop(verdict)


def _fresh(names: list[str], stem: str) -> str:
    while stem in names:
        stem += "_"
    return stem


def apply_store(df: DataFrame, policy: Policy) -> DataFrame:
    """What the policy's ``store`` lines let through to the output."""
    return project(df, policy.store)


def rule_report(df: DataFrame, policy: Policy) -> DataFrame:
    """(rule, text, evaluations, matches, wins) of the rules in their order; the text ends with the counts."""
    texts = rule_table(df.sparkSession, policy).withColumnRenamed("text", "rule_text")
    counts = F.concat(F.lit(" # evaluations "), "evaluations", F.lit(" matches "), "matches", F.lit(" wins "), "wins")
    both = rule_counters(df, policy).join(F.broadcast(texts), "rule")  # a row for each rule
    return both.select("rule", F.concat("rule_text", counts).alias("text"), "evaluations", "matches", "wins")


def rule_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """(rule, text) of the policy's rules, in their order."""
    return spark.createDataFrame([(i, str(r)) for i, r in enumerate(policy.rules)], "rule int, text string")


def counter_columns(policy: Policy, columns: list[str]) -> list[Column]:
    """Aggregates evaluations_<i>, matches_<i> and wins_<i> of each rule over flows of ``columns``."""
    rules = policy.rules
    tests = [matches(r, columns) for r in rules]
    stop = F.lit(len(rules))
    for i in range(len(rules) - 1, -1, -1):
        if rules[i].quick:
            stop = F.when(tests[i], F.lit(i)).otherwise(stop)
    win = winner(tests, rules)
    out = []
    for i in range(len(rules)):
        out.append(F.count_if(stop >= i).alias(f"evaluations_{i}"))
        out.append(F.count_if(tests[i] & (stop >= i)).alias(f"matches_{i}"))
        out.append(F.count_if(F.coalesce(win == i, F.lit(False))).alias(f"wins_{i}"))
    return out


def rule_counters(df: DataFrame, policy: Policy) -> DataFrame:
    """Per rule: rule (number), evaluations, matches, wins; one pass over the flows."""
    rules = policy.rules
    names = [f"m{i}" for i in range(len(rules))]
    tested = df.select(*[matches(r, df.columns).alias(n) for r, n in zip(rules, names, strict=True)])
    tests = [F.col(n) for n in names]
    stop = F.lit(len(rules))
    for i in range(len(rules) - 1, -1, -1):
        if rules[i].quick:
            stop = F.when(tests[i], F.lit(i)).otherwise(stop)
    win = winner(tests, rules)
    counted = tested.agg(
        *[
            F.struct(
                F.lit(i).alias("rule"),
                F.count_if(stop >= i).alias("evaluations"),
                F.count_if(tests[i] & (stop >= i)).alias("matches"),
                F.count_if(F.coalesce(win == i, F.lit(False))).alias("wins"),
            ).alias(f"r{i}")
            for i in range(len(rules))
        ]
    )
    return counted.select(F.inline(F.array(*[f"r{i}" for i in range(len(rules))])))
