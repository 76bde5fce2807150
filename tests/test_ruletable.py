"""Policies as tables of rules against compiled ones."""

import datetime as dt

import numpy as np

from fluxlens.plans.policy import Clause, Policy, Rule, apply_policy
from fluxlens.plans.ruletable import apply_rules, rules_of

FLOW = ("id long, src_addr binary, dst_addr binary, agent_addr binary, src_port int, dst_port int, protocol int, tos int, tcp_flags int, "
        "if_index_in long, if_index_out long, recv_time timestamp_ntz, tag long, verdict string")  # fmt: skip


def _policy(rng, n):
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3/32", "0.0.0.0/0", "2001:db8::/32", "2001:db8::1/128", "10.1.2.0/30"]
    moment = dt.datetime(2024, 1, 1, 12)
    kinds = {
        "src": lambda: str(rng.choice(nets)), "dst": lambda: str(rng.choice(nets)), "agent": lambda: str(rng.choice(nets[:4])), "in_ifndx": lambda: int(rng.integers(3)),
        "out_ifndx": lambda: int(rng.integers(3)), "af": lambda: int(rng.choice([4, 6])), "src_port": lambda: int(rng.integers(3)), "dst_port": lambda: int(rng.integers(3)),
        "proto": lambda: int(rng.choice([6, 17])), "tos": lambda: int(rng.integers(3)), "tcp_flags": lambda: (0x12, int(rng.choice([2, 0x12]))),
        "days": lambda: int(rng.integers(1, 128)), "after": lambda: int(rng.integers(86400)), "before": lambda: int(rng.integers(86400)),
        "after_date": lambda: moment, "before_date": lambda: moment,
    }
    rules = []
    for i in range(n):
        whats = rng.choice(list(kinds), int(rng.integers(0, 4)), replace=False)
        clauses = [Clause(str(w), kinds[str(w)](), bool(rng.random() < 0.3)) for w in whats]
        drop = rng.random() < 0.4
        rules.append(Rule("discard" if drop else "accept", tag=None if drop or rng.random() < 0.3 else i, quick=bool(rng.random() < 0.1) and len(clauses) > 1, clauses=clauses))
    return Policy(rules)


def _flows(spark, rng, n):
    addresses = [bytes([10, 1, 2, 3]), bytes([10, 1, 2, 9]), bytes([10, 9, 9, 9]), bytes([192, 0, 2, 1]), bytes.fromhex("20010db8" + "00" * 11 + "01"), bytes.fromhex("20010db8" + "00" * 11 + "02"), None]
    pick = lambda: addresses[int(rng.integers(len(addresses)))]
    maybe = lambda x: None if rng.random() < 0.1 else int(x)
    rows = []
    for i in range(n):
        at = dt.datetime(2024, 1, 1, 12) + dt.timedelta(seconds=int(rng.integers(-400_000, 400_000)) if rng.random() < 0.9 else 0)
        rows.append((i, pick(), pick(), pick(), maybe(rng.integers(3)), maybe(rng.integers(3)), maybe(rng.choice([6, 17])), maybe(rng.integers(3)), maybe(rng.choice([2, 0x12, 0])),
                     maybe(rng.integers(3)), maybe(rng.integers(3)), None if rng.random() < 0.1 else at, maybe(5), "x"))
    return spark.createDataFrame(rows, FLOW)


def test_a_table_decides_as_the_compiled_policy(spark):
    rng = np.random.default_rng(6)
    flows = _flows(spark, rng, 300).cache()
    for n in (0, 1, 12, 40):
        policy = _policy(rng, n)
        want = sorted((r["id"], r["tag"]) for r in apply_policy(flows, policy).collect())
        got = apply_rules(flows, rules_of(spark, policy))
        assert got.columns == flows.columns
        assert sorted(((r["id"], r["tag"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_ten_thousand_rules(spark):
    rng = np.random.default_rng(7)
    flows = _flows(spark, rng, 200)
    few = Policy([Rule("accept", tag=k, clauses=[Clause("src", f"10.{k >> 8}.{k & 255}.0/24"), Clause("proto", 6)]) for k in range(10)])
    many = Policy([Rule("accept", tag=k, clauses=[Clause("src", f"10.{k >> 8}.{k & 255}.0/24"), Clause("proto", 6)]) for k in range(10_000)])
    size = lambda p: len(apply_rules(flows, rules_of(spark, p))._jdf.queryExecution().analyzed().toString().split("\n"))
    assert size(many) == size(few)
    for r in apply_rules(flows, rules_of(spark, many)).collect():
        inside = r["src_addr"] is not None and len(r["src_addr"]) == 4 and r["src_addr"][0] == 10 and r["protocol"] == 6
        assert inside == (r["tag"] == (256 * r["src_addr"][1] + r["src_addr"][2] if inside else -1))
