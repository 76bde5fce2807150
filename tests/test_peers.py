"""Which exporters are kept, against going through all packets in turn."""

from collections import OrderedDict

import numpy as np
import pytest

from fluxlens.operators import peers


def in_turn(rows, limit):
    kept, out = OrderedDict(), []
    for agent, seq, flows in sorted(rows, key=lambda r: (r[1], r[0])):
        if agent in kept:
            if flows > 0:
                kept.move_to_end(agent)
            continue
        gone = kept.popitem(last=False)[0] if len(kept) >= limit else None
        kept[agent] = None
        out.append((agent, seq, gone))
    return sorted(out, key=str)


@pytest.mark.parametrize("share_without_flows", [0.0, 0.3, 0.9])
def test_comings_and_goings(spark, monkeypatch, share_without_flows):
    monkeypatch.setattr(peers, "RANGE", 200)
    rng = np.random.default_rng(int(share_without_flows * 10))
    rows = []
    for seq in range(400):
        agent = int(rng.zipf(1.3)) % 30 + (50 if seq > 200 else 0)
        rows.append((bytes([10, 0, 0, agent]), 5 * seq, 0 if rng.random() < share_without_flows else 3))
    df = spark.createDataFrame(rows, "agent_addr binary, seq long, flows long")
    for limit in (7,):
        want = in_turn(rows, limit)
        assert len(want) > 40
        got = peers.comings_and_goings(df, limit).collect()
        plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
        assert sorted((tuple(map(plain, r)) for r in got), key=str) == want


def test_none_has_to_go(spark):
    df = spark.createDataFrame([(b"\x01", 3, 1), (b"\x02", 1, 0), (b"\x01", 2, 0)], "agent_addr binary, seq long, flows long")
    assert sorted((bytes(r[0]), r[1], r[2]) for r in peers.turnover(df).collect()) == [(b"\x01", 1, 0), (b"\x02", 1, 0)]
    assert peers.comings_and_goings(df.limit(0)).collect() == []
