import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxlens.functions.times import crc
from fluxlens.schema import ALL, BRIEF, BY_NAME, CRC32, GROUPS, MASKS, columns_of, mask_of
from fluxlens.sources import records as R

WIDTH = {"I": 32, "H": 16, "B": 8, "Q": 64}


def a_row(draw, names):
    row = {}
    for name in names:
        g = BY_NAME[name]
        codes = [c for c in g.layout if c in WIDTH]
        if "s" in g.layout:
            row[g.columns[0]] = draw(st.binary(min_size=int(g.layout[:-1]), max_size=int(g.layout[:-1])))
        else:
            for column, code in zip(g.columns, codes, strict=True):
                row[column] = draw(st.integers(0, 2 ** WIDTH[code] - 1))
    return row


@st.composite
def rows(draw):
    names = [g.name for g in GROUPS if not g.name.endswith(("ADDR4", "ADDR6", "CRC32"))]
    chosen = draw(st.lists(st.sampled_from(names), unique=True))
    for role in ("AGENT_ADDR", "SRC_ADDR", "DST_ADDR", "GATEWAY_ADDR"):
        if family := draw(st.sampled_from([None, "4", "6"])):
            chosen.append(role + family)
    row = a_row(draw, chosen)
    if draw(st.booleans()):
        row["fields"] = CRC32
    return row


@settings(max_examples=150, deadline=None)
@given(rows())
def test_round_trip(row):
    data = R.encode(row)
    assert len(data) % 4 == 0
    got, end = R.decode(data)
    assert end == len(data)
    assert {k: got[k] for k in row if k != "fields"} == {k: v for k, v in row.items() if k != "fields"}
    assert R.encode(got) == data
    fields = struct.unpack_from(">I", data, 4)[0]
    assert R.length_of(fields) == len(data) - 8


def test_crc_starts_from_zero():
    assert crc(bytes(3)) == 0
    assert crc(b"abc") != 0 and crc(b"c", crc(b"ab")) == crc(b"abc")


def test_every_group_alone():
    for g in GROUPS:
        if g.mask != CRC32:
            row = {c: bytes(int(g.layout[:-1])) if "s" in g.layout else 7 for c in g.columns}
            got, _ = R.decode(R.encode(row))
            assert got["fields"] == g.mask and all(got[c] == row[c] for c in g.columns)


def test_errors():
    good = R.encode({"tag": 5, "octets": 2**63 + 9, "fields": CRC32})
    assert R.decode(good)[0]["octets"] == 2**63 + 9
    with pytest.raises(R.RecordError, match="checksum"):
        R.decode(good[:12] + b"\xff" + good[13:])
    assert R.decode(good[:-1] + b"\0", verify=False)[0]["tag"] == 5
    with pytest.raises(R.RecordError, match="version"):
        R.decode(b"\x40" + good[1:])
    with pytest.raises(R.RecordError, match="unknown fields"):
        R.decode(struct.pack(">BBHI", 0x60, 0, 0, 1 << 25))
    with pytest.raises(R.RecordError, match="two families"):
        R.decode(struct.pack(">BBHI", 0x60, 5, 0, (1 << 5) | (1 << 6)) + bytes(20))
    with pytest.raises(R.Truncated):
        R.decode(good[:-1])
    newer = struct.pack(">BBHI", 0x61, 2, 0, 1 | 1 << 25) + struct.pack(">II", 9, 1)
    assert R.decode(newer) == ({"fields": 1 | 1 << 25, "flow_ver": 0x61, "tag": 9}, 16)


def test_log_ends_at_a_cut_record():
    data = b"".join(R.encode({"tag": i}) for i in range(4))
    assert [r["tag"] for r in R.scan(data[:-2])] == [0, 1, 2]
    assert [r["tag"] for r in R.scan(data[: -R.HEADER.size + 1])] == [0, 1, 2]
    assert list(R.scan(b"")) == []


def test_old_format():
    row = {"tag": 1, "recv_sec": 77, "if_index_in": 3, "if_index_out": 4, "src_as": 65000, "dst_as": 1, "src_mask": 24,
           "dst_mask": 8, "engine_type": 1, "engine_id": 2, "flow_sequence": 5, "fields": CRC32}
    (got,) = R.scan(R.old_header() + R.encode_old(row | {"recv_usec": 0, "source_id": 0}), old=True)
    assert {k: got[k] for k in row if k != "fields"} == {k: v for k, v in row.items() if k != "fields"}
    assert got["recv_usec"] == 0 and got["source_id"] == 0
    with pytest.raises(R.RecordError, match="no flow log"):
        list(R.scan(bytes(16), old=True))
    with pytest.raises(R.RecordError, match="version"):
        list(R.scan(R.OLD_HEADER.pack(R.OLD_MAGIC, 9, 0, 0), old=True))


def test_masks():
    assert mask_of("all") == ALL and mask_of(["tag", "Src_Addr"]) == 1 | MASKS["SRC_ADDR"]
    assert columns_of(BRIEF)[:3] == ["tag", "recv_sec", "recv_usec"]
    assert len(MASKS) == 26
    with pytest.raises(ValueError, match="unknown field"):
        mask_of("PACKETS_OCTETS")
