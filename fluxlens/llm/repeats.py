"""Removal of passages that an earlier document has too, by suffix arrays over content-dealt shards."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialise, shuffle_width, slices
from .suffixes import common_prefixes, suffix_array

#: Bytes of a passage; bytes of the anchor in it, and the positions at which the anchor may start.
LENGTH, ANCHOR = 50, 16
PLACES = LENGTH - ANCHOR + 1
#: A match of LENGTH bytes round a common anchor has so many more bytes in common on one side of it at least.
SIDE = (LENGTH - ANCHOR + 1) // 2
#: Texts that are cut together; texts of a block, which is what goes through shuffles as one row.
CHUNK, BLOCK = 1 << 20, 8 << 20
#: Bytes of text whose keys are counted together; bytes of pieces in a shard; bytes of one suffix array.
COUNTED, SHARD, ARRAY = 32 << 20, 8 << 20, 1 << 20
#: Pieces of one key, in all blocks, beyond which its passages are dealt singly.
SPLIT = 4096
#: A piece takes about so many bytes.
_PIECE = 80
_U = np.uint64
_PLACE = _U(0xFFFFFF)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _U(0x9E3779B97F4A7C15)
    x += b * _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(29)
    return x


@dataclass
class Pieces:
    """Parts of texts.  Each has all passages with one anchor: passages start at ``lo`` and up to LENGTH - 1 bytes
    before the piece's end.  ``at`` is its place in ``data``, ``anchor`` the anchor's place in the piece."""

    data: np.ndarray
    at: np.ndarray
    size: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    text: np.ndarray
    lo: np.ndarray

    def take(self, rows: np.ndarray) -> Pieces:
        return Pieces(self.data, *(getattr(self, f.name)[rows] for f in fields(self)[1:]))

    def packed(self) -> Pieces:
        """The same with nothing else in ``data``."""
        starts = np.cumsum(self.size) - self.size
        index = np.repeat(self.at - starts, self.size) + np.arange(int(self.size.sum()))
        return Pieces(self.data[index], starts, *(getattr(self, f.name) for f in fields(self)[2:]))

    def words(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each place of ``data``."""
        return np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))[at]

    @staticmethod
    def joined(parts: Sequence[Pieces]) -> Pieces:
        shift = np.cumsum([0] + [len(p.data) for p in parts])
        rest = [np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Pieces)[2:]]
        return Pieces(
            np.concatenate([p.data for p in parts]),
            np.concatenate([p.at + s for p, s in zip(parts, shift, strict=False)]),
            *rest,
        )


def anchors(h: np.ndarray) -> np.ndarray:
    """Place of the smallest (high bits of the) hash among PLACES from each on, the leftmost of equal ones.

    The place takes the low bits, so a block of hashes is no longer than these can tell apart; the next
    one begins PLACES - 1 hashes before its end.
    """
    n = len(h) - PLACES + 1
    step = int(_PLACE) + 2 - PLACES
    place = np.empty(max(0, n), np.int64)
    for a in range(0, n, step):
        least = h[a : a + step + PLACES - 1] & ~_PLACE
        least |= np.arange(len(least), dtype=_U)
        m = 1
        while 2 * m <= PLACES:
            least = np.minimum(least[:-m], least[m:])
            m *= 2
        if m < PLACES:
            least = np.minimum(least[: m - PLACES], least[PLACES - m :])
        place[a : a + step] = (least & _PLACE).astype(np.int64) + a
    return place


def anchored(texts: Sequence[bytes], docs: np.ndarray, keys: np.ndarray, offsets: np.ndarray | None = None) -> Pieces:
    """Pieces of the texts (or of stretches of texts that begin at ``offsets``).  A passage's anchor is the ANCHOR bytes in it with the smallest hash (the leftmost of
    equal ones), so equal passages have equal anchors at equal places."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    n = len(data) - 8
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return Pieces(data, none, none, none, none, none, none)
    h = _mix(data[:n].astype(_U) + _U(1), np.full(1, 7, _U))
    m = 1
    while m < ANCHOR:
        h = _mix(h[:-m], h[m:])
        m *= 2
    place = anchors(h)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    start = np.arange(len(place))
    start = start[start + LENGTH <= ends[owner[: len(place)]]]
    if not len(start):
        return Pieces(data, none, none, none, none, none, none)
    place, owner = place[start], owner[start]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    first, last, place, owner = start[new], start[np.r_[new[1:], len(start)] - 1], place[new], owner[new]
    begins = (ends - lengths)[owner]
    if offsets is not None:
        begins = begins - offsets[owner]
    return Pieces(data, first, last - first + LENGTH, place - first, docs[owner], keys[owner], first - begins)


def stretches(texts: Sequence[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(stretches, number of the text of each, where each begins in it) of about CHUNK bytes together.

    A longer text is cut; LENGTH - 1 bytes of overlap give each passage to one stretch.
    """
    held: list[bytes] = []
    owners: list[int] = []
    begins: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, CHUNK):
            held.append(text[at : at + CHUNK + LENGTH - 1])
            owners.append(i)
            begins.append(at)
            size += len(held[-1])
            if size >= CHUNK:
                yield held, np.array(owners), np.array(begins)
                held, owners, begins, size = [], [], [], 0
    if held:
        yield held, np.array(owners), np.array(begins)


def keyed(p: Pieces) -> tuple[Pieces, np.ndarray]:
    """The pieces cut in two at most, and the key of each part.

    A passage has SIDE more bytes in front of its anchor or, if not, SIDE more behind it.  The passages
    of a piece that have them in front make one part, the others the other; a part's key is a hash of the anchor with
    those bytes.  All passages of a part have its key in them, and equal passages have equal keys.
    """
    m = p.size - LENGTH + 1
    front = np.flatnonzero(p.anchor >= SIDE)
    behind = np.flatnonzero(p.anchor - m + 1 < SIDE)
    skip = np.maximum(0, p.anchor[behind] - SIDE + 1)
    rows = np.r_[front, behind]
    at = np.r_[p.at[front], p.at[behind] + skip]
    anchor = np.r_[p.anchor[front], p.anchor[behind] - skip]
    size = np.r_[np.minimum(m[front], p.anchor[front] - SIDE + 1) + LENGTH - 1, p.size[behind] - skip]
    lo = np.r_[p.lo[front], p.lo[behind] + skip]
    parts = Pieces(p.data, at, size, anchor, p.doc[rows], p.text[rows], lo)
    return parts, keys_of(parts)


def keys_of(p: Pieces) -> np.ndarray:
    """Keys of parts: those whose anchor has SIDE bytes in front of it are keyed by these, the others by those behind."""
    start = p.at + p.anchor - np.where(p.anchor >= SIDE, SIDE, 0)
    key = (p.anchor >= SIDE).astype(_U)
    for k in (0, 8, 16, 24, ANCHOR + SIDE - 8):
        key = _mix(key, p.words(start + k))
    return key ^ (key >> _U(32))


def contents(p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct content, number of each row's content).  Equal hashes are compared byte by byte."""
    if not len(p.at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = p.size - 8
    at = [np.minimum(k, last) for k in range(0, int(p.size.max()), 8)]  # these words cover the whole piece
    key = p.size.astype(_U)
    for k in at:
        key = _mix(key, p.words(p.at + k))
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    like = first[group]
    equal = p.size == p.size[like]
    for k in at:
        equal &= p.words(p.at + k) == p.words(p.at[like] + k)
    alone = np.flatnonzero(~equal)
    group[alone] = len(first) + np.arange(len(alone))
    return np.r_[first, alone], group


def resolve(p: Pieces, key: np.ndarray, most: int = 1 << 22) -> tuple[list[np.ndarray], np.ndarray]:
    """(spans of passages that stand in a smaller document's piece too, rows of each content's smallest document).

    ``p`` has parts of pieces of several keys, and all that it has of a key decide together.  Each content of a key
    that several documents have is laid in a suffix array once, a key never over two of them.  Suffixes that start a passage and have LENGTH
    bytes in common with the one before them are equal passages; the smallest document of the contents that
    have one is the passage's, and every row of a larger document loses it.  Spans are (doc, text, start, stop).
    """
    none = [np.zeros(0, np.int64)] * 4
    if not len(p.at):
        return none, np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    several = np.minimum.reduceat(p.doc[order], begins) < np.maximum.reduceat(p.doc[order], begins)
    several = np.repeat(several, np.diff(np.r_[begins, len(order)]))
    alone, rows = np.sort(order[~several]), np.sort(order[several])
    if len(alone):
        spans, on = resolve(p.take(rows), key[rows], most) if len(rows) else (none, rows)
        return spans, np.sort(np.r_[alone, rows[on]])
    first, group = contents(p)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, group, p.doc)
    order = np.argsort(key[first], kind="stable")
    sorted_key = key[first][order]
    starts = p.size[first] - LENGTH + 1
    base = np.cumsum(starts) - starts
    owner_doc = np.repeat(least, starts)  # smallest document of each content's passages
    before = np.cumsum(p.size[first][order]) - p.size[first][order]
    begins = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
    cuts = [0]
    for b in [*begins[1:].tolist(), len(order)]:  # whole keys, until an array is full
        if b == len(order) or before[b] - before[cuts[-1]] >= ARRAY:
            cuts.append(b)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        if len(rows) < 2:
            continue
        part = p.take(first[rows]).packed()
        s = part.data
        sa = suffix_array(s, LENGTH)
        owner = np.repeat(np.arange(len(rows)), part.size)
        offset = np.arange(len(s)) - part.at[owner]
        sa = sa[offset[sa] <= part.size[owner[sa]] - LENGTH]  # passages; other suffixes leave their piece
        same = common_prefixes(s, sa, LENGTH)[sa] >= LENGTH
        number = np.cumsum(np.r_[0, ~same[1:]])
        found = np.minimum.reduceat(least[rows][owner[sa]], np.flatnonzero(np.r_[True, ~same[1:]]))
        owner_doc[base[rows][owner[sa]] + offset[sa]] = found[number]
    lowest = np.minimum.reduceat(owner_doc, base)
    hit = np.flatnonzero(p.doc > lowest[group])
    spans = [none]
    ends = np.cumsum(starts[group[hit]])
    a = 0
    while a < len(hit):  # so many passages at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most)))
        rows, n = hit[a:b], starts[group[hit[a:b]]]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rows = np.repeat(rows, n)
        gone = owner_doc[base[group[rows]] + offset] < p.doc[rows]
        rows, start = rows[gone], p.lo[rows[gone]] + offset[gone]
        spans.append(_runs(p.doc[rows], p.text[rows], start, start + LENGTH))
        a = b
    return [np.concatenate(x) for x in zip(*spans, strict=True)], np.flatnonzero(p.doc == least[group])


def _runs(doc: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Spans, sorted, with those that touch within a text made one."""
    order = np.lexsort((start, text, doc))
    doc, text, start, stop = doc[order], text[order], start[order], stop[order]
    if not len(doc):
        return [doc, text, start, stop]
    fresh_text = np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]
    number = np.cumsum(fresh_text)
    reach = np.maximum.accumulate(stop + number * (1 << 40)) - number * (1 << 40)
    new = fresh_text.copy()
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return [doc[first], text[first], start[first], np.maximum.reduceat(stop, first)]


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, each array in the narrowest kind and by planes of bytes, compressed."""
    out = []
    for x in arrays:
        if x.dtype != np.uint8 and len(x):
            low, high = int(x.min()), int(x.max())
            x = x.astype(next(t for t in ("u1", "u2", "u4", "i8") if low >= 0 and high < 1 << 8 * int(t[1]) or t == "i8"))
        out.append((x.dtype.str, x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""))
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(out))


def _unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, data in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel())
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.int64), prepend=0)


def _rows(*columns: Sequence, kinds: Sequence[pa.DataType], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def blocks_of(rows: DataFrame, text: str) -> DataFrame:
    """(block, size, blob): the rows in blocks of about BLOCK bytes of text, or of one longer text, packed.

    Checkpointed, so that a block has the same rows for good, whatever is computed again later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                writer.write_table(pa.Table.from_batches(held).combine_chunks())
            settings = zstandard.ZstdCompressionParameters.from_level(3, window_log=23, enable_ldm=True)
            blob = zstandard.ZstdCompressor(compression_params=settings).compress(sink.getvalue())
            return _rows([block], [size], [blob], kinds=(pa.int64(), pa.int64(), pa.binary()), names=("block", "size", "blob"))

        for piece in slices(batches, text, BLOCK):
            n = pc.sum(pc.binary_length(piece.column(piece.schema.get_field_index(text)))).as_py() or 0
            if held and size + n > BLOCK:
                yield out()
                held, size, block = [], 0, block + 1
            held.append(piece)
            size += n
        if held:
            yield out()

    return materialise(rows.mapInArrow(run, "block long, size long, blob binary"))


def rows_of(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def _texts(blob: bytes, doc: str, text: str) -> tuple[np.ndarray, list[bytes]]:
    """Documents and texts of a block; a row without a document has no text here, as it neither gives nor loses."""
    t = rows_of(blob).select([doc, text])
    ids = t.column(0)
    texts = t.column(1).cast(pa.binary()).to_pylist()
    return ids.fill_null(0).to_numpy(), [x if known and x else b"" for x, known in zip(texts, ids.is_valid().to_pylist(), strict=True)]


def _shards(spark: SparkSession, size: int, each: int) -> tuple[int, int]:
    """(shards, partitions): a shard takes about ``each`` bytes; where there are many, a task gets 16 in turn."""
    shards = max(1, -(-size // each))
    return shards, max(min(shards, shuffle_width(spark)), shards // 16)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each shard, which come sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def shared_keys(blocks: DataFrame, doc: str, text: str, size: int) -> DataFrame:
    """(block, shard, n, blob): the keys of each block that stand in another text too, of one shard of the keys.

    A key counts as the low half of its hash within its shard, so one in some hundreds is held for shared
    that isn't.  Blocks send their sorted keys as differences, two or three bytes for each, and get back those that
    several blocks, or several texts of one, have.  A key with more than SPLIT pieces is marked.
    """
    shards, parts = _shards(blocks.sparkSession, size, COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, texts = _texts(blob.as_py(), doc, text)
                found = [(np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))]
                for held, owner, begin in stretches(texts):
                    p, key = keyed(anchored(held, docs[owner], owner, begin))
                    found.append((_code(key, shards), _mix(_mix(key, p.words(p.at)), p.words(p.at + p.size - 8)), p.text))
                code, sign, owner = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(code, kind="stable")  # texts of equal codes stay in order
                code, owner = code[order], owner[order]
                if not len(code):
                    continue
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                last = np.r_[first[1:], len(code)] - 1
                several = owner[first] != owner[last]
                one_each = np.unique(sign, return_index=True)[1]
                at = np.empty(len(order), np.int64)
                at[order] = np.repeat(np.arange(len(first)), last - first + 1)
                n = np.bincount(at[one_each], minlength=len(first))
                code = code[first]
                edges = np.searchsorted(code >> 32, np.arange(shards + 1))
                ids, blobs = [], []
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    a, b = edges[k], edges[k + 1]
                    ids.append(k)
                    blobs.append(_pack(_deltas(code[a:b] & 0xFFFFFFFF), np.packbits(several[a:b]), n[a:b]))
                yield _rows(ids, [block] * len(ids), blobs, kinds=(pa.int32(), pa.int64(), pa.binary()), names=("shard", "block", "blob"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            lows, several, sizes = [], [], []
            for _, _, blob in rows:
                low, more, n = _unpack(blob)
                lows.append(np.cumsum(low.astype(np.int64)).astype(np.uint32))
                several.append(np.unpackbits(more, count=len(low)).astype(bool))
                sizes.append(n.astype(np.int64))
            source = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in lows])
            low = np.concatenate(lows)
            lows.clear()
            order = np.argsort(low, kind="stable")
            low, source = low[order], source[order]
            first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            count = np.diff(np.r_[first, len(low)])
            shared = (count > 1) | np.logical_or.reduceat(np.concatenate(several)[order], first)
            hot = np.add.reduceat(np.concatenate(sizes)[order], first) > SPLIT
            keep = np.repeat(shared, count)
            low, source, hot = low[keep], source[keep], np.repeat(hot, count)[keep]
            order = np.argsort(source, kind="stable")
            low, hot = low[order], hot[order]
            edges = np.searchsorted(source[order], np.arange(len(rows) + 1))
            out = [(rows[i][1], rows[i][0], int(b - a), _pack(_deltas(low[a:b]), np.packbits(hot[a:b])))
                   for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            if out:
                yield _rows(*zip(*out, strict=True), kinds=(pa.int64(), pa.int32(), pa.int64(), pa.binary()), names=("block", "shard", "n", "blob"))

    dealt = blocks.select("block", "blob").mapInArrow(count, "shard int, block long, blob binary")
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard")
    return materialise(dealt.mapInArrow(match, "block long, shard int, n long, blob binary"))


def _code(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key and the low half of its hash, in one number."""
    return ((key >> _U(32)) % _U(shards)).astype(np.int64) << 32 | (key & _U(0xFFFFFFFF)).astype(np.int64)


def repeated_spans(blocks: DataFrame, doc: str, text: str) -> DataFrame:
    """(block, blob): packed byte spans (number of the text in its block, start, stop) of passages that a smaller document has.

    First the keys that stand in several texts are found.  Then each block takes the pieces of those keys out of
    its texts, settles them among themselves, which leaves each content's smallest document, and deals what is left
    by key (of a very common key: by passage), so that equal passages meet in a shard, where they are settled for
    good.  Both times suffix arrays decide.
    """
    spark = blocks.sparkSession
    size = blocks.agg(F.sum("size")).first()[0] or 0
    counted = _shards(spark, size, COUNTED)[0]
    replies = shared_keys(blocks, doc, text, size)
    shards, parts = _shards(spark, (replies.agg(F.sum("n")).first()[0] or 0) * _PIECE, SHARD)
    told = replies.groupBy("block").agg(F.collect_list(F.struct("shard", "blob")).alias("told"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                docs, texts = _texts(batch.column(1)[i].as_py(), doc, text)
                codes, marks = [], []
                for reply in batch.column(2)[i].as_py():
                    low, hot = _unpack(reply["blob"])
                    codes.append((np.int64(reply["shard"]) << 32) + np.cumsum(low.astype(np.int64)))
                    marks.append(np.unpackbits(hot, count=len(low)).astype(bool))
                order = np.argsort(np.concatenate(codes), kind="stable")
                known, hot = np.concatenate(codes)[order], np.concatenate(marks)[order]
                held, keys, commons = [], [], []
                for words, owner, begin in stretches(texts):
                    p, key = keyed(anchored(words, docs[owner], owner, begin))
                    code = _code(key, counted)
                    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    rows = np.flatnonzero(known[at] == code)
                    held.append(p.take(rows).packed())
                    keys.append(key[rows])
                    commons.append(hot[at[rows]])
                if not held:
                    continue
                p, key, common = Pieces.joined([*held, _nothing()]), np.concatenate(keys), np.concatenate(commons)
                spans, on = resolve(p, key)
                p, key, common = p.take(on), key[on], common[on]
                shard = (key % _U(shards)).astype(np.int64)
                single = passages_of(p.take(np.flatnonzero(common)))
                rest = np.flatnonzero(~common)
                p = Pieces.joined([p.take(rest), single])
                shard = np.r_[shard[rest], (_passage_keys(single) % _U(shards)).astype(np.int64)]
                spare = np.r_[p.anchor[: len(rest)], np.full(len(single.at), 255)]
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                pass_on = _pack(*_spans(spans)) if len(spans[0]) else None
                ids, blobs, done = [], [], []
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    rows = order[edges[k] : edges[k + 1]]
                    q = p.take(rows).packed()
                    ids.append(k)
                    blobs.append(_pack(q.data, q.size, spare[rows], _deltas(q.doc), _deltas(q.text), _deltas(q.lo)))
                    done.append(None)
                if pass_on:  # what is settled already goes along with some shard
                    ids.append(block % shards)
                    blobs.append(None)
                    done.append(pass_on)
                yield _rows(ids, [block] * len(ids), blobs, done, kinds=(pa.int32(), pa.int64(), pa.binary(), pa.binary()), names=("shard", "block", "blob", "done"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            parts, blocks_at, spare = [_nothing()], [], [np.zeros(0, np.int64)]
            out = [(block, done) for _, block, _, done in rows if done]
            for _, block, blob, _ in rows:
                if blob:
                    data, length, anchor, *rest = (x if x.dtype == np.uint8 and not i else x.astype(np.int64) for i, x in enumerate(_unpack(blob)))
                    d, t, lo = map(np.cumsum, rest)
                    parts.append(Pieces(data, np.cumsum(length) - length, length, np.where(anchor == 255, 0, anchor), d, t + len(blocks_at) * (1 << 32), lo))
                    spare.append(anchor)
                    blocks_at.append(block)
            p = Pieces.joined([*parts, _nothing()])
            parts.clear()
            single = np.concatenate(spare) == 255
            key = keys_of(p) if len(p.at) else np.zeros(0, _U)
            key[single] = _passage_keys(p.take(np.flatnonzero(single)))
            spans, _ = resolve(p, key)
            at = spans[1] >> 32
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(len(blocks_at) + 1))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b > a:
                    d, t, start, stop = (x[order[a:b]] for x in spans)
                    out.append((blocks_at[i], _pack(*_spans([d, t & 0xFFFFFFFF, start, stop]))))
            if out:
                yield _rows(*zip(*out, strict=True), kinds=(pa.int64(), pa.binary()), names=("block", "spans"))

    dealt = blocks.select("block", "blob").join(told, "block").mapInArrow(deal, "shard int, block long, blob binary, done binary")
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(decide, "block long, spans binary")


def _nothing() -> Pieces:
    """No pieces, and room behind those before it to read whole words."""
    none = np.zeros(0, np.int64)
    return Pieces(np.zeros(8, np.uint8), none, none, none, none, none, none)


def passages_of(p: Pieces) -> Pieces:
    """A piece for each passage."""
    n = p.size - LENGTH + 1
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    rows = np.repeat(np.arange(len(n)), n)
    return Pieces(p.data, p.at[rows] + offset, np.full(len(rows), LENGTH), p.anchor[rows], p.doc[rows], p.text[rows], p.lo[rows] + offset)


def _passage_keys(p: Pieces) -> np.ndarray:
    key = np.full(len(p.at), 3, _U)
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        key = _mix(key, p.words(p.at + k))
    return key ^ (key >> _U(32))


def _spans(spans: Sequence[np.ndarray]) -> list[np.ndarray]:
    """What is packed of spans: differences of text numbers and starts, and lengths."""
    _, text, start, stop = spans
    order = np.lexsort((start, text))
    return [_deltas(text[order]), _deltas(start[order]), stop[order] - start[order]]


def without_repeats(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), doc_id: str = "doc_id", as_text: bool = False
) -> tuple[DataFrame, str]:
    """Columns ``keep`` and a struct: n_bytes, spans (maximal removed runs of bytes), kept (bytes); its name.

    With ``as_text``, kept is a string, without the bytes of characters that were cut.

    Null texts count as empty.  Rows without a doc_id lose nothing and take nothing from others; repeated
    rows of one doc_id don't remove each other, and each loses the same.
    """
    keep = tuple(keep)
    name, doc, text = fresh(keep, "repeats"), fresh(keep, "doc"), fresh(keep, "text_whole")
    base = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col(f"`{doc_id}`").cast("long").alias(doc), F.col("text").cast("string").alias(text)
    )
    blocks = blocks_of(base, text)
    spans = repeated_spans(blocks, doc, text).groupBy("block").agg(F.collect_list("spans").alias("spans"))
    both = blocks.select("block", "blob").join(spans, "block", "left").select("blob", "spans")
    pair = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    kind = T.StructType(
        [T.StructField("n_bytes", T.LongType()), T.StructField("spans", pair), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]
    )
    schema = T.StructType([*base.schema.fields[: len(keep)], T.StructField(name, kind)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                rows = rows_of(batch.column(0)[i].as_py())
                found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3]
                for blob in batch.column(1)[i].as_py() or ():
                    at, start, length = (x.astype(np.int64) for x in _unpack(blob))
                    start = np.cumsum(start)
                    found.append([np.cumsum(at), start, start + length])
                at, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
                _, at, start, stop = _runs(at, at, start, stop)
                edges = np.searchsorted(at, np.arange(rows.num_rows + 1)).tolist()
                start, stop = start.tolist(), stop.tolist()
                done = 0
                for piece in slices(iter(rows.to_batches()), text):
                    made = []
                    for k, whole in enumerate(piece.column(len(keep) + 1).cast(pa.binary()).to_pylist(), done):
                        whole = whole or b""
                        removed = list(zip(start[edges[k] : edges[k + 1]], stop[edges[k] : edges[k + 1]], strict=True))
                        places = [0, *(e for pair in removed for e in pair), len(whole)]
                        kept = b"".join(whole[a:b] for a, b in zip(places[::2], places[1::2], strict=True))
                        made.append({"n_bytes": len(whole), "spans": [{"start": a, "stop": b} for a, b in removed], "kept": kept.decode(errors="ignore") if as_text else kept})
                    done += piece.num_rows
                    columns = [piece.column(j).cast(out.field(j).type) for j in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(made, out.field(len(keep)).type)], schema=out)

    return both.mapInArrow(finish, schema), name


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])


def repeat_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out, c = without_repeats(docs)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(c)["n_bytes"].alias("n_bytes"),
        removed_bytes(F.col(c)["spans"]).alias("n_removed"),
        F.size(F.col(c)["spans"]).cast("long").alias("n_spans"),
        F.sha2(F.col(c)["kept"], 256).alias("kept_sha256"),
    )
