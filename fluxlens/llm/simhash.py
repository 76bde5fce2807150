"""SimHash near-duplicates, linked through a segment-popcount grid."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, map_texts, materialise
from .vectors import joined_to_classes

#: Fingerprints link at so many differing bits; the grid below is laid out for this distance.
DISTANCE = 3
#: 0101... as a signed long: picks every other bit.
_ODD = 0x5555555555555555
#: Cells with more fingerprints than this are searched breadth-first instead of pair by pair.
_SMALL_CELL = 48


#: Fingerprints by which near copies are sought: one alone links few of the pairs at a similarity of 0.8.
MANY = 12


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of every ``words``-word shingle, repeats included.

    Words are what stands between ASCII white space, A-Z lower-cased.  A text of fewer words is one
    shingle; without words (or null) the fingerprint is zero.  A bit is set if it is set in over
    half of the hashes.
    """
    return fingerprints_of(text, words, 1)[0]


def fingerprints_of(text: bytes | None, words: int, many: int) -> list[int]:
    """``many`` fingerprints: the first as described above, each other one from the same hashes, mixed with its number."""
    parts = text.lower().split() if text else []
    if not parts:
        return [0] * many
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    w = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((many, 64), np.int64)
    total = len(parts) - w + 1
    for at in range(0, total, 1 << 15):
        a, b = starts[at : min(at + (1 << 15), total)].tolist(), stops[at + w - 1 : at + w - 1 + (1 << 15)].tolist()
        hashes = np.array([digest(joined[x:y], 42) for x, y in zip(a, b, strict=True)], np.uint64)
        for k in range(many):
            mixed = hashes
            if k:
                mixed = (hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
                mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
                mixed ^= mixed >> np.uint64(33)
            bits = np.unpackbits(mixed.astype(">u8").view(np.uint8)).reshape(-1, 64)
            for i in range(0, len(bits), 255):  # a byte holds the count of so many
                ones[k] += bits[i : i + 255].sum(0, dtype=np.uint8)
    return [int.from_bytes(np.packbits(x * 2 > total).tobytes(), "big", signed=True) for x in ones]


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """Columns ``keep`` and ``fp`` (the fingerprint as a signed long)."""
    return map_texts(
        docs, lambda texts: [[fingerprint(t, words) for t in texts]], [("fp", T.LongType())], keep
    )


def _grid(fp: Column) -> Column:
    """Cells in which a fingerprint must be looked at.

    Its 32 two-bit segments are mapped to their bit counts (0, 1 or 2).  The Manhattan distance of two
    such vectors is at most the number of differing bits, so with at most 3 of those, one half of the
    vector (16 counts) is at Manhattan distance 0 or 1: equal, or one count differs by one.  Each half
    is a grid of unit cells.  A fingerprint stands in its own cell and visits the cells with one count
    raised by one; the lower of two neighbours thus meets the higher one in that one's own cell.
    """
    even, odd = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    low = F.lit(0xFFFFFFFF)
    halves = (
        even.bitwiseAND(low) + odd.bitwiseAND(low),
        F.shiftrightunsigned(even, 32) + F.shiftrightunsigned(odd, 32),
    )
    cells = []
    for half, part in enumerate(halves):
        base = part + F.lit(half << 32)
        cells.append(base)
        for i in range(16):
            at = F.shiftright(part, 2 * i).bitwiseAND(F.lit(3))
            cells.append(F.when(at < 2, base + F.lit(1 << (2 * i))))
    return F.array(*cells)


def _at_home(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether each fingerprint stands in its cell, or visits it (see :func:`_grid`)."""
    even, odd, low = fp & np.uint64(_ODD), (fp >> np.uint64(1)) & np.uint64(_ODD), np.uint64(0xFFFFFFFF)
    counts = even + odd
    return np.where(key >> 32 & 1, counts >> np.uint64(32), counts & low) == key.view(np.uint64) & low


def _pairs(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the fingerprints of each cell; ``key`` is sorted.  Every candidate is verified.

    Two visitors of a cell needn't meet there: if they link, one stands in another cell that the other shares.
    """
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[edges, len(key)])
    home = _at_home(key, fp)
    lived_in = np.logical_or.reduceat(home, edges)
    left = np.repeat(edges + sizes, sizes) - np.arange(len(key)) - 1  # rows of the cell behind this one
    at = np.flatnonzero((left > 0) & np.repeat((sizes <= _SMALL_CELL) & lived_in, sizes))
    step = 1
    while len(at):
        bits = np.bitwise_count(fp[at] ^ fp[at + step])
        hit = at[(bits > 0) & (bits <= DISTANCE) & (home[at] | home[at + step])]
        if len(hit):
            yield fp[hit], fp[hit + step]
        step += 1
        at = at[left[at] >= step]
    crowded = (sizes > _SMALL_CELL) & lived_in
    for start, size in zip(edges[crowded], sizes[crowded], strict=True):
        rest = np.unique(fp[start : start + size])
        while len(rest):  # a spanning forest of the cell: each point leaves ``rest`` when it is reached
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = np.bitwise_count(rest ^ x) <= DISTANCE
                if near.any():
                    reached = rest[near]
                    rest = rest[~near]
                    front.extend(reached)
                    yield np.full(len(reached), x, np.uint64), reached


def links(points: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints ``fp`` at ``DISTANCE`` bits or fewer.

    Their connected components are those of all such pairs; within a crowded cell only a spanning
    forest is returned, never all pairs.  ``points`` must hold each fingerprint once.
    """
    return links_by_kind(points.select(F.lit(0).alias("kind"), "fp", F.col("fp").alias("name")))


def links_by_kind(points: DataFrame) -> DataFrame:
    """Pairs (a, b) of names: :func:`links` among the fingerprints of each kind, a small number; ``points`` are (kind, fp, name)."""
    cells = points.select("fp", F.explode(_grid(F.col("fp"))).alias("cell"), "kind", "name").where("cell is not null")
    cells = cells.select("fp", (F.col("cell") + F.shiftleft(F.col("kind").cast("long"), 34)).alias("cell"), "name")
    dealt = cells.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []

        def found(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            key, fp, name = (np.concatenate(x) for x in zip(*parts, strict=True))
            kinds = key >> 34
            edges = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True])
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                pairs = list(_pairs(key[i:j], fp[i:j]))
                if not pairs:
                    continue
                known, first = np.unique(fp[i:j], return_index=True)
                ends = [name[i:j][first[np.searchsorted(known, np.concatenate(x))]] for x in zip(*pairs, strict=True)]
                both = np.unique(np.stack([np.minimum(*ends), np.maximum(*ends)], axis=1), axis=0)  # cells overlap
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, key, name = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last cell may go on
            if cut and held + cut >= 1 << 16:
                yield from found([*waiting, (key[:cut], fp[:cut], name[:cut])])
                waiting, held, fp, key, name = [], 0, fp[cut:], key[cut:], name[cut:]
            waiting.append((key, fp, name))
            held += len(key)
        if waiting:
            yield from found(waiting)

    return dealt.mapInArrow(run, "a long, b long")


def shingle_hashes(text: bytes | None, words: int) -> list[int]:
    """The distinct ``words``-word shingles of a text, as XXH64 in signed longs; words and short texts as in :func:`fingerprint`."""
    parts = text.lower().split() if text else []
    w = min(words, len(parts))
    shingles = {b" ".join(parts[i : i + w]) for i in range(len(parts) - w + 1)} if parts else set()
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles], np.uint64).view(np.int64).tolist()


def alike(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (key, hashes) have a Jaccard similarity of ``similar`` or more; two empty sets have 1."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("key").alias(end), F.col("hashes").alias(f"of_{end}")), end)
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.where(common >= similar * (F.size("of_a") + F.size("of_b") - common) - 1e-9).select("a", "b")


def near_copies(docs: DataFrame, key: str | Sequence[str], words: int = 2, many: int = MANY, of: int = 5, similar: float = 0.8) -> DataFrame:
    """(key ..., root) of the texts that have a near copy among ``docs``: what all texts which links lead to share.

    ``key`` is a column of longs that tells texts apart, and root the smallest one; or several columns do together, and
    root is a number.  Two texts are linked if any of their ``many`` fingerprints
    of ``words``-word shingles are within DISTANCE bits and their sets of ``of``-word shingles are similar to ``similar``
    (Jaccard).  Short shingles in the fingerprints bring pairs at that threshold within few bits, the sets decide.
    Equal fingerprints are one point of the grid, and each text with one is compared with the first of them, so
    copies are never expanded into pairs.  Null, empty and blank texts are linked to each other.
    """
    kind = T.ArrayType(T.LongType())
    key, number = ((key,), F.col(f"`{key}`")) if isinstance(key, str) else (tuple(key), F.monotonically_increasing_id())
    names = [F.col(f"`{c}`") for c in key]
    marked = map_texts(docs, lambda rows: [[fingerprints_of(t, words, many) for t in rows]], [("fps", kind)], key)
    marked = marked.groupBy(*names).agg(F.first("fps").alias("fps"))
    # from here on a text is a number of its own, which its row keeps once it is written
    numbered = materialise(marked.withColumn("key_number", number))
    each = numbered.select(F.col("key_number").alias("key"), F.posexplode("fps").alias("kind", "fp"))
    points = materialise(each.groupBy("kind", "fp").agg(F.min("key").alias("least"), F.count("*").alias("texts")))
    shared = points.where("texts > 1").drop("texts")
    equal = each.join(shared, ["kind", "fp"]).where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    close = links_by_kind(points.select("kind", "fp", F.col("least").alias("name")))
    pairs = materialise(equal.unionByName(close).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key_number")).distinct()
    wanted = numbered.join(ends, "key_number").select("key_number", *names)
    texts = docs.groupBy(*names).agg(F.first("text").alias("text")).join(wanted, list(key))
    sets = map_texts(texts, lambda rows: [[shingle_hashes(t, of) for t in rows]], [("hashes", kind)], ("key_number",))
    sets = materialise(sets.select(F.col("key_number").alias("key"), "hashes"))
    linked = components(alike(pairs, sets, similar)).withColumnRenamed("node", "key_number")
    return numbered.join(linked, "key_number").select(*names, "root")


def near_duplicates(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``fp`` and ``component_id`` of each row of ``docs``.

    component_id is the smallest doc_id reachable over links, the row's own included.  Equal
    fingerprints are one point from the start, so copies are never expanded into pairs.  Null and
    empty texts have fingerprint zero and link like any other; rows without doc_id belong to their
    component but don't name it (null if no member has an id); repeated rows each get a result.
    """
    marked = materialise(fingerprints(docs, keep, words))
    points = materialise(marked.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least_id"), F.count("*").alias("fp_rows")))
    linked = materialise(components(links(points.select("fp"))).select(F.col("node").alias("fp"), "root"))
    of_root = linked.join(points, "fp").groupBy("root").agg(F.min("least_id").alias("root_id"))
    renamed = linked.join(of_root, "root").select("fp", "root_id")
    named = points.join(renamed, "fp", "left").select("fp", F.coalesce("root_id", "least_id").alias("component_id"), "fp_rows")
    return joined_to_classes(marked, materialise(named), "fp", "fp_rows").select(*keep, "fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    out = near_duplicates(docs)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
