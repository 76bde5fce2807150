"""Near copies of vectors by cosine, through an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialise
from .vectors import joined_to_classes, matrix_of, product, usable

#: Least cosine of a link, and the share of pairs at exactly that cosine which the cells visited have to hold.
COSINE, RECALL = 0.9, 0.99
#: Distinct vectors of a cell on average, at which the codebooks aim; least and most entries of a codebook.
#: With the most, 2**20 cells, cells grow with the table and are dealt in parts.
CELL, LEAST_ENTRIES, MOST_ENTRIES = 64, 4, 1024
#: The codebooks are fitted on so many vectors for each entry; every vector is indexed.
SAMPLE = 32
#: Distinct vectors of a tile on average: some neighbouring cells, to which a visitor of several of them is sent once.
TILE = 1024
#: Residents and visitors of a tile that one task compares.
RESIDENTS, VISITORS = 8192, 32_768
_PIECE = 1024


def has_direction(vector: Column) -> Column:
    """Usable and not all zero."""
    return usable(vector) & F.exists(vector, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that squares neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(1, initial=0, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points * points).sum(1)[:, None] + (entries * entries).sum(1) - 2 * product(points, entries))


def codebook(points: np.ndarray, entries: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Entries of k-means from random starts; one that no point is nearest to starts again at the point farthest from its own."""
    out = points[rng.choice(len(points), min(entries, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near, far = np.empty(len(points), np.int64), np.empty(len(points))
        for i in range(0, len(points), _PIECE):
            gap = _squares(points[i : i + _PIECE], out)
            near[i : i + _PIECE], far[i : i + _PIECE] = gap.argmin(1), gap.min(1)
        count = np.bincount(near, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, near, points)
        out[count > 0] = sums[count > 0] / count[count > 0, None]
        lost = np.flatnonzero(count == 0)
        out[lost] = points[np.argsort(-far)[: len(lost)]]
    return out


@dataclass
class MultiIndex:
    """Codebooks of the halves of unit vectors; their product is a grid of cells.

    A vector lives in the cell of its nearest entries and visits the cells in the order of their summed squared
    distances, as far as ``reach`` beyond that of its own cell.  Cells without residents are skipped.  Entries of the
    second codebook stand along its main axis; cells of one first entry and ``across`` neighbouring second ones are a tile.
    """

    width: int
    first: np.ndarray
    second: np.ndarray
    reach: float = 0.0
    across: int = 1
    lives: np.ndarray | None = None  # whether any vector lives in a cell
    parts: np.ndarray | None = None  # of each tile: how many its residents are dealt to
    chunks: np.ndarray | None = None  # and its visitors

    def tile(self, cell: np.ndarray) -> np.ndarray:
        return cell // len(self.second) * -(-len(self.second) // self.across) + cell % len(self.second) // self.across

    def gaps(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squares(rows[:, :half], self.first), _squares(rows[:, half:], self.second)

    def home(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.gaps(rows)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def excess(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How far beyond its own cell each of ``rows`` has to go for the cell in which its partner lives."""
        (a, b), (c, d) = self.gaps(rows), self.gaps(others)
        at = np.arange(len(rows))
        return a[at, c.argmin(1)] + b[at, d.argmin(1)] - a.min(1) - b.min(1)

    def visits(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells to visit, own ones too.

        Both halves' distances are sorted; along the first, the frontier in the second falls back step by step,
        until not even its nearest entry is within reach.
        """
        a, b = self.gaps(rows)
        by_a, by_b = a.argsort(1), b.argsort(1)
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        limit = a[:, 0] + b[:, 0] + self.reach
        found = []
        for step in range(a.shape[1]):
            left = limit - a[:, step]
            inside = b <= left[:, None]
            if not inside[:, 0].any():
                break
            row, at = np.nonzero(inside)
            found.append((row, by_a[row, step] * len(self.second) + by_b[row, at]))
        row, cell = (np.concatenate(x) for x in zip(*found, strict=True))
        return row, cell


def partners(rows: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector another one in a random direction at just that cosine."""
    away = rng.normal(size=rows.shape)
    away -= (away * rows).sum(1)[:, None] * rows
    size = np.sqrt((away * away).sum(1, keepdims=True))
    away = np.divide(away, size, out=np.zeros_like(away), where=size > 0)
    return cosine * rows + np.sqrt(1 - cosine * cosine) * away


def fit(sample: np.ndarray, entries: int, cosine: float = COSINE, recall: float = RECALL) -> MultiIndex:
    """Codebooks from a sample of unit vectors, and the reach for the target recall.

    Pairs at the threshold are the hardest ones: the reach is such that the wanted share of sampled vectors with
    a partner made at exactly that cosine is found from one side or the other, and likewise the share of the
    links that the sample itself holds.
    """
    rng = np.random.default_rng(11)
    half = (sample.shape[1] + 1) // 2
    first, second = codebook(sample[:, :half], entries, rng), codebook(sample[:, half:], entries, rng)
    if second.shape[1]:
        second = second[np.argsort(second @ np.linalg.svd(second - second.mean(0))[2][0], kind="stable")]
    index = MultiIndex(sample.shape[1], first, second)
    some = sample[:4096]
    made = partners(some, cosine, rng)
    both = np.minimum(index.excess(some, made), index.excess(made, some))
    index.reach = float(np.quantile(both, recall))
    near = np.argwhere(np.triu(product(some, some) >= cosine, 1))
    if len(near):
        a, b = some[near[:, 0]], some[near[:, 1]]
        seen = np.concatenate([np.minimum(index.excess(a[i : i + 65536], b[i : i + 65536]), index.excess(b[i : i + 65536], a[i : i + 65536])) for i in range(0, len(a), 65536)])
        index.reach = max(index.reach, float(np.quantile(seen, recall)))
    return index


def classes_of(vectors: DataFrame) -> DataFrame:
    """(v, copies, uid, node): each distinct vector, the number of its rows, its smallest vec_id and a number of its own."""
    grouped = vectors.groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("uid"))
    return materialise(grouped.withColumn("node", F.monotonically_increasing_id()))


def built(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> MultiIndex | None:
    """The index of all distinct vectors: fitted on a sample, cells counted over all."""
    count, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return None
    entries = LEAST_ENTRIES
    while entries < MOST_ENTRIES and entries * entries * CELL < count:
        entries *= 2
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(max(4096, SAMPLE * entries)).select("v").toArrow()
    index = fit(unit(matrix_of(sample.column(0).combine_chunks(), width)), entries, cosine, recall)
    cells = len(index.first) * len(index.second)
    while index.across * 2 <= len(index.second) and index.across * 2 * count <= TILE * cells:
        index.across *= 2
    tiles = int(index.tile(np.array([cells - 1]))[0]) + 1
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, come = np.zeros(cells, np.int64), np.zeros(tiles, np.int64)
        at = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, _PIECE):
                rows = unit(matrix_of(batch.column(0).slice(i, _PIECE), width))
                live += np.bincount(at.home(rows), minlength=cells)
                row, cell = at.visits(rows)
                come += np.bincount(np.unique(row * tiles + at.tile(cell)) % tiles, minlength=tiles)
        for what, n in enumerate((live, come)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), what)), pa.array(used), pa.array(n[used])], names=["what", "place", "n"])

    sums = classes.select("v").mapInArrow(counted, "what long, place long, n long").groupBy("what", "place").agg(F.sum("n")).toArrow()
    what, place, n = (c.to_numpy() for c in sums.columns)  # at most twice MOST_ENTRIES squared
    live, come = np.zeros(cells, np.int64), np.zeros(tiles, np.int64)
    live[place[what == 0]], come[place[what == 1]] = n[what == 0], n[what == 1]
    index.lives = live > 0
    inside = np.bincount(index.tile(np.arange(cells)), weights=live, minlength=tiles).astype(np.int64)
    index.parts, index.chunks = (np.maximum(1, -(-x // y)).astype(np.int64) for x, y in ((inside, RESIDENTS), (come, VISITORS)))
    return index


def dealt(classes: DataFrame, index: MultiIndex) -> DataFrame:
    """Rows of each task (tile, part, chunk): residents of the part and visitors of the chunk.

    A tile of many residents has parts, one of many visitors has chunks, and each part meets each chunk.  ``cells`` of a
    resident are all that it visits, of a visitor those that it visits in the tile.  Residents visit the other
    parts of their own tile.
    """
    shared = classes.sparkSession.sparkContext.broadcast(index)
    kind = dict(classes.dtypes)["v"]
    schema = f"tile int, part int, chunk int, resident boolean, home int, own int, node long, uid long, copies long, cells array<int>, v {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, _PIECE):
                piece = batch.slice(i, _PIECE)
                rows = unit(matrix_of(piece.column(0), at.width))
                node = piece.column(3).to_numpy()
                spread = node ^ (node >> 33)  # a node's number has its partition above bit 33
                home = at.home(rows)
                own = spread % at.parts[at.tile(home)]
                row, cell = at.visits(rows)
                row, cell = row[at.lives[cell]], cell[at.lives[cell]]
                tile = at.tile(cell)
                order = np.lexsort((tile, row))
                row, cell, tile = row[order], cell[order], tile[order]
                # all that a resident visits, and the parts of that by tile
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(rows)))]
                begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (tile[1:] != tile[:-1])])
                cells = pa.array(cell.astype(np.int32))
                of_resident = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), cells)
                of_visitor = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(row)].astype(np.int32)), cells)
                visitor, there = row[begins], tile[begins]
                # residents go to every chunk of their tile, visitors to every part of a tile
                times = at.chunks[at.tile(home)]
                r = np.repeat(np.arange(len(rows)), times)
                chunk = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                many = at.parts[there]
                w = np.repeat(np.arange(len(begins)), many)
                part = np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many)
                at_home = (there[w] == at.tile(home[visitor[w]])) & (part == own[visitor[w]])
                w, part = w[~at_home], part[~at_home]
                take = np.r_[r, visitor[w]]
                columns = [
                    np.r_[at.tile(home[r]), there[w]].astype(np.int32),
                    np.r_[own[r], part].astype(np.int32),
                    np.r_[chunk, (spread[visitor[w]] // 7) % at.chunks[there[w]]].astype(np.int32),
                    np.r_[np.ones(len(r), bool), np.zeros(len(w), bool)],
                    home[take].astype(np.int32),
                    own[take].astype(np.int32),
                ]
                chosen = pa.array(take)
                rest = [piece.column(k).take(chosen) for k in (3, 2, 1)]
                visited = pa.concat_arrays([of_resident.take(pa.array(r)), of_visitor.take(pa.array(w))])
                names = ["tile", "part", "chunk", "resident", "home", "own", "node", "uid", "copies", "cells", "v"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *rest, visited, piece.column(0).take(chosen)], names=names)

    return classes.select("v", "copies", "uid", "node").mapInArrow(run, schema)


class _Forest:
    """Groups of a task's vectors, and the edges that join them."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def join(self, one: int, others: np.ndarray) -> None:
        here = self.label[one]
        for other in np.unique(self.label[others]):
            if other != here:
                self.edges.append((one, int(other)))  # a label is a member of its group
                self.label[self.label == other] = here


def links_in(table: pa.Table, width: int, cosine: float = COSINE) -> pa.Table:
    """What a task finds: for each vector with links the copies it is linked with, and a spanning forest of the links.

    Each cell's residents meet its visitors, and the task's own residents that visit it, once for all chunks.  A pair
    whose cells are both visited is counted in the cell of the lower number; a pair of one cell by the
    order of its places, or in the part of the higher number.  No pairs leave the task.
    """
    part, chunk = table.column("part")[0].as_py(), table.column("chunk")[0].as_py()
    resident = table.column("resident").to_numpy()
    table = table.take(pa.array(np.r_[np.flatnonzero(resident), np.flatnonzero(~resident)])).combine_chunks()
    n = int(resident.sum())
    rows = unit(matrix_of(table.column("v").combine_chunks(), width))
    copies, home, own = (table.column(c).to_numpy() for c in ("copies", "home", "own"))
    copies = copies.astype(np.float64)
    found, forest = np.zeros(len(table)), _Forest(len(table))
    lists = table.column("cells").combine_chunks()
    where = lists.flatten().to_numpy().astype(np.int64)
    who = np.repeat(np.arange(len(table)), lists.value_lengths().to_numpy(zero_copy_only=False))
    visits = np.sort(where[who < n] * n + who[who < n])  # cell, resident
    if chunk:  # residents meet each other in the first chunk
        where, who = where[who >= n], who[who >= n]
    order = np.argsort(where, kind="stable")
    where, who = where[order], who[order]
    by_home = np.argsort(home[:n], kind="stable")
    sorted_home = home[:n][by_home]
    for cell in np.unique(sorted_home):
        here = by_home[slice(*np.searchsorted(sorted_home, [cell, cell + 1]))]
        guests = who[slice(*np.searchsorted(where, [cell, cell + 1]))]
        for i in range(0, len(guests), 256):
            some = guests[i : i + 256]
            hit = product(rows[some], rows[here]) >= cosine
            g, r = np.nonzero(hit)
            if not len(g):
                continue
            a, b = some[g], here[r]
            same = home[a] == cell
            later = np.where(a < n, a < b, own[a] < part)
            key = home[a].astype(np.int64) * n + b
            at = np.minimum(np.searchsorted(visits, key), len(visits) - 1)
            elsewhere = (home[a] < cell) & (visits[at] == key)
            hit[g, r] = np.where(same, later, ~elsewhere)
            found[some] += hit @ copies[here]
            found[here] += copies[some] @ hit
            for j in np.flatnonzero(hit.any(1)):
                forest.join(int(some[j]), here[hit[j]])
    node, uid = table.column("node").to_numpy(), table.column("uid").to_numpy()
    linked = np.flatnonzero(found)
    a, b = (uid[[e[k] for e in forest.edges]] if forest.edges else np.zeros(0, np.int64) for k in (0, 1))
    none_linked, none_edges = pa.nulls(len(linked), pa.int64()), pa.nulls(len(a), pa.int64())
    columns = [(pa.array(node[linked]), none_edges), (pa.array(found[linked].astype(np.int64)), none_edges), (none_linked, pa.array(a)), (none_linked, pa.array(b))]
    return pa.table({c: pa.concat_arrays(both) for c, both in zip(("node", "links", "a", "b"), columns, strict=True)})


def near_copies_of(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(v, copies, n_links, root) of each distinct vector of ``vectors(vec_id long, v)``."""
    classes = classes_of(vectors)
    index = built(classes, cosine, recall)
    if index is None:
        return classes.select("v", "copies", F.lit(0).cast("long").alias("n_links"), F.col("uid").alias("root"))
    width = index.width

    def task(table: pa.Table) -> pa.Table:
        return links_in(table, width, cosine)

    links = materialise(dealt(classes, index).groupBy("tile", "part", "chunk").applyInArrow(task, "node long, links long, a long, b long"))
    sums = links.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.where("a is not null").select("a", "b")).withColumnRenamed("node", "uid")
    joined = classes.join(sums, "node", "left").join(roots, "uid", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    return materialise(joined.select("v", "copies", n_links.alias("n_links"), F.coalesce("root", "uid").alias("root")))


def embedding_groups(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``embeddings``.

    Linked are rows with a cosine of COSINE or more.  Equal vectors are indexed once and count as often as they stand
    in the table; rows that repeat an id are links of each other if their vectors are.  Null, zero and unusable
    vectors, and rows without an id, have no links and are their own component (kept, unless the id is null).
    Vectors of different widths are compared as if the shorter one had zeros behind.  An empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    fit_ = F.col("vec_id").isNotNull() & has_direction(F.col("v"))
    groups = near_copies_of(rows.where(fit_))
    linked = joined_to_classes(rows.where(fit_), groups, "v", "copies").select("vec_id", "n_links", F.col("root").alias("component_id"))
    alone = rows.where(~fit_).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
    vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
l AS (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.ok AND b.ok AND a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (SELECT DISTINCT vec_id AS a, vec_id AS b FROM e UNION SELECT reached.a, l.b FROM reached JOIN l ON l.a = reached.b),
c AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
n AS (SELECT r, count(*) AS n FROM l GROUP BY r)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM e LEFT JOIN n USING (r) LEFT JOIN c ON c.a = e.vec_id
"""
