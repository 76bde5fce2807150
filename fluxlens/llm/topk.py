"""Exact top-k inner products through a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Components become floor(SCALE * x).
SCALE = 1024
#: Distinct vectors from which pivots are chosen, and most pivots.  Every vector is indexed.
SAMPLE, PIVOTS = 4096, 256
#: Annuli round each pivot; vectors that one task scores together; queries that it holds together.
RINGS, BLOCK, QUERIES = 8, 4096, 20_000


def whole_components(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null if the vector is, or has a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def matrix(rows, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros."""
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def products(q: np.ndarray, v: np.ndarray, q_rows, v_rows) -> np.ndarray:
    """Exact integer inner products (held to the range of a long)."""
    most = (np.abs(q).max(initial=0) + 1) * (np.abs(v).max(initial=0) + 1) * max(1, q.shape[-1])
    if most < 2**53:
        return (v @ q).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(q_rows, x, strict=False)) for x in v_rows]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


@dataclass
class Index:
    """Pivots and the directory of annuli: (pivot, ring) with its number of vectors and range of distances.

    Vectors get one more component, sqrt(top - |v|^2) with ``top`` the largest square norm; queries get
    zero there.  Then |q - v|^2 = |q|^2 + top - 2 q.v, and the highest product is the nearest vector.
    """

    width: int
    top: float
    pivots: np.ndarray
    low: np.ndarray | None = None
    step: np.ndarray | None = None
    cells: np.ndarray | None = None  # pivot * RINGS + ring
    counts: np.ndarray | None = None
    nearest: np.ndarray | None = None
    farthest: np.ndarray | None = None

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.c_[v, np.sqrt(np.maximum(0, self.top - (v * v).sum(1)))]

    def distances(self, points: np.ndarray) -> np.ndarray:
        square = (points * points).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def ceilings(self, q: np.ndarray) -> np.ndarray:
        """Per query and cell: no vector of the cell has a higher product (triangle inequality)."""
        d = self.distances(np.c_[q, np.zeros(len(q))])[:, self.cells // RINGS]
        least = np.maximum(0, np.maximum(self.nearest - d, d - self.farthest))
        size = (q * q).sum(1)[:, None] + self.top
        slack = 1e-9 * size + 1e-3  # more than what rounding can do
        return (size - least * least) / 2 + slack

    def first(self, ceilings: np.ndarray, wanted: int) -> np.ndarray:
        """Cells in which each query starts: the best ones, until they hold ``wanted`` vectors."""
        order = np.argsort(-ceilings, axis=1, kind="stable")
        held = np.cumsum(self.counts[order], axis=1)
        start = np.zeros(ceilings.shape, bool)
        np.put_along_axis(start, order, held - self.counts[order] < wanted, axis=1)
        return start


def choose_pivots(points: np.ndarray, most: int) -> np.ndarray:
    """Centres of a few rounds of k-means from farthest-first starts."""
    rng = np.random.default_rng(7)
    centres = [points[0]]
    gap = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < most and gap.max() > 0:
        centres.append(points[rng.choice(len(points), p=gap / gap.sum())])
        gap = np.minimum(gap, ((points - centres[-1]) ** 2).sum(1))
    out = np.array(centres)
    for _ in range(5):
        near = ((points * points).sum(1)[:, None] - 2 * points @ out.T + (out * out).sum(1)).argmin(1)
        for k in range(len(out)):
            if (near == k).any():
                out[k] = points[near == k].mean(0)
    return out


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(uid, v, ids): each distinct vector once, with its k + 1 smallest ids; uid is the smallest.

    No query needs more ids of equal vectors: one of them may be its own.  Ranks are cut before the
    shuffle too, so a vector that a third of all rows share moves k + 1 rows from each task.
    """
    ranked = vectors.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id")))
    ids = F.array_sort(F.collect_set("vec_id"))
    return ranked.where(F.col("r") <= k + 1).groupBy("v").agg(ids.alias("ids")).select(F.get("ids", F.lit(0)).alias("uid"), "v", "ids")


def build(groups: DataFrame) -> tuple[Index, DataFrame] | None:
    """The index over all distinct vectors, and these with their cell, part and distance to the pivot."""
    facts = groups.agg(
        F.max(F.size("v")).alias("width"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("top"),
        F.count("*").alias("n"),
    ).first()
    if not facts["n"]:
        return None
    index = Index(facts["width"], facts["top"], np.zeros((1, facts["width"] + 1)))
    sample = groups.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").collect()
    points = index.lifted(matrix([r["v"] for r in sample], index.width))
    index.pivots = choose_pivots(points, min(PIVOTS, max(1, facts["n"] // (BLOCK // 2))))
    shared = groups.sparkSession.sparkContext.broadcast(index)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for x in frames:
            d = at.distances(at.lifted(matrix(x["v"].tolist(), at.width)))
            near = d.argmin(1)
            yield x.assign(pivot=near.astype("int32"), distance=d[np.arange(len(d)), near])

    keyed = materialise(groups.mapInPandas(assign, "uid long, v array<bigint>, ids array<bigint>, pivot int, distance double"))
    spread = {r["pivot"]: (r["a"], r["b"]) for r in keyed.groupBy("pivot").agg(F.min("distance").alias("a"), F.max("distance").alias("b")).collect()}
    n = len(index.pivots)
    index.low = np.array([spread.get(i, (0, 0))[0] for i in range(n)])
    index.step = np.array([max((spread.get(i, (0, 0))[1] - spread.get(i, (0, 0))[0]) / RINGS, 1e-9) for i in range(n)])
    low, step = (F.array(*[F.lit(float(x)) for x in y]) for y in (index.low, index.step))
    ring = F.least(F.lit(RINGS - 1), F.floor((F.col("distance") - F.get(low, F.col("pivot"))) / F.get(step, F.col("pivot"))))
    keyed = keyed.withColumn("cell", (F.col("pivot") * RINGS + ring).cast("int"))
    # at most PIVOTS * RINGS rows
    directory = sorted(map(tuple, keyed.groupBy("cell").agg(F.count("*"), F.min("distance"), F.max("distance")).collect()))
    index.cells, index.counts, index.nearest, index.farthest = (np.array(c) for c in zip(*directory, strict=True))
    parts = F.array(*[F.lit(-(-int(dict((c, m) for c, m, *_ in directory).get(c, 1)) // BLOCK)) for c in range(n * RINGS)])
    return index, keyed.withColumn("part", F.pmod(F.xxhash64("uid"), F.get(parts, F.col("cell"))).cast("int"))


def search(groups: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(uid, ids, score) candidates of each distinct query vector ``(quid, v)``: all that can be among the best k + 1.

    Round one expands the annuli of highest ceiling until they hold enough vectors, which gives each
    query a score that k + 1 vectors reach.  Round two opens only the annuli whose ceiling reaches it.
    """
    built = build(groups)
    if built is None:
        return groups.sparkSession.createDataFrame([], "quid long, uid long, ids array<bigint>, score long")
    index, keyed = built
    spark = groups.sparkSession
    shared = spark.sparkContext.broadcast(index)
    chunks = -(-max(1, queries.count()) // QUERIES)
    part_count = {int(c): -(-int(m) // BLOCK) for c, m in zip(index.cells, index.counts, strict=True)}

    def ask(floor_known: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = shared.value
            for x in frames:
                for a in range(0, len(x), 512):
                    part = x.iloc[a : a + 512]
                    if not len(part):
                        continue
                    ceilings = at.ceilings(matrix(part["v"].tolist(), at.width))
                    opened = at.first(ceilings, 4 * (k + 1))
                    if floor_known:
                        opened = ~opened & (ceilings >= part["floor"].fillna(-np.inf).to_numpy()[:, None])
                    q, c = np.nonzero(opened)
                    if not len(q):
                        continue
                    rows = part.iloc[q].assign(cell=at.cells[c].astype("int32"))
                    rows["part"] = [list(range(part_count[x])) for x in rows["cell"].tolist()]
                    rows["chunk"] = (rows["quid"] % chunks).astype("int32")
                    yield rows[["quid", "v", "floor", "cell", "part", "chunk"]]

        return run

    def score(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"quid": [], "uid": [], "ids": [], "score": []}).astype({"quid": "int64", "uid": "int64", "ids": object, "score": "int64"})
        if not len(vs) or not len(qs):
            return none
        at = shared.value
        vs = vs.sort_values(["distance", "uid"], ignore_index=True)
        v, q = matrix(vs["v"].tolist(), at.width), matrix(qs["v"].tolist(), at.width)
        r, uid, ids = vs["distance"].to_numpy(), vs["uid"].to_numpy(), vs["ids"].tolist()
        d = at.distances(np.c_[q, np.zeros(len(q))])[:, int(vs["pivot"].iloc[0])]
        size = (q * q).sum(1) + at.top
        floor = qs["floor"].fillna(-np.inf).to_numpy()
        reach = np.sqrt(np.maximum(0, size - 2 * (floor - 1e-3 - 1e-9 * size)))  # farther vectors stay below the floor
        first, stop = np.searchsorted(r, d - reach - 1e-6, "left"), np.searchsorted(r, d + reach + 1e-6, "right")
        out = []
        for i, quid in enumerate(qs["quid"].tolist()):
            a, b = first[i], stop[i]
            if a >= b:
                continue
            s = products(q[i], v[a:b], qs["v"].iloc[i], vs["v"].iloc[a:b])
            if len(s) > k + 1:
                edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                at_least = np.flatnonzero(s >= edge)
            else:
                at_least = np.arange(len(s))
            best = at_least[np.lexsort((uid[a:b][at_least], -s[at_least]))][: k + 1]
            out.append(pd.DataFrame({"quid": quid, "uid": uid[a:b][best], "ids": [ids[a + j] for j in best], "score": s[best]}))
        return pd.concat(out, ignore_index=True) if out else none

    def turn(asked: DataFrame, floor_known: bool) -> DataFrame:
        wide = asked.mapInPandas(ask(floor_known), "quid long, v array<bigint>, floor double, cell int, part array<int>, chunk int")
        wide = wide.withColumn("part", F.explode("part"))
        left = keyed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else keyed.withColumn("chunk", F.lit(0))
        by = ("cell", "part", "chunk")
        return (
            left.select("uid", "v", "ids", "pivot", "distance", *by).groupBy(*by)
            .cogroup(wide.groupBy(*by))
            .applyInPandas(score, "quid long, uid long, ids array<bigint>, score long")
        )

    one = materialise(turn(queries.withColumn("floor", F.lit(None).cast("double")), False))
    enough = best_ids(one, k + 1).groupBy("quid").agg(F.when(F.count("*") > k, F.min("score")).cast("double").alias("floor"))
    return one.unionByName(turn(queries.join(enough, "quid", "left").select("quid", "v", "floor"), True))


def best_ids(found: DataFrame, most: int) -> DataFrame:
    """(quid, vec_id, score): the ``most`` best ids of each query vector."""
    each = found.select("quid", "score", F.explode("ids").alias("vec_id"))
    by = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).drop("r")


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k highest inner products of each query with all other vectors: query_id, rank, vec_id, score.

    Queries: rows whose vec_id is divisible by ``every``.  Components are taken as floor(1024 x).
    Ties: smaller vec_id first.  Null ids, null vectors and vectors with a null or non-finite component
    take no part; shorter vectors are padded with zeros; a row repeated with its id is one candidate.
    Sums beyond the range of a long are held to it.
    """
    whole = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole_components(F.col("embedding")).alias("v"))
    whole = whole.where("vec_id is not null and v is not null")
    groups = materialise(distinct_vectors(whole, k))
    asked = whole.where(F.col("vec_id") % every == 0).distinct()
    named = materialise(asked.join(groups.select("uid", "v"), "v").select(F.col("vec_id").alias("query_id"), F.col("uid").alias("quid"), "v"))
    found = best_ids(search(groups, named.select("quid", "v").dropDuplicates(["quid"]), k), k + 1)
    pairs = named.select("query_id", "quid").join(found, "quid").where("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.select("query_id", F.row_number().over(by).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""
