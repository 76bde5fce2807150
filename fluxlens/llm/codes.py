"""Vectors as short codes: a codebook for each part, nearest entries found by float32 products with proven bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import matrix_of, product, usable

#: Components become floor(SCALE * x); parts of a vector; entries of a codebook; rounds of moving them.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Components beyond this are told apart in Python's own whole numbers, since squares would pass 64 bits.
_WIDE = 1 << 27
#: Labels that are broadcast at most; more are joined by a shuffle, dealt by label and SALTS numbers.
LABELS, SALTS = 100_000, 64
_LONG = 2**63 - 1


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, or as Python's numbers where one is beyond _WIDE."""
    floors = np.floor(values * SCALE)
    if not floors.size or np.abs(floors).max() <= _WIDE:
        return floors.astype(np.int64)
    exact = lambda x: int(x) if abs(x) < float("inf") else None
    out = np.array([exact(x) for x in floors.ravel()], object)
    for i in np.flatnonzero(out == None):  # noqa: E711  (SCALE * x is beyond the doubles, x isn't)
        out[i] = int(values.ravel()[i]) * SCALE
    return out.reshape(floors.shape)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance, entries evaluated exactly) of the nearest entry of each row, ties to the lower index.

    Distances less the row's own square are one float32 product, (x, 1) by (-2c, |c|^2).  Whatever the order
    of its sums, such a product of d terms is off by at most g = (d + 4)u / (1 - (d + 4)u) of the sum of the
    terms' sizes, u = 2^-24, with the rounding of the factors in it; that sum is at most 2|x||c| + |c|^2.
    Only entries whose interval reaches below the least upper end can be nearest; where a row has several of
    them, all are evaluated in int64.
    """
    if x.dtype == object or entries.dtype == object:
        gaps = ((x[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        index = np.array([min(range(len(g)), key=lambda j: (g[j], j)) for g in gaps.tolist()], np.int64)
        return index, gaps[np.arange(len(x)), index], gaps.size
    d = x.shape[1] + 1
    left, right = np.ones((len(x), d), np.float32), np.empty((len(entries), d), np.float32)
    left[:, :-1] = x
    squares = (entries * entries).sum(1)
    right[:, :-1], right[:, -1] = -2 * entries, squares
    screen = product(left, right).astype(np.float64)
    g = (d + 4) * 2.0**-24 / (1 - (d + 4) * 2.0**-24)
    size = np.sqrt((x * x).sum(1, dtype=np.float64))[:, None] * (2 * np.sqrt(squares.astype(np.float64))) + squares
    off = size * (g * (1 + 1e-6))  # the last factor covers the rounding of this line
    can = screen - off <= (screen + off).min(1)[:, None]
    index = can.argmax(1)
    open_ = np.flatnonzero(can.sum(1) > 1)
    row, entry = np.nonzero(can[open_])
    if len(row):
        gaps = ((x[open_[row]] - entries[entry]) ** 2).sum(1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(gaps, first)
        at = np.where(gaps == np.repeat(least, np.diff(np.r_[first, len(row)])), entry, len(entries))
        index[open_] = np.minimum.reduceat(at, first)  # entries ascend within a row
    return index, ((x - entries[index]) ** 2).sum(1), len(row)


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), a column for each part."""
    n, d = len(x), x.shape[1] // len(books)
    codes, gaps = np.zeros((n, len(books)), np.int64), np.zeros((n, len(books)), x.dtype)
    for p, entries in enumerate(books):
        codes[:, p], gaps[:, p], _ = nearest(x[:, p * d : (p + 1) * d], entries)
    return codes, gaps


def _pieces(batches: Iterator[pa.RecordBatch], at: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            piece = batch.slice(i, 4096)
            yield piece, whole_numbers(matrix_of(piece.column(at), width))


def _limbs(totals: np.ndarray) -> list[list[int]]:
    """Whole numbers as digits of 62 bits with their sign, from the lowest on; int64 ones are one digit."""
    if totals.dtype != object:
        return [totals.tolist()]
    out, left = [], [(1 if v >= 0 else -1, abs(int(v))) for v in totals]
    while not out or any(v for _, v in left):
        out.append([sign * (v & (1 << 62) - 1) for sign, v in left])
        left = [(sign, v >> 62) for sign, v in left]
    return out


def _book(rows: np.ndarray) -> np.ndarray:
    small = max((abs(int(v)) for v in rows.ravel()), default=0) <= _WIDE
    return rows.astype(np.int64) if small else rows


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks over ``vectors(vec_id, v)``, v without nulls, and the width they are made for.

    A task sends its sums and counts for each entry, so a round shuffles codebooks, not vectors; what
    comes to the driver is as large as the codebooks.
    """
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-width // parts) * parts
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select(F.col("v").cast("array<double>").alias("v")).collect()
    if not first or not width:
        return [np.zeros((len(first), 0), np.int64)] * parts, width
    start = np.zeros((len(first), width))
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = r["v"]
    d = width // parts
    books = [_book(whole_numbers(start)[:, p * d : (p + 1) * d]) for p in range(parts)]
    spark = vectors.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            n = len(now[0])
            total, count = np.zeros((parts * n, d), np.int64), np.zeros(parts * n, np.int64)
            held = 0
            for _, x in _pieces(batches, 0, width):
                if x.dtype == object or held > 2**34:  # sums of so many components stay within 64 bits
                    total = total.astype(object)
                codes, _ = assigned(x, now)
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    which, begin, number = np.unique(codes[order, p], return_index=True, return_counts=True)
                    total[p * n + which] += np.add.reduceat(x[order, p * d : (p + 1) * d], begin, axis=0)
                    count[p * n + which] += number
                held += len(x)
            used = np.flatnonzero(count)
            for i in range(0, len(used), 1024):
                u = used[i : i + 1024]
                place, entry, n_of = np.tile(np.arange(d), len(u)), np.repeat(u, d), np.repeat(count[u], d)
                for limb, value in enumerate(_limbs(total[u].ravel())):
                    yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(place), pa.array(np.full(len(entry), limb)), pa.array(value, pa.int64()), pa.array(n_of)],
                                                     names=["entry", "place", "limb", "value", "n"])

        partial = vectors.select("v").mapInArrow(sums, "entry long, place long, limb long, value long, n long")
        moved = partial.groupBy("entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("n").alias("n"))
        total: dict[tuple[int, int], int] = {}
        count: dict[tuple[int, int], int] = {}
        for r in moved.toLocalIterator():  # as many rows as the codebooks have components
            at = r["entry"], r["place"]
            total[at] = total.get(at, 0) + (int(r["value"]) << (62 * r["limb"]))
            count[at] = max(count.get(at, 0), r["n"])  # the lowest limb comes from all tasks
        n = len(books[0])
        table = np.concatenate(books).astype(object)
        for at, value in total.items():
            table[at] = value // count[at]
        books = [_book(table[p * n : (p + 1) * n]) for p in range(parts)]
        shared.unpersist()
    return books, width


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components in decimals by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], width: int, keep: list[str]) -> DataFrame:
    """``keep``, code (two hexadecimal digits for each part) and error (squared distances summed) of each vector ``v``."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    chosen = vectors.select(*keep, "v")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _pieces(batches, len(keep), width):
            codes, gaps = assigned(x, shared.value)
            joined = codes.astype(np.uint8).tobytes().hex()
            step = 2 * codes.shape[1]
            error = [min(int(e), _LONG) for e in gaps.sum(1)]
            made = [pa.array([joined[i : i + step] for i in range(0, len(joined), step)]), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(keep))), *made], names=[*keep, "code", "error"])

    return chosen.mapInArrow(run, ", ".join([*fields, "code string", "error long"]))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors summed over equal labels (nulls together).

    Sums are made before anything is shuffled.  Up to LABELS labels meet their rows in a broadcast; more are
    joined by label and one of SALTS numbers, so that a label of many rows is in many tasks.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    sums = materialise(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "label_of"))
    if sums.count() <= LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("label_of"))).drop("label_of")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    many = sums.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col("label").eqNullSafe(F.col("label_of")) & (F.col("salt") == F.col("salt_of"))
    return salted.join(many, on).drop("label_of", "salt", "salt_of")


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each embedding.

    Rows whose vector is null or has a null or non-finite component are dropped.  Widths: all vectors are
    taken as wide as the widest, rounded up to a multiple of PARTS, with zeros behind.  Codebooks start from
    the first ENTRIES rows by vec_id (ids that are null last; repeated rows each count; of equal ids the
    lesser vector first); of fewer rows, from all.  An empty table gives no rows.  Sums beyond a long are held to it.
    """
    names = embeddings.columns
    label = F.col("label") if "label" in [c.lower() for c in names] else F.lit(None).cast("int")
    vectors = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").alias("v"))
    books, width = train(vectors)
    coded = materialise(encode(vectors, books, width, ["vec_id", "label"]))
    out = with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, k, v[k * (len(v) // 16) + 1:(k + 1) * (len(v) // 16)] AS x FROM (SELECT r, v, unnest(range(16)) AS k FROM e)),
b0 AS (SELECT k, r - 1 AS j, x AS c FROM p WHERE r <= 64),
""" + "".join(
    f"""a{i} AS (SELECT r, k, arg_min(j, (g, j)) AS j, min(g) AS g FROM
  (SELECT r, k, j, list_sum(list_transform(range(1, len(x) + 1), lambda t: (x[t] - c[t]) * (x[t] - c[t]))) AS g FROM p JOIN b{i} USING (k)) GROUP BY r, k),
"""
    + (
        f"""s{i} AS (SELECT k, j, list(m ORDER BY t) AS c FROM
  (SELECT k, j, t, floor(sum(x[t]) / count(*)) AS m FROM (SELECT k, j, x, unnest(range(1, len(x) + 1)) AS t FROM a{i} JOIN p USING (r, k)) GROUP BY k, j, t)
  GROUP BY k, j),
b{i + 1} AS (SELECT k, j, coalesce(s{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN s{i} USING (k, j)),
"""
        if i < 2
        else ""
    )
    for i in range(3)
) + """h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY k, j)) AS codebooks_sha256 FROM b2),
o AS (SELECT r, string_agg(printf('%02x', CAST(j AS INTEGER)), '' ORDER BY k) AS code, CAST(sum(g) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN e USING (r), h
"""
