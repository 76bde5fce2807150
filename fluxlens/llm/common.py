"""Shared pieces of the corpus operators: word rules, batch-wise text maps, checkpoints, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import shared_folder

#: Texts are handled in slices of about so many bytes, which bounds a Python worker's memory.
SLICE_BYTES = 1 << 20

#: A-Z lower-cased, every other ASCII character that is no letter or digit becomes a space; bytes of
#: other characters stay.  Splitting at white space then gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text; none of null."""
    return text.translate(WORD_TABLE).split() if text else []


def materialise(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}"


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``most`` bytes in each piece (one row at least)."""
    for batch in batches:
        column_at = batch.schema.get_field_index(column)
        start = size = 0
        lengths = pc.binary_length(batch.column(column_at)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def fresh(names: Sequence[str], stem: str) -> str:
    """A column name that is not among ``names`` (compared without case)."""
    taken, name = {x.lower() for x in names}, stem
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(
    df: DataFrame,
    work: Callable[[list[bytes | None]], Sequence[Sequence]],
    added: Sequence[tuple[str, T.DataType]],
    keep: Sequence[str],
    text: str = "text",
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Columns ``keep`` of ``df`` and, after them, columns that ``work`` makes of each whole text.

    ``work`` gets the UTF-8 texts of some rows (None for null) and returns one sequence per added
    column.  Rows stay where they are: no shuffle.  Other columns are not read, so names in the
    input can't clash with the added ones unless they are in ``keep``.
    """
    reads = fresh(keep, "text_in")
    chosen = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias(reads))
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in chosen.schema.fields[:-1]] + [T.StructField(n, t) for n, t in added]
    )
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for piece in slices(batches, reads, most):
            made = work(piece.column(kept).cast(pa.binary()).to_pylist())
            columns = [piece.column(i).cast(out.field(i).type) for i in range(kept)]
            columns += [pa.array(x, type=out.field(kept + i).type) for i, x in enumerate(made)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return chosen.mapInArrow(run, schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``, root the smallest node.

    Large-star / small-star contraction: each step is a grouped minimum and an equi-join, both
    shuffled on a node, so no vertex or component is ever gathered anywhere.  Steps are
    checkpointed.  Nodes without an edge to another node are not in the result.
    """

    def star(pairs: DataFrame, only_larger: bool) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        joined = pairs.join(least, "a").withColumn("m", F.least("m", "a"))
        if only_larger:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            joined.select("a", F.col("m").alias("b"))
        )

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    # every pair is kept as (larger, smaller)
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = state(now)
    for _ in range(rounds if seen[0] else 0):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, True).where("a <> b").distinct()
        now = materialise(star(large, False).where("a <> b").distinct())
        if (new := state(now)) == seen:
            break
        seen = new
    else:
        if seen[0]:
            raise RuntimeError("components: no fixed point; raise rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
