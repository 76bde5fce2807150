"""Corpus pipeline: language ID, near-duplicates, repeated passages, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxlens.llm.common import fresh, scratch_folder
from fluxlens.llm.decontaminate import search_benchmark
from fluxlens.llm.language import fit, held_out, predict
from fluxlens.llm.mixing import mix
from fluxlens.llm.repeats import removed_bytes, without_repeats
from fluxlens.llm.simhash import near_copies

#: Least posterior of the predicted language.
MIN_SCORE = 0.5
#: Windows of a benchmark item that stand in a document make it contaminated; words in a window.
WINDOW = 10
#: Rows of a batch between Spark and Python workers: texts may be long, and both sides hold a batch.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: null text, no letter, or a posterior below ``MIN_SCORE``."""
    small_batches(spark)
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text"))
    out, c = predict(docs, model, tuple(docs.columns))
    return out.where((F.col(c)["lang_pred"] != "und") & (F.col(c)["score"] >= MIN_SCORE)).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies: the one of smallest doc_id (of repeated rows, one).

    Rows without a doc_id stand behind all others of their group.
    """
    small_batches(spark)
    one, two, root, row = (fresh(docs.columns, c) for c in ("text_key", "text_key_2", "group_root", "place_in_group"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({one: F.xxhash64(text), two: F.xxhash64(F.lit(1), text)})  # 128 bits
    groups = near_copies(keyed, (one, two)).withColumnRenamed("root", root)
    # of equal texts one row, then of each group one: only ids and keys are compared, and the texts join in the end
    least = keyed.groupBy(one, two).agg(F.min("doc_id").alias("doc_id")).join(groups, [one, two], "left")
    keys = F.struct(F.col(one).alias("k"), F.col(two).alias("l"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), keys.alias("k"))
    alone = F.when(F.col(root).isNull(), keys)  # a group of its own
    chosen = least.groupBy(F.col(root).alias("r"), alone.alias("a")).agg(F.min(order).alias("o"))
    chosen = chosen.select(F.col("o.doc_id").alias("chosen_id"), F.col("o.k.k").alias("chosen_key"), F.col("o.k.l").alias("chosen_key_2"))
    same = (keyed[one] == F.col("chosen_key")) & (keyed[two] == F.col("chosen_key_2"))
    both = keyed.join(chosen, same & keyed["doc_id"].eqNullSafe(F.col("chosen_id")))
    by = Window.partitionBy("chosen_id", "chosen_key", "chosen_key_2").orderBy("chosen_id")
    return both.withColumn(row, F.row_number().over(by)).where(F.col(row) == 1).select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte of a 50-byte passage that an earlier document has too.

    A document that loses all its text goes; n_chars follows the text that is left.  Bytes of a character
    that was cut are left out.
    """
    small_batches(spark)
    rest = [c for c in docs.columns if c != "text"]
    out, c = without_repeats(docs, keep=rest, as_text=True)
    removed, text = removed_bytes(F.col(c)["spans"]), F.col(c)["kept"]
    made = {"text": text.alias("text"), "n_chars": F.char_length(text).cast("long").alias("n_chars")}
    return out.where((removed == 0) | (F.length(text) > 0)).select(*[made.get(x, F.col(f"`{x}`")) for x in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item stands."""
    small_batches(spark)
    out, c = search_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW)
    return out.where(F.size(F.col(c)["items"]) == 0).select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, domain posteriors and the rate at which to take each document; drops the toxic ones.

    Those are the documents whose posterior is greatest for toxic.  A rate of 0 drops no other one.
    """
    small_batches(spark)
    out = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=docs.columns)
    return out.where("p_toxic <= greatest(p_good, p_poor)")


STAGES = [
    ("language ID", keep_known_language),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", remove_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each but the last returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
