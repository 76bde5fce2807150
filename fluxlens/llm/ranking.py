"""Ranked lexical search by three uniform threshold rounds over postings that are dealt by term."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import map_texts, materialise, slices, words_of

#: Results of each item.
K = 20
#: Documents of a shard, and postings after which a shard ends earlier.  A term has one list for each shard.
DOCUMENTS, POSTINGS = 8192, 4_000_000
#: Query terms of a pass over the lists, and rows that are broadcast at most; more query terms make more passes.
SMALL = 200_000

_BAG = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def small(df: DataFrame) -> DataFrame:
    """``df``, a materialised table, as one to broadcast if it has at most SMALL rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, q): the distinct terms of each item and how often they stand in it.

    Rows with the same id are one item, whose terms are those of all of them.
    """
    counted = map_texts(items, lambda texts: [[list(Counter(w.decode() for w in words_of(t)).items()) for t in texts]], [("bag", _BAG)], [item], text)
    return counted.select(F.col(item).alias("item"), F.explode("bag").alias("b")).groupBy("item", "b.term").agg(F.sum("b.tf").alias("q"))


def shard_lists(documents: DataFrame, wanted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Postings of each shard of documents: (shard, term, place, tf, n), and a row without term: its documents and the total of their terms.

    A shard is a run of a partition's rows that have a term; ``place`` is a document's number in it, ``n`` the
    number of its terms.  Up to SMALL wanted terms go to the tasks, which leave out all others.
    """
    listed = {r[0].encode() for r in wanted.collect()} if wanted.count() <= SMALL else None
    shared = documents.sparkSession.sparkContext.broadcast(listed)
    chosen = documents.select(F.col(doc).alias("doc"), F.col("text").cast("string").alias("text"))
    kind = chosen.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        ids = pa.list_(to_arrow_type(kind))
        only, shard = shared.value, TaskContext.get().partitionId() << 32
        docs: list = []
        lengths, held, lists = array("i"), 0, {}

        def made() -> Iterator[pa.RecordBatch]:
            size = np.array(lengths, np.int32)
            names = ["shard", "term", "place", "tf", "n", "docs", "total"]
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 3, pa.array([docs], ids), pa.array([size.sum(dtype=np.int64)])], names=names)
            each = list(lists.items())
            for i in range(0, len(each), 2048):
                part = each[i : i + 2048]
                columns = [[t.decode() for t, _ in part], [p.tobytes() for _, (p, _) in part], [f.tobytes() for _, (_, f) in part], [size[np.array(p)].tobytes() for _, (p, _) in part]]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part)), *arrays, pa.nulls(len(part), ids), pa.nulls(len(part), pa.int64())], names=names)

        for piece in slices(batches, "text"):
            for name, text in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist(), strict=True):
                counts = Counter(words_of(text))
                if not counts:
                    continue
                for word in counts.keys() & only if only is not None else counts:
                    if word not in lists:
                        lists[word] = (array("i"), array("i"))
                    places, often = lists[word]
                    places.append(len(docs))
                    often.append(counts[word])
                    held += 1
                docs.append(name)
                lengths.append(counts.total())
                if len(docs) == DOCUMENTS or held >= POSTINGS:
                    yield from made()
                    docs, lengths, held, lists, shard = [], array("i"), 0, {}, shard + 1
        if docs:
            yield from made()

    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), *[T.StructField(c, T.BinaryType()) for c in ("place", "tf", "n")],
                           T.StructField("docs", T.ArrayType(kind)), T.StructField("total", T.LongType())])
    return chosen.mapInArrow(run, schema)


def term_weight(df: Column, whole: Column) -> Column:
    """floor(1000 * ln((2N + 2) / (2 df + 1)))"""
    return F.floor(F.lit(1000.0) * F.log((2 * whole + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def by_impact(lists: DataFrame, documents: int, terms: int) -> DataFrame:
    """(term, shard, place, impact): lists dealt by term and shard, from the highest impact down (ties: lesser place).

    A posting's impact is (10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for raw in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                place, tf, n = (np.frombuffer(x, np.int32).astype(np.int64) for x in raw)
                if 25 * documents * int(n.max()) >= 2**63:
                    raise OverflowError("25 n N is beyond 64 bits")
                impact = 10**9 * tf // (1000 * tf + 12 * (75 + 25 * n * documents // terms))
                order = np.argsort(-impact, kind="stable")
                out.append((place[order].astype(np.int32).tobytes(), impact[order].astype(np.int32).tobytes()))
            made = [pa.array(x, pa.binary()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["term", "shard", "place", "impact"])

    dealt = lists.where("term is not null").select("term", "shard", "place", "tf", "n").repartition("term", "shard")
    return dealt.mapInArrow(run, "term string, shard long, place binary, impact binary")


def list_heads(lists: DataFrame, k: int) -> DataFrame:
    """(term, shard, place, impact): the k postings of highest impact of each term, from the heads of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [[np.frombuffer(x[: 4 * k], np.int32) for x in batch.column(i).to_pylist()] for i in (2, 3)]
            row = np.repeat(np.arange(batch.num_rows), [len(x) for x in heads[0]])
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int32)) for x in heads]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *flat], names=["term", "shard", "place", "impact"])

    each = lists.mapInArrow(run, "term string, shard long, place int, impact int")
    order = Window.partitionBy("term").orderBy(F.desc("impact"), "shard", "place")
    return each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def kth_score(partial: DataFrame, k: int) -> DataFrame:
    """(item, bound): the k-th highest of the sums ``partial(item, score)`` of each item, 0 if there are fewer."""
    ranked = partial.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") <= k)
    return ranked.groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("bound"))


def shard_groups(raw: DataFrame) -> DataFrame:
    """(shard, group): shards, in turn, while they have at most DOCUMENTS documents and POSTINGS terms together.

    So what the groups send grows with the documents, into however many partitions they are cut.  The driver
    looks at one row for each shard.
    """
    made, docs, terms, group = [], 0, 0, 0
    for shard, n, total in sorted(map(tuple, raw.where("term is null").select("shard", F.size("docs"), "total").collect())):
        if docs and (docs + n > DOCUMENTS or terms + total > POSTINGS):
            docs, terms, group = 0, 0, group + 1
        docs, terms = docs + n, terms + total
        made.append((shard, group))
    return materialise(raw.sparkSession.createDataFrame(made, "shard long, group long"))


def _held(table: pa.Table) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], pa.Array]:
    """The lists of a group of shards by term, from the highest impact down, and the documents that they name by place."""
    own = table.filter(pc.is_null(table.column("term")))
    docs = own.column("docs").combine_chunks()
    ends = np.cumsum(pc.list_value_length(docs).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = dict(zip(own.column("shard").to_pylist(), [0, *ends.tolist()], strict=False))
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for t, s, p, x in zip(*(table.column(c).to_pylist() for c in ("term", "shard", "place", "impact")), strict=True):
        if t is not None:
            parts.setdefault(t, []).append((np.frombuffer(p, np.int32) + first[s], np.frombuffer(x, np.int32).astype(np.int64)))
    lists = {}
    for t, each in parts.items():
        place, impact = (np.concatenate(x) for x in zip(*each, strict=True)) if len(each) > 1 else each[0]
        order = np.argsort(-impact, kind="stable") if len(each) > 1 else slice(None)
        lists[t] = place[order], impact[order]
    return lists, docs.flatten()


def _one_pass(members: DataFrame, heads: DataFrame, gains: DataFrame, k: int) -> DataFrame:
    """(item, doc, score): the k best documents of each group of shards that can be among those of an item of ``gains``."""
    spark = members.sparkSession
    one = heads.join(small(gains), "term").groupBy("item", "shard", "place").agg(F.sum(F.col("gain") * F.col("impact")).alias("score"))
    bound = {r["item"]: r["bound"] for r in kth_score(one, k).collect()}  # of SMALL terms, so of fewer items
    asked: dict = {}
    for r in gains.collect():
        asked.setdefault(r["item"], []).append((r["term"], r["gain"]))
    # item, bound, least sum of a list that is read, and the lists: term, gain, least impact
    plan = []
    for item, terms in asked.items():
        level = max(1, -(-bound.get(item, 0) // len(terms)))
        plan.append((item, bound.get(item, 0), level, [(t, g, -(-level // g)) for t, g in terms]))
    shared = spark.sparkContext.broadcast(plan)

    def best(table: pa.Table) -> pa.Table:
        held, docs = _held(table)
        rank = np.empty(len(docs), np.int64)
        rank[pc.array_sort_indices(docs, null_placement="at_end").to_numpy()] = np.arange(len(docs))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        for number, (_, bound, level, terms) in enumerate(shared.value):
            total, seen = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            rest = []
            for term, gain, least in terms:
                if term in held:
                    place, impact = held[term]
                    n = int(np.searchsorted(-impact, -least, "right"))
                    total[place[:n]] += gain * impact[:n]
                    seen[place[:n]] += 1
                    rest.append((place[n:], impact[n:], gain))
            at = np.flatnonzero(seen)
            if not len(at):
                continue
            reached = max(bound, int(np.partition(total[at], len(at) - k)[len(at) - k]) if len(at) >= k else 0)
            can = at[total[at] + (len(terms) - seen[at]) * (level - 1) >= reached]
            chosen = np.zeros(len(docs), bool)
            chosen[can] = True
            for place, impact, gain in rest:
                hit = chosen[place]
                total[place[hit]] += gain * impact[hit]
            can = can[total[can] >= max(reached, 1)]
            can = can[np.lexsort((rank[can], -total[can]))[:k]]
            found.append((np.full(len(can), number), can, total[can]))
        number, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"number": number.astype(np.int32), "doc": docs.take(pa.array(place)), "score": score})

    wanted = small(materialise(gains.select("term").distinct().withColumn("wanted", F.lit(True))))
    mine = members.join(wanted, "term", "left").where("term is null or wanted").drop("wanted")
    kind = members.schema["docs"].dataType.elementType
    out = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("doc", kind), T.StructField("score", T.LongType())])
    exact = materialise(mine.groupBy("group").applyInArrow(best, out))
    kinds = T.StructType([T.StructField("number", T.IntegerType()), gains.schema["item"]])
    names = materialise(spark.createDataFrame([(i, p[0]) for i, p in enumerate(plan)], kinds))
    return exact.join(small(names), "number").select("item", "doc", "score")


def search(documents: DataFrame, items: DataFrame, k: int = K, doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(item, rank, doc, score): the k documents of highest score for each item.

    1. The k heads of each term's lists give sums that k documents reach at least: a lower bound for each item.
    2. A document that gets less than bound / (number of the item's terms) from every list stays below the
       bound, so each list is read down to that only.  Lists meet by groups of shards, where what is read is added
       up.  The k-th highest sum raises the bound there; a document stays if its sum, with one less than the
       threshold for each list that it wasn't seen in, reaches the bound.
    3. The candidates are looked up in the rest of the item's lists, and the k best of each group are ranked.
    """
    asked = materialise(item_terms(items, item))
    wanted = materialise(asked.select("term").distinct())
    raw = materialise(shard_lists(documents, wanted, doc))
    count, terms = raw.agg(F.coalesce(F.sum(F.when(F.col("term").isNull(), F.size("docs"))), F.lit(0)), F.sum("total")).first()
    kinds = f"item {asked.schema['item'].dataType.simpleString()}, rank int, doc {documents.schema[doc].dataType.simpleString()}, score long"
    if not count:
        return documents.sparkSession.createDataFrame([], kinds)
    if wanted.count() > SMALL:  # lists hold all terms
        raw_lists = raw.where("term is not null").join(wanted, "term", "left_semi").select(*raw.columns)
    else:
        raw_lists = raw
    lists = materialise(by_impact(raw_lists, count, terms))
    df = lists.groupBy("term").agg(F.sum(F.length("place") / 4).cast("long").alias("df"))
    # what a term of an item gives a document is gain * impact
    gains = asked.join(df, "term").select("item", "term", (F.col("q") * term_weight(F.col("df"), F.lit(count))).alias("gain"))
    gains = materialise(gains.where("gain > 0"))
    heads = materialise(list_heads(lists, k))
    listed = lists.withColumn("docs", F.lit(None).cast(raw.schema["docs"].dataType))
    named = raw.where("term is null").select("term", "shard", "place", F.col("tf").alias("impact"), "docs")  # both null
    members = listed.unionByName(named).join(small(shard_groups(raw)), "shard")
    passes = -(-max(1, gains.count()) // SMALL)
    found = None
    for i in range(passes):
        mine = gains.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i) if passes > 1 else gains
        scored = _one_pass(members, heads, mine, k)
        found = scored if found is None else found.unionByName(scored)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item", "rank", "doc", "score")


def ranked_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of the K best documents of each benchmark item.

    Every row of ``documents`` with a term is a document, repeated rows too, each with a rank of its own;
    rows whose doc_id is null come after others of their score.  Rows of an item_id that repeats are one item;
    an item_id that is null is one too.  Null and empty texts have no terms; items without a term in any
    document have no rows, and empty tables give none.
    """
    return search(documents, benchmark).select(F.col("item").alias("item_id"), "rank", F.col("doc").cast("long").alias("doc_id"), "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
z AS (SELECT count(*) AS whole, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
g AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(whole) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, z GROUP BY t),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(w) * whole) // terms) AS m FROM d, z),
s AS (SELECT item_id, r, doc_id, CAST(sum(q * g.w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM i JOIN f USING (t) JOIN g USING (t) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM s) WHERE rank <= 20
"""
