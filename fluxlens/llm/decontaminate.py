"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_texts, materialise, words_of

#: So many windows of benchmark items are searched in one go; more are searched in further passes, so
#: that what is broadcast has a bound whatever the benchmark's size.
MOST_WINDOWS = 200_000
TABLE = 1 << 17
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


class WuManber:
    """Patterns (tuples of word ids from 1) of one length: shift table, suffix buckets, comparison."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.buckets: dict[int, list[tuple[tuple[int, ...], list[str]]]] = {}
        farthest = length - self.block + 1
        self.shift = np.full(TABLE, farthest, np.int16)
        for pattern, items in patterns.items():
            codes = self.codes(np.array(pattern, np.int64))
            for end in range(self.block - 1, length):
                code = codes[end]
                self.shift[code] = min(self.shift[code], length - 1 - end)
            self.buckets.setdefault(int(codes[-1]), []).append((pattern, items))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Hash of the block of words that ends at each position."""
        code = ids * 40503
        if self.block == 2:
            code[1:] += ids[:-1] * 2654435761
        return (code ^ (code >> 15)) % TABLE

    def search(self, ids: np.ndarray) -> Iterable[tuple[int, list[str]]]:
        """(start, items) of each occurrence in ``ids``; words outside every pattern have id 0."""
        m = self.length
        if len(ids) < m:
            return
        codes = self.codes(ids)
        shift = self.shift[codes]
        if shift[m - 1 :].all():
            return
        steps, i, n = shift.tolist(), m - 1, len(ids)
        while i < n:
            if step := steps[i]:
                i += step
                continue
            found = None
            for pattern, items in self.buckets.get(int(codes[i]), ()):
                found = found or tuple(ids[i - m + 1 : i + 1].tolist())
                if pattern == found:
                    yield i - m + 1, items
                    break
            i += 1


class Searcher:
    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.words: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, words in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                owners = by_length.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.tables = [WuManber(n, patterns) for n, patterns in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal spans of hit words, and the items with an occurring window."""
        if not words or not self.tables:
            return [], set()
        get = self.words.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        if not ids.any():
            return [], set()
        places, items = [], set()
        for table in self.tables:
            for start, owners in table.search(ids):
                places.append((start, start + table.length))
                items.update(owners)
        spans: list[tuple[int, int]] = []
        for start, stop in sorted(places):
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(stop, spans[-1][1]))
            else:
                spans.append((start, stop))
        return spans, items


def _passes(benchmark: DataFrame, window: int, most: int) -> Iterable[list[tuple[str, list[bytes]]]]:
    """The benchmark's items, streamed to the driver, in groups with at most ``most`` windows.

    An item with more windows than that is split into overlapping parts.
    """
    group: list[tuple[str, list[bytes]]] = []
    held = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in rows.where("item_id is not null and text is not null").toLocalIterator():
        words = words_of(text.encode())
        for at in range(0, max(1, len(words) - window + 1), most):
            part = words[at : at + most + window - 1]
            if not part:
                continue
            n = max(1, len(part) - window + 1)
            if held + n > most and group:
                yield group
                group, held = [], 0
            group.append((item, part))
            held += n
    if group:
        yield group


def search_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    keep: tuple[str, ...] | None = None,
    most_windows: int = MOST_WINDOWS,
) -> tuple[DataFrame, str]:
    """Columns ``keep`` of ``docs`` (all if None) and a struct (n_words, spans, items); its name.

    A window is ``window`` consecutive words of an item, or a shorter item's whole words.  spans are
    the maximal runs of document words inside any occurrence, items the item_ids as text, sorted so.
    One narrow pass for every ``most_windows`` windows of the benchmark, so a worker holds the windows of one pass; with
    one pass, documents are never moved.  Else they are written once with a number for each row, a pass leaves the numbers
    of rows with hits and those hits only, and these are joined to their rows in the end.
    Null texts and texts without words have no hits; items without words or without an id never occur;
    items of equal words both count; repeated document rows each get their own result.
    """
    keep = tuple(docs.columns) if keep is None else keep
    name = fresh(keep + ("text",), "found")
    kind = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", SPANS),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    out = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, "text"))])
    sc = docs.sparkSession.sparkContext

    def searched(rows: DataFrame, group: list[tuple[str, list[bytes]]], kept: Sequence[str]) -> DataFrame:
        """``kept`` and ``name``, what a pass finds in each row."""
        shared = sc.broadcast((group, window))
        cache: dict[str, Searcher] = {}

        def work(texts):
            if "it" not in cache:
                cache["it"] = Searcher(*shared.value)
            made = []
            for text in texts:
                words = words_of(text)
                spans, items = cache["it"].find(words)
                made.append(
                    {"n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(items)}
                )
            return [made]

        return map_texts(rows, work, [(name, kind)], kept)

    groups = iter(_passes(benchmark, window, most_windows) if docs.columns else [])
    first = next(groups, [])
    second = next(groups, None)
    if second is None:
        return searched(out, first, keep), name
    # rows get numbers that stay when they are written; each pass reads the texts and leaves the numbers of rows with hits
    number = fresh(out.columns, "row_number")
    out = materialise(out.withColumn(number, F.monotonically_increasing_id()))
    found = None
    for group in chain([first, second], groups):
        hits = searched(out.select(number, "text"), group, (number,)).where(F.size(F.col(name)["items"]) > 0)
        hits = materialise(hits.select(number, F.col(name)["spans"].alias("spans"), F.col(name)["items"].alias("items")))
        found = hits if found is None else found.unionByName(hits)
    of_row = found.groupBy(number).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    hit = of_row.select(F.col(number).alias("hit_number"), merge_spans(F.col("spans")).alias("hit_spans"), F.array_sort(F.array_distinct("items")).alias("hit_items"))
    counted = map_texts(out, lambda texts: [[{"n_words": len(words_of(t)), "spans": [], "items": []} for t in texts]], [(name, kind)], (*keep, number))
    both = counted.join(hit, counted[number] == F.col("hit_number"), "left")
    whole = F.struct(
        F.col(name)["n_words"].alias("n_words"),
        F.coalesce("hit_spans", F.col(name)["spans"]).alias("spans"),
        F.coalesce("hit_items", F.col(name)["items"]).alias("items"),
    )
    return both.select(*[F.col(f"`{c}`") for c in keep], whole.alias(name)), name


def merge_spans(spans: Column) -> Column:
    """Sorted union of half-open spans."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        touches = (F.size(done) > 0) & (x["start"] <= last["stop"])
        return F.when(
            touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        ).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, add)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out, f = search_benchmark(docs, benchmark, window, keep=("doc_id",))
    hit = F.aggregate(F.col(f)["spans"], F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    items = F.array_join(F.col(f)["items"], ",")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(f)["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(F.col(f)["items"]).cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
