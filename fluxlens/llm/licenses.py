"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_texts, slices, words_of

#: A block has at least this share of a template's distinct words, or the template isn't in it.  With less, a short
#: template would be found without the word that tells its license from others.
CONTAINMENT = 0.9
#: A block for a template has as many words as that, repeats included, and this share more, for words put in between.
SLACK = 0.25

# fixed values: phrases whose places are counted, with their labels
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# fixed values: sentences by which well-known licenses are recognised, with their labels
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "www apache org licenses license 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution international license", "cc"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("you can redistribute it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[bytes]
    block: int

    @property
    def needed(self) -> int:
        return max(1, math.ceil(CONTAINMENT * len(self.words) - 1e-9))


def templates_of(pairs: Sequence[tuple[str, str]]) -> list[Template]:
    listed = [(label, words_of(text.encode())) for text, label in pairs]
    return [Template(label, frozenset(words), len(words) + math.ceil(SLACK * len(words))) for label, words in listed if words]


def text_frequencies(docs: DataFrame, templates: Sequence[Template]) -> dict[bytes, int]:
    """In how many texts each template word stands."""
    known = frozenset(w for t in templates for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for piece in slices(batches, "text"):
            for text in piece.column(0).cast(pa.binary()).to_pylist():
                counts.update(known.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    rows = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}  # template words only: their number is fixed


class TemplateIndex:
    """Prefix index over templates, whose words stand in the global order: rarest first, ties by bytes."""

    def __init__(self, templates: Sequence[Template], frequencies: dict[bytes, int]):
        order = sorted({w for t in templates for w in t.words}, key=lambda w: (frequencies.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates = templates
        self.sorted = [sorted(self.rank[w] for w in t.words) for t in templates]
        self.place = [{r: i for i, r in enumerate(ranks)} for ranks in self.sorted]
        # a block with enough of a template's words has one of its first len - needed + 1
        self.prefix: dict[int, list[int]] = {}
        for k, (t, ranks) in enumerate(zip(templates, self.sorted, strict=True)):
            for r in ranks[: len(ranks) - t.needed + 1]:
                self.prefix.setdefault(r, []).append(k)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """(template, first word, end, highest containment) of each run of overlapping blocks that meet the threshold.

        Blocks start at a template word: any other one has no more of them than the next that does.
        """
        get = self.rank.get
        at = [(i, r) for i, w in enumerate(words) if (r := get(w)) is not None]
        present = {r for _, r in at}
        for k in sorted({k for r in present for k in self.prefix.get(r, ())}):
            place, needed, size = self.place[k], self.templates[k].needed, self.templates[k].block
            common = [place[r] for r in present if r in place]
            # length filter; positional filter: all other common words stand behind the first
            if len(common) < needed or min(common) > len(place) - needed:
                continue
            mine = [(i, place[r]) for i, r in at if r in place]
            held: Counter = Counter()
            stop, run = 0, None
            for first, (i, p) in enumerate(mine):
                while stop < len(mine) and mine[stop][0] < i + size:
                    held[mine[stop][1]] += 1
                    stop += 1
                if stop - first >= needed and len(held) >= needed:
                    share = len(held) / len(place)
                    if run and i <= run[1]:
                        run = [run[0], i + size, max(run[2], share)]
                    else:
                        if run:
                            yield k, run[0], min(run[1], len(words)), run[2]
                        run = [i, i + size, share]
                held[p] -= 1
                if not held[p]:
                    del held[p]
            if run:
                yield k, run[0], min(run[1], len(words)), run[2]


class PhraseFinder:
    def __init__(self, phrases: Sequence[tuple[str, str]]):
        self.first: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for text, label in phrases:
            if words := words_of(text.encode()):
                self.first.setdefault(words[0], []).append((words, label))

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        first = self.first
        return [
            (i, label)
            for i, w in enumerate(words)
            if w in first
            for phrase, label in first[w]
            if words[i : i + len(phrase)] == phrase
        ]


KIND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("places", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())]))),
        T.StructField("blocks", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
            T.StructField("containment", T.DoubleType())]))),
    ]
)


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    keep: tuple[str, ...] = ("doc_id",),
) -> tuple[DataFrame, str]:
    """Columns ``keep`` and a struct: n_words, places of phrases, and every block with a template in it; its name.

    Two narrow passes: in how many of all texts the templates' words stand, then the join.  The
    templates are a fixed list, so the index that each task holds has a fixed size.
    Null texts count as empty; repeated rows each get a result.
    """
    listed = templates_of(templates)
    frequencies = text_frequencies(docs, listed)
    cache: dict[str, tuple] = {}

    def work(texts):
        if not cache:
            cache["it"] = (TemplateIndex(listed, frequencies), PhraseFinder(phrases))
        index, finder = cache["it"]
        rows = []
        for text in texts:
            words = words_of(text)
            rows.append({
                "n_words": len(words),
                "places": [{"word": i, "label": x} for i, x in finder.places(words)],
                "blocks": [
                    {"label": listed[k].label, "start": a, "stop": b, "containment": c} for k, a, b, c in index.search(words)
                ],
            })
        return [rows]

    name = fresh(keep, "license")
    return map_texts(docs, work, [(name, KIND)], keep), name


def license_labels(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the highest containment of a template in a block that meets the threshold, 1 where a base
    phrase stands, else 0.
    """
    out, c = scan(docs)
    places, blocks = F.col(c)["places"], F.col(c)["blocks"]
    base = F.array_distinct(places["label"])
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(c)["n_words"].alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places["word"]).alias("first_word"),
        F.array_max(places["word"]).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, blocks["label"])), ",").alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(blocks["containment"]), F.lit(0.0))).alias("score"),
    )


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_TEMPLATE_ROWS = ", ".join(f"({k}, '{t.label}', {t.needed}, {len(t.words)}, {t.block}, '{w.decode()}')" for k, t in enumerate(templates_of(TEMPLATES)) for w in sorted(t.words))
_PHRASE_ROWS = ", ".join(f"('{label}', {text.split()})" for text, label in PHRASES)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
o AS (SELECT r, i, w[i + 1] AS x FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d)),
p(label, phrase) AS (VALUES {_PHRASE_ROWS}),
b AS (SELECT r, i, label FROM o JOIN p ON o.x = p.phrase[1] JOIN d USING (r) WHERE w[i + 1:i + len(phrase)] = phrase),
bs AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
t(k, label, needed, n, block, x) AS (VALUES {_TEMPLATE_ROWS}),
h AS (SELECT o.r, t.k, o.i, t.x, t.block FROM o JOIN t USING (x)),
enough AS (SELECT h.r, h.k FROM h JOIN t ON t.k = h.k AND t.x = h.x GROUP BY h.r, h.k HAVING count(DISTINCT h.x) >= any_value(needed)),
e AS (SELECT h.* FROM h JOIN enough USING (r, k)),
m AS (SELECT a.r, a.k, a.i, count(DISTINCT c.x) AS c FROM e a JOIN e c ON a.r = c.r AND a.k = c.k AND c.i BETWEEN a.i AND a.i + a.block - 1 GROUP BY a.r, a.k, a.i),
f AS (SELECT r, label, max(c / n) AS share FROM m JOIN (SELECT DISTINCT k, label, needed, n FROM t) USING (k) WHERE c >= needed GROUP BY r, label),
ls AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM f UNION SELECT r, label FROM b) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM f GROUP BY r)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN ls USING (r) LEFT JOIN s USING (r)
"""
