"""Language identification: word frequencies first, shorter and shorter character n-grams after."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_texts, materialise, slices

#: Size of the model, which bounds what is broadcast: so many of the most frequent words and n-grams of each order for
#: a language, or GROWTH times the root of its distinct ones, if that is more.  Every document is counted; rarer words
#: take the way of unseen words.
WORDS, GRAMS, LONGEST, GROWTH = 20_000, 10_000, 4, 8
#: Languages at most; more than these is an error, since a model of that many values of ``lang`` has no bound.
LANGUAGES = 256
#: What an unseen word counts, in occurrences over the text of all languages.
ALPHA = 0.5
#: Classes of counts for each doubling, by which the most frequent entries are found.
STEPS = 16
#: Distinct entries that a task counts before it passes them on.
HELD = 200_000

def _marks() -> str:
    """All combining marks, as ranges of a character class."""
    points = [i for i in range(0x20000) if unicodedata.category(chr(i))[0] == "M"]
    edges = [0, *(k for k in range(1, len(points)) if points[k] != points[k - 1] + 1), len(points)]
    return "".join(f"{re.escape(chr(points[a]))}-{re.escape(chr(points[b - 1]))}" for a, b in zip(edges[:-1], edges[1:], strict=True))


_WORD = re.compile(rf"[^\W\d_]+(?:[{_marks()}]+[^\W\d_]*)*")


def letters_of(text: bytes | None) -> list[str]:
    """Lower-cased runs of letters with their combining marks; none if there is no letter."""
    words = _WORD.findall(text.decode().lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word between boundary marks (single characters: without the marks)."""
    word = f"<{word}>" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def held_out(doc_id="doc_id"):
    """True if crc32(doc_id as text) mod 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _flush(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([k[2] for k in keys], pa.string()),
            pa.array(list(counts.values()), pa.int64()),
        ],
        ["lang", "n", "gram", "hits"],
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, n=0, gram, hits): counts of every word of all texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_lang: dict[str, Counter] = {}
        for piece in slices(batches, "text"):
            for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist(), strict=True):
                per_lang.setdefault(lang, Counter()).update(letters_of(text))
            if sum(map(len, per_lang.values())) > HELD:
                yield _flush(Counter({(k, 0, w): n for k, c in per_lang.items() for w, n in c.items()}))
                per_lang = {}
        yield _flush(Counter({(k, 0, w): n for k, c in per_lang.items() for w, n in c.items()}))

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = rows.where("lang is not null and text is not null").mapInArrow(run, "lang string, n int, gram string, hits long")
    return counted.groupBy("lang", "n", "gram").agg(F.sum("hits").alias("hits"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, n=1.., gram, hits): character n-grams of the counted words, as often as the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], dict[str, int]] = {}

        def out() -> pa.RecordBatch:
            return _flush(Counter({(*k, g): n for k, c in counts.items() for g, n in c.items()}))

        for batch in batches:
            for lang, word, hits in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                for n in range(1, LONGEST + 1):
                    table = counts.get((lang, n))
                    if table is None:
                        table = counts[lang, n] = {}
                    get = table.get
                    for g in grams_of(word, n):
                        table[g] = get(g, 0) + hits
            if sum(map(len, counts.values())) > HELD:
                yield out()
                counts.clear()
        yield out()

    counted = words.mapInArrow(run, "lang string, n int, gram string, hits long")
    return counted.groupBy("lang", "n", "gram").agg(F.sum("hits").alias("hits"))


class LanguageModel:
    """Log frequencies of words and n-grams: a row of ``vectors`` each, a column for each language (by name)."""

    def __init__(self, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        self.langs = sorted({lang for lang, _ in totals})
        column = {x: i for i, x in enumerate(self.langs)}
        #: Row of each word (0) and of each n-gram (1..).
        self.places: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        orders: list[int] = []
        for _, n, gram, _ in rows:
            if gram not in self.places[n]:
                self.places[n][gram] = len(orders)
                orders.append(n)
        sums = np.array([[totals.get((x, n), 0) for x in self.langs] for n in range(LONGEST + 1)], float)
        unseen = ALPHA / np.maximum(1, sums.sum(1, keepdims=True))  # alike for every language, however much text it has
        self.vectors = np.repeat(unseen, len(self.langs), axis=1)[orders] if orders else np.zeros((0, len(self.langs)))
        for lang, n, gram, hits in rows:
            self.vectors[self.places[n][gram], column[lang]] += hits / sums[n, column[lang]]
        self.vectors = np.log(self.vectors)

    def backoff(self, word: str) -> list[int]:
        """Rows of an unseen word: its known n-grams of the longest order that has any."""
        for n in range(LONGEST, 0, -1):
            get = self.places[n].get
            if found := [i for g in grams_of(word, n) if (i := get(g)) is not None]:
                return found
        return []

    def __call__(self, text: bytes | None) -> tuple[str, float]:
        """Language and its posterior.  An unseen word counts as the mean over its n-grams."""
        words = letters_of(text)
        if not words or not self.langs:
            return "und", 0.0
        get = self.places[0].get
        rows, weights, unseen = [], [], []
        for w in words:
            if (i := get(w)) is None:
                unseen.append(w)
            else:
                rows.append(i)
        known = len(rows)
        for w in unseen:
            if found := self.backoff(w):
                rows += found
                weights += [1 / len(found)] * len(found)
        total = self.vectors[rows[:known]].sum(0) + np.array(weights) @ self.vectors[rows[known:]]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def listed(counts: DataFrame) -> DataFrame:
    """(n, gram) of the most frequent entries of any language.

    Entries are classed by their hits, STEPS classes for each doubling; a language lists the highest classes that
    together fit its model, the highest one always.  Only the sizes of the classes are gathered, and no entries
    are ranked, so no task gets a language's entries.
    """
    level = F.floor(F.log2(F.col("hits").cast("double")) * STEPS).cast("int")
    sizes = counts.groupBy("lang", "n", level.alias("level")).agg(F.count("*").alias("m")).collect()
    classes: dict[tuple[str, int], dict[int, int]] = {}
    for r in sizes:
        classes.setdefault((r["lang"], r["n"]), {})[r["level"]] = r["m"]
    if len({lang for lang, _ in classes}) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    cut: list[tuple[str, int, int]] = []
    for (lang, n), mine in classes.items():
        most = max(GRAMS if n else WORDS, int(GROWTH * sum(mine.values()) ** 0.5))
        held, lowest = 0, max(mine)
        for k in sorted(mine, reverse=True):
            held += mine[k]
            if held > most and k != max(mine):
                break
            lowest = k
        cut.append((lang, n, lowest))
    cuts = counts.sparkSession.createDataFrame(cut, "lang string, n int, lowest int")  # a row for each language and order
    return counts.join(F.broadcast(cuts), ["lang", "n"]).where(level >= F.col("lowest")).select("n", "gram").distinct()


def fit(docs: DataFrame) -> LanguageModel:
    """Model of all texts of ``docs`` with a language.

    Counts cover every row.  What comes to the driver is the entries of :func:`listed`, each with its
    hits in every language, and totals.
    """
    words = materialise(word_counts(docs))
    both = words.unionByName(materialise(gram_counts(words)))
    totals = both.groupBy("lang", "n").agg(F.sum("hits").alias("hits")).collect()
    if not totals:
        return LanguageModel([], {})
    chosen = both.join(F.broadcast(listed(both)), ["n", "gram"])  # as many as the models have entries
    rows = [tuple(r) for r in chosen.select("lang", "n", "gram", "hits").collect()]
    return LanguageModel(rows, {(r["lang"], r["n"]): r["hits"] for r in totals})


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    """Columns ``keep`` and a struct (lang_pred, score); its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        return [[dict(zip(("lang_pred", "score"), shared.value(t), strict=True)) for t in texts]]

    name = fresh(keep, "language")
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_texts(docs, work, [(name, kind)], keep), name


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    Learns from rows with a text, a lang and a doc_id whose crc32 mod 3 is not 1; predictions use the
    text alone.  score is the posterior of the predicted language under equal priors.  Null texts and
    texts without a letter: ``und``, 0; so are all if nothing can be learned.  Equal posteriors: the
    language that sorts first.  Text of unknown characters only: equal posteriors.
    """
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text"))
    out, c = predict(docs, model, ("doc_id",))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out().alias("held_out"),
        F.col(c)["lang_pred"].alias("lang_pred"),
        F.col(c)["score"].alias("score"),
    )
