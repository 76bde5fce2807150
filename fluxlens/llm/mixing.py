"""Document rates for a target mixture, from soft domain memberships."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_texts, materialise, words_of

#: Domains of the labelled table and the target weight of each in the mixture's tokens.
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.9, "poor": 0.1, "toxic": 0.0}
#: The classifier is fitted on at most so many labelled documents.
LABELLED = 4000
#: Words that are features: those in most of the fitted documents.  After them come shares of ASCII
#: characters and how often words repeat.
WORDS = 6000
#: Weight of a word feature, and the penalty on squared weights.
SCALE, PENALTY = 0.5, 2e-4
#: Weight of a departure from taking each document once against a miss of the targets: without it, all tokens of the
#: mixture would come from the few documents whose posteriors are nearest to the targets, taken many times.
EVEN = 1e-3
#: Steps of projected gradient at most; the change of a rate at which they end; steps after which rates are written.
STEPS, TOLERANCE, SPAN = 2000, 1e-5, 32
#: Documents that a task goes through in a step: with fewer, tasks would cost more than what they do.
DOCUMENTS = 65536


class Features:
    """(indices, values, number of words) of a text's features."""

    def __init__(self, words: Sequence[bytes]):
        self.places = {w: i for i, w in enumerate(words)}
        self.size = len(self.places) + 128 + 1

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32), 0
        counts = Counter(words)
        known = [(at, n) for w, n in counts.items() if (at := self.places.get(w)) is not None]
        shares = np.bincount(np.frombuffer(text, np.uint8), minlength=128)[:128].astype(np.float32) / len(text)
        tail = np.r_[np.sqrt(shares) * 2, np.float32(1 - len(counts) / len(words))]
        tail_at = np.flatnonzero(tail)
        at = np.r_[np.array([i for i, _ in known], np.int32), len(self.places) + tail_at.astype(np.int32)]
        x = np.r_[SCALE * np.log1p(np.array([n for _, n in known], np.float32)), tail[tail_at]]
        return at.astype(np.int32), x.astype(np.float32), len(words)


@dataclass
class Classifier:
    """Multinomial logistic regression over :class:`Features`."""

    features: Features
    weights: np.ndarray  # features x domains
    bias: np.ndarray

    def posteriors(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        x = values @ self.weights[at] + self.bias
        e = np.exp(x - x.max())
        return e / e.sum()


def domain_of(quality: Column, toxic: Column) -> Column:
    """Number of a labelled document's domain: toxic, else by quality."""
    return F.when(toxic == 1, 2).when(quality == 1, 0).otherwise(1)


def fit_classifier(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, steps: int = 200) -> Classifier:
    """Fitted on ``labelled`` labelled documents (in the order of a hash of their ids) or all, if fewer.

    Labels with a null are left out; a document labelled twice counts with each label.  Without
    labels every domain gets the same posterior.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = materialise(texts.select("domain", "text"))
    spread = map_texts(texts, lambda rows: [[list(set(words_of(t))) for t in rows]], [("w", T.ArrayType(T.BinaryType()))], ())
    common = spread.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    make = Features([bytes(r["w"]) for r in common.orderBy(F.desc("n"), "w").limit(WORDS).collect()])
    kind = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])

    def work(rows):
        made = [make(t)[:2] for t in rows]
        return [[{"at": at, "x": x} for at, x in made]]

    rows = map_texts(texts, work, [("f", kind)], ("domain",)).collect()  # at most ``labelled`` sparse vectors
    k = len(DOMAINS)
    if not rows:
        return Classifier(make, np.zeros((make.size, k)), np.zeros(k))
    x = np.zeros((len(rows), make.size), np.float32)
    for i, r in enumerate(rows):
        x[i, r["f"]["at"]] = r["f"]["x"]
    y = np.eye(k, dtype=np.float32)[[r["domain"] for r in rows]]
    order = np.argsort([zlib.crc32(v.tobytes()) for v in x], kind="stable")  # the same sums whatever came first
    x, y = x[order], y[order]
    w, b = np.zeros((make.size, k), np.float32), np.zeros(k, np.float32)
    mw, mb, vw, vb = (np.zeros_like(z) for z in (w, b, w, b))
    for t in range(1, steps + 1):  # Adam over all rows at once
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - y) / len(x)
        for value, g, m, v in ((w, x.T @ d + PENALTY * w, mw, vw), (b, d.sum(0), mb, vb)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Classifier(make, w, b)


def memberships(docs: DataFrame, model: Classifier, keep: Sequence[str]) -> tuple[DataFrame, str]:
    """Columns ``keep`` and a struct: n_tokens and p, the posteriors of the domains; its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        rows = []
        for text in texts:
            at, x, n = shared.value.features(text)
            rows.append({"n_tokens": n, "p": shared.value.posteriors(at, x).astype(float)})
        return [rows]

    name = fresh(tuple(keep), "member")
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    return map_texts(docs, work, [(name, kind)], tuple(keep)), name


def advance(n: np.ndarray, p: np.ndarray, r: np.ndarray, y: np.ndarray, steps: Sequence[Sequence[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates ``r`` and the points ``y`` ahead of them after ``steps``, each the gradient by domain and the momentum."""
    for *slope, momentum in steps:
        new = np.maximum(0, y - (p @ np.array(slope) + EVEN * (y - 1)) / (1 + EVEN))
        y = new + momentum * (new - r)
        r = new
    return r, y


def _packed(table: DataFrame, n: Column, p: Column) -> DataFrame:
    """Blocks of documents: n, p, r and y as bytes of doubles, all rates 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            posteriors = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ones = np.ones(size).tobytes()
            columns = [batch.column(0).to_numpy(zero_copy_only=False).tobytes(), np.ascontiguousarray(posteriors, float).tobytes(), ones, ones]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["n", "p", "r", "y"])

    chosen = table.select(n.alias("n"), p.alias("p")).where("n > 0")
    return materialise(chosen.mapInArrow(run, "n binary, p binary, r binary, y binary"))


def _unpacked(batch: pa.RecordBatch, k: int) -> Iterator[list[np.ndarray]]:
    for block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        n, p, r, y = (np.frombuffer(x) for x in block)
        yield [n, p.reshape(-1, k), r, y]


def fit_rates(table: DataFrame, n: Column, p: Column, targets: Sequence[float], tolerance: float = TOLERANCE) -> list[list[float]]:
    """Steps of accelerated projected gradient descent; :func:`rate` turns them into each document's rate.

    Minimises e'We + EVEN * sum(n (r - 1)^2) over nonnegative rates r, with e the domains' expected tokens
    sum(r n p) less the targets.  W is the inverse of sum(n p p'), so that a step of 1 / (1 + EVEN) is safe; rates start at 1.
    Each step goes on from a point ahead of the rates (Nesterov's momentum), which starts anew where it leads uphill.
    A step is one distributed sum of a few numbers over all documents, whose rates are written
    every SPAN steps.  Steps end when the last one changed no rate by more than ``tolerance``; if STEPS don't
    suffice, that is an error.
    """
    k = len(targets)
    pick = [F.get(p, F.lit(i)) for i in range(k)]
    sums = [F.sum(n * pick[i] * pick[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
    sums += [F.sum(n * q).alias(f"s{i}") for i, q in enumerate(pick)]
    sums.append(F.count("*"))
    first = [x or 0.0 for x in table.agg(*sums).first()]
    gram, of_rates = np.array(first[: k * k], float).reshape(k, k), np.array(first[k * k : -1], float)
    if not gram.any():
        return []
    weigh, goal = np.linalg.pinv(gram, rcond=1e-12, hermitian=True), np.array(targets, float)
    tasks = -(-first[-1] // DOCUMENTS)
    blocks = _packed(table, n, p).coalesce(tasks)
    history: list[list[float]] = []
    written, ahead, pace = 0, of_rates, 1.0

    def step(steps: list[list[float]], slope: list[float]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, uphill, change = np.zeros(k), 0.0, 0.0
            for batch in batches:
                for n_, p_, r, y in _unpacked(batch, k):
                    r, y = advance(n_, p_, r, y, steps)
                    new, _ = advance(n_, p_, r, y, [[*slope, 0.0]])
                    total += (n_ * new) @ p_
                    uphill += float(((y - new) * n_) @ (new - r))
                    change = max(change, float(np.abs(new - y).max()))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([uphill]), pa.array([change])], names=["total", "uphill", "change"])

        return run

    def moved(steps: list[list[float]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [(n_.tobytes(), p_.tobytes(), *(x.tobytes() for x in advance(n_, p_, r, y, steps))) for n_, p_, r, y in _unpacked(batch, k)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*done, strict=True)], names=["n", "p", "r", "y"])

        return run

    for _ in range(STEPS):
        slope = [float(x) for x in weigh @ (ahead - goal)]
        parts = blocks.mapInArrow(step(history[written:], slope), "total array<double>, uphill double, change double")
        got = parts.agg(*[F.sum(F.get("total", F.lit(i))) for i in range(k)], F.sum("uphill"), F.max("change")).first()
        if got[k] > 0:
            pace = 1.0
        after = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum, pace = (pace - 1) / after, after
        new = np.array(got[:k], float)
        ahead, of_rates = new + momentum * (new - of_rates), new  # as linear as the points themselves
        history.append([*slope, momentum])
        if got[k + 1] <= tolerance:
            return history
        if len(history) - written >= SPAN:
            blocks = materialise(blocks.mapInArrow(moved(history[written:]), blocks.schema))
            written = len(history)
    raise RuntimeError(f"fit_rates: a rate still changes by {got[k + 1]:.3g} after {STEPS} steps, {tolerance:.3g} wanted")


def rate(p: Column, history: Sequence[Sequence[float]]) -> Column:
    """Rate of a document with posteriors ``p`` after the steps of ``history``."""
    if not history:
        return F.lit(1.0)

    @F.pandas_udf("double")
    def after_steps(posteriors: pd.Series) -> pd.Series:
        held = np.array(posteriors.tolist(), float).reshape(len(posteriors), -1)
        ones = np.ones(len(held))
        return pd.Series(advance(ones, held, ones, ones, history)[0])

    return after_steps(p)


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    total_tokens: float | None = None,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep``, n_tokens, p_<domain> and rate of each row.

    rate is how often the document is to be taken (0: not at all), such that over all rows the expected
    tokens of each domain, sum(rate * n_tokens * p), come near to the target weights times ``total_tokens`` (by
    default the tokens of ``docs``): as near as can be but for EVEN, see :func:`fit_rates`.  Texts without words, null ones too, have no
    tokens, the classifier's prior as posteriors, and a rate like any other row; repeated rows each get one.
    """
    targets = TARGETS if targets is None else targets
    model = fit_classifier(docs, labels)
    out, m = memberships(docs, model, keep)
    n, p = F.col(m)["n_tokens"].cast("double"), F.col(m)["p"]
    if "text" in keep:  # the steps need no texts: these are gone through once more at the end
        table = materialise(memberships(docs, model, ())[0].withColumnRenamed("member", m))
    else:
        out = materialise(out)
        table = out.select(m)
    whole = sum(targets.values()) or 1.0
    tokens = total_tokens if total_tokens is not None else table.agg(F.sum(n)).first()[0] or 0.0
    history = fit_rates(table, n, p, [targets.get(d, 0.0) / whole * tokens for d in DOMAINS])
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(m)["n_tokens"].alias("n_tokens"),
        *[F.get(p, F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        rate(p, history).alias("rate"),
    )
