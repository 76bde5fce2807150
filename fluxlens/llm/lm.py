"""Document scores of a masked language model: a bidirectional window network in numpy."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, materialise, shuffle_width, slices, words_of

#: Digits of a word's number, and the least size of the vocabulary.  The output is a softmax over GROUP for
#: each digit, from the highest on, so that a word costs GROUP times the number of digits.
GROUP = 32
VOCABULARY = GROUP * GROUP
#: The most frequent words of the corpus have numbers of their own: all up to VOCABULARY, beyond that GROWTH times
#: the root of the number of distinct words.  Every other word is its first byte, which has a number as well, and
#: the bytes after it, which :class:`Spelling` scores; so no two words are the same to the model.
GROWTH = 8
#: Words seen on either side of the masked one; size of the hidden layer.
REACH, HIDDEN = 2, 16
#: Nodes of a digit whose outputs depend on the hidden layer: the words below these, the most frequent ones, are told
#: apart by context.  In the other nodes, context chooses the node and the counts of the corpus the word in it.
CONTEXTUAL = 64
#: Passes over all texts.  Each masks its share of the positions of every text: each position once in all.
PASSES = 2
#: Positions of a step: an eighth of those that the group has behind it, within these bounds.
BATCH, LARGEST, RATE = 2048, 16384, 0.15
#: Bytes of text for each byte of weights that a group of texts sends (fewer, larger groups for a larger model).
TEXT_FOR_WEIGHTS, LEAST_TEXT = 4, 4 << 20
_HELD = 200_000
#: Bytes of words as 1..164 (digits, letters, bytes of other characters); 0 is the end.
SYMBOLS = 165
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[[*range(48, 58), *range(97, 123), *range(128, 256)]] = np.arange(1, SYMBOLS)


#: Rows of a matrix product: more would wake a second BLAS thread, which only waits beside the task's own.
_ROWS = 256


def _product(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    if out is None:
        out = np.empty((len(a), b.shape[1]), np.result_type(a, b))
    for i in range(0, len(a), _ROWS):
        np.matmul(a[i : i + _ROWS], b, out=out[i : i + _ROWS])
    return out


def _moment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b"""
    out = a[:_ROWS].T @ b[:_ROWS]
    for i in range(_ROWS, len(a), _ROWS):
        out += a[i : i + _ROWS].T @ b[i : i + _ROWS]
    return out


def _powers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, e to it, and its sums by row; x is lowered to 0 at most in each row where e to it could leave the range of float32."""
    if x.size and max(x.max(), -x.min()) > 60:
        x = x - x.max(1, keepdims=True)
    e = np.exp(x)
    return x, e, _product(e, np.ones((e.shape[1], 1), e.dtype))[:, 0]


def _sorting(x: np.ndarray, size: int) -> np.ndarray:
    """Stable order of numbers below ``size``: by counting, if they have 16 bits."""
    return np.argsort(x.astype(np.uint16) if size <= 1 << 16 else x, kind="stable")


class Network:
    """hidden = tanh(sum of the neighbours' vectors by place); a softmax for each digit of the word on top.

    A digit's outputs are the biases of the node that the digits before it lead to and, in the first CONTEXTUAL
    nodes, the hidden layer by the node's weights.
    """

    def __init__(self, flat: np.ndarray | None = None, seed: int = 0, size: int = VOCABULARY):
        depth = 2
        while GROUP**depth < size:
            depth += 1
        #: What a word's number is divided by to give the node of each digit.
        self.steps = [GROUP ** (depth - k) for k in range(depth)]
        nodes = [-(-size // x) for x in self.steps]
        self.shapes = [(2 * REACH, size, HIDDEN)]
        for n in nodes:
            self.shapes += [(min(n, CONTEXTUAL), HIDDEN, GROUP), (n, GROUP)]
        sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat = flat
        self.near, *layers = (x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), self.shapes, strict=True))
        self.layers = list(zip(layers[::2], layers[1::2], strict=True))
        #: ln P of the digits in nodes without weights, once it is asked for.
        self.fixed: dict[int, np.ndarray] = {}
        self.group_w, self.group_b = self.layers[0][0][0], self.layers[0][1][0]
        self.word_w, self.word_b = self.layers[1]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.near[0].take(context[:, 0], axis=0)
        for k in range(1, 2 * REACH):
            total += self.near[k].take(context[:, k], axis=0)
        return np.tanh(total, out=total)

    @staticmethod
    def log_softmax(x: np.ndarray) -> np.ndarray:
        x = x - x.max(1, keepdims=True)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    def count(self, hits: np.ndarray) -> None:
        """Biases of the nodes without weights: what each word's number of occurrences tells."""
        for step, (w, b) in zip(self.steps, self.layers, strict=True):
            below = np.zeros(b.size)
            n = -(-len(hits) // (step // GROUP))
            below[:n] = np.add.reduceat(hits, np.arange(n) * (step // GROUP))
            b[len(w) :] = np.log(below + 0.5).reshape(b.shape)[len(w) :]

    def _digit(self, k: int, h: np.ndarray, target: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Where the rows of each node with weights begin and end, for sorted targets, and the outputs of digit ``k`` there."""
        w, b = self.layers[k]
        edges = np.searchsorted(target, np.arange(len(w) + 1, dtype=target.dtype) * self.steps[k]).tolist()
        x = np.empty((edges[-1], GROUP), np.result_type(h, w))
        for node, (i, j) in enumerate(pairwise(edges)):
            if i < j:
                _product(h[i:j], w[node], x[i:j])
                x[i:j] += b[node]
        return edges, x

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """ln P(target | both sides) of each position."""
        order = _sorting(target, self.near.shape[1])
        h, target = self.hidden(context[order]), target[order]
        total = np.zeros(len(h))
        for k, step in enumerate(self.steps if len(h) else ()):
            digit = target % step // (step // GROUP)
            edges, x = self._digit(k, h, target)
            n = edges[-1]
            x, _, sums = _powers(x)
            total[:n] += x[np.arange(n), digit[:n]] - np.log(sums)
            if n < len(h):  # nodes without weights give each word the same chance everywhere
                if k not in self.fixed:
                    self.fixed[k] = self.log_softmax(self.layers[k][1])
                total[n:] += self.fixed[k][target[n:] // step, digit[n:]]
        out = np.empty(len(h))
        out[order] = total
        return out

    def slopes(self, context: np.ndarray, target: np.ndarray, all_nodes: bool = True) -> Iterator[tuple[np.ndarray, slice | np.ndarray, np.ndarray]]:
        """Gradient of the mean negative log probability: (weights, rows of them, slope), zero elsewhere.

        All of it is computed before the first is given, so weights may be changed meanwhile.  Without
        ``all_nodes``, biases of nodes without weights are left out.
        """
        order = _sorting(target, self.near.shape[1])
        context, target = context[order], target[order]
        h = self.hidden(context)
        n = len(h)
        back = np.zeros_like(h)
        found = []
        for k, step in enumerate(self.steps):
            w, b = self.layers[k]
            slope_w, slope_b = np.zeros_like(w), np.zeros_like(b[: len(w)])
            digit = target % step // (step // GROUP)
            edges, x = self._digit(k, h, target)
            q = self._off(x, digit[: len(x)])
            for node, (i, j) in enumerate(pairwise(edges)):
                if i < j:
                    back[i:j] += _product(q[i:j], w[node].T)
                    slope_w[node], slope_b[node] = _moment(h[i:j], q[i:j]) / n, q[i:j].sum(0) / n
            found += [(w, slice(None), slope_w), (b, slice(0, len(w)), slope_b)]
            if all_nodes and len(x) < n:
                node = target[len(x) :] // step
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                found.append((b, node[starts], np.add.reduceat(self._off(b[node], digit[len(x) :]), starts, axis=0) / n))
        back *= (1 - h * h) / n
        for k in range(2 * REACH):
            order = _sorting(context[:, k], self.near.shape[1])
            ids = context[order, k]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            found.append((self.near[k], ids[starts], np.add.reduceat(back.take(order, axis=0), starts, axis=0)))
        yield from found

    @staticmethod
    def _off(x: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """Chances by the outputs ``x``, less one for the digit that it is."""
        _, q, sums = _powers(x)
        q /= sums[:, None]
        q[np.arange(len(q)), digit] -= 1
        return q

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Gradient of the mean negative log probability, laid out as ``flat``."""
        out = np.zeros_like(self.flat)
        first = self.flat.__array_interface__["data"][0]
        for weights, rows, slope in self.slopes(context, target):
            at = (weights.__array_interface__["data"][0] - first) // self.flat.itemsize
            view = out[at : at + weights.size].reshape(weights.shape)
            view[rows] += slope
        return out


class Vocabulary(dict):
    """Numbers of words, and of first bytes (after a space) of those spelled; what the spelled words consist of.

    ``hits`` are the occurrences of each number.  Looked up by brackets, a spelled word has its first byte's number.
    """

    def __init__(self, places: dict[bytes, int] | None = None, codes: np.ndarray | None = None, counts: np.ndarray | None = None, hits: np.ndarray | None = None):
        super().__init__(places or {})
        self.codes = np.zeros(0, np.int64) if codes is None else codes
        self.counts = np.zeros(0, np.int64) if counts is None else counts
        self.hits = np.zeros(0, np.int64) if hits is None else hits
        #: Numbers from this one on are first bytes of spelled words.
        self.first_spelled = 2 + sum(not w.startswith(b" ") for w in self)

    def __missing__(self, word: bytes) -> int:
        return self.get(b" " + word[:1], 1)

    def __reduce__(self):
        return Vocabulary, (dict(self), self.codes, self.counts, self.hits)


def size_of(places: dict[bytes, int]) -> int:
    return max(VOCABULARY, -(-(len(places) + 2) // GROUP) * GROUP)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of three symbols in a row: each byte of a word after its first, and its end, after the two before; word of each."""
    row = _SYMBOL[np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)].astype(np.int64)
    ends = np.flatnonzero(row == 0)
    owner = np.cumsum(row == 0) - 1  # each word stands behind its own zero
    at = np.arange(len(row))
    codes = np.zeros(len(row), np.int64)
    codes[2:] = (row[:-2] * SYMBOLS + row[1:-1]) * SYMBOLS + row[2:]
    owner[ends] -= 1  # an end belongs to the word before it
    use = at > ends[owner] + 1
    use[0] = False
    return codes[use], owner[use]


class Spelling:
    """ln P of the bytes of a spelled word after its first, from counts of three in a row, backed off to two and one."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        n = np.bincount(codes, counts, SYMBOLS**3).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        one, two = n.sum((0, 1)), n.sum(0)
        p = (one + 1) / (one.sum() + SYMBOLS)
        p = (two + 5 * p) / (two.sum(1, keepdims=True) + 5)
        p = (n + 5 * p) / (n.sum(2, keepdims=True) + 5)
        self.table = np.log(p).astype(np.float32).ravel()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        codes, owner = spelled(words)
        return np.bincount(owner, self.table[codes], len(words))


def in_a_row(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    at = np.arange(len(owner)) + REACH * (owner + 1)
    ids = np.zeros(len(owner) + REACH * (len(texts) + 1), np.int32)
    ids[at] = np.concatenate(texts) if texts else 0
    return ids, at, owner


def neighbours(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([ids[at + d] for d in range(-REACH, REACH + 1) if d], axis=1)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Numbers of the most frequent words of all texts (ties: by bytes), and what all other words are spelled with.

    Every word is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        counts: Counter = Counter()
        for piece in slices(batches, "text"):
            for text in piece.column(0).cast(pa.binary()).to_pylist():
                counts.update(words_of(text))
            if len(counts) > _HELD:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for piece in slices(batches, "word"):
            codes, owner = spelled(piece.column(0).to_pylist())
            np.add.at(total, codes, piece.column(1).to_numpy()[owner])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    counted = texts_of(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted)
    distinct = counted.count()
    most = max(VOCABULARY - 2, int(GROWTH * distinct**0.5))
    top = counted.orderBy(F.desc("n"), "word").limit(most).collect()
    places = {bytes(r["word"]): i + 2 for i, r in enumerate(top)}
    hits = [0, 0, *(r["n"] for r in top)]
    if distinct <= most:
        return Vocabulary(places, hits=np.array(hits))
    n, word = F.lit(top[-1]["n"]), F.lit(bytes(top[-1]["word"]))
    rest = counted.where((F.col("n") < n) | (F.col("n") == n) & (F.col("word") > word))
    for r in rest.groupBy(F.substring("word", 1, 1).alias("first")).agg(F.sum("n").alias("n")).orderBy("first").collect():
        places[b" " + bytes(r["first"])] = len(places) + 2
        hits.append(r["n"])
    parts = rest.mapInArrow(spell, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    found = parts.orderBy("code").toArrow()
    return Vocabulary(places, found["code"].to_numpy(), found["n"].to_numpy(), np.array(hits))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text")).where("text is not null")


def coded(docs: DataFrame, places: Vocabulary, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep``, ids and spelled: the numbers of each text's words, and the summed ln P of how its spelled words go on."""
    shared = docs.sparkSession.sparkContext.broadcast(places)
    made: list[Spelling] = []

    def work(texts):
        known = shared.value
        if not made:
            made.append(Spelling(known.codes, known.counts))
        ids, sums = [], []
        for text in texts:
            words = words_of(text)
            row = np.array(list(map(known.__getitem__, words)), "<i4")
            rare = np.flatnonzero((row >= known.first_spelled) | (row == 1)).tolist()
            ids.append(row.tobytes())
            sums.append((len(rare), [words[i] for i in rare]))
        owner = np.repeat(np.arange(len(texts)), [n for n, _ in sums])
        scores = made[0]([w for _, words in sums for w in words]) if len(owner) else None
        return [ids, np.bincount(owner, scores, len(texts)).astype(float)]

    return map_texts(docs, work, [("ids", T.BinaryType()), ("spelled", T.DoubleType())], keep)


def encoded(docs: DataFrame, places: Vocabulary, keep: tuple[str, ...] = ()) -> DataFrame:
    """(group, ids, spelled) and ``keep`` of each text that isn't null, in groups that depend on nothing but the texts."""
    length = texts_of(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-length // max(LEAST_TEXT, TEXT_FOR_WEIGHTS * Network(size=size_of(places)).flat.nbytes)))
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("hash"), *keep).where("text is not null")
    made = coded(rows, places, ("hash", *keep)).withColumn("group", F.pmod("hash", F.lit(groups)).cast("int"))
    dealt = made.repartition(min(groups, max(shuffle_width(docs.sparkSession), groups // 16)), "group")
    return materialise(dealt.sortWithinPartitions("group", "hash").select("group", "ids", "spelled", *keep))


def train(docs: DataFrame, places: Vocabulary, passes: int = PASSES) -> np.ndarray:
    """Weights of a network trained on masked positions of all texts."""
    return fit(encoded(docs, places), places, passes)


def fit(texts: DataFrame, places: Vocabulary, passes: int = PASSES) -> np.ndarray:
    """Weights of a network trained on masked positions of all texts, as :func:`encoded` deals them.

    Texts are dealt to groups by a hash.  In each pass the gradient is followed over each group's own texts
    from the common weights; the results are averaged by their number of positions in a tree of
    reductions, so neither a task nor the driver ever holds more than a few copies of the weights.  How many
    partitions the input has makes no difference but for rounding.  A text's positions are masked in turn: pass t has
    each ``passes``-th one, so that after the last pass each was a target once.
    """
    sc = texts.sparkSession.sparkContext
    size = size_of(places)
    net = Network(size=size)
    if len(places.hits):
        net.count(places.hits)
    flat = net.flat
    texts = texts.select("group", "ids")
    for turn in range(passes):
        shared = sc.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            group, learner = None, None
            for piece in slices(batches, "ids"):
                of = piece.column(0).to_numpy()
                for a, b in zip(*_runs_of(of), strict=True):
                    if of[a] != group:
                        if learner is not None and learner.seen:
                            yield learner.result()
                        group, learner = of[a], Learner(shared.value, size)
                    blobs = piece.column(1).slice(a, b - a).to_pylist()
                    ids, at, owner = in_a_row([np.frombuffer(x, "<i4") for x in blobs])
                    at = at[targets_of(blobs, owner, passes) == turn]
                    learner.add(neighbours(ids, at), ids[at])
            if learner is not None and learner.seen:
                yield learner.result()

        parts = texts.mapInArrow(run, "w binary, n long")
        weighed = parts.rdd.map(lambda r: (np.frombuffer(r["w"], np.float32), r["n"]))
        n_parts = weighed.getNumPartitions()
        nothing = (np.zeros(1, np.float32), 0)
        total, seen = weighed.treeAggregate(nothing, _add, _add, depth=2 if n_parts < 1000 else 4)
        if not seen:
            break
        flat = total
    return flat


def _runs_of(x: np.ndarray) -> tuple[list[int], list[int]]:
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]).tolist() if len(x) else []
    return starts, [*starts[1:], len(x)][: len(starts)]


class Learner:
    """Follows the gradient over the positions of one group, with a rate for each weight by its past slopes."""

    def __init__(self, flat: np.ndarray, size: int):
        self.net = Network(flat.copy(), size=size)
        every = [*self.net.near, *(x for layer in self.net.layers for x in layer)]
        self.squares = {x.__array_interface__["data"][0]: np.full_like(x, 1e-6) for x in every}
        self.seen = self.done = self.waiting = 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, context: np.ndarray, target: np.ndarray) -> None:
        self.held.append((context, target))
        self.seen += len(target)
        self.waiting += len(target)
        if self.waiting >= self.step():
            self.learn(False)

    def step(self) -> int:
        return min(LARGEST, max(BATCH, self.done // 8))

    def learn(self, last: bool) -> None:
        context = np.concatenate([x for x, _ in self.held])
        target = np.concatenate([y for _, y in self.held])
        i = 0
        while i < len(target) and (last or len(target) - i >= self.step()):
            j = min(len(target), i + self.step())
            for weights, rows, g in self.net.slopes(context[i:j], target[i:j], False):
                past = self.squares[weights.__array_interface__["data"][0]]
                now = past[rows] + g * g
                past[rows] = now
                weights[rows] -= RATE * g / np.sqrt(now)
            self.done += j - i
            i = j
        self.held = [(context[i:], target[i:])]
        self.waiting = len(target) - i

    def result(self) -> pa.RecordBatch:
        self.learn(True)
        return pa.RecordBatch.from_arrays([pa.array([self.net.flat.tobytes()], pa.binary()), pa.array([self.seen], pa.int64())], ["w", "n"])


def _add(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """Mean of two networks by their numbers of positions."""
    n = a[1] + b[1]
    if not (a[1] and b[1]):
        return a if a[1] else b
    return (a[0] + (b[0] - a[0]) * np.float32(b[1] / n)).astype(np.float32), n


def targets_of(texts: list[bytes], owner: np.ndarray, passes: int) -> np.ndarray:
    """The pass that has each position as a target."""
    first = np.searchsorted(owner, np.arange(len(texts)))
    offset = np.array([zlib.crc32(t) for t in texts], np.int64)
    return (np.arange(len(owner)) - first[owner] + offset[owner]) % passes


def score(docs: DataFrame, places: Vocabulary, flat: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep``, n_tokens and pll, the summed ln P of every word (spelled ones: with their spelling) given both sides."""
    return likelihoods(coded(docs, places, keep), places, flat, keep)


def likelihoods(texts: DataFrame, places: Vocabulary, flat: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """:func:`score` of texts by their ids and spelled; copies that stand together are gone through once."""
    shared = texts.sparkSession.sparkContext.broadcast(flat)
    size = size_of(places)
    chosen = texts.select("ids", "spelled", *keep)
    schema = T.StructType([*chosen.schema.fields[2:], T.StructField("n_tokens", T.LongType()), T.StructField("pll", T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value, size=size)
        for piece in slices(batches, "ids"):
            blobs = piece.column(0).to_pylist()
            place = {x: i for i, x in enumerate(dict.fromkeys(blobs))}
            ids, at, owner = in_a_row([np.frombuffer(x, "<i4") for x in place])
            lp = np.zeros(len(at))
            for i in range(0, len(at), 1 << 15):
                part = at[i : i + (1 << 15)]
                lp[i : i + len(part)] = net.log_probabilities(neighbours(ids, part), ids[part])
            mine = [place[x] for x in blobs]
            n = np.bincount(owner, minlength=len(place))[mine]
            pll = np.bincount(owner, lp, len(place))[mine] + piece.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*piece.columns[2:], pa.array(n, pa.int64()), pa.array(pll, pa.float64())], names=names)
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return chosen.mapInArrow(run, schema)


def pseudo_likelihood(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """Per document: doc_id, n_tokens, pll (masked pseudo-log-likelihood), mean_pll (by token; null without).

    Vocabulary and network are made from all texts of ``docs`` itself.  Null and empty texts: 0 tokens,
    pll 0.  Repeated rows each get their score, and count as often in training.
    """
    places = vocabulary(docs)
    texts = encoded(docs, places, ("doc_id",))
    scored = likelihoods(texts, places, fit(texts, places, passes), ("doc_id",))
    none = docs.where("text is null").select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("pll"))
    out = scored.unionByName(none)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(
        "mean_pll", F.col("pll") / F.nullif(F.col("n_tokens"), F.lit(0))
    )
