"""Near copies of vectors, vector codes and ranked search: against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from fluxlens.llm import codes, neighbours, ranking, vectors

VECTORS = "vec_id long, embedding array<double>, label int, node string, v int, salt int, code string, root string, copies string"


def table_of(spark, rows):
    """Embeddings with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, e, lab, "n", 1, 2, "c", "r", "k") for i, e, lab in rows], VECTORS)


ODD = [(900, None, 1), (901, [0.0, 0.0, 0.0], None), (902, [1.0, None, 0.0], 1), (903, [float("nan"), 1.0, 0.0], 1), (904, [float("inf"), 1.0, 2.0], 2), (905, [], 3)]


# near copies


def groups_by_hand(rows):
    good = [(i, np.array(e, float)) for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    width = max((len(e) for _, e in good), default=0)
    u = np.zeros((len(good), width))
    for k, (_, e) in enumerate(good):
        u[k, : len(e)] = e / np.abs(e).max()
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    hit = u @ u.T >= 0.9 if len(good) else np.zeros((0, 0), bool)
    np.fill_diagonal(hit, False)
    root = {i: i for i, _ in good}
    while True:
        new = dict(root)
        for a, b in np.argwhere(hit):
            new[good[a][0]] = min(new[good[a][0]], root[good[b][0]])
        if new == root:
            break
        root = new
    out = [(i, int(n), root[i], root[i] == i) for (i, _), n in zip(good, hit.sum(1), strict=True)]
    ids = [i for i, _ in good]
    for i, e, _ in rows:
        if ids and i in ids and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            continue
        out.append((i, 0, i, i is not None))
    return sorted(out, key=str)


def clusters(rng, n, d=16):
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            e = rng.normal(size=d)
        else:
            e = np.array(rows[int(rng.integers(0, max(1, len(rows) // 4)))][1]) + rng.normal(size=d) * rng.choice([0, 0.05, 0.2, 0.3])
        rows.append((int(i), [float(x) for x in e * rng.choice([1e-3, 1, 50])], int(i % 4) if i % 5 else None))
    return rows


@pytest.mark.parametrize("small_parts", [False, True])
def test_near_copies(spark, monkeypatch, small_parts):
    if small_parts:  # every cell in many parts and chunks; heavy classes are broadcast
        monkeypatch.setattr(neighbours, "RESIDENTS", 5)
        monkeypatch.setattr(neighbours, "VISITORS", 9)
        monkeypatch.setattr(vectors, "LEAST", 3)
        monkeypatch.setattr(vectors, "HEAVY", 100)
    rows = clusters(np.random.default_rng(5), 240)
    rows += [(1000 + i, rows[7][1], 1) for i in range(40)] + [rows[3], (None, rows[3][1], 2)] + ODD
    got = neighbours.embedding_groups(table_of(spark, rows)).collect()
    assert got[0].asDict().keys() == {"vec_id", "n_links", "component_id", "kept"}
    assert sorted(map(tuple, got), key=str) == groups_by_hand(rows)


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    points = neighbours.unit(rng.normal(size=(6000, 48)))
    index = neighbours.fit(points[:2000], 16)
    a = points[3000:]
    b = neighbours.partners(a, 0.9, rng)
    found = np.minimum(index.excess(a, b), index.excess(b, a)) <= index.reach
    assert found.mean() >= 0.97
    row, cell = index.visits(a)
    assert np.bincount(row).mean() < 256 / 4  # most cells are not visited
    gaps_a, gaps_b = index.gaps(a)
    whole = (gaps_a[:, :, None] + gaps_b[:, None, :]).reshape(len(a), -1)
    want = np.argwhere(whole <= whole.min(1)[:, None] + index.reach)
    assert abs(len(want) - len(row)) <= 2  # sums at the edge may round either way
    assert (index.home(a)[row] == cell).sum() == len(a)


def test_no_vectors(spark):
    assert neighbours.embedding_groups(table_of(spark, [])).collect() == []
    assert sorted(map(tuple, neighbours.embedding_groups(table_of(spark, ODD)).collect())) == groups_by_hand(ODD)
    assert codes.vector_codes(table_of(spark, [])).collect() == []
    assert codes.vector_codes(table_of(spark, [ODD[0], *ODD[2:5]])).collect() == []


def test_one_component(spark):
    rows = [(1, [2.0], 1), (2, [-1.0], 1), (3, [0.5], 1)]
    assert sorted(map(tuple, neighbours.embedding_groups(table_of(spark, rows)).collect())) == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]


# codes


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    kept = [(i, e, lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = -(-max((len(e) for _, e, _ in kept), default=0) // parts) * parts
    d = width // parts
    whole = [[math.floor(256 * x) for x in e] + [0] * (width - len(e)) for _, e, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[whole[k][p * d : (p + 1) * d] for k in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in whole:
                x = v[p * d : (p + 1) * d]
                held.setdefault(near(x, books[p])[1], []).append(x)
            for j, xs in held.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for (i, _, lab), v in zip(kept, whole, strict=True):
        found = [near(v[p * d : (p + 1) * d], books[p]) for p in range(parts)]
        error = min(sum(g for g, _ in found), 2**63 - 1)
        by_label[lab] += error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, lab))
    return sorted(((i, c, e, min(by_label[lab], 2**63 - 1), digest) for i, c, e, lab in out), key=str)


@pytest.mark.parametrize("labels", [100_000, 0])
def test_codes(spark, monkeypatch, labels):
    monkeypatch.setattr(codes, "LABELS", labels)  # joined by a broadcast, by a shuffle
    rows = clusters(np.random.default_rng(3), 150, 37)
    rows += [rows[5], (None, rows[6][1], None), (2, [1.0, -2.0], 3)] + ODD[:5]
    got = codes.vector_codes(table_of(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == codes_by_hand(rows)


def test_codes_of_few_and_of_huge(spark):
    few = [(5, [0.1, -0.1], 1), (4, [1e300, 3.0], 1), (3, [1e17, 3.0], 1)]
    assert sorted(map(tuple, codes.vector_codes(table_of(spark, few)).collect()), key=str) == codes_by_hand(few)


def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    for spread, d in ((3, 4), (400, 6), (1 << 20, 3), (1 << 26, 8)):
        entries = rng.integers(-spread, spread, (64, d))
        entries[40] = entries[3]  # ties go to the lower index
        x = np.r_[rng.integers(-spread, spread, (500, d)), entries, (entries[:32] + entries[32:]) // 2]
        gaps = ((x[:, None] - entries[None]) ** 2).sum(2)
        index, error, looked = codes.nearest(x, entries)
        assert (index == gaps.argmin(1)).all() and (error == gaps.min(1)).all()
        assert looked < gaps.size / 2


# ranked search


def ranks_by_hand(docs, items, k=20):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) if t else []
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    bags = [b for b in bags if b[2]]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(words(t))
    out = []
    for i, q in asked.items():
        found = []
        for row, (doc, bag, n) in enumerate(bags):
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, c in q.items() if t in bag)
            if s > 0:
                found.append((-s, doc is None, doc or 0, row))
        out += [(i, r + 1, None if none else doc, -s) for r, (s, none, doc, _) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def texts(rng, n):
    word = lambda: str(rng.choice(["Ab", "c1", "dé", "É", "x", "the", "a", "q"])) + (str(rng.integers(0, 60)) if rng.random() < 0.7 else "")
    return [" ".join(word() for _ in range(int(rng.integers(0, 60)))) + str(rng.choice(["", ".", "-z", "\x7f{]"])) for _ in range(n)]


@pytest.mark.parametrize("limits", [(8192, 200_000), (7, 40)])
def test_ranks(spark, monkeypatch, limits):
    monkeypatch.setattr(ranking, "DOCUMENTS", limits[0])  # many shards; several passes, joins by shuffles
    monkeypatch.setattr(ranking, "SMALL", limits[1])
    rng = np.random.default_rng(8)
    made = texts(rng, 150)
    docs = [(i, t) for i, t in enumerate(made)] + [(200 + i, made[3]) for i in range(40)] + [(3, made[3]), (None, made[5]), (7, None), (8, ""), (9, "... --")]
    docs.append((300, "the " * 5000 + made[0]))
    asked = [(i, t) for i, t in enumerate(texts(rng, 12))] + [(2, made[3]), (50, None), (51, ""), (52, "nowhere"), (None, made[3]), (53, "THE the x")]
    d = spark.createDataFrame([(i, t, 1, "s", 2, "p", 3) for i, t in docs], "doc_id long, text string, rank int, term string, n long, shard string, place int").repartition(3)
    q = spark.createDataFrame([(i, t, 1, "s") for i, t in asked], "item_id long, text string, rank int, term string")
    got = ranking.ranked_documents(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranks_by_hand(docs, asked)


def test_ranks_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.ranked_documents(d.limit(0), q).collect() == []
    assert ranking.ranked_documents(d, q.limit(0)).collect() == []
    assert ranking.ranked_documents(d, spark.createDataFrame([(1, "zz")], q.schema)).collect() == []
    # a term that all documents hold weighs ln(4 / 3)
    assert sorted(map(tuple, ranking.ranked_documents(d, q).collect())) == ranks_by_hand([(1, "a b")], [(1, "a b")])


@pytest.mark.parametrize("same", [False, True])
def test_groups_send_few_documents(spark, monkeypatch, same):
    """Documents that can be among the best aren't sent, but the best of them; the same for one partition or many."""
    sent = []

    def kept(df):
        out = keep(df)
        if "score" in out.columns:
            sent.append(out.count())
        return out

    keep = ranking.materialise
    monkeypatch.setattr(ranking, "materialise", kept)
    rng = np.random.default_rng(4)
    docs = [(i, ("a b c" if i % 3 else "z") if same else " ".join(f"t{int(x)}" for x in rng.integers(0, 12, 30))) for i in range(600)]
    asked = [(1, "a b" if same else "t1 t2 t3 t4 t5"), (2, "c" if same else "t6 t7 t8 t1")]
    q = spark.createDataFrame(asked, "item_id long, text string")
    for partitions in (1, 40):
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
        got = ranking.ranked_documents(d, q)
        assert sorted(map(tuple, got.collect()), key=str) == ranks_by_hand(docs, asked)
    assert sent and max(sent) <= 20 * len(asked)


def test_lists_are_cut(spark):
    """Most of a common term's list is never read where rarer terms decide."""
    rng = np.random.default_rng(1)
    docs = [(i, "common " * int(rng.integers(1, 4)) + f"w{i} " * 3 + f"g{i % 10}") for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "g3 common")], "item_id long, text string")
    assert sorted(map(tuple, ranking.ranked_documents(d, q).collect()), key=str) == ranks_by_hand(docs, [(1, "g3 common")])
