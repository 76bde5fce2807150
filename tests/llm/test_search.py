"""Exact top-k, SimHash groups, repeated passages, decontamination: against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from fluxlens.llm import decontaminate, repeats, simhash, topk
from fluxlens.llm.common import components, words_of
from fluxlens.llm.suffixes import common_prefixes, suffix_array

DOCS = "doc_id long, text string, spans string, fp long, found string, key string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 5, None, "y") for i, t in rows], DOCS)


# suffix arrays


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(0, 200))
        s = rng.integers(0, int(rng.integers(1, 6)), n).astype(np.uint8) * int(rng.integers(1, 60))
        b = s.tobytes()
        order = sorted(range(n), key=lambda i: b[i:])
        assert suffix_array(s).tolist() == order
        cut = suffix_array(s, 9).tolist()
        assert [b[i : i + 9] for i in cut] == sorted(b[i : i + 9] for i in range(n))
        if n > 1:
            p = common_prefixes(s, np.array(order), 20)
            for x, y in zip(order, order[1:], strict=False):
                k = 0
                while k < 20 and max(x, y) + k < n and b[x + k] == b[y + k]:
                    k += 1
                assert p[y] == k
    assert suffix_array(np.zeros(5000, np.uint8)).tolist() == list(range(4999, -1, -1))


# repeated passages


def repeats_by_hand(rows):
    first = {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows if i is not None):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k + 1 : k + 51] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(rng, n):
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 8))))
    common = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(int(rng.integers(0, 40)))) for _ in range(2)]
        for c in common:
            if rng.random() < 0.4:
                a = int(rng.integers(0, 60))
                parts.insert(int(rng.integers(0, len(parts) + 1)), c[a : a + int(rng.integers(45, 90))])
        rows.append((int(rng.integers(0, n)), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,shard,parts", [(1, 1 << 20, 1), (2, 2000, 5)])
def test_repeats(spark, monkeypatch, seed, shard, parts):
    rng = np.random.default_rng(seed)
    rows = passages(rng, 120)
    rows += [(5, None), (None, rows[0][1] * 3), (7, ""), (1000, rows[3][1]), (1000, rows[3][1]), (1001, "ab" * 3000), (1002, "ab" * 40)]
    monkeypatch.setattr(repeats, "SHARD", shard)
    got = repeats.repeat_digest(docs_of(spark, rows).repartition(parts))
    assert sorted(map(tuple, got.collect()), key=str) == repeats_by_hand(rows)


def test_repeats_of_nothing(spark):
    assert repeats.repeat_digest(docs_of(spark, [])).count() == 0
    out, c = repeats.without_repeats(docs_of(spark, [(1, "é" * 60), (2, "x" + "é" * 60)]), keep=["doc_id", "spans", "text"], as_text=True)
    kept = {r["doc_id"]: (r["text"], r[c]["kept"]) for r in out.collect()}
    assert kept == {1: ("é" * 60, "é" * 60), 2: ("x" + "é" * 60, "x")}


# near-duplicates


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups_by_hand(rows):
    fps = [fingerprint_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))], key=str)


def test_simhash(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(25):
        words = [f"W{int(x)}" for x in rng.integers(0, 500, int(rng.integers(1, 300)))]
        for _ in range(int(rng.integers(1, 6))):
            edited = list(words)
            edited[int(rng.integers(0, len(edited)))] = "neu\tü"
            rows.append((int(rng.integers(0, 10_000)), " ".join(edited)))
    rows += [(3, None), (9, ""), (8, " \n"), (None, "a b c"), (4, "A b c"), (4, "A b c"), (None, "only me"), (12, "x" * 50_000)]
    got = simhash.simhash_groups(docs_of(spark, rows))
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()], key=str) == groups_by_hand(rows)
    assert simhash.simhash_groups(docs_of(spark, [])).count() == 0


def test_links_of_a_crowded_cell(spark):
    rng = np.random.default_rng(4)
    fps = {0x0F0F0F0F0F0F0F0F}
    for _ in range(400):
        x = int(rng.choice(list(fps)))
        for b in rng.integers(0, 63, int(rng.integers(1, 5))):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = simhash.links(df).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 3 for r in found)
    got = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    root = {x: x for x in fps}
    for _ in fps:
        changed = False
        for x in fps:
            m = min(root[y] for y in fps if (x ^ y).bit_count() <= 3)
            changed |= m < root[x]
            root[x] = min(root[x], m)
        if not changed:
            break
    assert {x: got.get(x, x) for x in fps} == root


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 3), (3, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(61)}
    assert components(edges.limit(0)).count() == 0


# decontamination


def contamination_by_hand(docs, items, window=10):
    out = []
    for d, t in docs:
        words, hit, found = words_of((t or "").encode()), set(), set()
        for i, x in items:
            iw = words_of((x or "").encode())
            if i is None or not iw:
                continue
            n = min(window, len(iw))
            wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(i)
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [200_000, 7])
def test_decontamination(spark, most):
    rng = np.random.default_rng(6)
    text = lambda n, k=6: " ".join(f"w{int(x)}" for x in rng.integers(0, k, n))
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(12)] + [(11, "W1 w1, W1"), (50, ""), (51, None), (None, "w1"), (60, "ÀB c"), (61, "ÀB c")]
    docs = [(i, text(int(rng.integers(0, 300)))) for i in range(40)]
    docs += [(40, None), (41, ""), (None, items[0][1]), (42, items[3][1].upper() + "!"), (42, items[3][1]), (43, "x Àb-C x " + text(5000, 3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, c = decontaminate.search_benchmark(docs_of(spark, docs), bench, keep=("doc_id",), most_windows=most)
    import pyspark.sql.functions as F

    hits = F.aggregate(F.col(c)["spans"], F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform(F.col(c)["items"], lambda x: x.cast("string"))), ",")
    got = found.select("doc_id", F.col(c)["n_words"], hits, F.size(F.col(c)["items"]), F.sha2(ids, 256), hits > 0)
    assert sorted(map(tuple, got.collect()), key=str) == contamination_by_hand(docs, items)
    if most > 7:
        got = decontaminate.contamination(docs_of(spark, docs), bench)
        assert sorted(map(tuple, got.collect()), key=str) == contamination_by_hand(docs, items)
        assert decontaminate.contamination(docs_of(spark, docs[:2]), bench.limit(0)).where("n_hit > 0").count() == 0
        assert decontaminate.contamination(docs_of(spark, []), bench).count() == 0


# exact top-k

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.StringType())])


def top_by_hand(rows, k):
    whole = {}
    for i, e, _ in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            whole.setdefault(i, [int(np.floor(1024 * float(np.float32(x)))) for x in e])
    out = []
    for q, qe in whole.items():
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(qe, e, strict=False)), i) for i, e in whole.items() if i != q)
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.2, 8)).astype(np.float32).tolist(), "v") for i in range(700)]
    rows += [(i, rows[100][1], "v") for i in range(1000, 1300)]  # one very common vector
    rows += [(2000, None, "v"), (2001, [float("nan")] * 8, "v"), (2100, [None] * 8, "v"), (None, rows[0][1], "v"), (2200, [0.0] * 8, "v"),
             (2300, [1.0, -2.0], "v"), (2400, [], "v"), (0, rows[0][1], "v")]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, got.collect())) == top_by_hand(rows, 10)
    few = [(100, [1.0, 2.0], "v"), (7, [3.0, 0.5], "v")]
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame(few, VECTORS)).collect()] == [(100, 1, 7, 1024 * 1024 * 4)]
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_products_beyond_doubles():
    big = [2**40, -(2**40), 3]
    v = topk.matrix([big, [1, 1, 1]], 3)
    assert topk.products(topk.matrix([big], 3)[0], v, big, [big, [1, 1, 1]]).tolist() == [2**63 - 1, 3]
