"""Cases in which an operator once did less than its whole job."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlens.llm import decontaminate, html, language, lm, mixing, repeats
from fluxlens.llm.common import words_of

# language model


def test_every_word_counts(spark):
    rng = np.random.default_rng(6)
    rare = lambda: "".join(rng.choice(list("bcdfgk"), 6))
    rows = [(i, " ".join([rare() for _ in range(300)] + ["the", "of"] * 100)) for i in range(60)]
    rows += [(900, "the of kgfdcg"), (901, "the of kqzqzq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places = lm.vocabulary(docs)
    distinct = {w for _, t in rows for w in words_of(t.encode())}
    whole = [w for w in places if not w.startswith(b" ")]
    assert len(whole) == max(1022, int(lm.GROWTH * len(distinct) ** 0.5)) and len(distinct) > 10_000
    assert all(places.get(w) or places.get(b" " + w[:1]) for w in distinct)
    got = {r["doc_id"]: r["pll"] for r in lm.pseudo_likelihood(docs).collect()}
    assert got[901] < got[900] - 0.5  # both words occur once and begin alike, but one is spelled like no other


def test_spelling_is_a_distribution():
    words = [b"abc", b"abd", b"b", b"\xc3\xa9a"]
    codes, owner = lm.spelled(words)
    assert np.bincount(owner).tolist() == [3, 3, 1, 3]
    model = lm.Spelling(*np.unique(codes, return_counts=True))
    assert np.allclose(np.exp(model.table.reshape(-1, lm.SYMBOLS)).sum(1), 1, atol=1e-4)
    assert model(words)[0] > model([b"axc"])[0] and len(model([])) == 0


def test_each_position_is_a_target_once():
    texts, owner = [b"x", b"y", b"z"], np.repeat([0, 2], [5, 4])
    turns = lm.targets_of(texts, owner, 2)
    assert all(len(set(turns[a:b].tolist())) == 2 for a, b in ((0, 2), (5, 7))) and set(turns.tolist()) == {0, 1}


def test_deep_network():
    rng = np.random.default_rng(0)
    size = 1600
    net = lm.Network(lm.Network(size=size).flat.astype(float) * 4, size=size)
    assert len(net.layers) == 3
    context, target = rng.integers(0, size, (40, 2 * lm.REACH)), rng.integers(0, size, 40)
    g = net.gradient(context, target)
    for i in np.r_[np.argsort(-np.abs(g))[:8], rng.integers(0, len(g), 5)]:
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (lm.Network(down, size=size).log_probabilities(context, target).mean() - lm.Network(up, size=size).log_probabilities(context, target).mean()) / 2e-4
        assert abs(slope - g[i]) < 1e-6


# repeated passages


def test_anchors_beyond_24_bits():
    """A passage's piece doesn't depend on where in a text it stands, not behind 16 MiB either."""
    rng = np.random.default_rng(7)
    passage = rng.integers(97, 123, 400).astype(np.uint8).tobytes()
    long = rng.integers(97, 123, (1 << 24) + 5000).astype(np.uint8).tobytes()
    ids = np.zeros(1, np.int64)
    alone = repeats.anchored([passage], ids, ids)
    want = {(bytes(passage[a + k : a + k + repeats.ANCHOR]), int(a)) for a, k in zip(alone.lo.tolist(), alone.anchor.tolist(), strict=True)}
    behind = repeats.anchored([long + passage], ids, ids)
    assert (behind.anchor >= 0).all() and (behind.anchor <= repeats.PLACES - 1 + behind.size).all()
    last = np.flatnonzero(behind.lo > len(long))
    got = {(bytes(passage[a - len(long) + k : a - len(long) + k + repeats.ANCHOR]), int(a - len(long))) for a, k in zip(behind.lo[last].tolist(), behind.anchor[last].tolist(), strict=True)}
    assert len(got) > 5 and got <= want


def test_blocks_of_anchors(monkeypatch):
    h = np.random.default_rng(8).integers(0, 1 << 63, 3000).astype(np.uint64)
    monkeypatch.setattr(repeats, "_PLACE", np.uint64(0xFF))
    high = h >> np.uint64(8)
    want = [a + int(np.argmin(high[a : a + repeats.PLACES])) for a in range(3000 - repeats.PLACES + 1)]
    assert repeats.anchors(h).tolist() == want
    assert len(repeats.anchors(h[: repeats.PLACES - 1])) == 0


# mixing


def test_rates_are_converged(spark):
    rng = np.random.default_rng(12)
    n, z = rng.integers(50, 800, 3000).astype(float), rng.normal(0, 1.2, (3000, 3))
    z[np.arange(3000), rng.choice(3, 3000, p=[0.5, 0.35, 0.15])] += 4
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    df = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n double, p array<double>").cache()
    goal = np.array([0.9, 0.1, 0.0]) * n.sum()
    weigh = np.linalg.inv((p * n[:, None]).T @ p)
    cost = lambda r: (e := (r * n) @ p - goal) @ weigh @ e
    steps = mixing.fit_rates(df, F.col("n"), F.col("p"), goal.tolist())
    got = np.array([x[0] for x in df.select(mixing.rate(F.col("p"), steps)).collect()])
    # no rate can be bettered: the slope of the whole aim is 0, or not below 0 where the rate is 0
    slope = p @ (weigh @ ((got * n) @ p - goal)) + mixing.EVEN * (got - 1)
    assert np.abs(slope[got > 0]).max() < 1e-4 and slope[got == 0].min() > -1e-4
    best = rates_by_dual(n, p, goal, mixing.EVEN)
    assert np.abs(got - best).max() < 0.05 and np.abs((got * n) @ p - (best * n) @ p).max() < 1e-4 * n.sum()
    aim = lambda r: cost(r) + mixing.EVEN * (n * (r - 1) ** 2).sum()
    assert aim(best) <= aim(got) + 1e-9 <= aim(np.ones(3000)) / 5
    assert len(steps) > mixing.SPAN  # rates were written in between


def rates_by_dual(n, p, goal, even):
    """max(0, 1 - x'p) with the x that Newton's method finds on the dual: three numbers, to a slope of 1e-10 of the tokens."""
    weigh, x = np.linalg.inv((p * n[:, None]).T @ p), np.zeros(p.shape[1])
    gram = np.linalg.inv(weigh)

    def look(x):
        r = np.maximum(0, 1 - p @ x)
        value = even / 2 * x @ gram @ x + (n * r * r).sum() / 2 + x @ goal
        return value, even * gram @ x - (n * r) @ p + goal, even * gram + (p * (n * (r > 0))[:, None]).T @ p

    for _ in range(200):
        value, slope, bend = look(x)
        if np.abs(slope).max() <= 1e-10 * n.sum():
            break
        move, part = -np.linalg.solve(bend, slope), 1.0
        while look(x + part * move)[0] > value + 1e-4 * part * (slope @ move) and part > 1e-12:
            part /= 2
        x = x + part * move
    return np.maximum(0, 1 - p @ x)


def test_mixing_stage_keeps_what_is_not_toxic(spark, monkeypatch, tmp_path):
    import corpus_pipeline as cp

    rows = [(1, 0.9, 0.05, 0.05, 0.0), (2, 0.3, 0.3, 0.4, 0.7), (3, 0.2, 0.5, 0.3, 0.0)]
    monkeypatch.setattr(cp, "mix", lambda docs, labels, keep: docs)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, p_good double, p_poor double, p_toxic double, rate double")
    assert sorted(r["doc_id"] for r in cp.mix_to_targets(spark, docs, str(tmp_path)).collect()) == [1, 3]


# html


def test_text_dives_where_the_window_is_empty():
    line = lambda n, linked=0: html.Line("x" * n, False, linked)
    lines = [line(4), line(9, 9), line(0), line(0), line(100), line(20, 20), line(30), line(0), line(0), line(0), line(8)]
    assert html.main_lines(lines).tolist() == [False] * 4 + [True] * 3 + [False] * 4
    assert html.main_text(f"<p>{'x' * 100}</p><p><a href=/>all linked</a></p><p>short end</p>".encode()).endswith("all linked short end")


def test_windows_by_hand():
    rng = np.random.default_rng(3)
    unlike = 0
    for _ in range(600):
        n = int(rng.integers(0, 30))
        sizes = rng.choice([1, 3, 40, 90], n)
        lines = [html.Line("x" * int(k), bool(rng.random() < 0.7) and n % 2 == 0, int(k) * bool(rng.random() < 0.6)) for k in sizes]
        marked = any(x.inside for x in lines)
        places = [i for i in range(n) if lines[i].inside or not marked]
        weight = [len(lines[i].text) - lines[i].linked for i in places]
        sums = [sum(weight[i : i + html.WINDOW]) for i in range(len(places))]
        surge = min(html.MARKED if marked else html.SURGE, max(sums, default=0))
        want, at, on = [False] * n, 0, False
        while surge and at < len(places):
            if not on and sums[at] >= surge:
                while weight[at] < (1 if marked else surge / html.WINDOW):
                    at += 1
                on = True
            on = on and sums[at] > 0
            want[places[at]] = on
            at += 1
        assert html.main_lines(lines).tolist() == want
        unlike += marked and want != [x.inside for x in lines]
    assert unlike > 100  # the mark bounds the search, it doesn't settle it


def test_links_within_the_article_are_no_text():
    links = "".join(f'<li><a href="/{i}">more about {i}</a></li>' for i in range(5))
    page = f"<article><p>{'One long sentence. ' * 9}</p><ul>{links}</ul><p>The end of it all.</p></article><p>{'outside ' * 30}</p>"
    assert html.main_text(page.encode()) == "One long sentence. " * 9 + "The end of it all."
    assert html.main_text(b"<ul><li>Home</li><li>News</li><li>Shop</li><li>About</li></ul><p>" + b"body text " * 20 + b"</p>") == ("body text " * 20).strip()


def test_names_of_paragraphs_drop_no_text_of_the_article():
    page = '<article><p class="banner">The banner hung over the street.</p><p class="side" id="menu">Side notes on art</p><div class="banner">buy</div></article>'
    assert html.main_text(page.encode()) == "The banner hung over the street. Side notes on art"


def test_malformed_pages_take_linear_time():
    began = time.time()
    for bad in ("<a" * 500_000, '<x ">" ' * 50_000, "</script " * 50_000, "<b>" * 50_000 + "<p>" * 1000, "<div>" * 50_000 + "</p>" * 50_000, "<!--" * 99_999):
        html.main_text(bad.encode())
    assert time.time() - began < 10


def test_one_class_word_drops_no_text_of_the_article():
    page = '<article><div class="two side"><p>one</p></div><div class="post tags"><p>two</p></div><div class="ad">no</div><p>three</p></article>'
    assert html.main_text(page.encode()) == "one two three"


# language


def test_predictions_by_hand(spark):
    rng = np.random.default_rng(4)
    word = lambda letters: "".join(rng.choice(list(letters), int(rng.integers(1, 6))))
    rows = [(i, " ".join(word("abcde" if i % 2 else "cdefgé") for _ in range(12)), "xy"[i % 2]) for i in range(60)] + [(90, "किताब की", "hi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    known = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    langs = sorted({x for _, x in known})
    counts = {(x, n): {} for x in langs for n in range(5)}
    for t, x in known:
        for w in language.letters_of(t.encode()):
            for n in range(5):
                for g in [w] if n == 0 else language.grams_of(w, n):
                    counts[x, n][g] = counts[x, n].get(g, 0) + 1
    total = {k: sum(c.values()) for k, c in counts.items()}

    def chance(x, n, g):
        return np.log(counts[x, n].get(g, 0) / max(1, total[x, n]) + language.ALPHA / max(1, sum(total[y, n] for y in langs)))

    for i, t, _ in rows:
        sums = {x: 0.0 for x in langs}
        for w in language.letters_of(t.encode()):
            use = [(0, w)]
            if not any(w in counts[x, 0] for x in langs):
                use = next(([(n, g) for g in language.grams_of(w, n) if any(g in counts[x, n] for x in langs)] for n in (4, 3, 2, 1)
                            if any(g in counts[x, n] for x in langs for g in language.grams_of(w, n))), [])
            for x in langs:
                sums[x] += sum(chance(x, n, g) for n, g in use) / max(1, len(use))
        best = max(langs, key=lambda x: sums[x])
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - 1 / sum(np.exp(s - sums[best]) for s in sums.values())) < 1e-6
    assert language.letters_of("किताब की".encode()) == ["किताब", "की"]


def test_entries_are_listed_with_all_their_counts(spark, monkeypatch):
    monkeypatch.setattr(language, "WORDS", 3)
    monkeypatch.setattr(language, "GROWTH", 0)
    counts = [("x", 0, f"w{i}", 100 - 10 * i) for i in range(8)] + [("y", 0, "w7", 50), ("y", 0, "v", 1)]
    df = spark.createDataFrame(counts, "lang string, n int, gram string, hits long")
    chosen = {r["gram"] for r in language.listed(df).collect()}
    assert {"w0", "w1", "w2", "w7"} <= chosen and "w5" not in chosen
    monkeypatch.setattr(language, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        language.listed(df)


# mixing


def test_totals_meet_the_targets(spark):
    rng = np.random.default_rng(13)
    n, p = rng.integers(50, 800, 2000).astype(float), rng.dirichlet([1, 0.6, 0.3], 2000)
    df = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n double, p array<double>").cache()
    goal = np.array([0.55, 0.3, 0.15]) * n.sum()
    r = np.array([x[0] for x in df.select(mixing.rate(F.col("p"), mixing.fit_rates(df, F.col("n"), F.col("p"), goal.tolist()))).collect()])
    assert (r >= 0).all() and np.abs((r * n) @ p - goal).max() < 1e-3 * goal.sum()


# language model


def test_partitions_make_no_difference(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 60) % 500)) for i in range(200)], "doc_id long, text string")
    got = [{r["doc_id"]: r["pll"] for r in lm.pseudo_likelihood(docs.repartition(k)).collect()} for k in (1, 7)]
    assert max(abs(got[0][i] - got[1][i]) for i in got[0]) < 1e-2


def test_scores_need_no_text(spark):
    """They come from the numbers that training used; copies and texts that are null or empty have theirs."""
    rows = [(i, f"one two {i} three") for i in range(20)] + [(30, None), (31, "")]
    docs = spark.createDataFrame(rows + [(40, rows[3][1])], "doc_id long, text string")
    out = lm.pseudo_likelihood(docs)
    assert "text_in" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 23 and got[40]["pll"] == got[3]["pll"] < 0 and got[3]["n_tokens"] == 4
    assert got[30]["pll"] == got[31]["pll"] == got[30]["n_tokens"] == got[31]["n_tokens"] == 0


def test_nodes_are_worked_out_together(monkeypatch):
    """One pass over the outputs of all nodes of a digit, the same as node by node."""
    calls = []

    def noted(*args, **kw):
        calls.append(1)
        return exp(*args, **kw)

    exp = np.exp
    rng = np.random.default_rng(1)
    net = lm.Network(size=5056)
    context, target = rng.integers(0, 5056, (3000, 2 * lm.REACH)), rng.integers(0, 5056, 3000)
    monkeypatch.setattr(np, "exp", noted)
    got = net.log_probabilities(context, target)
    assert len(calls) <= 2 * len(net.steps)
    h = net.hidden(context)
    for i in range(0, 3000, 100):
        whole = 0.0
        for step, (w, b) in zip(net.steps, net.layers, strict=True):
            node, digit = target[i] // step, target[i] % step // (step // lm.GROUP)
            x = b[node] + (h[i] @ w[node] if node < len(w) else 0)
            whole += x[digit] - np.log(exp(x).sum())
        assert abs(got[i] - whole) < 1e-4


def test_chances_far_out():
    """Outputs beyond what float32 can raise e to."""
    x = np.array([[300.0] + [0] * 31, [-300] * 32, [1] * 32], np.float32)
    low, e, sums = lm._powers(x)
    assert np.isfinite(e).all() and np.allclose(low[:, 0] - np.log(sums), [0, -np.log(32), -np.log(32)], atol=1e-5)


# decontamination


def test_item_ids_are_text(spark):
    docs = spark.createDataFrame([(1, "x one two three y")], "doc_id long, text string")
    bench = spark.createDataFrame([("b-1", "one two"), ("a", "three")], "item_id string, text string")
    out, c = decontaminate.search_benchmark(docs, bench, keep=("doc_id",), most_windows=1)
    assert out.first()[c]["items"] == ["a", "b-1"] and "MapInArrow" in out._jdf.queryExecution().toString()


# near copies


def test_near_copies_are_linked(spark):
    from fluxlens.llm import simhash

    rng = np.random.default_rng(21)
    rows, base = [], {}
    for g in range(40):
        words = [f"w{int(x)}" for x in rng.integers(0, 5000, 300)]
        for c in range(3):
            edited = list(words)
            for at in rng.choice(300, 3, replace=False) if c else ():  # a similarity of about 0.9 in five words
                edited[at] = f"x{int(rng.integers(0, 9999))}"
            base[len(rows)] = g
            rows.append((len(rows), " ".join(edited)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, rows[0][1])]
    docs = spark.createDataFrame(rows, "key long, text string")
    root = {r["key"]: r["root"] for r in simhash.near_copies(docs, "key").collect()}
    linked = [root.get(i, i) for i in range(120)]
    assert all(base[linked[i]] == g for i, g in base.items())  # no two groups meet
    caught = sum(linked[i] != i for i in range(120))
    assert caught >= 0.9 * 80 and root[1003] == root.get(0, 0) and root[1001] == 1000 and 1002 not in root
    assert simhash.near_copies(docs.limit(0), "key").count() == 0
    for text in (b"a b c d e", b"", None):
        assert simhash.fingerprints_of(text, 3, 8)[0] == simhash.fingerprint(text)


def test_similar_sets_against_brute_force(spark):
    from fluxlens.llm import simhash

    rng = np.random.default_rng(4)
    texts = [None, "", " ", "One two", "one  TWO", "one three"]
    for _ in range(6):
        words = [f"w{int(x)}" for x in rng.integers(0, 40, 80)]
        for edits in (0, 1, 2, 3, 4):
            texts.append(" ".join(w + "x" * bool(i in set(range(7, 7 + 12 * edits, 12))) for i, w in enumerate(words)))
    shingled = [p and {tuple(p[i : i + 5]) for i in range(max(1, len(p) - 4))} for p in ((t or "").lower().split() for t in texts)]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    want = {(a, b) for a, b in pairs if len(x := set(shingled[a])) + len(y := set(shingled[b])) == 0 or len(x & y) / len(x | y) >= 0.8}
    sets = spark.createDataFrame([(k, simhash.shingle_hashes(t and t.encode(), 5)) for k, t in enumerate(texts)], "key long, hashes array<long>")
    got = simhash.alike(spark.createDataFrame(pairs, "a long, b long"), sets, 0.8).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) and 6 < len(want) < len(pairs)
