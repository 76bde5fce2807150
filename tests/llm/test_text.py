"""Language ID, licenses, HTML, URLs, language model, mixing, pipeline."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlens.llm import html, language, licenses, lm, mixing, urls
from fluxlens.llm.common import words_of

EN = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat daß".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words, n))


def corpus(spark, n=120):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        en = i % 2 == 0
        made = [("ing" if en else "ung") + "abcdefg"[int(rng.integers(7))] + "xyz"[int(rng.integers(3))] for _ in range(4)]
        rows.append((i, sentence(rng, EN if en else DE, 30) + " " + " ".join(made), "en" if en else "de"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


# language


def test_language(spark):
    docs = corpus(spark)
    odd = spark.createDataFrame(
        [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !?", "en"), (1003, "ingaxq ingbyq", None), (1004, "漢字", None), (None, "the of and", "en"), (1005, "²³", None)],
        docs.schema,
    )
    got = {r["doc_id"]: r for r in language.identify(docs.unionByName(odd).withColumn("score", F.lit("x"))).collect()}
    for i in range(120):
        assert got[i]["lang_pred"] == ("en" if i % 2 == 0 else "de") and got[i]["score"] > 0.99
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    for i in (1000, 1001, 1002, 1005):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[1003]["lang_pred"] == "en"  # unseen words, known n-grams
    assert got[1004]["lang_pred"] == "de" and got[1004]["score"] == 0.5
    assert got[None]["lang_pred"] == "en" and got[None]["held_out"] is False
    blank = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in blank.collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0


def test_language_model_is_what_the_counts_say(spark):
    docs = corpus(spark, 30)
    model = language.fit(docs)
    counts, grams = {}, {}
    for r in docs.collect():
        for w in language.letters_of(r["text"].encode()):
            counts[r["lang"], w] = counts.get((r["lang"], w), 0) + 1
            for n in range(1, language.LONGEST + 1):
                for g in language.grams_of(w, n):
                    grams[r["lang"], n, g] = grams.get((r["lang"], n, g), 0) + 1
    total = {x: sum(n for (y, _), n in counts.items() if y == x) for x in ("de", "en")}
    for (lang, w), n in counts.items():
        want = np.log(n / total[lang] + language.ALPHA / sum(total.values()))
        assert abs(model.vectors[model.places[0][w], model.langs.index(lang)] - want) < 1e-9
    for n in range(1, language.LONGEST + 1):
        assert set(model.places[n]) == {g for _, k, g in grams if k == n}
    word = "ingzzz"
    found = [g for g in language.grams_of(word, 4) if g in model.places[4]]
    assert model.backoff(word) == [model.places[4][g] for g in found]


# licenses


def test_licenses(spark):
    rng = np.random.default_rng(2)
    words = ["license", "version", "the", "under", "free", "software", "public", "gnu", "filler", "word", "general", "this", "work", "is", "licensed"]
    rows = []
    for i in range(60):
        text = sentence(rng, words, int(rng.integers(0, 200)))
        if i % 3 == 0:
            text += "\nReleased under the MIT License.\n" + sentence(rng, words, 40)
        if i % 5 == 0:
            text += " " + licenses.TEMPLATES[9][0].upper() + " filler" * 30
        rows.append((i, text))
    rows += [(100, None), (101, ""), (None, "cc by nc cc by nc"), (102, "x " * 40_000 + "Apache License, Version 2.0"), (102, "x")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, license string")
    listed = licenses.templates_of(licenses.TEMPLATES)
    counts, want = {}, []
    for i, t in rows:
        w = words_of((t or "").encode())
        for x in {x for u in listed for x in u.words} & set(w):
            counts[x] = counts.get(x, 0) + 1
        for u in listed:
            run = None
            for at in range(len(w)):
                share = len(u.words.intersection(w[at : at + u.block])) / len(u.words)
                if w[at] in u.words and share >= licenses.CONTAINMENT - 1e-9:
                    if run and at <= run[3]:
                        run[3:] = at + u.block, max(run[4], share)
                    else:
                        want += [tuple(run)] if run else []
                        run = [i, u.label, at, at + u.block, share]
            want += [tuple(run)] if run else []
    lengths = {i: len(words_of((t or "").encode())) for i, t in rows}
    assert licenses.text_frequencies(docs, listed) == counts
    out, c = licenses.scan(docs)
    found = [(r["doc_id"], b["label"], b["start"], b["stop"], b["containment"]) for r in out.collect() for b in r[c]["blocks"]]
    assert sorted(found, key=str) == sorted(((i, lab, at, min(end, lengths[i]), x) for i, lab, at, end, x in want), key=str) and len(want) > 10
    got = {}
    for r in licenses.license_labels(docs).collect():
        got.setdefault(r["doc_id"], r)
    for i, t in rows[:-1]:
        w = words_of((t or "").encode())
        places = [(k, lab) for k in range(len(w)) for p, lab in licenses.PHRASES if w[k : k + len(p.split())] == p.encode().split()]
        r = got[i]
        assert r["n_words"] == len(w) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = sorted({lab for _, lab in places})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and bool(r["labels"]) == (r["score"] > 0)
    assert licenses.license_labels(docs.limit(0)).count() == 0


def test_other_licenses_get_no_label(spark):
    rows = ["released under the gpl license", "licensed under the mozilla public license version 2 0", "the license of the bar is under review by the mit board"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert [r["labels"] for r in licenses.license_labels(docs).collect()] == ["", "", ""]


def test_templates_are_found_at_any_offset():
    """At the threshold, with as many other words in between as a block has room for."""
    listed = licenses.templates_of(licenses.TEMPLATES)
    index = licenses.TemplateIndex(listed, {})
    for k, (text, _) in enumerate(licenses.TEMPLATES):
        words, t = words_of(text.encode()), listed[k]
        last = {w: i for i, w in enumerate(words)}
        gone = sorted(t.words, key=last.get)[1 : 1 + len(t.words) - t.needed]  # neither the first nor the last word
        copy = [b"zz" if w in gone else w for w in words]
        copy[1:1] = [b"yy"] * (t.block - len(words))
        for before in range(0, 40):
            assert any(j == k and a <= before + 0 + len(words) and c >= licenses.CONTAINMENT for j, a, _, c in index.search([b"xx"] * before + copy + [b"xx"] * 9))


# html


LONG = "This paragraph is part of the article and it is long enough to make the distribution surge, as running text does."


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p><b>one<br>two<p>th&eacute;\n ee</p></article><footer>&copy; me</footer>", "A & B one two thé ee"),
        (f"<body><header>Site</header><div class='content'><h1>Head</h1><p>{LONG}</p><p>{LONG} <i>x</i>y</p></div><div id=comments><p>{LONG}</p></div><aside>{LONG}</aside><form>{LONG}</form></body>", f"Head {LONG} {LONG} xy"),
        ("<article>Only <!-- no --> this<div class='ad'>Buy</div><div class=cookie-notice>Cookies</div><ul><li>a<li>b</ul></article><p>not this", "Only this a b"),
        ("<article><header><h1>T</h1></header><p>body</p><section class='article-comments'>c</section></article><article class='comment'>nice</article>", "T body"),
        ("", ""), (None, ""), ("<nav>x</nav>", ""), ("plain words", "plain words"), ("<p>a < b &lt; c", "a < b < c"), ("<a title='unclosed>x", ""),
    ],
)
def test_main_text(page, text):
    if page == "<a title='unclosed>x":
        html.main_text(page.encode())
    else:
        assert html.main_text(None if page is None else page.encode()) == text


def test_line_blocks():
    make = lambda *n: [html.Line("x" * k, False, 0) for k in n]
    assert html.main_lines(make(5, 5, 0, 0, 0, 60, 70, 80, 0, 0, 0, 4)).tolist() == [False] * 5 + [True] * 3 + [False] * 4
    assert html.main_lines([]).tolist() == [] and html.main_lines([html.Line("xx", False, 2)]).tolist() == [False]


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article>é&#8364;</article>", "t"), (2, None, None, "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html.extract(pages).collect()), key=str) == [(1, "u", "é€", 2), (2, None, "", 0), (2, None, "", 0)]
    big = spark.createDataFrame([(1, "u", "<article><p>" + "word " * 100_000)], "page_id long, url string, html string")
    assert html.extract(big).first()["n_chars"] == 499_999 and html.extract(big.limit(0)).count() == 0


# urls


def test_rules(spark):
    rows = [
        ("https://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://blog.example.com/en/1", "blog.example.com", "/en/1", "example.com/en/", "block"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("http://a.net/fr/x#y", "a.net", "/fr/x", "net/fr/", "block"),
        ("http://a.net/FR/x", "a.net", "/FR/x", None, None),
        ("http://a.com", "a.com", "", None, None),
        ("http://a.com?q=/", "a.com", "", None, None),
        ("http://a.com:80/x", "a.com:80", "/x", None, None),
        ("mailto:x", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None), ("ä://ß/" + "y" * 20_000, "ß", "/" + "y" * 20_000, None, None),
    ]
    pages = spark.createDataFrame([(i, r[0], "x", 1) for i, r in enumerate(rows)], "page_id long, url string, rule string, code int")
    got = {r["page_id"]: r for r in urls.url_verdicts(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert got[11]["score"] is None and got[11]["verdict"] == "allow" and got[10]["verdict"] == "allow"
    assert urls.url_verdicts(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.url_verdicts(pages.where("page_id = 9")).collect()} == {"allow"}


def test_url_model(spark):
    good = [(i, f"http://good{i % 7}.com/news/{i}", None) for i in range(40)]
    bad = [(100 + i, f"http://zq{i % 7}.net/fr/xxzz{i}", None) for i in range(40)]
    free = [(200, "http://good1.org/news/5", "allow"), (201, "http://zq1.org/fr/xxzz3", "block"), (200, "http://good1.org/news/5", "allow")]
    pages = spark.createDataFrame([x[:2] for x in good + bad + free], "page_id long, url string")
    df = urls.url_verdicts(pages)
    got = [(r["page_id"], r["verdict"]) for r in df.collect() if r["page_id"] in (200, 201)]
    assert sorted(got) == [(200, "allow"), (200, "allow"), (201, "block")]
    counts = spark.createDataFrame([(5, 3, 1)], "code long, accepted long, rejected long")
    row = urls.log_ratios(counts).where("code = 5").first()
    p1 = lambda n, m: (n + 1) / (m + urls.SIZE)
    p = [(n + 5 * ((n + 5 * p1(n, n)) / (n + 5))) / (n + 5) for n in (3.0, 1.0)]
    assert row["ratio"] == round(np.log(p[0] / p[1]) * urls.PARTS)
    # chances of all characters after a context add up to one
    assert urls.log_ratios(counts).count() == urls.SIZE**3


# language model


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = lm.Network(lm.Network().flat.astype(float) * 4)
    context, target = rng.integers(0, lm.VOCABULARY, (40, 2 * lm.REACH)), rng.integers(0, lm.VOCABULARY, 40)
    g = net.gradient(context, target)
    for i in np.r_[np.argsort(-np.abs(g))[:5], rng.integers(0, len(g), 5)]:
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = (lm.Network(down).log_probabilities(context, target).mean() - lm.Network(up).log_probabilities(context, target).mean()) / 2e-4
        assert abs(slope - g[i]) < 1e-6
    every = np.exp(net.log_probabilities(np.repeat(context[:1], lm.VOCABULARY, 0), np.arange(lm.VOCABULARY)))
    assert abs(every.sum() - 1) < 1e-9


def test_pseudo_likelihood(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"a{int(x)} b{int(x)} c{int(x)}" for x in rng.integers(0, 20, 80))) for i in range(150)]
    docs = spark.createDataFrame(rows + [(500, None), (501, ""), (None, "a1 b1"), (502, "zzz"), (502, "zzz")], "doc_id long, text string")
    docs = docs.withColumn("pll", F.lit("x")).repartition(3)
    places = lm.vocabulary(docs)
    assert set(places) >= {b"a1", b"zzz"} and sorted(places.values()) == list(range(2, len(places) + 2))
    flat = lm.train(docs, places)
    got = {r["doc_id"]: r for r in lm.score(docs, places, flat, ("doc_id",)).collect()}
    net, ids = lm.Network(flat), [0, 0, *(places[w] for w in words_of(rows[3][1].encode())), 0, 0]
    total = 0.0
    for k in range(2, len(ids) - 2):  # a token at a time, over the whole vocabulary
        context = np.array([[ids[k - 2], ids[k - 1], ids[k + 1], ids[k + 2]]])
        h = net.hidden(context)[0]
        group = h @ net.group_w + net.group_b
        words = np.concatenate([np.log(np.exp(group)[g] / np.exp(group).sum()) + lm.Network.log_softmax((h @ net.word_w[g] + net.word_b[g])[None])[0] for g in range(lm.GROUP)])
        total += words[ids[k]]
    assert abs(got[3]["pll"] - total) < 1e-2 and got[3]["n_tokens"] == 240
    counts = np.bincount(np.concatenate([[places[w] for w in words_of(t.encode())] for _, t in rows]))
    p = counts[counts > 0] / counts.sum()
    mean = sum(got[i]["pll"] for i in range(150)) / (150 * 240)
    assert mean > (p * np.log(p)).sum() + 0.3  # better than word frequencies alone
    assert got[500]["pll"] == 0 and got[501]["n_tokens"] == 0
    none = {r["doc_id"]: r["mean_pll"] for r in lm.pseudo_likelihood(docs.where("doc_id >= 500"), 1).collect()}
    assert none[500] is None and none[502] < 0
    assert lm.pseudo_likelihood(docs.limit(0)).count() == 0


# mixing


def test_rates_against_numpy(spark):
    rng = np.random.default_rng(9)
    n, p = rng.integers(1, 500, 400).astype(float), rng.dirichlet([1, 0.5, 0.3], 400)
    df = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n double, p array<double>")
    goal = np.array([0.7, 0.3, 0.0]) * n.sum()
    history = mixing.fit_rates(df, F.col("n"), F.col("p"), goal.tolist())
    weigh, r = np.linalg.inv((p * n[:, None]).T @ p), np.ones(400)
    cost = lambda r: (e := (r * n) @ p - goal) @ weigh @ e
    y = r
    for *slope, momentum in history:
        assert np.allclose(slope, weigh @ ((y * n) @ p - goal), atol=1e-9)  # the sums are those of all documents
        new = np.maximum(0, y - (p @ slope + mixing.EVEN * (y - 1)) / (1 + mixing.EVEN))
        r, y = new, new + momentum * (new - r)
    got = np.array([x[0] for x in df.select(mixing.rate(F.col("p"), history)).collect()])
    assert np.allclose(got, r, atol=1e-9) and cost(got) <= cost(np.ones(400)) and (got >= 0).all()
    wanted = (n * rng.uniform(0.5, 1.5, 400)) @ p
    exact = mixing.fit_rates(df, F.col("n"), F.col("p"), wanted.tolist())
    met = np.array([x[0] for x in df.select(mixing.rate(F.col("p"), exact)).collect()])
    assert (met > 0).all() and np.abs((met * n) @ p - wanted).max() < 1e-3 * n.sum()


def test_mix(spark):
    rng = np.random.default_rng(10)
    rows, labels = [], []
    for i in range(240):
        kind = i % 3
        words = [f"w{int(x)}" for x in rng.integers(0, 200, 40)]
        words += (["lovely", "clear"], ["###", "spam", "|"], ["nasty", "awful"])[kind] * 3
        rows.append((i, " ".join(words)))
        if i < 180:
            labels.append((i, int(kind != 1), int(kind == 2)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "lovely clear"), (5, "x")], "doc_id long, text string").withColumn("rate", F.lit("r"))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, marks).toPandas()
    held = got[got.doc_id.between(180, 239)]
    best = held[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy().argmax(1)
    assert (best == held.doc_id % 3).mean() > 0.95
    assert held[held.doc_id % 3 == 2].rate.max() < 0.2 and held[held.doc_id % 3 == 0].rate.min() > 0.5
    assert len(got) == 244 and (got.rate >= 0).all()
    same = mixing.mix(docs, marks.limit(0)).toPandas()
    assert np.allclose(same.p_good, 1 / 3)
    assert mixing.mix(docs.limit(0), marks).count() == 0


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(11)
    item = " ".join(f"bench{int(x)}" for x in rng.integers(0, 50, 20))
    passage = " ".join(f"shared{int(x)}" for x in rng.integers(0, 90, 60))
    rows = []
    for i in range(90):
        rows.append((i, sentence(rng, EN, 60) + f" unique{i} " + " ".join(f"t{int(x)}" for x in rng.integers(0, 900, 60)), "en"))
    rows += [(100, rows[0][1], "en"), (101, rows[1][1] + " x", "en"), (102, None, "en"), (103, "123", "en"), (104, sentence(rng, EN, 110) + " " + item + " " + sentence(rng, EN, 30), "en"),
             (105, sentence(rng, DE, 80) + " " + passage, "de"), (106, sentence(rng, DE, 90) + " " + passage, "de"), (5, rows[5][1], "en"), (107, rows[3][1].replace(" unique3 ", " other3 "), "en")]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = docs, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append({r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()})
        if k < len(cp.STAGES) - 1:
            assert now.schema.names == docs.schema.names and now.dtypes == docs.dtypes
    assert set(kept[0]) == {i for i, _, _ in rows} - {102, 103}
    assert not {100, 107} & set(kept[1]) and {0, 3, 5, 104, 105, 106} <= set(kept[1])
    assert spark.read.parquet(str(tmp_path / "out1")).where("doc_id = 5").count() == 1
    assert passage in kept[2][105] and passage not in kept[2][106]
    assert set(kept[2]) - set(kept[3]) == {104} and set(kept[4]) <= set(kept[3])
    assert cp.run(spark, str(tmp_path)).count() == len(kept[4])
    assert not re.search("import .*pytest", open(cp.__file__).read())
