"""The pipeline's stages by themselves: empty tables, nulls, repeated rows, columns whose names the stages use."""

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, predicted string, found string, repeats string, member string, rate string, text_key string, fp long, row_number string"
ENGLISH = "the quick brown fox jumps over the lazy dog and then it goes home to rest for a while near the river"
FRENCH = "le renard brun saute par dessus le chien paresseux et puis il rentre chez lui pour se reposer un peu"
ITEM = "what is the capital of the largest country on the smallest continent in the world"


def _docs(spark):
    rows = []
    for i in range(40):
        words = (ENGLISH if i % 2 else FRENCH).split()
        turned = words[i % 19 :] + words[: i % 19] + [f"n{i}" + ("day" if i % 2 else "jour") for _ in range(6)]
        rows.append((i, " ".join(turned), "en" if i % 2 else "fr"))
    rows += [(100, None, "en"), (101, "", None), (102, "12 34", "en"), (3, rows[3][1], "en"), (None, ENGLISH + " by night", None), (103, f"{ENGLISH} {ITEM} once", "en")]
    made = [(i, t, lang, "s", None if t is None else len(t), "p", "f", "r", "m", "x", "k", 7, "y") for i, t, lang in rows]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture()
def tables(spark, tmp_path):
    spark.createDataFrame([(1, ITEM), (2, None), (None, "the lazy dog and then it goes home to rest for")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    marks = [(i, i % 4 < 2, 0) for i in range(0, 40, 2)] + [(1, None, 1), (None, 1, 0), (7, 0, 1)]
    spark.createDataFrame([(i, None if q is None else int(q), t) for i, q, t in marks], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=lambda f: f.__name__)
def test_stage_of_odd_rows(spark, tables, stage):
    docs = _docs(spark)
    out = stage(spark, docs, tables)
    kept = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns
    if stage is not cp.mix_to_targets:
        assert out.columns == docs.columns
    others = {tuple(r[c] for c in docs.columns if c not in ("text", "n_chars")) for r in docs.collect()}
    assert {tuple(r[c] for c in docs.columns if c not in ("text", "n_chars")) for r in kept} <= others
    ids = sorted((r["doc_id"] for r in kept), key=str)
    match stage.__name__:
        case "keep_known_language":
            assert {100, 101, 102}.isdisjoint(ids) and set(range(40)) <= set(ids)
        case "keep_one_of_near_copies":
            assert ids.count(3) == 1 and len({100, 101} & set(ids)) == 1  # texts without words are alike
        case "drop_contaminated":
            assert 103 not in ids and ids.count(3) == 2 and {100, 101, None} <= set(ids)
        case "remove_repeated_passages":
            assert all(r["n_chars"] == len(r["text"]) for r in kept if r["text"] is not None) and 0 in ids
        case "mix_to_targets":
            assert all(r["n_tokens"] is not None for r in kept)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=lambda f: f.__name__)
def test_stage_of_nothing(spark, tables, stage):
    assert stage(spark, _docs(spark).limit(0), tables).collect() == []
