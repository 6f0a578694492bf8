"""The corpus pipeline, stage by stage, on a small table with a case for each decision."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    words = "the of and to in is that for with was his on are they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = said(40)
    base = said(200)
    rows = {i: said(120) for i in range(1, 15)}
    rows |= {20: base, 21: base, 22: base.replace("water", "sea", 1), 30: f"{said(50)} {item} {said(50)}", 40: None, 41: "", 42: "12 34 56"}
    rows |= {i: f"{said(80)}\nall rights of this text belong to {w}\n{said(30)}" for i, w in zip(range(50, 64), words)}
    at = str(tmp_path_factory.mktemp("corpus"))
    table = [(i, t, "en", "s", len(t or "")) for i, t in rows.items()] + [(1, said(90), "en", "s", 1), (None, base, "en", "s", 1)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def test_stages(spark, tables):
    at, rows = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, at).cache()
    assert {x["doc_id"] for x in kept.collect()} == {*rows, None} - {40, 41, 42} and kept.columns == docs.columns
    lined = corpus_pipeline.lines(spark, kept, at).cache()
    got = {x["doc_id"]: x for x in lined.collect()}
    assert "belong" in got[50]["text"] and not any("belong" in got[i]["text"] for i in range(51, 64)) and lined.columns == docs.columns
    assert all(x["n_chars"] == len(x["text"]) for i, x in got.items() if i and 51 <= i < 64)
    single = corpus_pipeline.near_duplicates(spark, lined, at).cache()
    left = [x["doc_id"] for x in single.collect()]
    assert sorted(i for i in left if i) == sorted([*(i for i in rows if i not in (21, 22, 40, 41, 42)), 1]) and None in left
    clean = corpus_pipeline.benchmarks(spark, single, at).cache()
    assert {x["doc_id"] for x in single.collect()} - {x["doc_id"] for x in clean.collect()} == {30}
    packed = corpus_pipeline.packed(spark, clean, at)
    assert {x["doc_id"] for x in packed.collect()} == {x["doc_id"] for x in clean.collect()}


def test_run_is_the_stages_in_order(spark, tables):
    at, rows = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, at).collect()
    assert {x["doc_id"] for x in out} == {*rows, None} - {21, 22, 30, 40, 41, 42}


def test_empty_table(spark, tables):
    at, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0
