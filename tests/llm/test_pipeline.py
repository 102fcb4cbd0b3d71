import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import sentence
from test_near_duplicates import brute as components
from test_repeats import brute as repeats
from test_repeats import words

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in two made-up languages with insults, near copies, shared passages and junk."""
    rng = random.Random(9)
    passage = sentence(rng, 60)
    rows, labels = [], []
    for k in range(360):
        text = sentence(rng, rng.randint(30, 90))
        if k % 2:
            text = " ".join("tz" + w + "ung" for w in text.split())
        if k % 6 == 0:
            parts = text.split()
            for _ in range(3):
                parts[rng.randrange(len(parts))] = "grobian"
            text = " ".join(parts)
        if k % 10 == 3:
            text += " " + passage
        if k % 10 == 7:
            text = rows[k - 1][1]
        if k % 10 == 8:
            text = rows[k - 3][1] + " once more"
        rows.append((k, text, "bb" if k % 2 else "aa", "s", len(text)))
        labels.append((k, int("grobian" in text)))
    rows += [(900, "12 34", "aa", "s", 5), (901, None, None, None, None), (None, sentence(rng, 30), "aa", "s", 1)]
    root = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    inputs, steps = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        steps[name] = docs
    texts = {n: {r.doc_id: r.text for r in d.collect()} for n, d in steps.items() if n != "packing"}
    # language: only rows without a letter go
    before = dict(inputs["language"])
    assert set(texts["language"]) == {i for i, t in before.items() if re.search("[a-z]", t or "")}
    # toxicity: the insulting ones go, no others
    assert set(texts["toxicity"]) == {i for i, t in inputs["toxicity"] if "grobian" not in t}
    # near duplicates: the smallest of each group stays
    want = components(inputs["near duplicates"])
    assert set(texts["near duplicates"]) == {i for i, (_, c) in want.items() if i == c} | {None}
    # repeated text: what an earlier window has is cut
    gone = repeats(inputs["repeated text"], words, 20)
    for i, t in inputs["repeated text"]:
        left = [w for w, g in zip(words(t), gone[i, t]) if not g]
        assert words(texts["repeated text"][i]) == left
    assert any(any(g) for g in gone.values())
    # packing: every text once, without gaps
    pieces = defaultdict(list)
    for r in steps["packing"].collect():
        pieces[r.sequence_id].append((r.offset, r.length))
    for parts in pieces.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert steps["packing"].select("doc_id").distinct().count() == len(inputs["packing"])


def test_the_whole_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.agg(F.count("*"), F.countDistinct("sequence_id")).first()[0] > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near duplicates", "repeated text", "packing"]


@pytest.mark.parametrize("stage", ["known_language", "one_of_each", "without_repeats"])
def test_stages_on_an_empty_table_and_clashing_names(spark, stage):
    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n_removed long"
    run = getattr(corpus_pipeline, stage)
    got = run(spark, spark.createDataFrame([], columns), "")
    assert got.columns == corpus_pipeline.COLUMNS and got.collect() == []
    rows = [(1, "one plain text of words", None, None, None, 0.5, None, 3), (2, None, None, "s", 0, None, False, None)]
    got = run(spark, spark.createDataFrame(rows, columns), "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, rows[0][1]), (2, None)]  # no language is known
