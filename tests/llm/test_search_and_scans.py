import random
import re

import numpy as np
import pytest

from cases import corpus, frame, sentence, with_edges
from twinloom.llm import topk_tiles
from twinloom.llm.license_diagonals import PHRASES, scan_licenses
from twinloom.llm.topk_tiles import integer_vectors, top_k


def brute(rows, k=5):
    usable = [(i, [np.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % 50:
            continue
        scores = [(-int(sum(int(a) * int(b) for a, b in zip(q, v))), j) for j, v in usable if j != i and len(v) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k_like_brute_force(spark, block, monkeypatch):
    rng = np.random.default_rng(block)
    rows = [(k, rng.standard_normal(8).round(1).tolist()) for k in range(400)]
    rows += [(400 + k, rows[k][1]) for k in range(60)]  # ties
    rows += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (None, [1.0] * 8), (1150, [1.0] * 3), (1200, [-1e9] * 8), (1201, [3e8] * 8)]
    monkeypatch.setattr(topk_tiles, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk_tiles, "LEAST_SHARD", 64)
    vectors = integer_vectors(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3))
    got = sorted(map(tuple, top_k(vectors.where("vec_id % 50 = 0"), vectors, 5).collect()))
    assert got == brute(rows)


def test_few_candidates_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    vectors = integer_vectors(spark.createDataFrame([(0, [1.0, 0.5]), (3, [0.5, 0.5]), (50, [0.25, 1.0])], schema))
    got = top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)
    assert sorted(map(tuple, got.collect())) == brute([(0, [1.0, 0.5]), (3, [0.5, 0.5]), (50, [0.25, 1.0])])
    empty = vectors.limit(0)
    assert top_k(empty, empty).collect() == []


# ---- licenses ----------------------------------------------------------------------

LICENSED = [
    "All rights reserved. ALL RIGHTS, reserved! all rights", "cc by cc by-sa CC-BY", "the GNU General Public License; general public", "cc_by", "all\nrights\treserved",
    "Licensed under the Apache License, Version 2.0 (the License)", "Licensed under the famous Apache License, Version 2.0", "permission is granted",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "créative cc by éé", "Kcc by", "a" * 100_000 + " cc by", "x cc", "by cc by",
]


def base_of(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(table))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_phrases_like_brute_force(spark):
    rng = random.Random(3)
    rows = with_edges(corpus(2, 10)) + [(8000 + k, t) for k, t in enumerate(LICENSED)]
    rows += [(9000 + k, f"{sentence(rng, 40)} {rng.choice(LICENSED[:9])} {sentence(rng, 30)}") for k in range(20)]
    got = scan_licenses(frame(spark, rows, "n_words labels words parts hash")).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows if i is not None}
    for r in got:
        if r.doc_id is None:
            continue
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {texts[r.doc_id]: r.labels for r in got if r.doc_id}
    assert "apache-2.0" in labels[LICENSED[5]] and "apache-2.0" in labels[LICENSED[6]] and "mit" in labels[LICENSED[8]]
    assert labels[LICENSED[7]] == ""
    assert scan_licenses(frame(spark, [])).collect() == []


def test_votes_count_once_and_in_order(spark):
    whole = "this source code form is subject to the terms of the mozilla public license"
    words = whole.split()
    rows = [
        "licensed under " * 5,  # one pair five times
        "this source form code " * 9,
        whole,
        whole.replace("subject", "hereby subject"),
        " ".join(words[:6] + words[7:]),
        " ".join(w for k in range(len(words) - 2, -1, -2) for w in words[k : k + 2]),  # all words, backwards in pairs
        "version 2 0 " * 30 + "the apache " * 30,
    ]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, list(enumerate(rows)))).collect()}
    assert [got[k].labels for k in range(len(rows))] == ["", "", "mpl", "mpl", "mpl", "", ""]
    assert got[2].score == 1.0 and 0.6 <= got[3].score < 1.0 and got[0].score == 0.0


def test_scan_runs_in_the_engine(spark):
    plan = scan_licenses(frame(spark, corpus(2, 5)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
