import random

import numpy as np
import pytest

from cases import frame, sentence, with_edges
from twinloom.llm import string_kernel, toxicity_grammar
from twinloom.llm.toxicity_grammar import (
    INSULT_BIT,
    MACHINES,
    NEGATION_BIT,
    REPORTED_BIT,
    TARGET_BIT,
    Grammar,
    compose,
    pattern_of,
)

LANGUAGES = {"aa": "ka ke ki ko ku la le li lo lu", "bb": "schr tz ung heit keit ver ein", "cc": "ção ñar ión dad ment que", "dd": "th ing tion ed er wh"}


def spoken(rng, language, n=60):
    parts = LANGUAGES[language].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_held_out(spark):
    rng = random.Random(1)
    rows = [(k, spoken(rng, lang), lang if k % 9 else None) for k in range(240) for lang in [list(LANGUAGES)[k % 4]]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    model = string_kernel.fit(docs.where("doc_id % 4 <> 2 or doc_id % 8 = 2"), per_language=20, landmarks=5)
    assert model.languages == list(LANGUAGES)
    got = string_kernel.identify(docs, model).collect()
    truth = {k: list(LANGUAGES)[k % 4] for k, _, _ in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = with_edges([(1, "12 34 !!"), (2, ""), (3, "ka ke " * 30_000), (4, "é")])
    found = string_kernel.identify(frame(spark, odd, "lang_pred"), model).collect()
    assert len(found) == len(odd)
    assert {r.lang_pred for r in found if not any(c.isalpha() for c in r.text or "")} == {"und"}
    assert {r.lang_pred for r in found if r.doc_id == 3} == {"aa"}
    assert string_kernel.identify(docs.limit(0), model).collect() == []


def test_texts_of_megabytes_keep_their_language(spark):
    """Varied long texts fill no row of bits: they are scored by segments."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = string_kernel.fit(docs.where("doc_id % 4 <> 2"))
    rng = random.Random(2)
    rows = []
    for lang in model.languages:
        texts = [r.text for r in docs.where((docs.lang == lang) & docs.text.isNotNull()).select("text").collect()]
        rng.shuffle(texts)
        prose = "\n".join(texts)[:2_000_000]
        ids = " ".join(f"{rng.getrandbits(64):x}-{rng.randrange(10**9)}" for _ in range(20_000))
        rows += [(lang, prose), (lang, f"{prose} {ids}")]
    found = {r.doc_id: r for r in string_kernel.identify(frame(spark, [(k, t) for k, (_, t) in enumerate(rows)]), model).collect()}
    assert [found[k].lang_pred for k in range(len(rows))] == [lang for lang, _ in rows]
    assert min(found[k].score for k in range(0, len(rows), 2)) > 0.9
    cut = string_kernel.segments(b"x" * 10_001, 3)
    assert len(cut) == 3 and sum(map(len, cut)) == 10_001 + 3 * 2 and string_kernel.segments(b"", 3) == [b""]


def test_nothing_learned(spark):
    model = string_kernel.fit(spark.createDataFrame([(1, "text", None), (2, None, "aa")], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in string_kernel.identify(frame(spark, [(1, "text")]), model).collect()] == ["und"]
    none = toxicity_grammar.fit(frame(spark, [(1, "a b c")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity_grammar.score_toxicity(frame(spark, [(1, "a b c"), (2, None)]), none).where("predicted <> 0").count() == 0


def test_kernel_by_hand():
    bits = string_kernel.presence([b"ab", b"abab", b"", b"zz"], 1 << 14, (1, 2))
    assert bits.sum(axis=1).tolist() == [3, 4, 0, 2]
    k = string_kernel._scaled(bits) @ string_kernel._scaled(bits).T
    assert k[0, 1] == pytest.approx(3 / (3 * 4) ** 0.5) and k[0, 3] == 0


# ---- toxicity ----------------------------------------------------------------------


def test_composition_follows_its_machines():
    moves, states = compose(MACHINES, 32)
    rng = random.Random(1)
    for _ in range(300):
        word = [rng.choice([0, 0, INSULT_BIT, TARGET_BIT, NEGATION_BIT, REPORTED_BIT]) for _ in range(rng.randint(0, 9))]
        state, single = 0, [0] * len(MACHINES)
        for symbol in word:
            state = moves[state][symbol]
            single = [m.step(s, symbol) for m, s in zip(MACHINES, single)]
        assert states[state] == tuple(single)
        assert bool(pattern_of(states[state])) == (INSULT_BIT in word)


def test_clauses_of_a_text():
    grammar = Grammar([("grobian", True), ("lowei", False)])
    assert grammar.clauses("A plain text. You are kind!") == []
    plain, targeted, negated, reported = (grammar.clauses(t) for t in ("What a Grobian.", "you grobian", "You are not a grobian", "she said: they called him a grobian"))
    assert plain == [1] and targeted == [1 | 4] and negated == [1 | 4 | 16] and reported == [1 | 4 | 8]
    assert grammar.clauses("loweischaft, grobian. x") == [1] and grammar.clauses("grobian; loweien") == [1, 1]
    assert grammar.clauses("grobians grobianic") == []
    assert grammar.clauses("not now but later a grobian") == [1]  # too far for the negation
    assert grammar.clauses("He said: you grobian") == [1 | 4 | 8]  # reported across a colon
    assert grammar.clauses("He said so. You grobian") == [1 | 4]
    weights = [toxicity_grammar.prior(p) for p in range(toxicity_grammar.PATTERNS)]
    assert toxicity_grammar.text_score(grammar.clauses("You are not an idiot."), weights, 0.0) < toxicity_grammar.THRESHOLD
    assert toxicity_grammar.text_score(grammar.clauses("You are an idiot."), weights, 0.0) > toxicity_grammar.THRESHOLD


def test_toxic_held_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(500):
        words = sentence(rng, 60).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["grobian", "zwxein" + rng.choice(["ko", "ka", "lu", "me"]), "zwxeinig"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    docs = frame(spark, with_edges(rows), "score predicted lang")
    model = toxicity_grammar.fit(docs, marks.where("doc_id % 4 <> 2"))
    got = toxicity_grammar.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) + 7
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 500:
            assert r.predicted == int(r.doc_id % 5 == 0)
        if not r.text:
            assert r.predicted == 0
    assert toxicity_grammar.score_toxicity(docs.limit(0), model).collect() == []


def test_copies_teach_once(spark):
    """Words that only copies of one toxic text share are no insults."""
    rng = random.Random(6)
    one = sentence(rng, 60) + " schurke"
    rows = [(k, one) for k in range(60)]
    rows += [(100 + k, sentence(rng, 50) + (" schurke " if k % 5 == 0 else " ") + sentence(rng, 20)) for k in range(300)]
    labels = [(k, 1) for k in range(60)] + [(100 + k, int(k % 5 == 0)) for k in range(300)]
    model = toxicity_grammar.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {e[:4] for e, _ in model.insults} == {"schu"}
