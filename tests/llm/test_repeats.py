import hashlib
import random
import re

import numpy as np
import pytest

from cases import corpus, frame, with_edges
from twinloom.llm.relative_lz import factor, remove_repeated_text
from twinloom.llm.suffix_array import common_prefixes, remove_repeated_bytes, repeated_windows, suffix_array


def brute(rows, units, window):
    """Units removed of each (id, text), by looking up every window."""
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        u = units(text)
        for p in range(len(u) - window + 1):
            w = tuple(u[p : p + window])
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = {}
    for i, text in rows:
        u = units(text)
        gone = [False] * len(u)
        if i is not None:
            for p in range(len(u) - window + 1):
                if first[tuple(u[p : p + window])] < (i, p):
                    gone[p : p + window] = [True] * window
        out[i, text] = gone
    return out


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def octets(text):
    return list((text or "").encode())


@pytest.mark.parametrize("seed", [1, 2])
def test_words_like_brute_force(spark, seed):
    rows = with_edges(corpus(seed))
    want = brute(rows, words, 20)
    got = remove_repeated_text(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert any(r.n_removed for r in got)
    for r in got:
        w, gone = words(r.text), want[r.doc_id, r.text]
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), sum(gone), kept)
        covered = set()
        for f in r.factors:
            assert f.words >= 20
            covered.update(range(f.start, f.start + f.words))
        assert covered == {k for k, g in enumerate(gone) if g}


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_like_brute_force(spark, seed):
    rows = with_edges(corpus(seed))
    want = brute(rows, octets, 100)
    got = remove_repeated_bytes(frame(spark, rows)).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        data, gone = octets(r.text), want[r.doc_id, r.text]
        assert bytes(r.kept) == bytes(b for b, g in zip(data, gone) if not g)
        assert (r.n_bytes, r.n_removed) == (len(data), sum(gone))
        assert r.n_spans == len(r.spans) == sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))


def test_hot_anchors_go_alone(spark, monkeypatch):
    """Windows of very common passages take another way to the shards, with the same result."""
    from twinloom.llm import repeats

    rng = random.Random(4)
    passage = "the same passage stands in all of these texts, and it is longer than one hundred bytes, as it has to be for this"
    rows = [(k, f"{rng.random()} {passage} {rng.random()}") for k in range(60)]
    want = brute(rows, octets, 100)
    monkeypatch.setattr(repeats, "HOT_LEAST", 4)
    got = remove_repeated_bytes(frame(spark, rows)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: sum(g) for (i, _), g in want.items()}


def test_other_columns_and_empty_tables(spark):
    clash = "n_words KEPT_TEXT kept n_bytes spans factors places starts bucket"
    rows = frame(spark, corpus(3, 8), clash)
    for op, key in ((remove_repeated_text, "n_words"), (remove_repeated_bytes, "n_bytes")):
        out = op(rows)
        assert len({c.lower() for c in out.columns}) == len(out.columns) and {"places", "starts", "bucket"} <= set(out.columns)
        assert out.count() == rows.count() and out.where(f"{key} is null or places <> 'x'").count() == 0
        assert op(rows.limit(0)).collect() == []


def test_factors_break_where_the_source_breaks():
    starts = np.array([3, 4, 5, 9])
    got = factor(starts, np.array([1, 1, 2, 2]), np.array([7, 8, 0, 4]), 20)
    assert got.tolist() == [[3, 21, 1, 7], [5, 20, 2, 0], [9, 20, 2, 4]]


@pytest.mark.parametrize("letters", [1, 2, 3, 256])
def test_suffix_arrays(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 17, 200, 901):
        text = rng.integers(0, letters, n).astype(np.uint8)
        for t in (text, np.tile(text[:5], n)[:n]):
            data = t.tobytes()
            order = suffix_array(t)
            assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
            prefix = common_prefixes(t, order, np.full(n, n))
            if letters < 255:
                for a, b in zip(order[:-1], order[1:]):
                    k = 0
                    while a + k < n and b + k < n and data[a + k] == data[b + k]:
                        k += 1
                    assert prefix[b] == k


def test_windows_of_pieces():
    pieces = [b"abcdefgh", b"xxbcdefg", b"abc", b"q"]
    docs, starts = repeated_windows(pieces, np.array([1, 2, 3, 4]), np.array([0, 10, 5, 0]), 3)
    assert sorted(zip(docs.tolist(), starts.tolist())) == [(2, 12), (2, 13), (2, 14), (2, 15), (3, 5)]


def test_digest_of_nothing(spark):
    r = remove_repeated_text(frame(spark, [(1, None)])).first()
    assert (r.n_words, r.n_removed, r.kept_text) == (0, 0, "")
    assert hashlib.sha256(r.kept_text.encode()).hexdigest().startswith("e3b0c442")
