import hashlib

import numpy as np
import pytest

from twinloom.llm import grid_codes
from twinloom.llm.grid_codes import Cells, codebook_digest, compress, decompress, integer_vectors, with_label_error

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def usable(rows, size):
    fine = [r for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == size and all(x is not None and np.isfinite(x) for x in r[1])]
    return [(i, [int(np.floor(min(max(1024 * x, -(2**24)), 2**24))) for x in v], label) for i, v, label in fine]


def brute(rows, size=8, rounds=4):
    rows = sorted(usable(rows, size), key=lambda r: (r[0], r[1]))
    w = size // 4
    values = np.array([r[1] for r in rows], dtype=object).reshape(len(rows), size)
    books = [[list(v) for v in values[:256, k * w : (k + 1) * w]] for k in range(4)]

    def nearest(part, book):
        return min(((sum((int(a) - int(b)) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book)))

    for r in range(rounds + 1):
        found = [[nearest(v, books[k]) for v in values[:, k * w : (k + 1) * w]] for k in range(4)]
        if r < rounds:
            for k in range(4):
                for e in range(len(books[k])):
                    mine = [values[i, k * w : (k + 1) * w] for i, f in enumerate(found[k]) if f[1] == e]
                    if mine:
                        books[k][e] = [sum(c) // len(mine) for c in zip(*mine)]
    text = ",".join(str(x) for b in books for e in b for x in e)
    errors = [sum(found[k][i][0] for k in range(4)) for i in range(len(rows))]
    labels = {}
    for r, e in zip(rows, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    out = [(r[0], "".join(f"{found[k][i][1]:02x}" for k in range(4)), errors[i], labels[r[2]]) for i, r in enumerate(rows)]
    return sorted(out), hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA).repartition(3)


def run(spark, rows):
    coded, books = compress(integer_vectors(frame(spark, rows)))
    got = with_label_error(coded).select("vec_id", "code", "error", "label_error")
    return sorted(map(tuple, got.collect())), books


@pytest.mark.parametrize("n, scale", [(700, 0.1), (40, 0.1), (300, 0.004)])
def test_like_brute_force(spark, n, scale):
    rng = np.random.default_rng(n)
    rows = [(int(k * 3), (rng.standard_normal(8) * scale).tolist(), int(rng.integers(3))) for k in range(n)]
    rows += [(5000 + k, rows[k % n][1], None) for k in range(30)]  # copies, null labels
    rows += [(None, [0.1] * 8, 1), (1, None, 1), (2, [None] * 8, 1), (4, [float("nan")] + [0.0] * 7, 1), (5, [float("inf")] * 8, 2)]
    rows += [(7, [0.1] * 12, 1), (8, [], 1), (10, [1e300] * 8, 1), (10, [-1e300] * 8, 1), rows[3], rows[3]]
    got, books = run(spark, rows)
    want, digest = brute(rows)
    assert got == want and codebook_digest(books) == digest


def test_none(spark):
    assert run(spark, []) == ([], [])
    assert run(spark, [(1, None, 1), (2, [0.5] * 7, 1), (None, [0.5] * 8, 2)]) == ([], [])


def test_dominated_entries_are_left_out():
    """Cells keep few entries, are remembered, and never lose the nearest one."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-400, 400, (50, 16))
    entries = centres[rng.integers(0, 50, 256)] + rng.integers(-40, 40, (256, 16))
    parts = centres[rng.integers(0, 50, 3000)] + rng.integers(-40, 40, (3000, 16))
    cells = Cells(entries)
    code, error = cells.nearest(np.concatenate([parts, parts]))
    distance = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code[:3000] == distance.argmin(axis=1)).all() and (error[:3000] == distance.min(axis=1)).all()
    assert (code[:3000] == code[3000:]).all()
    assert len(cells.place) <= 3000 and cells.open.mean() < 0.3


def test_a_full_memory_begins_anew(monkeypatch):
    rng = np.random.default_rng(5)
    entries, parts = rng.integers(-400, 400, (256, 4)), rng.integers(-500, 500, (2000, 4))
    want = Cells(entries).nearest(parts)
    monkeypatch.setattr(grid_codes, "CELLS_KEPT", 64)
    monkeypatch.setattr(grid_codes, "PAIRS_AT_ONCE", 100)
    small = Cells(entries)
    got = [small.nearest(parts[at : at + 50]) for at in range(0, 2000, 50)]
    assert (np.concatenate([g[0] for g in got]) == want[0]).all() and (np.concatenate([g[1] for g in got]) == want[1]).all()
    assert len(small.place) <= 64


def test_codes_stand_for_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (rng.standard_normal(8) * 0.1).tolist(), 0) for k in range(300)]
    vectors = integer_vectors(frame(spark, rows))
    coded, books = compress(vectors)
    back = {r.vec_id: r["values"] for r in decompress(coded, books).collect()}
    errors = {r.vec_id: r.error for r in coded.collect()}
    for r in vectors.collect():
        assert sum((a - b) ** 2 for a, b in zip(r["values"], back[r.vec_id])) == errors[r.vec_id]
