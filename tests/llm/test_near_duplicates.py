import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import corpus, frame, sentence, with_edges
from twinloom.llm import components, minhash_forest, projection_passes
from twinloom.llm.minhash_forest import near_duplicates
from twinloom.llm.projection_passes import near_duplicate_vectors


class Groups(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def sets_of(rows):
    out = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows, percent=75):
    sets, groups = sets_of([r for r in rows if r[0] is not None]), Groups()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        groups.root(a)
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.root(i)) for i in ids}


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = with_edges(corpus(seed))
    check(near_duplicates(frame(spark, rows, "tree key rep component kept")).collect(), rows)


def star(n, seed=3):
    """An original and copies that are near it but often not near each other."""
    rng = random.Random(seed)
    base = sentence(rng, 150).split()
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        rows.append((k + 10, " ".join(words)))
    return [*rows, (n + 100, " ".join(base))]


def test_crowded_regions_keep_their_links(spark, monkeypatch):
    """Small limits force deeper regions and hub pairs; the components stay the same."""
    rows = star(90) + corpus(5, 12)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    monkeypatch.setattr(minhash_forest, "REGION", 16)
    monkeypatch.setattr(minhash_forest, "SMALL_REGION", 6)
    monkeypatch.setattr(minhash_forest, "CHUNK", 8)
    check(near_duplicates(frame(spark, rows)).collect(), rows)


def boilerplate(pairs):
    """Texts that share 0.70 of their shingles with each other, and 0.76 in pairs."""
    rng = random.Random(8)
    common = " ".join(f"c{k}" for k in range(248))
    rows = []
    for _ in range(pairs):
        both = " ".join(f"b{rng.random()}" for _ in range(12))
        rows += [f"{common} {both} " + " ".join(f"o{rng.random()}" for _ in range(40)) for _ in range(2)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_look_alikes_do_not_hide_a_link(spark):
    """In a region that is not crowded, a true partner may rank behind many others."""
    rows = boilerplate(60)
    check(near_duplicates(frame(spark, rows)).collect(), rows)


def test_crowded_regions_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "REGION", 16)
    monkeypatch.setattr(minhash_forest, "TILE", 16, raising=False)
    rows = boilerplate(90) + star(60)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    check(near_duplicates(frame(spark, rows)).collect(), rows)


def test_tiles_of_sets():
    """Postings count like sets do; blocks hold every place once, large sets alone."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 30, 60, 200)]
    got = list(minhash_forest.intersections(sets, sets[::-1]))
    assert [g.tolist() for g in got] == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]
    most = minhash_forest.TILE_SHINGLES
    sizes = np.array([5, most, 1, most // 2, most // 2, 3])
    blocks = minhash_forest.set_blocks(np.arange(6), sizes)
    assert np.concatenate(blocks).tolist() == list(range(6))
    assert all(sizes[b].sum() - sizes[b[-1]] <= most for b in blocks)


def test_look_alikes_send_each_set_once_per_tile(spark):
    """180 texts that nearly link have 16,110 pairs; their sets travel per tile and tree."""
    rows = boilerplate(90)
    sent = []

    def counted(tickets, texts, percent, real=minhash_forest.links_of):
        sent.append(tickets.count())
        return real(tickets, texts, percent)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(minhash_forest, "links_of", counted)
        check(near_duplicates(frame(spark, rows)).collect(), rows)
    assert sent[-1] <= 2 * minhash_forest.TREES * len(rows)


def test_edges_of_the_threshold(spark):
    words = [f"w{k}" for k in range(39)]  # 35 shingles
    near = words[:-5] + ["x"] * 5  # 30 of 40 shared: exactly 75 in 100
    far = words[:-6] + ["y"] * 6
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "A b"), (5, "a  B"), (6, "a b c")]
    check(near_duplicates(frame(spark, rows)).collect(), rows)


def test_empty(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    got = near_duplicates(frame(spark, [(1, None), (2, ""), (3, "\t")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(k, 0, k, True) for k in (1, 2, 3)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(900, k) for k in range(901, 960)] + [(7, 7), (None, 3)]
    rng.shuffle(edges)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r.node: r.component for r in got} == {k: 100 for k in range(100, 161)} | {k: 900 for k in range(900, 960)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- vectors -----------------------------------------------------------------------


def brute_vectors(rows, threshold=0.98):
    groups, links = Groups(), {}
    unit = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, dtype=np.float64) if ok else None
        unit.append(None if a is None else (a / np.abs(a).max()) / np.linalg.norm(a / np.abs(a).max()))
    for p, (i, _, label) in enumerate(rows):
        links[p] = 0
        if i is not None:
            groups.root(i)
        for q, (j, _, other) in enumerate(rows):
            if p != q and unit[p] is not None and unit[q] is not None and label == other and len(unit[p]) == len(unit[q]):
                if unit[p] @ unit[q] >= threshold:
                    links[p] += 1
                    groups.join(i, j)
    return [(rows[p][0], links[p], groups.root(rows[p][0]) if rows[p][0] is not None else None) for p in range(len(rows))]


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.standard_normal(16).tolist(), int(k % 3)) for k in range(60)]
    center = rng.standard_normal(16)
    rows += [(100 + k, (center + 0.08 * rng.standard_normal(16)).tolist(), 1) for k in range(50)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(10)]  # equal vectors
    rows += [(300, [2 * x for x in rows[0][1]], rows[0][2]), (301, rows[1][1], None), (302, None, 1), (303, [0.0] * 16, 1)]
    rows += [(304, [float("nan")] + [1.0] * 15, 1), (305, [float("inf")] + [1.0] * 15, 1), (306, [], 1), (307, [1.0, None], 1)]
    rows += [(308, [1.0, 0.0], 1), (309, [1.0, 0.1], 1), (310, [1e200] * 16, 2), (311, [1e-200] * 16, 2), (None, [1.0, 0.0], 1)]
    rows += [(312, [-0.0, 1.0], 0), (313, [0.0, 1.0], 0), (308, [1.0, 0.0], 1)]
    return rows


@pytest.mark.parametrize("tile", [1024, 8])
def test_vectors_like_brute_force(spark, tile):
    rows = vectors(tile)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, values string").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(df, tile=tile).collect()), key=str)
    assert got == sorted(brute_vectors(rows), key=str)
    kept = near_duplicate_vectors(df, tile=tile).where("kept <> (vec_id = component_id)").count()
    assert kept == 0


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_duplicate_vectors(df).collect() == []


def test_passes_sort_every_label(spark):
    """With production parameters all labels of a small table go through several sorted passes, in blocks without gaps."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    reps = table.where("label is not null").select(
        F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("values"), F.col("vec_id").alias("rep")
    ).withColumn("size", F.size("values"))
    rows = projection_passes.sorted_passes(reps, 0.98, projection_passes.WINDOW, 100).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows))) and all(r.block == r.position // 100 for r in rows)
    order = [(r["pass"], r.label, r["size"], r.key, r.rep) for r in rows]
    assert order == sorted(order)
    sizes = {r.label: r["count"] for r in reps.groupBy("label").count().collect()}
    counts = projection_passes.passes_of(0.98)
    for label, n in sizes.items():
        bits = max(0, int(np.ceil(np.log2(n / projection_passes.WINDOW))))
        assert {r["pass"] for r in rows if r.label == label} == set(range(counts[bits]))
        assert n <= projection_passes.WINDOW or counts[bits] > 4
    assert len(counts) == projection_passes.KEY_BITS + 1 and counts[-1] <= projection_passes.PASSES


def test_ranges_and_windows_cross_blocks(spark):
    """Every two vectors of a range, or of a window, meet in a tile, wherever the blocks end."""
    rng = random.Random(6)
    rows, window, tile = [], 3, 8
    for position, prefix in enumerate(sorted(rng.choice([1, 2, 2, 2, 3, 4, 5, 6, 7]) for _ in range(100))):
        rows.append((0, 5, 2, prefix, prefix, 1000 + position, position, position // tile))
    schema = "pass int, label long, size int, key long, prefix long, rep long, position long, block long"
    placed = projection_passes._in_tiles(spark.createDataFrame(rows, schema).repartition(4), window, tile)
    tiles = {}
    for r in placed.select("position", F.inline("tiles")).collect():
        tiles.setdefault((r.i, r.j), {0: set(), 1: set()})[r.side].add(r.position)
    for p in rows:
        for q in rows:
            if p[6] < q[6] and (p[4] == q[4] or q[6] - p[6] <= window):
                tile_of = tiles[p[7], q[7]]
                assert p[6] in tile_of[0] and q[6] in tile_of[0 if p[7] == q[7] else 1]


@pytest.mark.parametrize("background, tile", [(0.95, 1024), (0.95, 64), (0.0, 64)])
def test_dense_label_like_brute_force(spark, background, tile):
    """Planted pairs in a label whose other vectors nearly link: whole, and in passes if spread."""
    rng = np.random.default_rng(4)
    middle = rng.standard_normal(64)
    middle /= np.linalg.norm(middle)

    def near(of, cosine):
        noise = rng.standard_normal(of.shape)
        noise -= (noise * of).sum(axis=1, keepdims=True) * of
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        return cosine * of + np.sqrt(1 - cosine * cosine) * noise

    base = near(np.tile(middle, (1500, 1)), background**0.5)
    rows = np.vstack([base, near(base, 0.982)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    linked = rows @ rows.T >= 0.98
    np.fill_diagonal(linked, False)
    groups = Groups()
    for i, j in zip(*np.nonzero(linked)):
        groups.join(int(i), int(j))
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>, label long")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(df, tile=tile).collect())
    assert got == [(k, int(linked[k].sum()), groups.root(k)) for k in range(len(rows))]
