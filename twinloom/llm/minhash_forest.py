"""Near-duplicate documents with a MinHash LSH forest.

A text's set is its distinct shingles of five words. Texts with equal sets are one class.
Each of TREES trees sorts the classes by a signature order of its own: the same minhashes,
read in another order. Classes that share a prefix of the order lie in one region. A region
is entered at the shallowest depth; where it is crowded it is split at the next depth, and so
on, so that each region gets the depth that suits it.

Candidates, within a region:
  * the region's most central class with each other one (a crowded region keeps these pairs
    before it is split, so that copies of one original stay linked to it),
  * in small regions all pairs, in others the neighbours of longest common prefix in the
    order.
Candidates whose signatures differ too much are dropped (by five standard deviations below
the threshold). The others are confirmed on their full sets: each set travels once to each
pair's hub, hubs in chunks. A second round looks at all pairs that share a region of the
first depth, however crowded, but are not yet in one component: crowded regions in tiles of
signatures. No pair leaves a tile: the classes with a fitting partner there are written once
per tile, their sets follow them once, and the tile counts all its intersections from
postings of the shingles. Components are those of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinloom.llm.common import (
    as_bytes,
    documents,
    in_larger_batches,
    mix,
    odd_numbers,
    partitions,
    sorted_groups,
    stored,
    text_segments,
    tidy,
    word_hashes,
)
from twinloom.llm.components import Forest, connected_components, unite_tile

SHINGLE = 5
TREES = 24
OWN = 4  # minhashes that only one tree begins with
HASHES = TREES * OWN
DEPTHS = (3, 5, 8, 12)
REGION = 256  # classes compared in one region
SMALL_REGION = 24  # classes that are compared pair by pair
TILE = 1024  # classes on a side of a tile of signatures
DEVIATIONS = 5.0
CHUNK = 128  # sets compared with one copy of a hub's set
TILE_SHINGLES = 1 << 21  # shingles on a side of a tile of sets (one set may be larger)


# ---- sets and signatures -----------------------------------------------------------


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (lower-cased A-Z)."""
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint64)] * len(texts)
    odd = odd_numbers(width + 1, 3)
    for places, group in text_segments([t.lower() for t in texts]):
        words, offsets = word_hashes(group)
        n = max(len(words) - width + 1, 0)
        grams = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            grams += words[k : k + n] * odd[k]
        grams = mix(grams)
        for place, b, e in zip(places, offsets[:-1].tolist(), offsets[1:].tolist()):
            if e - b >= width:
                out[place] = np.unique(grams[b : e - width + 1])
            elif e > b:  # too few words: the whole sequence is one shingle
                whole = (words[b:e] * odd[: e - b]).sum(dtype=np.uint64, keepdims=True)
                out[place] = mix(whole + odd[width : width + 1] * np.uint64(e - b))
    return out


def signature(items: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minimum of each of many mixings of a set."""
    least = np.full(len(odd), np.uint64(2**64 - 1))
    for at in range(0, len(items), 2048):
        least = np.minimum(least, (items[at : at + 2048, None] * odd[None, :]).min(axis=0))
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


_SKETCH = "doc_id long, n_shingles long, high long, low long, signature binary"
_SKETCH_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("signature", pa.binary())]
)


@tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd = odd_numbers(HASHES, 11)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = shingle_sets(as_bytes(part.column("text")))
            high = [int((mix(s).sum(dtype=np.uint64)).astype(np.int64)) for s in sets]
            low = [int(np.bitwise_xor.reduce(mix(s ^ odd[0])).astype(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.array([signature(s, odd).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ],
                schema=_SKETCH_SCHEMA,
            )


# ---- the forest --------------------------------------------------------------------


def tree_orders() -> np.ndarray:
    """The order in which each tree reads the minhashes, as far as the greatest depth."""
    rng = np.random.default_rng(5)
    rows = []
    for t in range(TREES):
        own = list(range(t * OWN, (t + 1) * OWN))
        rest = rng.permutation([h for h in range(HASHES) if h not in own])
        rows.append([*own, *rest[: max(DEPTHS) - OWN]])
    return np.array(rows)


def prefix_keys(signatures: np.ndarray, trees: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the first ``depth`` minhashes in the order of each row's tree."""
    odd = odd_numbers(max(DEPTHS) + 1, 13)
    picked = np.take_along_axis(signatures, tree_orders()[trees][:, :depth], axis=1).astype(np.uint64)
    key = (trees.astype(np.uint64) + np.uint64(1)) * odd[-1] + np.uint64(depth)
    for k in range(depth):
        key = mix(key ^ (picked[:, k] + np.uint64(k + 1)) * odd[k])
    return key.view(np.int64)


@tidy
def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class in all trees at the first depth."""
    schema = pa.schema([("tree", pa.int32()), ("key", pa.int64()), ("rep", pa.int64())])
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
        rep = batch.column("rep").to_numpy(zero_copy_only=False)
        for at in range(0, len(rep), 2048):
            some = sig[at : at + 2048]
            trees = np.tile(np.arange(TREES, dtype=np.int32), len(some))
            keys = prefix_keys(np.repeat(some, TREES, axis=0), trees, DEPTHS[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees), pa.array(keys), pa.array(np.repeat(rep[at : at + 2048], TREES))], schema=schema
            )


def _deeper(depth: int):
    schema = pa.schema([("tree", pa.int32()), ("key", pa.int64()), ("rep", pa.int64())])

    @tidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
                trees = batch.column("tree").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trees), pa.array(prefix_keys(sig, trees, depth)), batch.column("rep")], schema=schema
                )

    return run


def least_matches(percent: int) -> int:
    """Equal minhashes that a pair above the threshold has but for a chance of about 1e-6."""
    p = percent / 100
    return max(1, int(HASHES * p - DEVIATIONS * (HASHES * p * (1 - p)) ** 0.5))


def _region_pairs(percent: int):
    """Candidate pairs (hub, other) of regions."""
    least = least_matches(percent)
    schema = pa.schema([("hub", pa.int64()), ("other", pa.int64())])
    orders = tree_orders()

    def pairs_of(rep, sig, central, tree):
        same = (sig[:, None, :] == sig[None, :, :]).sum(axis=2)
        fit = same >= least
        np.fill_diagonal(fit, False)
        n = len(rep)
        if n <= SMALL_REGION:
            return np.nonzero(np.triu(fit))
        hubs, others = [], []
        # the most central class of those left takes all that are near it
        left = np.ones(n, dtype=bool)
        support = same.sum(axis=1) + central / (central.max() + 1)
        while left.any():
            hub = int(np.argmax(np.where(left, support, -1)))
            near = np.flatnonzero(fit[hub])
            left[hub] = False
            hubs.append(np.full(len(near), hub))
            others.append(near)
            left[near] = False
        sorted_ = np.lexsort(sig[:, orders[tree][::-1]].T)  # neighbours in the tree's own order
        a, b = sorted_[:-1], sorted_[1:]
        ok = fit[a, b]
        hubs.append(a[ok])
        others.append(b[ok])
        return np.concatenate(hubs), np.concatenate(others)

    def pairs_in(region: pa.Table) -> pa.RecordBatch:
        rep, central = region.column("rep").to_numpy(), region.column("central").to_numpy()
        sig = np.frombuffer(b"".join(region.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
        h, o = pairs_of(rep, sig, central, region.column("tree")[0].as_py())
        ends = np.unique(np.sort(np.stack([rep[h], rep[o]], axis=1), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_larger_batches(pairs_in(x) for x in sorted_groups(batches, ["key"]) if x.num_rows > 1)

    return run


def set_blocks(places: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Places in runs of at most TILE_SHINGLES shingles; a larger set has a run of its own."""
    if not len(places):
        return []
    before = np.cumsum(sizes[places]) - sizes[places]
    return np.split(places, np.flatnonzero(np.diff(before // TILE_SHINGLES)) + 1)


def _across(percent: int):
    """Members of tiles of sets: classes of tiles of signatures that fit one of another component.

    A pair counts in the first tree it shares. Rows are sorted by tile.
    """
    least = least_matches(percent)
    schema = pa.schema([("ticket", pa.int64()), ("hub", pa.bool_()), ("rep", pa.int64())])
    heads = tree_orders()[:, : DEPTHS[0]].tolist()
    keys = ["key", "i", "j"]
    odd = odd_numbers(5, 17)

    def members_of(tile: pa.Table) -> Iterator[tuple[int, bool, np.ndarray]]:
        """Ticket, side and classes of each tile of sets."""
        rep, group = tile.column("rep").to_numpy(), tile.column("group").to_numpy()
        size = tile.column("n_shingles").to_numpy()
        sig = np.frombuffer(b"".join(tile.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
        left = tile.column("side").to_numpy() == 0
        alone = tile.column("i")[0] == tile.column("j")[0]
        right = left if alone else ~left
        fit = group[left][:, None] != group[right][None, :]
        if not fit.any():
            return
        a, b = sig[left].T.copy(), sig[right].T.copy()
        same = np.zeros(fit.shape, dtype=np.uint8)
        for h in range(HASHES):
            same += a[h][:, None] == b[h][None, :]
        fit &= same >= least
        for head in heads[: tile.column("tree")[0].as_py()]:  # an earlier tree has the pair in one region
            if not fit.any():
                return
            earlier = np.ones(fit.shape, dtype=bool)
            for h in head:
                earlier &= a[h][:, None] == b[h][None, :]
            fit &= ~earlier
        ticket = np.zeros(1, dtype=np.uint64)
        for c, k in zip(keys, odd):
            ticket = mix((ticket ^ tile.column(c)[:1].to_numpy().astype(np.int64).view(np.uint64)) * k)
        rows = set_blocks(np.flatnonzero(fit.any(axis=1)), size[left])
        cols = set_blocks(np.flatnonzero(fit.any(axis=0)), size[right])
        for x, these in enumerate(rows):
            for y, those in enumerate(cols):
                part = fit[np.ix_(these, those)]
                if (alone and y > x) or not part.any():
                    continue
                name = int(mix(mix(ticket + odd[3:4] * np.uint64(x)) + odd[4:] * np.uint64(y)).view(np.int64)[0])
                yield name, True, rep[left][these[part.any(axis=1)]]
                if not (alone and x == y):  # a block with itself has one side
                    yield name, False, rep[right][those[part.any(axis=0)]]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (
            pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(reps), ticket)), pa.array(np.full(len(reps), side)), pa.array(reps)], schema=schema
            )
            for tile in sorted_groups(batches, keys)
            for ticket, side, reps in members_of(tile)
        )
        yield from in_larger_batches(made)

    return run


def tiles_across(entry: DataFrame, groups: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Members (ticket, hub, rep) of tiles of sets, for pairs of different components in one region of ``entry``.

    A component with more than TILE members of a region has blocks of its own, which do not
    meet each other; the other members share blocks by component.
    """
    n = partitions(entry.sparkSession)
    grouped = entry.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    grouped = stored(grouped.select("tree", "key", "rep", F.coalesce("component", "rep").alias("group")))
    counts = stored(grouped.groupBy("key", "group").agg(F.count("*").alias("m")))
    large = F.col("m") > TILE
    blocks = F.ceil(F.col("m") / F.lit(TILE))
    regions = stored(
        counts.groupBy("key")
        .agg(
            F.count("*").alias("many"),
            F.ceil(F.sum(F.when(~large, F.col("m")).otherwise(0)) / F.lit(TILE)).alias("common"),
            F.sum(F.when(large, blocks).otherwise(0)).alias("own"),
        )
        .where("many > 1")
        .select("key", "common", (F.col("common") + F.col("own")).alias("all"))
    )
    upto = Window.partitionBy("key").orderBy("group")  # large components of a region only
    own = counts.where(large).select("key", "group", blocks.alias("width"), (F.sum(blocks).over(upto) - blocks).alias("begin"))
    rows = grouped.join(regions, "key").join(own, ["key", "group"], "left").join(reps.select("rep", "signature", "n_shingles"), "rep")
    low = F.col("common") + F.col("begin")
    block = F.coalesce(low + F.pmod(F.xxhash64("rep"), F.col("width")), F.pmod(F.xxhash64("group"), F.col("common")))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)))
    rows = rows.where(F.col("width").isNull() | (F.col("other") < low) | (F.col("other") >= low + F.col("width")))
    rows = rows.select(
        "key",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        "tree",
        "rep",
        "group",
        "n_shingles",
        "signature",
    )
    order = ["key", "i", "j"]
    dealt = rows.repartition(n, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_across(percent), "ticket long, hub boolean, rep long")


def forest_regions(reps: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Regions (tree, key, rep, central) of adaptive depth, hub pairs of crowded ones, regions of the first depth.

    ``central`` of a class is the number of classes around it, summed over the trees.
    """
    found = reps.mapInArrow(_enter, "tree int, key long, rep long")
    regions, pairs = [], []
    central = entry = None
    for level, depth in enumerate(DEPTHS):
        sizes = stored(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        members = stored(found.join(sizes, "key"))
        if central is None:
            entry = members.select("tree", "key", "rep")
            central = stored(members.groupBy("rep").agg(F.sum("n").alias("central")))
        members = members.join(central, "rep")
        regions.append(members.where(F.col("n") <= REGION).select("tree", "key", "rep", "central"))
        crowded = stored(members.where(F.col("n") > REGION))
        if not crowded.limit(1).count():
            return _union(regions), (_union(pairs) if pairs else None), entry
        top = F.max_by("rep", F.struct("central", -F.col("rep"))).alias("hub")
        hubs = stored(crowded.groupBy("key").agg(top))
        pairs.append(crowded.join(hubs, "key").select("hub", F.col("rep").alias("other")).where("hub <> rep"))
        if level + 1 < len(DEPTHS):
            deeper = crowded.select("tree", "rep").join(reps.select("rep", "signature"), "rep")
            found = deeper.mapInArrow(_deeper(DEPTHS[level + 1]), "tree int, key long, rep long")
        else:  # as deep as signatures go: parts of a region, each with the hub pairs above
            part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / F.lit(REGION / 2)))
            regions.append(crowded.withColumn("key", F.xxhash64("key", part)).select("tree", "key", "rep", "central"))
    return _union(regions), _union(pairs), entry


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


# ---- confirmation ------------------------------------------------------------------


@tidy
def _ship_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's set, once for each ticket."""
    schema = pa.schema([("ticket", pa.int64()), ("hub", pa.bool_()), ("rep", pa.int64()), ("items", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = shingle_sets(as_bytes(part.column("text")))
            rows: list[tuple] = []
            for rep, items, tickets in zip(part.column("rep").to_pylist(), sets, part.column("tickets").to_pylist()):
                blob = items.tobytes()
                rows += [(t["ticket"], t["hub"], rep, blob) for t in tickets]
            for k in range(0, len(rows), 1024):
                some = rows[k : k + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in some], type=f.type) for i, f in enumerate(schema)], schema=schema
                )


def intersections(sets: list[np.ndarray], others: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Size of the intersection of each set with all others, from postings of their items."""
    items = np.concatenate(others)
    owner = np.repeat(np.arange(len(others)), [len(o) for o in others])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    for own in sets:
        begin = np.searchsorted(items, own)
        many = np.searchsorted(items, own, side="right") - begin
        stop = np.cumsum(many)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - many), many)
        yield np.bincount(owner[at], minlength=len(others))


def _links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], percent: int) -> np.ndarray:
    sizes = np.array([len(x) for _, x in right])
    linked = np.zeros((len(left), len(right)), dtype=bool)
    for k, both in enumerate(intersections([x for _, x in left], [x for _, x in right])):
        linked[k] = 100 * both >= percent * (len(left[k][1]) + sizes - both)
    return linked


def _confirm(percent: int):
    """Links within each ticket: of its first side with the other, or of all where there is one side.

    Rows are sorted by ticket. Each ticket gives a tree of links for each of its components.
    """

    def edges(ticket: pa.Table) -> pa.RecordBatch:
        sides: tuple[list, list] = ([], [])
        for hub, rep, items in zip(*(ticket.column(c).to_pylist() for c in ("hub", "rep", "items"))):
            sides[0 if hub else 1].append((rep, np.frombuffer(items, np.uint64)))
        left, right = sides[0], sides[1] or sides[0]
        forest = Forest()
        if left:
            ends = [np.array([rep for rep, _ in side], dtype=np.int64) for side in (left, right)]
            unite_tile(forest, *ends, _links(left, right, percent))
        return forest.edges()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_larger_batches(edges(ticket) for ticket in sorted_groups(batches, ["ticket"]))

    return run


def links_of(tickets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within tickets (ticket, hub, rep), by full sets; a set goes to each of its tickets."""
    sent = tickets.groupBy("rep").agg(F.collect_list(F.struct("ticket", "hub")).alias("tickets"))
    sets = texts.withColumnRenamed("doc_id", "rep").join(stored(sent).hint("shuffle_hash"), "rep")
    shipped = sets.select("rep", "text", "tickets").mapInArrow(_ship_sets, "ticket long, hub boolean, rep long, items binary")
    dealt = shipped.repartition(partitions(texts.sparkSession), "ticket").sortWithinPartitions("ticket")
    return dealt.mapInArrow(_confirm(percent), "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among candidate pairs (hub, other), by their full sets."""
    pairs = pairs.select(F.least("hub", "other").alias("x"), F.greatest("hub", "other").alias("y")).distinct()
    # The endpoint with more pairs is the hub, so that its set is sent seldom.
    ends = pairs.select(F.explode(F.array("x", "y")).alias("rep"))
    degree = stored(ends.groupBy("rep").agg(F.count("*").alias("degree")))
    left = degree.select(F.col("rep").alias("x"), F.col("degree").alias("dx"))
    right = degree.select(F.col("rep").alias("y"), F.col("degree").alias("dy"))
    first = F.col("dx") >= F.col("dy")
    chosen = (
        stored(pairs)
        .join(left, "x")
        .join(right, "y")
        .select(
            F.when(first, F.col("x")).otherwise(F.col("y")).alias("hub"),
            F.when(first, F.col("y")).otherwise(F.col("x")).alias("other"),
            F.greatest("dx", "dy").alias("degree"),
        )
    )
    chunk = F.pmod(F.xxhash64("other"), F.ceil(F.col("degree") / F.lit(CHUNK)))
    chosen = chosen.withColumn("ticket", F.xxhash64("hub", chunk))
    tickets = chosen.select(F.col("other").alias("rep"), "ticket", F.lit(False).alias("hub")).unionByName(
        chosen.select(F.col("hub").alias("rep"), "ticket", F.lit(True).alias("hub")).distinct()
    )
    return links_of(tickets, texts, percent)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their sets.

    ``docs`` has doc_id (integer) and text. Returns one row per row of ``docs``: doc_id,
    n_shingles (size of the set), component_id (smallest doc_id reachable, itself included)
    and kept (doc_id = component_id).

    A text with fewer than five words has one shingle, the whole sequence. Null texts and
    texts without words have none and link with nothing. Rows that repeat a doc_id are
    expected to repeat the text; they are in one component. A row with a null doc_id links
    with nothing: component_id null, kept true. An empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = texts.where(F.col("doc_id").isNotNull())
    sketch = stored(known.mapInArrow(_sketch, _SKETCH))
    same = ["high", "low", "n_shingles"]
    reps = stored(
        sketch.where("n_shingles > 0")
        .groupBy(*same)
        .agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"))
    )
    regions, hub_pairs, entry = forest_regions(reps)
    signed = regions.join(reps.select("rep", "signature"), "rep")
    dealt = signed.select("key", "tree", "rep", "central", "signature").repartition(partitions(docs.sparkSession), "key")
    pairs = dealt.sortWithinPartitions("key", "rep").mapInArrow(_region_pairs(percent), "hub long, other long")
    if hub_pairs is not None:
        pairs = pairs.unionByName(hub_pairs)
    links = stored(confirmed(pairs, known, percent))
    groups = stored(connected_components(links))
    tiles = stored(tiles_across(entry, groups, reps, percent))
    if tiles.limit(1).count():
        more = stored(links_of(tiles, known, percent))
        groups = stored(connected_components(links.unionByName(more)))
    classes = stored(
        reps.select(*same, "rep")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*same, F.coalesce("component", "rep").alias("component_id"))
    )
    columns = ["doc_id", "n_shingles", "component_id"]
    found = sketch.where("n_shingles > 0").join(classes, same).select(*columns)
    alone = sketch.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    lone = texts.where(F.col("doc_id").isNull()).mapInArrow(_sketch, _SKETCH)
    lone = lone.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    whole = found.unionByName(alone).unionByName(lone)
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
