"""Near-duplicate vectors by sorted projection passes.

A pass hashes every vector to a string of bits, the signs of its products with random
directions, and sorts the vectors of a label lexicographically by it. Each vector is then
compared with its neighbours in that order: at least ``window`` of them, and beyond these as
far as the range of equal leading bits goes. How many leading bits count follows from the
label's number of vectors, so that a range holds about a window of them where they are
spread; how many passes a label takes follows from the bits, so that a pair at the threshold
shares no range in any pass with a chance below MISS. Both rules are the same at every size.

The sorted order is cut into blocks of ``tile`` vectors by position, wherever labels, ranges
or partitions end. Vectors near a border also go to the next block's tile, and a range that
spans several blocks is compared in a tile for each two of them, so no window ends at a
border and no crowded range is one task. Pairs of cosine ``threshold`` or more are united
across passes into components; a task hands on one link per member, not all pairs.

Links are counted afterwards: only members of one component can be linked, and within a
component all pairs are compared in tiles, which give counts and no pairs. Equal vectors are
one representative with a multiplicity throughout.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinloom.llm.common import partitions, record_batch, run_starts, sorted_groups, stored, tidy
from twinloom.llm.components import Forest, connected_components, unite_tile

KEY_BITS = 24  # hashes of a pass, concatenated
PASSES = 64  # at most; 24 bits at cosine 0.98 take 60
MISS = 1e-6  # chance that a pair at the threshold shares no range in any pass
WINDOW = 32  # neighbours that are always compared
TILE = 1024


@functools.lru_cache(maxsize=8)
def directions(size: int) -> np.ndarray:
    """Random directions of all passes: pass, bit, component."""
    return np.random.default_rng(10).standard_normal((PASSES, KEY_BITS, size))


def passes_of(threshold: float) -> list[int]:
    """How many passes each number of leading bits takes, as far as PASSES suffice."""
    apart = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi  # chance that one bit parts a pair
    counts = [1]
    for bits in range(1, KEY_BITS + 1):
        lost = 1.0 - (1.0 - apart) ** bits  # in one pass
        needed = math.ceil(math.log(MISS) / math.log(lost)) if 0.0 < lost < 1.0 else 1 if lost == 0.0 else PASSES + 1
        if needed > PASSES:
            break
        counts.append(needed)
    return counts


def unit_rows(values: list | np.ndarray) -> np.ndarray:
    """Vectors of one length divided by their norms, in double precision.

    They are scaled by their largest component first, so that no square overflows.
    """
    rows = np.array(values, dtype=np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _units(values: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of lists of one length."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return unit_rows(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1))


_KEYED = "pass int, label long, size int, key long, prefix long, rep long"
_KEYED_SCHEMA = pa.schema(
    [("pass", pa.int32()), ("label", pa.int64()), ("size", pa.int32()), ("key", pa.int64()), ("prefix", pa.int64()), ("rep", pa.int64())]
)
_ORDER = ["pass", "label", "size", "key", "rep"]


def _keys(threshold: float, window: int):
    """Each vector's key in each of its label's passes; ``prefix`` is its leading bits that count."""
    needed = np.array(passes_of(threshold))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes = part.column("size").to_numpy()
                for size in np.unique(sizes).tolist():
                    rows = part.take(pa.array(np.flatnonzero(sizes == size)))
                    unit = _units(rows.column("values"))
                    label, rep = rows.column("label").to_numpy(), rows.column("rep").to_numpy()
                    many = rows.column("members").to_numpy()
                    bits = np.clip(np.ceil(np.log2(many / window)), 0, len(needed) - 1).astype(np.int64)
                    for p in range(int(needed[bits].max())):
                        mine = np.flatnonzero(needed[bits] > p)
                        key = (unit[mine] @ directions(size)[p].T > 0) @ (1 << np.arange(KEY_BITS)[::-1])
                        yield record_batch(
                            {
                                "pass": np.full(len(mine), p),
                                "label": label[mine],
                                "size": np.full(len(mine), size),
                                "key": key,
                                "prefix": key >> (KEY_BITS - bits[mine]),
                                "rep": rep[mine],
                            },
                            _KEYED_SCHEMA,
                        )

    return run


@tidy
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield batch.append_column("part", pa.array(np.full(n, part, dtype=np.int32))).append_column(
            "at", pa.array(np.arange(at, at + n, dtype=np.int64))
        )
        at += n


def sorted_passes(reps: DataFrame, threshold: float, window: int, tile: int) -> DataFrame:
    """Rows of ``_KEYED`` in the order of all passes: their position, and its block of ``tile`` positions.

    ``reps`` has label, size, rep, values. Vectors are left out: only keys are sorted.
    """
    of = ["label", "size"]
    members = reps.groupBy(*of).agg(F.count("*").alias("members"))
    keyed = reps.join(members, of).select(*of, "members", "rep", "values").mapInArrow(_keys(threshold, window), _KEYED)
    n = partitions(reps.sparkSession)
    ordered = keyed.repartitionByRange(n, *_ORDER).sortWithinPartitions(*_ORDER)
    placed = stored(ordered.mapInArrow(_places, f"{_KEYED}, part int, at long"))
    # A row per partition, so one task may add them up and all may have them.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    position = placed.join(F.broadcast(before), "part").withColumn("position", F.col("before") + F.col("at"))
    return position.withColumn("block", F.floor(F.col("position") / F.lit(tile))).drop("part", "at", "before")


def _in_tiles(passes: DataFrame, window: int, tile: int) -> DataFrame:
    """Rows of the passes in each tile (i, j, side) that compares them."""
    key = ["pass", "label", "size", "prefix"]
    ranges = passes.groupBy(*key).agg(F.min("block").alias("first"), F.max("block").alias("last"))
    # A block has parts of at most two ranges that go on beyond it, so joining by block meets no hot key.
    spans = (
        ranges.where("last > first")
        .withColumn("block", F.explode(F.sequence("first", "last")))
        .groupBy("block")
        .agg(F.collect_list(F.struct(*key, "first", "last")).alias("spans"))
    )
    mine = F.filter("spans", lambda s: functools.reduce(lambda a, b: a & b, [s[c] == F.col(c) for c in key]))
    span = F.try_element_at(mine, F.lit(1))
    first, last = F.coalesce(span["first"], F.col("block")), F.coalesce(span["last"], F.col("block"))
    at = F.pmod(F.col("position"), F.lit(tile))
    first = F.when((at < window) & (F.col("block") > 0), F.least(first, F.col("block") - 1)).otherwise(first)
    last = F.when(at >= tile - window, F.greatest(last, F.col("block") + 1)).otherwise(last)
    others = F.transform(
        F.sequence("from", "to"),
        lambda o: F.struct(
            F.least("block", o).alias("i"),
            F.greatest("block", o).alias("j"),
            F.when(F.col("block") <= o, 0).otherwise(1).alias("side"),
        ),
    )
    reach = passes.join(spans, "block", "left").withColumns({"from": first, "to": last})
    return reach.select(*key, "position", "rep", others.alias("tiles"))


def _link_tiles(threshold: float, window: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for tile in sorted_groups(batches, ["i", "j"]):
            inside = tile.column("i")[0] == tile.column("j")[0]
            names = ("pass", "label", "size", "side", "prefix", "rep")
            turn, label, size, side, prefix, reps = (tile.column(c).to_numpy() for c in names)
            begin = run_starts(turn, label, size)
            for b, e in zip(begin.tolist(), [*begin[1:].tolist(), tile.num_rows]):
                if e - b < 2 or not inside and side[b] == side[e - 1]:
                    continue
                unit, rep = _units(tile.column("values").slice(b, e - b)), reps[b:e]
                if not inside:  # two blocks: what shares a range or stands near their border
                    cut = int(np.searchsorted(side[b:e], 1))
                    unite_tile(forest, rep[:cut], rep[cut:], unit[:cut] @ unit[cut:].T >= threshold)
                    continue
                starts = run_starts(prefix[b:e])
                ends = np.repeat(np.append(starts[1:], e - b), np.diff(np.append(starts, e - b)))
                for low in range(0, e - b, window):
                    high = min(low + window, e - b)
                    reach = max(high + window, int(ends[high - 1]))
                    linked = unit[low:high] @ unit[low:reach].T >= threshold
                    linked[np.arange(high - low), np.arange(high - low)] = False
                    unite_tile(forest, rep[low:high], rep[low:reach], linked)
        yield forest.edges()

    return run


def _count_tiles(threshold: float):
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in sorted_groups(batches, ["component", "i", "j"]):
            unit = _units(tile.column("values"))
            side, reps, many = (tile.column(c).to_numpy() for c in ("side", "rep", "many"))
            left, right = side == 0, side == 1
            if tile.column("i")[0] == tile.column("j")[0]:  # a block with itself
                right = left
            linked = unit[left] @ unit[right].T >= threshold
            linked &= reps[left][:, None] != reps[right][None, :]
            found = [(reps[left], linked @ many[right])]
            if right is not left:
                found.append((reps[right], many[left] @ linked))
            for who, n in found:
                yield record_batch({"rep": who, "n": n.astype(np.int64)}, schema)

    return run


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, window: int = WINDOW, tile: int = TILE
) -> DataFrame:
    """Links and components of vectors with equal labels.

    ``vectors`` has vec_id, embedding and label (integer). Returns one row per row: vec_id,
    n_links (other rows linked directly), component_id (smallest vec_id reachable, itself
    included), kept (vec_id = component_id). Rows whose label is null, or whose vector is
    null, empty, zero or holds null or non-finite components, link with nothing. Vectors of
    different lengths do not link. Rows with equal vectors link like others; so do rows that
    repeat a vec_id. A row with a null vec_id links with nothing: component_id and kept are
    null. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    window = min(window, tile)
    x = F.col("values")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("values"))
    usable = F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # -0.0 and 0.0 are one value for grouping in Spark, so equal vectors meet.
    rows = rows.withColumn("values", F.when(usable, F.col("values")))
    reps = stored(
        rows.where(F.col("values").isNotNull())
        .groupBy("label", "values")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"))
    )
    reps = reps.withColumn("size", F.size("values"))
    n = partitions(spark)
    places = _in_tiles(sorted_passes(reps, threshold, window, tile), window, tile)
    order = ["i", "j", "pass", "label", "size", "side", "position"]
    dealt = (
        places.join(reps.select("label", "size", "rep", "values"), ["label", "size", "rep"])
        .select(*places.columns[:-1], "values", F.inline("tiles"))
        .repartition(n, "i", "j")
        .sortWithinPartitions(*order)
    )
    links = dealt.mapInArrow(_link_tiles(threshold, window), "a long, b long")
    groups = stored(connected_components(links))
    # All pairs within a component, counted in tiles.
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("blocks"))
    members = groups.join(sizes, "component").join(reps.withColumnRenamed("rep", "node"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    members = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = members.select(
        "component",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.col("node").alias("rep"),
        "many",
        "values",
    )
    counted = (
        tiles.repartition(n, "component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInArrow(_count_tiles(threshold), "rep long, n long")
        .groupBy("rep")
        .agg(F.sum("n").alias("n"))
    )
    found = (
        reps.join(counted, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("label").alias("__label"),
            F.col("values").alias("__values"),
            (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    # Two joins: null vectors must not meet in one task.
    linked = rows.where(F.col("values").isNotNull()).join(
        stored(found), (F.col("label") == F.col("__label")) & (F.col("values") == F.col("__values"))
    )
    alone = rows.where(F.col("values").isNull()).withColumns(
        {"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")}
    )
    columns = ["vec_id", "n_links", "component_id"]
    whole = linked.select(*columns).unionByName(alone.select(*columns))
    return whole.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_projection_passes(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_FINE = "list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

OP10_SQL = f"""WITH RECURSIVE fine AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
      WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND {_FINE}),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98e0),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
    tops AS (SELECT a, min(b) AS top FROM reach GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(top, vec_id))::BIGINT AS component_id,
           vec_id = least(vec_id, coalesce(top, vec_id)) AS kept
    FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN tops t ON t.a = vec_id"""
