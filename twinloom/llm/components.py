"""Connected components of links, without collecting them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import stored, tidy

_EDGE = "a long, b long"
_EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, at = self.up, x
        while (to := up.get(at, at)) != at:
            at = to
        while (to := up.get(x, x)) != at:
            up[x], x = at, to
        return at

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.up.setdefault(low, low)
        self.up[high] = low
        return True

    def edges(self) -> pa.RecordBatch:
        pairs = [(self.root(x), x) for x in list(self.up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
            schema=_EDGE_SCHEMA,
        )


def unite_tile(forest: Forest, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> None:
    """Join what a tile links; each row and column of the tile is looked at once."""
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    for start in np.flatnonzero(rows).tolist():
        if not rows[start]:
            continue
        first, rows[start] = int(left[start]), False
        at = np.array([start])
        while len(at):
            near = np.flatnonzero(linked[at].any(axis=0) & cols)
            cols[near] = False
            for k in near.tolist():
                forest.join(first, int(right[k]))
            at = np.flatnonzero(linked[:, near].any(axis=1) & rows)
            rows[at] = False
            for k in at.tolist():
                forest.join(first, int(left[k]))


@tidy
def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as a star around the smallest member of each of its groups."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.join(a, b)
    yield forest.edges()


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for all nodes of links (a, b); component is the smallest node.

    Each round points every node to its smallest neighbour and contracts the links; the maps
    of the rounds are then chained. Nulls and links of a node to itself are left out. Tasks
    reduce their links first, so a group costs at most a link per member and task.
    """
    edges = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = stored(edges.mapInArrow(_reduce, _EDGE))
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")))
        maps.append(up)
        left = up.select(F.col("node").alias("a"), F.col("up").alias("up_a"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("up_b"))
        moved = edges.join(left, "a").join(right, "b").where("up_a <> up_b")
        moved = moved.select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).mapInArrow(_reduce, _EDGE)
        edges = stored(moved)
    spark = links.sparkSession
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    found = maps[0].select("node", F.col("up").alias("component"))
    for up in maps[1:]:
        more = up.select(F.col("node").alias("component"), F.col("up").alias("next"))
        found = found.join(more, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return found
