"""Prefix trie of conversations, summed by time-forward processing.

A node is a distinct sequence of first turns. Its key is the exclusive or of hashes of its turns,
each salted with its place, so a conversation's keys are a running value: tasks sort ranges of
(conversation, place) and what a conversation brings from the tasks before is added afterwards.
A conversation of any length is thus cut over many tasks, and texts are not shuffled at all.
Nodes are then named by (smallest member, depth); a node's smallest member is not smaller than
its parent's, so ranges of (member, depth) hold most edges within one shard.

Subtree totals go from leaves to the root by time-forward processing: a shard's nodes come in
reverse level order, from Spark's external sort; each takes the messages addressed to it from a
priority queue, adds them up and sends its own total to its parent's address. The queue merges
messages to one address and spills sorted runs to unnamed files of the task beyond QUEUE_LIMIT
addresses; a lost task simply runs again. Messages to parents in other shards leave the shard.
These parents (shard roots' ends) form a smaller forest, in which each points to the next one above it; it is
summed in the same way, and the sums enter a second pass over the shards.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinloom.llm.common import partitions, run_starts, stored, tidy

GROUP = 100  # conversations c - c % GROUP ... share first turns
HEADS = 6  # of which conversation c takes crc32(c) % HEADS
SHARD_NODES = 1 << 18  # nodes in a shard
LEAST_SHARD = 1 << 11
QUEUE_LIMIT = 1 << 16  # addresses that a queue holds in memory
PIECE_IDS = 1 << 13  # ids in one text on their way to a digest


def shards_for(df: DataFrame, n: int) -> int:
    return max(1, math.ceil(n / SHARD_NODES), min(partitions(df.sparkSession), n // LEAST_SHARD))


# ---- running values over sorted ranges ---------------------------------------------

_RUN_SCHEMA = [("n", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64())]


def _running(columns: pa.Schema):
    """Per conversation and task: number of the row, exclusive or of h1 and of h2 so far."""
    schema = pa.schema([*columns, *_RUN_SCHEMA])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, (0, 0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            starts = run_starts(conv)
            counts = np.diff(np.append(starts, len(conv)))
            number = np.arange(1, len(conv) + 1) - np.repeat(starts, counts)
            out = []
            for c in ("h1", "h2"):
                upto = np.bitwise_xor.accumulate(batch.column(c).to_numpy())
                before = np.where(starts > 0, upto[starts - 1], 0)
                out.append(upto ^ np.repeat(before, counts))
            if conv[0] == last:  # it began in an earlier batch
                first = slice(0, int(counts[0]))
                number[first] += state[0]
                for x, s in zip(out, state[1:]):
                    x[first] ^= s
            last, state = conv[-1], (int(number[-1]), int(out[0][-1]), int(out[1][-1]))
            arrays = [*batch.columns, pa.array(number, pa.int64()), *(pa.array(x, pa.int64()) for x in out)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def running(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add n, x1, x2: number of a row in its conversation, exclusive or of h1 and of h2 so far.

    Rows are ordered by conv_id and ``order``. Whatever of a conversation lies in earlier ranges is
    added from one row per range.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n = partitions(df.sparkSession)
    keys = [F.col("conv_id"), *order]
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"{c} {k}" for c, k in dealt.dtypes)
    local = stored(dealt.mapInArrow(_running(to_arrow_schema(dealt.schema)), f"{kinds}, n long, x1 long, x2 long"))
    ends = local.groupBy("conv_id", "part").agg(
        F.max("n").alias("rows"), F.max_by("x1", "n").alias("e1"), F.max_by("x2", "n").alias("e2")
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(  # at most one conversation goes on from one range to the next
        "conv_id",
        "part",
        F.sum("rows").over(before).alias("c"),
        F.bit_xor("e1").over(before).alias("c1"),
        F.bit_xor("e2").over(before).alias("c2"),
    ).where("c is not null")
    zero = F.lit(0).cast("long")
    return local.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        *df.columns,
        (F.col("n") + F.coalesce("c", zero)).alias("n"),
        F.col("x1").bitwiseXOR(F.coalesce("c1", zero)).alias("x1"),
        F.col("x2").bitwiseXOR(F.coalesce("c2", zero)).alias("x2"),
    )


# ---- conversations -----------------------------------------------------------------


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, t1, t2, size, last) of rebuilt conversations, and (conv_id, turns).

    ``t1``, ``t2`` are a digest of role and text, ``size`` the code points of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    signed = lambda s: F.conv(s, 16, -10).cast("long")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        signed(F.substring(digest, 1, 16)).alias("t1"),
        signed(F.substring(digest, 17, 16)).alias("t2"),
        F.char_length(text).cast("long").alias("size"),
    )
    turns = turns.withColumns({"h1": F.lit(0).cast("long"), "h2": F.lit(0).cast("long"), "input": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("t1"), F.col("t2"), F.col("input")]
    turns = stored(running(turns, order).select("conv_id", F.col("n").alias("place"), "t1", "t2", "size"))

    base = F.col("conv_id") - F.col("conv_id") % GROUP
    head = F.when(F.col("conv_id") == base, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    counts = turns.groupBy("conv_id").agg(F.max("place").alias("turns"))
    roots = counts.where(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    taken = F.least("head", F.coalesce("base_turns", F.lit(0).cast("long")))
    convs = counts.select("conv_id", "turns", base.alias("base"), head.cast("long").alias("head")).join(roots, "base", "left")
    convs = stored(convs.select("conv_id", "turns", "base", "head", taken.alias("taken")))
    whole = F.col("taken") + F.greatest(F.col("turns") - F.col("head"), F.lit(0).cast("long"))

    own = turns.join(convs.select("conv_id", "turns", "head", "taken"), "conv_id").where("place > head")
    own = own.select(
        "conv_id",
        (F.col("place") - F.col("head") + F.col("taken")).alias("place"),
        "t1",
        "t2",
        "size",
        (F.col("place") == F.col("turns")).alias("last"),
    )
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < HEADS)).withColumnRenamed("conv_id", "base")
    heads = convs.where("taken > 0").join(first, "base").where("place <= taken")  # at most HEADS * GROUP rows a base
    heads = heads.select("conv_id", "place", "t1", "t2", "size", (F.col("place") == whole).alias("last"))
    return own.unionByName(heads), convs.select("conv_id", whole.alias("turns"))


def trie_nodes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, k1, k2, p1, p2, conv_id, n_convs, size) and conversation ends (conv_id, depth, k1, k2).

    ``p1``, ``p2`` are the parent's key; the root has keys 0 and its own key as parent's.
    """
    turns, convs = rebuilt_turns(conversations)
    salted = lambda n: F.xxhash64(F.lit(n), "place", "t1", "t2")
    keyed = running(turns.withColumns({"h1": salted(1), "h2": salted(2)}), [F.col("place")])
    keyed = stored(
        keyed.select(
            "conv_id",
            F.col("place").alias("depth"),
            F.col("x1").alias("k1"),
            F.col("x2").alias("k2"),
            F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"),
            F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"),
            "size",
            "last",
        )
    )
    zero = F.lit(0).cast("long")
    nodes = keyed.groupBy("depth", "k1", "k2").agg(
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("size").alias("size"),
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2")], "conv_id", "n_convs", zero.alias("size"))
    ends = keyed.where("last").select("conv_id", "depth", "k1", "k2")
    alone = convs.where("turns = 0").select("conv_id", *[zero.alias(c) for c in ("depth", "k1", "k2")])
    return stored(nodes.unionByName(root)), ends.unionByName(alone)


# ---- digests of members ------------------------------------------------------------

_KEY = ["depth", "k1", "k2"]
_PIECE_SCHEMA = pa.schema([*((c, pa.int64()) for c in [*_KEY, "first"]), ("ids", pa.string()), ("whole", pa.bool_())])
_END_SCHEMA = pa.schema([*((c, pa.int64()) for c in _KEY), ("ends_sha256", pa.string())])


@tidy
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined ids of each node, in texts of at most PIECE_IDS; ``whole`` if the node ends and begins here for certain."""
    held: tuple | None = None
    ids: list[str] = []
    first, edge, cut = 0, True, False

    def row(end: bool) -> tuple:
        return (*held, first, ",".join(ids), not (edge or end or cut))

    rows: list[tuple] = []
    for batch in batches:
        depth, k1, k2, conv = (batch.column(c).to_numpy() for c in (*_KEY, "conv_id"))
        begin = run_starts(depth, k1, k2).tolist()
        for b, e in zip(begin, [*begin[1:], batch.num_rows]):
            key = (int(depth[b]), int(k1[b]), int(k2[b]))
            if key != held:
                if held is not None:
                    rows.append(row(False))
                    edge = False
                held, ids, first, cut = key, [], int(conv[b]), False
            for at in range(b, e, PIECE_IDS):
                if len(ids) >= PIECE_IDS:
                    cut = True
                    rows.append(row(False))
                    ids, first = [], int(conv[at])
                ids += map(str, conv[at : min(e, at + PIECE_IDS)].tolist())
        for at in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECE_SCHEMA.names, r)) for r in rows[at : at + 1024]], schema=_PIECE_SCHEMA)
        rows = []
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_PIECE_SCHEMA.names, row(True)))], schema=_PIECE_SCHEMA)


@tidy
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the pieces of each node, which come in order."""
    held, state = None, None
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in (*_KEY, "ids"))
        for *key, ids in zip(*columns):
            if key != held:
                if held is not None:
                    rows.append((*held, state.hexdigest()))
                held, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_END_SCHEMA.names, r)) for r in rows], schema=_END_SCHEMA)
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_END_SCHEMA.names, (*held, state.hexdigest())))], schema=_END_SCHEMA)


def end_digests(ends: DataFrame) -> DataFrame:
    """Rows (depth, k1, k2, ends_sha256): SHA-256 of each node's ascending conv_ids.

    Ids are joined where the sort by (node, id) leaves them; only nodes that lie across ranges, or have
    many ids, go on as texts to one task, which feeds them to the hash one after the other.
    """
    n = partitions(ends.sparkSession)
    pieces = stored(
        ends.repartitionByRange(n, *_KEY, "conv_id")
        .sortWithinPartitions(*_KEY, "conv_id")
        .mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, ids string, whole boolean")
    )
    kind = "depth long, k1 long, k2 long, ends_sha256 string"
    whole = pieces.where("whole").select(*_KEY, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    rest = pieces.where("not whole").repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first")
    return whole.unionByName(rest.select(*_KEY, "ids").mapInArrow(_hashed, kind))


# ---- time-forward processing -------------------------------------------------------


class SpillingQueue:
    """Sums by address, given back in ascending order of address.

    Beyond ``limit`` addresses the larger half goes to a sorted run in an unnamed file.
    """

    _ROW = "<qqqq"

    def __init__(self, limit: int = 0) -> None:
        self.limit = limit or QUEUE_LIMIT
        self.sums: dict[tuple[int, int], tuple[int, int]] = {}
        self.heap: list[tuple[int, int]] = []
        self.runs: list[Iterator[tuple]] = []
        self.heads: list[tuple] = []  # (address, run, sums)
        self.spills = 0

    def push(self, address: tuple[int, int], a: int, b: int) -> None:
        held = self.sums.get(address)
        if held is None:
            heapq.heappush(self.heap, address)
            self.sums[address] = (a, b)
            if len(self.heap) > self.limit:
                self._spill()
        else:
            self.sums[address] = (held[0] + a, held[1] + b)

    def _spill(self) -> None:
        self.heap.sort()  # a sorted list is a heap
        late = self.heap[self.limit // 2 :]
        del self.heap[self.limit // 2 :]
        rows = ((x, *self.sums.pop(x)) for x in late)
        if len(self.heads) >= 32:  # few open files: merge the runs there are
            rows = heapq.merge(rows, self._rest())
            self.runs, self.heads = [], []
        self._open(rows)
        self.spills += 1

    def _rest(self) -> Iterator[tuple]:
        runs = [self._from(h, self.runs[h[1]]) for h in self.heads]
        return heapq.merge(*runs)

    @staticmethod
    def _from(head: tuple, run: Iterator[tuple]) -> Iterator[tuple]:
        yield (head[0], *head[2])
        yield from run

    def _open(self, rows: Iterator[tuple]) -> None:
        file = tempfile.TemporaryFile()
        for (x, y), a, b in rows:
            file.write(struct.pack(self._ROW, x, y, a, b))
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                while block := file.read(struct.calcsize(self._ROW) * 512):
                    for x, y, a, b in struct.iter_unpack(self._ROW, block):
                        yield (x, y), a, b

        self.runs.append(read())
        self._advance(len(self.runs) - 1)

    def _advance(self, run: int) -> None:
        for address, a, b in self.runs[run]:
            heapq.heappush(self.heads, (address, run, (a, b)))
            break

    def least(self) -> tuple[int, int] | None:
        ends = [q[0] if q is self.heap else q[0][0] for q in (self.heap, self.heads) if q]
        return min(ends) if ends else None

    def pop(self) -> tuple[tuple[int, int], int, int]:
        """The least address with the sum of all that was sent there."""
        address = self.least()
        a = b = 0
        if self.heap and self.heap[0] == address:
            heapq.heappop(self.heap)
            a, b = self.sums.pop(address)
        while self.heads and self.heads[0][0] == address:
            _, run, (x, y) = heapq.heappop(self.heads)
            a, b = a + x, b + y
            self._advance(run)
        return address, a, b


_FLOW_COLUMNS = ["shard", "kind", "depth", "conv_id", "up_depth", "up_conv", "a", "b"]
_FLOW = ", ".join(f"{c} long" for c in _FLOW_COLUMNS)
_FLOW_SCHEMA = pa.schema([(c, pa.int64()) for c in _FLOW_COLUMNS])


def _flow_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_FLOW_SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_FLOW_SCHEMA)


def _flow_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


@tidy
def _upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of the nodes of shards (kind 0), and sums for parents elsewhere (kind 1)."""

    def rows() -> Iterator[tuple]:
        now, queue = None, SpillingQueue()

        def elsewhere(until: tuple[int, int] | None) -> Iterator[tuple]:
            while (least := queue.least()) is not None and (until is None or least < until):
                (depth, conv), a, b = queue.pop()
                yield now, 1, -depth, conv, None, None, a, b

        for shard, depth, conv, up_depth, up_conv, a, b in _flow_rows(batches, ["shard", *_FLOW_COLUMNS[2:]]):
            if shard != now:
                yield from elsewhere(None)
                now = shard
            here = (-depth, conv)
            yield from elsewhere(here)
            if queue.least() == here:
                _, x, y = queue.pop()
                a, b = a + x, b + y
            yield shard, 0, depth, conv, up_depth, up_conv, a, b
            if up_conv is not None:
                queue.push((-up_depth, up_conv), a, b)
        yield from elsewhere(None)

    yield from _flow_batches(rows())


@tidy
def _downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ends (kind 2 rows of nodes) the first node above them that is in another shard.

    Rows come in level order: a node (kind 0), whether it is an end (kind 2), its edges to children (kind 1, with
    the child in up_depth and up_conv). What a node hands down is the address of that node above.
    """

    def rows() -> Iterator[tuple]:
        now, queue, here, top = None, SpillingQueue(), None, None
        for shard, kind, depth, conv, up_depth, up_conv, a, b in _flow_rows(batches, _FLOW_COLUMNS):
            if shard != now:
                now, queue, here = shard, SpillingQueue(), None
            if kind == 0:
                while (least := queue.least()) is not None and least < (depth, conv):
                    queue.pop()
                if queue.least() == (depth, conv):
                    _, x, y = queue.pop()
                    top = None if x < 0 else (x, y)
                else:
                    top = None if up_conv is None else (up_depth, up_conv)
                here = (depth, conv)
            elif here != (depth, conv):
                continue  # the parent is in another shard
            elif kind == 1:
                queue.push((up_depth, up_conv), *(top or (-1, 0)))
            else:
                yield shard, 2, depth, conv, *(top or (None, None)), a, b

    yield from _flow_batches(rows())


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """Rows (depth, conv_id, a, b): values a and b summed over each node's subtree.

    ``nodes`` has depth, conv_id (its name), up_depth, up_conv (the parent's name; null at a root), a, b.
    Parents have smaller depths, and names that are not greater by (conv_id, depth).
    """
    spark = nodes.sparkSession
    shards = shards_for(nodes, nodes.count())
    placed = nodes.select("depth", "conv_id", "up_depth", "up_conv", "a", "b")
    if shards == 1:
        placed = placed.withColumn("shard", F.lit(0).cast("long"))
    else:
        placed = stored(placed.repartitionByRange(shards, "conv_id", "depth").withColumn("shard", F.spark_partition_id().cast("long")))

    def upward(df: DataFrame) -> DataFrame:
        dealt = df.repartition(max(1, min(shards, partitions(spark))), "shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id")
        return dealt.select("shard", *_FLOW_COLUMNS[2:]).mapInArrow(_upward, _FLOW)

    first = stored(upward(placed)) if shards > 1 else upward(placed)
    results = first.where("kind = 0").select("depth", "conv_id", "a", "b")
    if shards == 1 or not first.where("kind = 1").limit(1).count():
        return results
    ends = first.where("kind = 1").groupBy("depth", "conv_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ends = stored(ends.join(placed.select("depth", "conv_id", "shard"), ["depth", "conv_id"]))
    none = F.lit(None).cast("long")
    flow = placed.withColumn("kind", F.lit(0).cast("long")).select(*_FLOW_COLUMNS)
    edges = placed.where("up_conv is not null").select(
        "shard",
        F.lit(1).cast("long").alias("kind"),
        F.col("up_depth").alias("depth"),
        F.col("up_conv").alias("conv_id"),
        F.col("depth").alias("up_depth"),
        F.col("conv_id").alias("up_conv"),
        none.alias("a"),
        none.alias("b"),
    )
    asked = ends.select(
        "shard", F.lit(2).cast("long").alias("kind"), "depth", "conv_id", none.alias("up_depth"), none.alias("up_conv"), "a", "b"
    )
    order = ["shard", "depth", "conv_id", "kind", "up_depth", "up_conv"]
    down = flow.unionByName(edges).unionByName(asked).repartition(max(1, min(shards, partitions(spark))), "shard")
    forest = stored(down.sortWithinPartitions(*order).mapInArrow(_downward, _FLOW))
    incoming = stored(subtree_sums(forest.select("depth", "conv_id", "up_depth", "up_conv", "a", "b")))
    added = placed.join(incoming.select("depth", "conv_id", F.col("a").alias("in_a"), F.col("b").alias("in_b")), ["depth", "conv_id"], "left")
    zero = F.lit(0).cast("long")
    added = added.withColumns({"a": F.col("a") + F.coalesce("in_a", zero), "b": F.col("b") + F.coalesce("in_b", zero)})
    return upward(added).where("kind = 0").select("depth", "conv_id", "a", "b")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, one row per node.

    ``conversations`` has conv_id, turn, role, text. Turns are ordered by turn (null first; ties by role, then
    by a digest of role and text, so repeated rows are repeated turns); null roles and texts are empty. Conversation c
    begins with the first crc32(c) % HEADS turns of conversation c - c % GROUP instead of its own. Rows with
    a null conv_id are left out; an empty table has no nodes.

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) * code points of the last text), ends_sha256 (of the members of
    exactly ``depth`` turns).
    """
    nodes, ends = trie_nodes(conversations)
    digests = end_digests(ends)
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    # all nodes of depth 1 have one parent, the root, whose name needs no join
    root = nodes.where("depth = 0").first()
    deep = nodes.where("depth > 1").join(above.where("depth > 1"), ["depth", "p1", "p2"]).select(*nodes.columns, "parent_conv_id")
    top = F.when(F.col("depth") == 1, F.lit(root["conv_id"] if root else None)).cast("long")
    named = stored(deep.unionByName(nodes.where("depth <= 1").withColumn("parent_conv_id", top)))
    children = named.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"))
    children = children.agg(F.count("*").alias("n_children"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    whole = stored(
        named.join(children, ["depth", "conv_id"], "left")
        .join(digests, _KEY, "left")
        .select(
            "depth",
            "conv_id",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
            F.coalesce("ends_sha256", empty).alias("ends_sha256"),
        )
    )
    sums = subtree_sums(
        whole.select(
            "depth",
            "conv_id",
            F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_depth"),
            F.col("parent_conv_id").alias("up_conv"),
            (F.col("n_children") == 0).cast("long").alias("a"),
            F.col("saved").alias("b"),
        )
    )
    return whole.join(sums, ["depth", "conv_id"]).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("a").alias("n_leaves"),
        F.col("b").alias("saved_tokens"),
        "ends_sha256",
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = """
WITH t AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 100 AS base, max(place) AS turns,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))) % 6 AS h
  FROM t GROUP BY conv_id
),
r AS (
  SELECT c.conv_id, t.place AS o, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, t.place AS o, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h
),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS depth, role, text FROM r),
k AS MATERIALIZED (
  SELECT conv_id, depth, length(text) AS size,
         sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node
  FROM n
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c
),
e AS (SELECT conv_id, max(depth) AS depth FROM k GROUP BY conv_id),
m AS MATERIALIZED (
  SELECT node, k.depth, min(k.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved,
         sha256(coalesce(string_agg(k.conv_id::VARCHAR, ',' ORDER BY k.conv_id) FILTER (WHERE e.depth = k.depth), '')) AS ends_sha256
  FROM k JOIN e USING (conv_id) GROUP BY node, k.depth
),
u AS (SELECT DISTINCT b.node, a.node AS up FROM k b JOIN k a ON a.conv_id = b.conv_id AND a.depth = b.depth - 1),
q AS MATERIALIZED (SELECT up AS node, count(*) AS n_children FROM u GROUP BY up),
s AS (SELECT DISTINCT a.node AS top, b.node FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
z AS (
  SELECT s.top AS node, sum((coalesce(q.n_children, 0) = 0)::BIGINT)::BIGINT AS n_leaves, sum(m.saved)::BIGINT AS saved_tokens
  FROM s JOIN m ON m.node = s.node LEFT JOIN q ON q.node = s.node GROUP BY s.top
)
SELECT m.conv_id::BIGINT AS conv_id, m.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, m.n_convs::BIGINT AS n_convs,
       coalesce(q.n_children, 0)::BIGINT AS n_children, z.n_leaves, z.saved_tokens, m.ends_sha256
FROM m JOIN z USING (node) LEFT JOIN q USING (node) LEFT JOIN u USING (node) LEFT JOIN m p ON p.node = u.up
"""
