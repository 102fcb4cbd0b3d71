"""Which windows of texts may repeat: anchors, and the questions about them.

A window of ``window`` units (words or bytes) picks one of its grams as its anchor: the
leftmost one of smallest hash. Equal windows pick the same gram, so a window that occurs
twice has an anchor that occurs twice. About one gram in ``(window - gram) / 2`` is an
anchor, and only windows of repeated anchors need a closer look.

``repeated_anchors`` finds these anchors. A task sends every distinct anchor once to the
anchor's bucket; what repeats within the task is known there and asks for nothing, so
that a passage found in a third of all documents loads no bucket. Buckets answer to
groups of documents. Rows carry packed arrays instead of one row per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import (
    as_bytes,
    mix,
    odd_numbers,
    packed,
    partitions,
    run_starts,
    sliding_min,
    stored,
    text_segments,
    tidy,
    unpacked,
    word_hashes,
)

FLUSH_ANCHORS = 3_000_000  # anchors that a task holds before it sends them
HOT_PER_BUCKET = 32  # an anchor is hot with that fraction of its bucket's occurrences
HOT_LEAST = 1024  # occurrences

_LOW = np.uint64((1 << 24) - 1)


class Shape(NamedTuple):
    """Units are "words" or "bytes"; gram units make an anchor."""

    units: str
    window: int
    gram: int


class Block(NamedTuple):
    """Units of some texts one after the other; offsets by text."""

    places: list[int]
    values: np.ndarray
    offsets: np.ndarray


class Anchored(NamedTuple):
    """Windows of a block, in order: their starts, anchors (both block places) and text numbers."""

    starts: np.ndarray
    anchors: np.ndarray
    texts: np.ndarray
    grams: np.ndarray


def blocks(shape: Shape, texts: list[bytes]) -> Iterator[Block]:
    for places, group in text_segments(texts):
        if shape.units == "words":
            values, offsets = word_hashes(group)
        else:
            values = np.frombuffer(b"".join(group), dtype=np.uint8)
            offsets = np.cumsum([0] + [len(t) for t in group]).astype(np.int64)
        yield Block(places, values, offsets)


def gram_hashes(shape: Shape, values: np.ndarray) -> np.ndarray:
    """Hash of the gram at each place; the last places of the block have none."""
    n = len(values) - shape.gram + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    odd = odd_numbers(shape.gram, 7)
    if shape.units == "bytes":  # eight bytes at a time
        eight = np.ndarray((len(values) - 7,), dtype="<u8", buffer=values.tobytes(), strides=(1,))
        total = np.zeros(n, dtype=np.uint64)
        for k, at in enumerate(range(0, shape.gram, 8)):
            total += mix(eight[at : at + n] * odd[k])
        return mix(total)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(shape.gram):
        total += values[k : k + n] * odd[k]
    return mix(total)


def anchored(shape: Shape, block: Block) -> Anchored:
    """All windows of a block that lie within one text, with their anchors."""
    lengths = np.diff(block.offsets)
    counts = np.maximum(lengths - shape.window + 1, 0)
    n = int(counts.sum())
    empty = np.empty(0, dtype=np.int64)
    if not n:
        return Anchored(empty, empty, empty, np.empty(0, dtype=np.uint64))
    texts = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    starts = np.arange(n) - np.repeat(first - block.offsets[:-1], counts)
    grams = gram_hashes(shape, block.values)
    width = shape.window - shape.gram + 1
    if len(grams) <= int(_LOW):
        keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        anchors = (sliding_min(keys, width)[starts] & _LOW).astype(np.int64)
    else:  # a text of over 16 million units: pieces that overlap by a window
        anchors, step = np.empty(n, dtype=np.int64), int(_LOW) - width
        for at in range(0, len(grams), step):
            part = grams[at : at + step + width - 1]
            keys = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
            mine = (starts >= at) & (starts < at + step)
            found = sliding_min(keys, width)[starts[mine] - at] & _LOW
            anchors[mine] = found.astype(np.int64) + at
    return Anchored(starts, anchors, texts, grams)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


_ASK = "bucket int, hashes binary, docs binary, places binary, known_docs binary, known_places binary"
_ASK_SCHEMA = pa.schema(
    [("bucket", pa.int32())]
    + [(c, pa.binary()) for c in ("hashes", "docs", "places", "known_docs", "known_places")]
)
_PLACES = {"places": np.uint32}


def by_bucket(n: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> dict[int, dict[str, bytes]]:
    """Packed slices of columns by bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begin = run_starts(bucket)
    end = np.append(begin[1:], len(bucket))
    rows: dict[int, dict[str, bytes]] = {int(b): {} for b in bucket[begin]}
    for name, values in columns.items():
        for b, blob in zip(bucket[begin].tolist(), packed(values[order], begin, end)):
            rows[b][name] = blob
    return rows


def bucket_rows(n: int, parts: list[tuple[np.ndarray, dict[str, np.ndarray]]], schema: pa.Schema) -> pa.RecordBatch:
    """One row per bucket, with the packed columns of all parts."""
    rows: dict[int, dict[str, bytes]] = {}
    for bucket, columns in parts:
        for b, found in by_bucket(n, bucket, columns).items():
            rows.setdefault(b, {}).update(found)
    arrays = [pa.array(list(rows), type=pa.int32())]
    arrays += [
        pa.array([rows[b].get(f.name, b"") for b in rows], type=f.type) for f in list(schema)[1:]
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _ask(shape: Shape, n: int):
    def send(hashes, docs, places) -> pa.RecordBatch:
        h, d, p = (np.concatenate(x) for x in (hashes, docs, places))
        order = np.argsort(h, kind="stable")
        h, d, p = h[order], d[order], p[order]
        begin = run_starts(h)
        size = np.diff(np.append(begin, len(h)))
        many = np.repeat(size > 1, size)
        # A document number to answer, or the negative count of what needs no answer.
        asks = np.where(size > 1, -1 - size, d[begin])
        alone = size == 1
        return bucket_rows(
            n,
            [
                (
                    bucket_of(h[begin], n),
                    {
                        "hashes": h[begin],
                        "docs": asks,
                        "places": np.where(alone, p[begin], 0xFFFFFFFF).astype(np.uint32),
                    },
                ),
                (
                    bucket_of(mix(d[many].view(np.uint64)), n),
                    {"known_docs": d[many], "known_places": p[many]},
                ),
            ],
            _ASK_SCHEMA,
        )

    @tidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, places, held = [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for block in blocks(shape, as_bytes(batch.column(1))):
                a = anchored(shape, block)
                if not len(a.starts):
                    continue
                first = run_starts(a.anchors, a.texts)
                at, text = a.anchors[first], a.texts[first]
                hashes.append(a.grams[at])
                docs.append(ids[np.asarray(block.places)[text]])
                places.append((at - block.offsets[text]).astype(np.uint32))
                held += len(at)
            if held >= FLUSH_ANCHORS:
                yield send(hashes, docs, places)
                hashes, docs, places, held = [], [], [], 0
        if held:
            yield send(hashes, docs, places)

    return run


def group_schema(columns: dict) -> tuple[str, pa.Schema]:
    """Rows of packed findings for a group of documents; ``hot`` stands in rows of its own."""
    names = ["docs", *columns]
    ddl = "bucket int, " + ", ".join(f"{c} binary" for c in names) + ", hot long"
    fields = [("bucket", pa.int32())] + [(c, pa.binary()) for c in names] + [("hot", pa.int64())]
    return ddl, pa.schema(fields)


def group_rows(n: int, docs: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Findings packed by group of documents."""
    if not len(docs):
        return
    rows = by_bucket(n, bucket_of(mix(docs.view(np.uint64)), n), {"docs": docs, **columns})
    _, schema = group_schema(columns)
    arrays = [pa.array(list(rows), type=pa.int32())]
    arrays += [pa.array([r[c] for r in rows.values()], type=pa.binary()) for c in ("docs", *columns)]
    yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(rows), pa.int64())], schema=schema)


def by_document(findings: DataFrame, types: dict) -> DataFrame:
    """One row (doc_id, packed columns) per document from rows of ``group_rows``."""
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.binary()) for c in types])

    @tidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[bytes]] = {c: [] for c in ("docs", *types)}
        for batch in batches:
            for c in got:
                got[c] += batch.column(c).to_pylist()
        docs = unpacked(got["docs"], np.int64)
        if not len(docs):
            return
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        begin = run_starts(docs)
        end = np.append(begin[1:], len(docs))
        blobs = [packed(unpacked(got[c], t)[order], begin, end) for c, t in types.items()]
        for at in range(0, len(begin), 4096):
            some = slice(at, at + 4096)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[begin[some]])] + [pa.array(x[some], type=pa.binary()) for x in blobs], schema=schema
            )

    n = partitions(findings.sparkSession)
    ddl = "doc_id long, " + ", ".join(f"{c} binary" for c in types)
    grouped = findings.where(F.col("bucket").isNotNull()).repartitionById(n, F.col("bucket"))
    return grouped.mapInArrow(run, ddl)


def _answer(n: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[bytes]] = {c: [] for c in _ASK_SCHEMA.names[1:]}
        for batch in batches:
            for c in got:
                got[c] += batch.column(c).to_pylist()
        h = unpacked(got["hashes"], np.uint64)
        d = unpacked(got["docs"], np.int64)
        p = unpacked(got["places"], np.uint32)
        order = np.argsort(h, kind="stable")
        h, d, p = h[order], d[order], p[order]
        begin = run_starts(h)
        size = np.diff(np.append(begin, len(h)))
        twice = np.repeat(size > 1, size) & (p != 0xFFFFFFFF)
        docs = np.concatenate([d[twice], unpacked(got["known_docs"], np.int64)])
        places = np.concatenate([p[twice], unpacked(got["known_places"], np.uint32)])
        yield from group_rows(n, docs, {"places": places})
        if len(h):
            count = np.add.reduceat(np.where(p == 0xFFFFFFFF, -1 - d, 1), begin)
            least = max(HOT_LEAST, int(count.sum()) // HOT_PER_BUCKET)
            hot = h[begin][count >= least]
            if len(hot):
                none = [pa.nulls(len(hot), f.type) for f in list(group_schema(_PLACES)[1])[:-1]]
                yield pa.RecordBatch.from_arrays([*none, pa.array(hot.view(np.int64))], schema=group_schema(_PLACES)[1])

    return run


def repeated_anchors(docs: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Anchors of documents that occur elsewhere in ``docs``, and hot anchors.

    Takes columns doc_id (long, not null) and text. Gives rows (doc_id, places), one per
    document, and rows ``hot``: hashes of the few anchors (at most HOT_PER_BUCKET for
    each shuffle partition) that would fill a good part of a bucket.
    """
    n = partitions(docs.sparkSession)
    asked = docs.select("doc_id", "text").mapInArrow(_ask(shape, n), _ASK)
    answers = asked.repartitionById(n, F.col("bucket")).mapInArrow(_answer(n), group_schema(_PLACES)[0])
    answers = stored(answers)
    return by_document(answers, _PLACES), answers.where(F.col("hot").isNotNull()).select("hot")


def dealt_by_id(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id, dealt by it under the key ``__llm_id``, and rows without one.

    Two joins on ``__llm_id`` that read all columns share this one exchange of the texts.
    """
    keyed = docs.withColumn("__llm_id", F.col("doc_id").cast("long"))
    dealt = keyed.where(F.col("__llm_id").isNotNull()).repartition(partitions(docs.sparkSession), "__llm_id")
    return dealt, docs.where(F.col("doc_id").cast("long").isNull())


def with_findings(dealt: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The dealt rows with their document's findings in ``__llm_found``, built on the narrow side."""
    found = F.struct(*[c for c in rows.columns if c != "doc_id"]).alias("__llm_found")
    return dealt.join(rows.select(F.col("doc_id").alias("__llm_id"), found).hint("shuffle_hash"), "__llm_id", how)


def found_of(batch: pa.RecordBatch) -> list[dict | None]:
    """The findings of a batch; rows without an id were not joined and have none."""
    if "__llm_found" not in batch.schema.names:
        return [None] * batch.num_rows
    return batch.column("__llm_found").to_pylist()


def marked_windows(block: Block, windows: Anchored, found: list[dict | None]) -> np.ndarray:
    """Which windows have an anchor that repeats."""
    marked = np.zeros(len(block.values), dtype=bool)
    for k, place in enumerate(block.places):
        at = np.frombuffer(found[place]["places"], np.uint32).astype(np.int64)
        at = at[at < block.offsets[k + 1] - block.offsets[k]]
        marked[at + block.offsets[k]] = True
    return marked[windows.anchors]
