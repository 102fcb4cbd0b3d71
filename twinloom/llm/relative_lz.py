"""Substring dedup by relative Lempel-Ziv factors.

The reference is the collection itself, dealt into blocks by window hash. A block's index
maps each window of ``window`` words to the first place that has it. Every document asks
every block that can hold one of its windows, and gets the first place of each window that
has an earlier one. It is then factored greedily: a factor begins at the first window with
an earlier place and runs on as long as the next window continues at that same place of the
reference. At a factor's end the windows that straddle the boundary are checked on their
own, as they may continue another reference. Factors are at least one window long, and
what they cover is duplicate text.

Only windows whose anchor repeats are asked about (see repeats.py), each distinct one once
per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from twinloom.llm.common import (
    as_bytes,
    documents,
    kept_fields,
    mix,
    partitions,
    run_starts,
    sliding_sum,
    tidy,
    unpacked,
    word_hashes,
)
from twinloom.llm.repeats import (
    Shape,
    anchored,
    blocks,
    bucket_of,
    bucket_rows,
    by_document,
    dealt_by_id,
    found_of,
    group_rows,
    group_schema,
    marked_windows,
    repeated_anchors,
    with_findings,
)

FLUSH_WINDOWS = 2_000_000
_FIRST, _SECOND = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)

_ASKED = ["high", "low", "docs", "starts"]
_KNOWN = ["known_docs", "known_starts", "known_from", "known_at"]
_WINDOW = "bucket int, " + ", ".join(f"{c} binary" for c in _ASKED + _KNOWN)
_WINDOW_SCHEMA = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in _ASKED + _KNOWN])
_PLACES = {"starts": np.uint32, "from_docs": np.int64, "from_starts": np.uint32}


def _earlier(high, low, docs, starts):
    """Sorted occurrences, whether each has an earlier one, and the number of the first one."""
    order = np.lexsort((starts, docs, low, high))
    high, low = high[order], low[order]
    begin = run_starts(high, low)
    first = np.repeat(begin, np.diff(np.append(begin, len(high))))
    docs, starts = docs[order], starts[order]
    later = (docs != docs[first]) | (starts != starts[first])
    return order, later, first, docs, starts


def _ask_windows(shape: Shape, n: int):
    def send(parts) -> pa.RecordBatch:
        high, low, docs, starts = (np.concatenate(x) for x in zip(*parts))
        order, later, first, docs, starts = _earlier(high, low, docs, starts)
        high, low = high[order], low[order]
        lead = np.flatnonzero(first == np.arange(len(first)))
        return bucket_rows(
            n,
            [
                (bucket_of(high[lead], n), dict(zip(_ASKED, (high[lead], low[lead], docs[lead], starts[lead])))),
                (
                    bucket_of(mix(docs[later].view(np.uint64)), n),
                    dict(zip(_KNOWN, (docs[later], starts[later], docs[first][later], starts[first][later]))),
                ),
            ],
            _WINDOW_SCHEMA,
        )

    @tidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("__llm_id").to_numpy(zero_copy_only=False)
            found = found_of(batch)
            for block in blocks(shape, as_bytes(batch.column("text"))):
                a = anchored(shape, block)
                if not len(a.starts):
                    continue
                mine = marked_windows(block, a, found)
                at, text = a.starts[mine], a.texts[mine]
                parts.append(
                    (
                        mix(sliding_sum(block.values, shape.window, _FIRST)[at]),
                        (sliding_sum(block.values, shape.window, _SECOND)[at] >> np.uint64(32)).astype(np.uint32),
                        ids[np.asarray(block.places)[text]],
                        (at - block.offsets[text]).astype(np.uint32),
                    )
                )
                held += len(at)
            if held >= FLUSH_WINDOWS:
                yield send(parts)
                parts, held = [], 0
        if held:
            yield send(parts)

    return run


def _index(n: int):
    """One block of the reference: its windows' first places, and who else has them."""

    @tidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[bytes]] = {c: [] for c in _ASKED + _KNOWN}
        for batch in batches:
            for c in got:
                got[c] += batch.column(c).to_pylist()
        high, low = unpacked(got["high"], np.uint64), unpacked(got["low"], np.uint32)
        _, later, first, docs, starts = _earlier(
            high, low, unpacked(got["docs"], np.int64), unpacked(got["starts"], np.uint32)
        )
        yield from group_rows(
            n,
            np.concatenate([docs[later], unpacked(got["known_docs"], np.int64)]),
            {
                "starts": np.concatenate([starts[later], unpacked(got["known_starts"], np.uint32)]),
                "from_docs": np.concatenate([docs[first][later], unpacked(got["known_from"], np.int64)]),
                "from_starts": np.concatenate([starts[first][later], unpacked(got["known_at"], np.uint32)]),
            },
        )

    return run


def factor(starts: np.ndarray, docs: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """Greedy factors (start, words, from_doc, from_start) of one document.

    ``starts``: its windows that have an earlier place, ascending, each once; ``docs`` and
    ``places``: that place. A factor goes on while the next window continues it; where it
    ends, the window after it that still straddles its end may begin the next factor.
    """
    if not len(starts):
        return np.empty((0, 4), dtype=np.int64)
    goes_on = (starts[1:] == starts[:-1] + 1) & (docs[1:] == docs[:-1]) & (places[1:] == places[:-1] + 1)
    begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    last = np.append(begin[1:], len(starts)) - 1
    return np.stack([starts[begin], starts[last] - starts[begin] + window, docs[begin], places[begin]], axis=1)


def _cut(text: bytes, n_words: int, factors: np.ndarray) -> tuple[int, bytes]:
    """Number of removed words, and the kept ones joined by one space."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(change, factors[:, 0], 1)
    np.add.at(change, factors[:, 0] + factors[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    words = text.split()
    return n_words - int(keep.sum()), b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def _finish(text_at: str, window: int, schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(text_at))
            found = found_of(batch)
            total, removed, kept, spans = [], [], [], []
            for text, parts in zip(texts, found):
                if not parts:
                    words = text.split()
                    total.append(len(words))
                    removed.append(0)
                    kept.append(b" ".join(words))
                    spans.append([])
                    continue
                got = {c: np.frombuffer(parts[c], t).astype(np.int64) for c, t in _PLACES.items()}
                _, once = np.unique(got["starts"], return_index=True)
                factors = factor(*(got[c][once] for c in _PLACES), window)
                total.append(len(text.split()))
                gone, rest = _cut(text, total[-1], factors)
                removed.append(gone)
                kept.append(rest)
                spans.append([dict(zip(("start", "words", "from_doc", "from_start"), f)) for f in factors.tolist()])
            made = {"n_words": total, "n_removed": removed, "kept_text": kept, "factors": spans}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(made[f.name], type=pa.binary()).cast(pa.string())
                    if f.name == "kept_text"
                    else pa.array(made[f.name], type=f.type)
                    if f.name in made
                    else batch.column(f.name)
                    for f in schema
                ],
                schema=schema,
            )

    return run


_FACTOR = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "words", "from_doc", "from_start")])
_RESULTS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()),
        T.StructField("factors", T.ArrayType(_FACTOR)),
    ]
)


def remove_repeated_text(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """Cut every word covered by a window of words that also starts earlier.

    ``docs`` has doc_id (integer) and text; its other columns stay, except that results
    replace columns of the same names. Added: n_words, n_removed, kept_text (kept words
    joined by one space) and factors (start, words, from_doc, from_start).

    Null text counts as empty: no words, kept_text "". Texts shorter than a window are kept.
    "Earlier" is a smaller doc_id, or the same document and an earlier start. Rows that
    repeat a doc_id count as one document: equal rows are treated alike, and neither is
    earlier. A row with a null doc_id keeps its words and is no reference. An empty table
    gives an empty one. Equality of windows is decided by 96-bit hashes.
    """
    shape = Shape("words", window, gram)
    n = partitions(docs.sparkSession)
    keep = kept_fields(docs, _RESULTS)
    base = docs.select(*[f"`{f.name}`" for f in keep])
    dealt, lone = dealt_by_id(base)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    answers, _ = repeated_anchors(base.where(F.col("doc_id").isNotNull()).select(ids, "text"), shape)
    asked = with_findings(dealt, answers, "inner").mapInArrow(_ask_windows(shape, n), _WINDOW)
    found = asked.repartitionById(n, F.col("bucket")).mapInArrow(_index(n), group_schema(_PLACES)[0])
    schema = T.StructType(keep + _RESULTS.fields)
    finish = _finish("text", window, to_arrow_schema(schema))
    whole = with_findings(dealt, by_document(found, _PLACES), "left").mapInArrow(finish, schema)
    return whole.unionByName(lone.mapInArrow(finish, schema))


def op4_relative_lz(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeated_text(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
