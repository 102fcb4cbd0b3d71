"""Substring dedup with suffix arrays built by induced sorting.

A shard's text is sorted as follows. Suffixes are classified as smaller (S) or larger (L)
than the next one; the leftmost S of each run (LMS) is a sample. LMS substrings are sorted
by inducing L from LMS and S from L, get names, and the string of names is sorted
recursively: names of neighbours are paired at doubled distance until all are different.
The sorted LMS suffixes then induce the whole array. Permuted common prefixes come from the
predecessor links: only irreducible ones are compared, the others are one less than their
left neighbour. Suffixes next to each other with a common prefix of a window or more share
that window; all but the first place of each window are cut.

Buckets of a symbol are handled as whole arrays, a symbol's own run step by step, so that
the work is linear and in numpy.

Which texts meet in a shard: a window goes to the shard of its anchor (repeats.py), together
with the neighbouring windows of that anchor. Equal stretches are sent once per task and
enter a shard once. Windows of hot anchors go one by one to the shard of their own hash, so
that no shard grows with a common passage.
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

SEPARATOR = 0xFF  # never part of UTF-8
SHARD_BYTES = 1 << 20
FINE = 64  # parts of a partition that a shard is made of
FLUSH_BYTES = 24 << 20  # distinct stretches that a task holds before it sends them


# ---- induced sorting ---------------------------------------------------------------


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the end of the text is smaller than every symbol."""
    n = len(text)
    rise = np.empty(n, dtype=np.int8)
    rise[-1] = -1
    rise[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    at = np.where(rise != 0, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _deal(text: np.ndarray, found: list[np.ndarray], lists: list[list[np.ndarray]]) -> None:
    """Append suffixes to the lists of their first symbols, in order."""
    if not found:
        return
    suffixes = np.concatenate(found)
    symbols = text[suffixes]
    order = np.argsort(symbols, kind="stable")
    suffixes, symbols = suffixes[order], symbols[order]
    begin = run_starts(symbols)
    for b, e in zip(begin.tolist(), np.append(begin[1:], len(symbols)).tolist()):
        lists[symbols[b]].append(suffixes[b:e])


def _step(text, wanted, lists, symbol: int, rest: np.ndarray) -> None:
    """Induce from one bucket: its own growing list first, then ``rest``."""
    found, mine = [], lists[symbol]
    done = 0
    while done < len(mine):
        batch = np.concatenate(mine[done:]) if len(mine) - done > 1 else mine[done]
        mine[done:] = [batch]
        done += 1
        before = batch[batch > 0] - 1
        before = before[wanted[before]]
        same = text[before] == symbol
        if same.any():
            mine.append(before[same])
            before = before[~same]
        if len(before):
            found.append(before)
    before = rest[rest > 0] - 1
    before = before[wanted[before]]
    if len(before):
        found.append(before)
    _deal(text, found, lists)


def _induce(text: np.ndarray, small: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """The suffix array from LMS suffixes, in the order given within a symbol."""
    none = np.empty(0, dtype=samples.dtype)
    large_lists: list[list[np.ndarray]] = [[] for _ in range(256)]
    small_lists: list[list[np.ndarray]] = [[] for _ in range(256)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal(text, [samples] if len(samples) else [], seeds)
    large_lists[text[-1]].append(np.array([len(text) - 1], dtype=samples.dtype))
    large = ~small
    join = lambda parts: np.concatenate(parts) if parts else none
    for c in range(256):
        if large_lists[c] or seeds[c]:
            _step(text, large, large_lists, c, join(seeds[c]))
    for c in range(255, -1, -1):
        if large_lists[c] or small_lists[c]:
            _step(text, small, small_lists, c, join(large_lists[c])[::-1])
    return np.concatenate([x for c in range(256) for x in (join(large_lists[c]), join(small_lists[c])[::-1])])


def _eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on; past the end they are zero."""
    data = text.tobytes() + b"\0" * 8
    return np.ndarray((len(text) + 1,), dtype="<u8", buffer=data, strides=(1,))


def _sort_names(names: np.ndarray, step: int = 1) -> np.ndarray:
    """Rank of each suffix of a string of names: pairs of names are named anew, recursively."""
    if len(names) == 0 or int(names.max()) + 1 == len(names):
        return names
    after = np.zeros(len(names), dtype=np.int64)
    after[:-step] = names[step:] + 1
    _, pairs = np.unique(names * (int(names.max()) + 2) + after, return_inverse=True)
    return _sort_names(pairs, 2 * step)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes."""
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int64)
    small = _types(text)
    is_sample = np.zeros(len(text), dtype=bool)
    is_sample[1:] = small[1:] & ~small[:-1]
    samples = np.flatnonzero(is_sample)
    if len(samples) > 1:
        rough = _induce(text, small, samples)
        rough = rough[is_sample[rough]]
        # Names: LMS substrings next to each other in this order are equal or not.
        length = np.zeros(len(text), dtype=np.int64)
        length[samples[:-1]] = np.diff(samples) + 1
        a, b = rough[:-1], rough[1:]
        same = (length[a] == length[b]) & (length[a] > 0)
        open_ = np.flatnonzero(same)
        eight, at = _eight(text), 0
        while len(open_):
            left = length[a[open_]] - at
            mask = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1))
            equal = (eight[a[open_] + at] & mask) == (eight[b[open_] + at] & mask)
            same[open_[~equal]] = False
            at += 8
            open_ = open_[equal & (left > 8)]
        names = np.empty(len(text), dtype=np.int64)
        names[rough] = np.concatenate([[0], np.cumsum(~same)])
        ranks = _sort_names(names[samples])
        ordered = np.empty_like(samples)
        ordered[ranks] = samples
        samples = ordered
    return _induce(text, small, samples)


def common_prefixes(text: np.ndarray, order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """By place: common prefix with the preceding suffix of the array, at most ``room`` long."""
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (before[1:] <= 0) | (text[:-1] != text[np.maximum(before[1:] - 1, 0)]) | (text[:-1] == SEPARATOR)
    prefix = np.zeros(n, dtype=np.int64)
    places = np.flatnonzero(fresh & (before >= 0))
    eight, at = _eight(text), 0
    limit = np.minimum(room[places], n - np.maximum(places, before[places]))
    alive = np.arange(len(places))
    while len(alive):
        p = places[alive]
        differ = eight[p + at] ^ eight[before[p] + at]
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) // 8)
        got = np.minimum(at + same, limit[alive])
        prefix[p] = got
        at += 8
        alive = alive[(differ == 0) & (limit[alive] > at)]
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(prefix[last] - (np.arange(n) - last), 0)


# ---- shards ------------------------------------------------------------------------

_SENT = ["text", "lengths", "docs", "starts", "parts"]
_CUT = ["cut_docs", "cut_starts", "cut_lengths"]
_STRETCH = "bucket int, " + ", ".join(f"{c} binary" for c in _SENT + _CUT)
_STRETCH_SCHEMA = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in _SENT + _CUT])
_SPANS = {"starts": np.uint32, "lengths": np.uint32}


def _stretches(shape: Shape, n: int, hot: np.ndarray):
    """Stretches of windows with one anchor; equal ones once per task."""

    def send(first: dict, cut: list) -> pa.RecordBatch:
        keys = list(first)
        lengths = np.array([len(k) for k in keys], dtype=np.uint32)
        docs = np.array([first[k][0] for k in keys], dtype=np.int64)
        starts = np.array([first[k][1] for k in keys], dtype=np.uint32)
        fine = bucket_of(np.array([first[k][2] for k in keys], dtype=np.uint64), n * FINE)
        order = np.argsort(fine, kind="stable")
        bucket, parts = fine // FINE, (fine % FINE).astype(np.uint8)
        begin = run_starts(bucket[order])
        rows = {}
        for b, e in zip(begin.tolist(), np.append(begin[1:], len(order)).tolist()):
            mine = order[b:e]
            rows[int(bucket[mine[0]])] = {
                "text": b"".join([keys[k] for k in mine.tolist()]),
                "lengths": lengths[mine].tobytes(),
                "docs": docs[mine].tobytes(),
                "starts": starts[mine].tobytes(),
                "parts": parts[mine].tobytes(),
            }
        batch = [pa.array(list(rows), type=pa.int32())]
        batch += [pa.array([r.get(c, b"") for r in rows.values()], type=pa.binary()) for c in _SENT + _CUT]
        yield pa.RecordBatch.from_arrays(batch, schema=_STRETCH_SCHEMA)
        if cut:
            gone = np.array(cut, dtype=np.int64)
            known = bucket_of(mix(np.ascontiguousarray(gone[:, 0]).view(np.uint64)), n)
            yield bucket_rows(
                n,
                [
                    (
                        known,
                        {
                            "cut_docs": gone[:, 0],
                            "cut_starts": gone[:, 1].astype(np.uint32),
                            "cut_lengths": gone[:, 2].astype(np.uint32),
                        },
                    )
                ],
                _STRETCH_SCHEMA,
            )

    @tidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int, int]] = {}
        cut: list[tuple[int, int, int]] = []
        held = 0
        for batch in batches:
            ids = batch.column("__llm_id").to_numpy(zero_copy_only=False)
            found = found_of(batch)
            for block in blocks(shape, as_bytes(batch.column("text"))):
                a = anchored(shape, block)
                if not len(a.starts):
                    continue
                mine = marked_windows(block, a, found)
                starts, texts, anchors = a.starts[mine], a.texts[mine], a.anchors[mine]
                if not len(starts):
                    continue
                hashes = a.grams[anchors]
                begin = run_starts(anchors, texts)
                end = np.append(begin[1:], len(starts)) - 1
                if len(hot):  # windows of hot anchors go alone, to the shard of their own hash
                    near = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
                    single = np.flatnonzero(hot[near] == hashes)
                    own = sliding_sum(block.values.astype(np.uint64), shape.window, np.uint64(0xD1342543DE82EF95))
                    hashes = hashes.copy()
                    hashes[single] = mix(own[starts[single]])
                    whole = hot[near[begin]] != a.grams[anchors[begin]]
                    begin, end = np.append(begin[whole], single), np.append(end[whole], single)
                data = block.values.tobytes()
                begins, ends = starts[begin], starts[end] + shape.window
                docs = ids[np.asarray(block.places)[texts[begin]]]
                inside = begins - block.offsets[texts[begin]]
                for b, e, d, s, h in zip(
                    begins.tolist(), ends.tolist(), docs.tolist(), inside.tolist(), hashes[begin].tolist()
                ):
                    key = data[b:e]
                    known = first.get(key)
                    if known is None:
                        first[key] = (d, s, h)
                        held += e - b + 120
                    elif (d, s) < known[:2]:
                        first[key] = (d, s, h)
                        cut.append((known[0], known[1], e - b))
                    elif (d, s) > known[:2]:
                        cut.append((d, s, e - b))
            if held + 60 * len(cut) >= FLUSH_BYTES:
                yield from send(first, cut)
                first, cut, held = {}, [], 0
        if first:
            yield from send(first, cut)

    return run


def repeated_windows(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int):
    """Windows of distinct pieces that have an earlier place: (document, start) of each."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    text = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]), dtype=np.uint8)
    begin = np.cumsum(lengths + 1) - lengths - 1
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    inside = np.arange(len(text)) - begin[piece]
    room = lengths[piece] - inside
    order = suffix_array(text)
    prefix = common_prefixes(text, order, room)
    order = order[room[order] > 0]
    # Runs of suffixes whose first window is the same. A suffix shorter than a window ends a run.
    far = (prefix[order] < window) | (room[order] < window)
    run = np.cumsum(far)
    size = np.bincount(run, minlength=int(run[-1]) + 1 if len(run) else 0)
    many = (size[run] > 1) & (room[order] >= window)
    at, run = order[many], run[many]
    doc, start = docs[piece[at]], starts[piece[at]] + inside[at]
    sort = np.lexsort((start, doc, run))
    doc, start, run = doc[sort], start[sort], run[sort]
    lead = run_starts(run)
    lead = np.repeat(lead, np.diff(np.append(lead, len(run))))
    later = (doc != doc[lead]) | (start != start[lead])
    return doc[later], start[later]


def _shards(window: int, n: int):
    def sort(first: dict[bytes, tuple[int, int]], out: list) -> None:
        if not first:
            return
        places = np.array(list(first.values()), dtype=np.int64)
        doc, start = repeated_windows(list(first), places[:, 0], places[:, 1], window)
        if len(doc):
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(doc)) - 1
            out.append((doc[begin], start[begin], start[end] - start[begin] + window))

    @tidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[bytes]] = {c: [] for c in _SENT}
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for c in _SENT:
                got[c] += batch.column(c).to_pylist()
            for cd, cs, cl in zip(*(batch.column(c).to_pylist() for c in _CUT)):
                if cd:
                    out.append(
                        (
                            np.frombuffer(cd, np.int64),
                            np.frombuffer(cs, np.uint32).astype(np.int64),
                            np.frombuffer(cl, np.uint32).astype(np.int64),
                        )
                    )
        text = b"".join(got.pop("text"))
        lengths = unpacked(got["lengths"], np.uint32).astype(np.int64)
        docs, starts = unpacked(got["docs"], np.int64), unpacked(got["starts"], np.uint32)
        parts = unpacked(got["parts"], np.uint8)
        order = np.argsort(parts, kind="stable")
        begins = (np.cumsum(lengths) - lengths)[order].tolist()
        first: dict[bytes, tuple[int, int]] = {}
        held, cut, last = 0, [], -1
        for part, at, k, d, s in zip(
            parts[order].tolist(), begins, lengths[order].tolist(), docs[order].tolist(), starts[order].tolist()
        ):
            if part != last and held >= SHARD_BYTES:  # windows of one anchor stay in one shard
                sort(first, out)
                first, held = {}, 0
            last = part
            key = text[at : at + k]
            known = first.get(key)
            if known is None:
                first[key] = (d, s)
                held += k + 1
            elif (d, s) < known:
                first[key] = (d, s)
                cut.append((known[0], known[1], k))
            elif (d, s) > known:
                cut.append((d, s, k))
        sort(first, out)
        if cut:
            out.append(tuple(np.array(cut, dtype=np.int64).T))
        if out:
            doc, start, length = (np.concatenate(x) for x in zip(*out))
            yield from group_rows(n, doc, {"starts": start.astype(np.uint32), "lengths": length.astype(np.uint32)})

    return run


_RESULTS = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])),
        ),
    ]
)


def merged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (begin, end) covered by intervals."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], reach[np.append(new[1:], len(starts)) - 1]


def _finish(schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {f.name: [] for f in _RESULTS.fields}
            for text, parts in zip(as_bytes(batch.column("text")), found_of(batch)):
                made["n_bytes"].append(len(text))
                if not parts:
                    for c, v in (("n_removed", 0), ("n_spans", 0), ("kept", text), ("spans", [])):
                        made[c].append(v)
                    continue
                begin, end = merged(
                    np.frombuffer(parts["starts"], np.uint32).astype(np.int64),
                    np.frombuffer(parts["lengths"], np.uint32).astype(np.int64),
                )
                made["n_removed"].append(int((end - begin).sum()))
                made["n_spans"].append(len(begin))
                edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(text)]
                made["kept"].append(b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
                made["spans"].append([{"start": s, "length": e - s} for s, e in zip(begin.tolist(), end.tolist())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(made[f.name], type=f.type) if f.name in made else batch.column(f.name)
                    for f in schema
                ],
                schema=schema,
            )

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = 100, gram: int = 16) -> DataFrame:
    """Cut every byte covered by a string of ``window`` bytes that also starts earlier.

    ``docs`` has doc_id (integer) and text; its other columns stay, except that results
    replace columns of the same names. Added: n_bytes, n_removed, n_spans (maximal removed
    runs), kept (remaining bytes) and spans (start, length). ``gram`` is a multiple of 8.

    Null text counts as empty: no bytes, nothing removed. Texts shorter than a window are
    kept. "Earlier" is a smaller doc_id, or the same document and an earlier start. Rows that
    repeat a doc_id count as one document: equal rows are treated alike, and neither is
    earlier. A row with a null doc_id keeps its bytes and is no reference. A cut may end
    within a character, so kept is binary. An empty table gives an empty one.
    """
    shape = Shape("bytes", window, gram)
    spark = docs.sparkSession
    n = partitions(spark)
    keep = kept_fields(docs, _RESULTS)
    base = docs.select(*[f"`{f.name}`" for f in keep])
    dealt, lone = dealt_by_id(base)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    answers, hot_rows = repeated_anchors(base.where(F.col("doc_id").isNotNull()).select(ids, "text"), shape)
    # At most HOT_PER_BUCKET numbers for each partition, by the rule that makes an anchor hot.
    hot = np.sort(np.array([r[0] for r in hot_rows.collect()], dtype=np.int64).view(np.uint64))
    sent = with_findings(dealt, answers, "inner").mapInArrow(_stretches(shape, n, hot), _STRETCH)
    found = sent.repartitionById(n, F.col("bucket")).mapInArrow(
        _shards(window, n), group_schema(_SPANS)[0]
    )
    schema = T.StructType(keep + _RESULTS.fields)
    finish = _finish(to_arrow_schema(schema))
    whole = with_findings(dealt, by_document(found, _SPANS), "left").mapInArrow(finish, schema)
    return whole.unionByName(lone.mapInArrow(finish, schema))


def op5_suffix_array(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeated_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
