"""Byte-pair encoding and decoding with an index of pair occurrences.

A task puts the distinct pieces of its texts one after the other and maps each mergeable
pair, by its rank, to all its positions. Active ranks are applied in ascending order, each
to all its positions at once; only the pairs beside a merge change, and they join the
lists of their ranks. This gives the ids that merging each piece on its own gives, as
within a piece the lowest rank always comes first. Texts are then put together from the
encoded pieces.
"""

from __future__ import annotations

import heapq
import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from twinloom.llm.common import documents, kept_fields, tidy

KNOWN_PIECES = 400_000  # encoded chunks that a worker remembers between groups
GROUP_CHARS = 8 << 20  # text whose new pieces are indexed together
OTHER_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f"  # ASCII that may count as white space beside the space

# The pattern that splits text before the merges (fixed value of byte-level vocabularies).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Ids of bytes and merges, and bytes of ids, from a byte-level tokenizer file."""

    def __init__(self, content: bytes):
        data = json.loads(content)
        model, symbols = data["model"], _byte_symbols()
        ids: dict[str, int] = model["vocab"]
        self.pieces: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in ids.items()}
        self.special: dict[str, int] = {}
        for added in data["added_tokens"]:
            self.special[added["content"]] = added["id"]
            self.pieces[added["id"]] = added["content"].encode()
        self.of_byte = np.zeros(256, dtype=np.int64)
        for symbol, byte in symbols.items():
            self.of_byte[byte] = ids.get(symbol, -1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.left, self.right = left, right
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 without a merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of each piece."""
    ids, stop = encode_together(vocabulary, pieces)
    return np.split(ids, stop[:-1]) if pieces else []


def encode_together(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and where each piece ends, by one index over all of them."""
    if not pieces:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
    data = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    symbol = vocabulary.of_byte[data].copy()
    symbol[ends] = -1  # never part of a pair
    n = len(symbol)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(places: np.ndarray) -> None:
        """Put the pairs that begin at these places in the lists of their ranks."""
        right = symbol[after[places]]
        places, right = places[right >= 0], right[right >= 0]
        rank = vocabulary.ranks(symbol[places], right)
        places, rank = places[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        begin = np.flatnonzero(np.diff(rank, prepend=-1))
        for r, b, e in zip(rank[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(rank)]):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(places[b:e])

    add(np.flatnonzero(symbol[:-1] >= 0))
    while active:
        r = heapq.heappop(active)
        places = np.unique(np.concatenate(index.pop(r)))
        a, b = vocabulary.left[r], vocabulary.right[r]
        # Lists are not cleaned when a symbol goes: a stale place fails this test.
        places = places[symbol[places] == a]
        places = places[symbol[after[places]] == b]
        if a == b and len(places) > 1:  # of overlapping pairs the left one merges
            follows = np.zeros(len(places), dtype=bool)
            follows[1:] = after[places[:-1]] == places[1:]
            first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(places))))
            places = places[(np.arange(len(places)) - first) % 2 == 0]
        if not len(places):
            continue
        gone = after[places]
        symbol[places] = vocabulary.merged[r]
        symbol[gone] = -2
        rest = after[gone]
        after[places] = rest
        before[rest[rest < n]] = places[rest < n]
        prior = before[places]
        prior = prior[prior >= 0]
        add(np.concatenate([prior[symbol[prior] >= 0], places]))
    kept = symbol >= 0
    count = np.cumsum(kept)
    return symbol[kept].astype(np.int32), count[ends]


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    stop = np.cumsum(count)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - count), count)


class Numbers(dict):
    """Chunks and their numbers; a chunk that is missing gets the next one."""

    def __init__(self, chunks=()):
        super().__init__((c, k) for k, c in enumerate(chunks))
        self.new: list = []

    def __missing__(self, chunk):
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class Encoder:
    """Encodes groups of texts, remembering the ids of a bounded number of chunks."""

    def __init__(self, content: bytes):
        self.vocabulary = Vocabulary(content)
        self.split = regex.compile(PIECES)
        self.loose = regex.compile(r" \s|\s ")
        special = list(self.vocabulary.special.items())
        self.numbers = Numbers([(token,) for token, _ in special])  # never equal to a chunk of text
        self.fixed = len(special)
        self.ids = np.array([k for _, k in special], dtype=np.int32)  # of all chunks, by number
        self.begin = np.arange(self.fixed)
        self.count = np.ones(self.fixed, dtype=np.int64)

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are encoded on their own.

        A single space always begins a piece, so the text is cut there; where white space
        meets a space, the pattern decides.
        """
        if text.isascii() and not any(c in text for c in OTHER_SPACE):
            loose = "  " in text
        else:
            loose = self.loose.search(text) is not None
        if loose:
            return self.split.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text between special tokens, and these."""
        cut = self.vocabulary.cut
        if cut is None or not cut.search(text):
            return [(text, False)]
        out, at = [], 0
        for m in cut.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def pieces(self, chunk: str) -> list[str]:
        """Pieces of a chunk; one word of plain letters is one piece."""
        word = chunk[1:] if chunk.startswith(" ") else chunk
        return [chunk] if word.isascii() and word.isalpha() else self.split.findall(chunk)

    def learn(self) -> None:
        """Encode the chunks that are new."""
        parts = [self.pieces(c) for c in self.numbers.new]
        self.numbers.new = []
        distinct = Numbers()
        places = np.array([distinct[p] for x in parts for p in x], dtype=np.int64)
        ids, stop = encode_together(self.vocabulary, [p.encode() for p in distinct])
        many = np.diff(stop, prepend=0)
        of_place = np.concatenate([[0], np.cumsum(many[places])])
        ends = of_place[np.cumsum([len(x) for x in parts], dtype=np.int64)]
        count = np.diff(ends, prepend=0)
        self.begin = np.concatenate([self.begin, len(self.ids) + ends - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids[ranges((stop - many)[places], many[places])]])

    def forget(self, used: np.ndarray) -> None:
        """Keep the chunks of the last group only, if there are too many."""
        if len(self.numbers) <= KNOWN_PIECES:
            return
        kept = np.union1d(np.arange(self.fixed), used)
        if len(kept) > KNOWN_PIECES:
            kept = kept[: max(self.fixed, KNOWN_PIECES // 2)]
        chunks = list(self.numbers)
        self.numbers = Numbers([chunks[k] for k in kept.tolist()])
        self.ids = self.ids[ranges(self.begin[kept], self.count[kept])]
        self.count = self.count[kept]
        self.begin = np.cumsum(self.count) - self.count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of the texts."""
        found: list[np.ndarray] = []
        number = self.numbers.__getitem__
        for text in texts:
            mine: list[int] = []
            for part, special in self.segments(text):
                mine.extend(map(number, [(part,)] if special else self.chunks(part)))
            found.append(np.array(mine, dtype=np.int64))
        if self.numbers.new:
            self.learn()
        used = np.concatenate(found)
        offsets = np.concatenate([[0], np.cumsum(self.count[used])])
        offsets = offsets[np.cumsum([0, *map(len, found)])]
        ids = self.ids[ranges(self.begin[used], self.count[used])]
        self.forget(used)
        return ids, offsets

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def worker_cache(key: object, make):
    """Something that a Python worker builds once and keeps for its next tasks."""
    store = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def text_groups(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


_RESULTS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def _run(content, schema: pa.Schema, key: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(("bpe", key), lambda: Encoder(content.value))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for b, e in text_groups(texts, GROUP_CHARS):
                group = texts[b:e]
                ids, offsets = encoder.encode(group)
                decoded = [encoder.decode(ids[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                made = {
                    "ids": pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(ids)),
                    "decoded": pa.array(decoded, type=pa.string()),
                }
                part = batch.slice(b, e - b)
                yield pa.RecordBatch.from_arrays(
                    [made[f.name].cast(f.type) if f.name in made else part.column(f.name) for f in schema], schema=schema
                )

    return run


def encode_and_decode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Ids of each text under a byte-level vocabulary, and the text that they decode to.

    ``docs`` has text; its other columns stay, except that results replace columns of the
    same names. Added: ids (array of int) and decoded. Special tokens of the file are
    recognised in texts and kept in decoding. Null text counts as empty: no ids, decoded "".
    Rows are independent of each other; repeated rows give repeated results and an empty
    table an empty one. The file (a few MB) is read by the driver and broadcast.
    """
    with open(tokenizer_file, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    keep = kept_fields(docs, _RESULTS)
    schema = T.StructType(keep + _RESULTS.fields)
    return docs.select(*[f"`{f.name}`" for f in keep]).mapInArrow(
        _run(content, to_arrow_schema(schema), tokenizer_file), schema
    )


def op6_bpe_index(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_and_decode(
        documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
