"""Packing of tokenized documents into training sequences by vector best-fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared
piece lengths). Pieces go, largest first, into the open sequence that has room in every
dimension and that fits best: smallest weighted norm of what would be left, or largest
weighted dot product of the piece and what is left.

Pieces that fill a sequence stand alone. The others are dealt at random into groups of
bounded size, each packed by one task; a group leaves about one sequence part empty.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from twinloom.llm.bpe_index import Numbers, ranges, text_groups, worker_cache
from twinloom.llm.common import documents, stored, tidy

KNOWN_CHUNKS = 500_000  # tokenized parts of texts that a task remembers, about 100 MB
GROUP_CHARS = 2 << 20  # text that is cut and numbered together
GROUP_PIECES = 8192  # pieces packed by one task


class Capacity(NamedTuple):
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


# ---- tokens ------------------------------------------------------------------------


BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)  # classes of characters; OTHER ties a chunk together


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the characters of one and two bytes.

    OTHER are apostrophes, as contractions begin with them, marks, and what is composed or
    lower-cased to anything but one character of as many bytes.
    """
    kinds, lower = np.full(0x800, OTHER, dtype=np.uint8), np.arange(0x800)
    for k in range(0x800):
        c, kind = chr(k), unicodedata.category(chr(k))[0]
        if c in " \t\n\r":
            kinds[k] = BLANK
        elif c.isprintable() and c != "'" and kind != "M" and unicodedata.normalize("NFC", c) == c:
            small = c.lower()
            if len(small) == 1 and len(small.encode()) == len(c.encode()):
                kinds[k] = {"L": LETTER, "N": DIGIT}.get(kind, SIGN)
                lower[k] = ord(small)
    return kinds, lower


KINDS, LOWER = _classes()
BYTE_KINDS = np.concatenate([KINDS[:0x80], np.full(0x80, OTHER, dtype=np.uint8)])
BYTE_LOWER = np.concatenate([LOWER[:0x80], np.arange(0x80, 0x100)]).astype(np.uint8)


def cut_parts(text: bytes) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Parts of UTF-8 text, whether each is a chunk that was not cut, and where each begins.

    Chunks stand between blanks. One of plain characters, without apostrophe or the beginning of
    a special token, is lower-cased and cut into runs of letters, single digits and runs of signs.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    kind, low = BYTE_KINDS[raw], BYTE_LOWER[raw]
    two = np.flatnonzero((raw >= 0xC2) & (raw <= 0xDF))  # first bytes of characters of two bytes
    code = (raw[two].astype(np.int64) & 0x1F) << 6 | raw[two + 1] & 0x3F
    kind[two] = kind[two + 1] = KINDS[code]
    low[two], low[two + 1] = LOWER[code] >> 6 | 0xC0, LOWER[code] & 0x3F | 0x80
    special = np.flatnonzero(raw[:-1] == ord("<"))
    kind[special[raw[special + 1] == ord("|")]] = OTHER

    solid = kind != BLANK
    first = solid.copy()  # bytes that begin a chunk
    first[1:] &= ~solid[:-1]
    begins = solid & (kind == DIGIT)  # bytes that begin a part
    begins[two + 1] = False
    begins[1:] |= solid[1:] & (kind[1:] != kind[:-1])
    begins |= first
    places = np.flatnonzero(begins)
    heads = first[places]
    chunk = np.cumsum(heads) - 1  # of each part
    starts = places[heads]
    tied = np.zeros(len(starts), dtype=bool)
    tied[np.searchsorted(starts, np.flatnonzero(kind == OTHER), side="right") - 1] = True
    kept = heads | ~tied[chunk]
    places, whole = places[kept], tied[chunk[kept]]

    filled = np.concatenate([[0], np.cumsum(solid)])
    ends = np.append(filled[places], filled[-1])  # without blanks
    same = ranges(places[whole], np.diff(ends)[whole])
    low[same] = raw[same]
    parts = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(low[solid]))
    return parts.dictionary_encode(), whole, places


class Tokenizer:
    """Ids of texts; parts of texts are tokenized once and remembered.

    Only for byte-level tokenizers that drop white space, compose and lower-case characters, take
    runs of letters, single digits and runs of other signs apart, and mark the last token of a word.
    A chunk between blanks then has ids that do not depend on what stands around it. Plain chunks,
    of letters, digits and signs of at most two bytes, are lower-cased and cut into such runs, many
    at once by byte classes; the library's model makes ids of new runs. Any other chunk goes to the
    library, signs after its last letter apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library
        from tokenizers import pre_tokenizers

        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = Library(self.library.model)  # the same merges, for words that are cut already
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary, suffix = self.library.get_vocab(), self.library.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.known = np.empty(0, dtype="<u4")  # ids of all parts, by number
        self.begin = self.count = np.empty(0, dtype=np.int64)

    @staticmethod
    def pieces(chunk: str) -> list[str]:
        """Parts of an uncut chunk with ids of their own: signs that end it stay apart."""
        if "'" in chunk or "<|" in chunk or not chunk.isprintable():
            return [chunk]
        word = chunk.rstrip(string.punctuation)
        # a sign stays with a letter whose lower case ends in a mark
        if word != chunk and word and word[-1].isalpha() and word[-1].lower()[-1].isalpha():
            return [word, chunk[len(word) :]]
        return [chunk]

    def encoded_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased runs of one class, one after the other, and their counts."""
        ids, counts = [np.empty(0, dtype="<u4")], [np.empty(0, dtype=np.int64)]
        for at in range(0, len(runs), 20_000):
            found = self.model.encode_batch_fast([" ".join(runs[at : at + 20_000])], add_special_tokens=False)[0]
            ids.append(np.array(found.ids, dtype="<u4"))
            counts.append(np.diff(np.flatnonzero(self.last[ids[-1]]), prepend=-1))
        return np.concatenate(ids), np.concatenate(counts)

    def encoded_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any chunks, one after the other, and their counts: blanks between them, those whose offsets lie in them."""
        ids, counts = [np.empty(0, dtype="<u4")], [np.empty(0, dtype=np.int64)]
        for at in range(0, len(chunks), 20_000):
            some = chunks[at : at + 20_000]
            found = self.library.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.array(found.ids, dtype="<u4"))
            places = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            counts.append(np.diff(np.searchsorted(places, np.cumsum([len(c) + 1 for c in some]) - 1), prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def learn(self, parts: list[str], whole: np.ndarray) -> None:
        """Ids of new parts, in the order of their numbers; ``whole`` ones are chunks that were not cut."""
        runs = [p for p, uncut in zip(parts, whole.tolist()) if not uncut]
        chunks = [self.pieces(p) for p, uncut in zip(parts, whole.tolist()) if uncut]
        distinct = Numbers()
        places = np.array([distinct[p] for x in chunks for p in x], dtype=np.int64)
        run_ids, run_counts = self.encoded_runs(runs)
        ids, counts = self.encoded_chunks(list(distinct))
        chunk_ids = ids[ranges((np.cumsum(counts) - counts)[places], counts[places])]
        stops = np.concatenate([[0], np.cumsum(counts[places])])[np.cumsum([len(x) for x in chunks], dtype=np.int64)]
        order = np.argsort(whole, kind="stable")  # runs, then chunks
        counts = np.concatenate([run_counts, np.diff(stops, prepend=0)])
        begin, count = np.empty((2, len(parts)), dtype=np.int64)
        begin[order], count[order] = len(self.known) + np.cumsum(counts) - counts, counts
        self.known = np.concatenate([self.known, run_ids, chunk_ids])
        self.begin = np.concatenate([self.begin, begin])
        self.count = np.concatenate([self.count, count])

    def numbered(self, parts: pa.DictionaryArray, whole: np.ndarray) -> np.ndarray:
        """Numbers of parts, by which their ids are known."""
        texts, at = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        if len(self.numbers) + len(texts) > KNOWN_CHUNKS:
            self.forget()
        numbers = np.fromiter(map(self.numbers.__getitem__, texts), dtype=np.int64, count=len(texts))
        if self.numbers.new:
            uncut = np.zeros(len(texts), dtype=bool)
            uncut[at[whole]] = True
            self.learn(self.numbers.new, uncut[numbers >= len(self.begin)])
            self.numbers.new = []
        return numbers[at]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids."""
        data = [t.encode() for t in texts]
        parts, whole, places = cut_parts(b"\n".join(data))
        numbers = self.numbered(parts, whole)
        count = self.count[numbers]
        ids = self.known[ranges(self.begin[numbers], count)].tobytes()
        text_begins = np.cumsum([0, *(len(t) + 1 for t in data)])
        offsets = (4 * np.concatenate([[0], np.cumsum(count)]))[np.searchsorted(places, text_begins)].tolist()
        return [ids[b:e] for b, e in zip(offsets[:-1], offsets[1:])]


_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
_IDS = T.StructField("ids", T.ArrayType(T.LongType()))


def _pieces(path: str, end_id: int, most: int, schema: pa.Schema):
    end = np.array([end_id], dtype="<u4").tobytes()

    @tidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_cache(("tokenizer", path), lambda: Tokenizer(path))
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for b, e in text_groups(texts, GROUP_CHARS):
                made: dict[str, list] = {f.name: [] for f in schema}
                for doc, ids in zip(docs[b:e], tokenizer.ids(texts[b:e])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[at : at + 4 * most]
                        made["doc_id"].append(doc)
                        made["piece"].append(k)
                        made["start"].append(at // 4)
                        made["length"].append(len(part) // 4)
                        made["ids_crc32"].append(zlib.crc32(part))
                        if "ids" in made:
                            made["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in schema], schema=schema)
        tokenizer.forget()  # an idle worker should hold little

    return run


def token_pieces(docs: DataFrame, tokenizer_file: str, most: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``most`` tokens of each text: its ids, then ``end_id``.

    Every worker machine has the file at ``tokenizer_file``. Null text counts as empty and
    gives one piece that holds only ``end_id``.
    """
    schema = T.StructType(_PIECES.fields + [_IDS] * with_ids)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(tokenizer_file, end_id, most, to_arrow_schema(schema)), schema)


# ---- packing -----------------------------------------------------------------------


def best_fit(
    lengths: np.ndarray,
    capacity: Capacity,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.

    ``rule`` "norm": the bin with the smallest weighted norm of what is left after the piece;
    "dot": the bin with the largest weighted dot product of the piece and what is left.
    Ties go to the oldest bin.
    """
    limit = np.array(capacity, dtype=np.float64)
    size = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2], axis=1) / limit
    if len(size) and size.max() > 1:
        raise ValueError("a piece is larger than a sequence")
    w = np.sqrt(np.array(weights))
    order = np.argsort(-lengths, kind="stable")
    left = np.empty((len(lengths), 3))  # of open bins
    name = np.empty(len(lengths), dtype=np.int64)
    n_open = n_bins = 0
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    used = np.zeros(len(lengths), dtype=np.int64)
    smallest = size.min(axis=0) if len(size) else limit
    for item in order.tolist():
        need = size[item]
        rest = left[:n_open] - need
        fits = np.flatnonzero((rest >= -1e-12).all(axis=1))
        if len(fits):
            if rule == "norm":
                score = ((rest[fits] * w) ** 2).sum(axis=1)
                at = int(fits[np.argmin(score)])
            else:
                score = (left[fits] * need * w**2).sum(axis=1)
                at = int(fits[np.argmax(score)])
        else:
            at = n_open
            left[at], name[at] = 1.0, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[item], offsets[item] = name[at], used[name[at]]
        used[name[at]] += lengths[item]
        left[at] -= need
        if (left[at] < smallest - 1e-12).any():  # nothing fits any more
            n_open -= 1
            left[at:n_open] = left[at + 1 : n_open + 1]
            name[at:n_open] = name[at + 1 : n_open + 1]
    return bins, offsets


def pack(
    pieces: DataFrame,
    capacity: Capacity = Capacity(),
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    rule: str = "norm",
) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length.

    Pieces of full length get a sequence of their own. ``pieces`` should be stored, as it is
    read twice and its rows are numbered.
    """
    spark = pieces.sparkSession
    full = F.col("length") >= capacity.tokens
    schema = T.StructType(
        [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    names = [f.name for f in schema.fields[:-2]]
    # Even numbers for packed sequences: group, then bin. Odd ones for pieces alone.
    alone = pieces.where(full).select(
        *names, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(~full).select(*names)
    n_groups = max(1, -(-rest.count() // GROUP_PIECES))
    groups = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)).cast("int")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], kind="stable", ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, weights, rule)
        group = int(rows["__group"].iloc[0]) if len(rows) else 0
        out = rows.drop(columns="__group")
        out["sequence_id"] = (bins + (group << 31)) * 2
        out["offset"] = offsets
        return out

    packed = (
        rest.withColumn("__group", groups)
        .groupBy("__group")
        .applyInPandas(run, schema)
    )
    return alone.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: Capacity = Capacity()) -> DataFrame:
    """Tokenize, cut and pack texts: one row per piece, with its sequence and offset.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset; other columns of
    ``docs`` are not carried. Null text counts as empty: one piece of one token. Null and
    repeated ids are packed like others; repeated rows are separate pieces. An empty table
    gives an empty one.
    """
    return pack(stored(token_pieces(docs, tokenizer_file, capacity.tokens)), capacity)


def op2_vector_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(
        documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")
    )
