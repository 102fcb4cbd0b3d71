"""Language identification with string kernels.

Two texts are as alike as the n-grams (of several orders, blended) that both have, whatever
their counts: k(x, y) = |X and Y| / sqrt(|X| |Y|). N-grams are hashed to bits, so a text is
a row of bits. Some training texts are landmarks; the Nystroem map turns kernel values with
the landmarks into features, on which one ridge regression per language (one against the
rest) is solved. Scoring multiplies batches of texts with the landmarks, and the kernel
values with the weights.

A long text has nearly all n-grams of any language, so texts are cut in equal segments of at most
SEGMENT bytes over their whole length, and the regression values of the segments are averaged.

The fit reads a bounded sample of labelled rows (PER_LANGUAGE per language; of a long text one
segment); only their bits come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from twinloom.llm.common import SEGMENT_BYTES, as_bytes, documents, kept_fields, tidy, training_rows

ORDERS = (1, 2, 3, 4)  # bytes per n-gram
BITS = 1 << 14
SEGMENT = 1 << 12  # bytes of a text that are compared at once; they fill a small part of the bits
PER_LANGUAGE = 250  # training texts per language
LANDMARKS = 32  # per language
MOST_LANDMARKS = 512
RIDGE = 0.1
SHARPNESS = 6.0  # of the score: a softmax of the regression values
ROWS = 256  # texts that are multiplied at once

_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER[[0x09, 0x0A, 0x0D]] = 0x20
_LOWER[0x30:0x3A] = 0x30


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray  # bits (0 or 1) of each landmark, over the root of their number
    weights: np.ndarray  # landmark by language


def presence(texts: list[bytes], bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Rows of bits: which hashed n-grams a text has."""
    rows = np.zeros((len(texts), bits), dtype=np.uint8)
    for k, text in enumerate(texts):
        row = rows[k]
        for at in range(0, len(text), SEGMENT_BYTES):  # pieces overlap by the longest n-gram
            a = _LOWER[np.frombuffer(text[at : at + SEGMENT_BYTES + max(orders) - 1], dtype=np.uint8)]
            code = a.astype(np.uint32)
            for n in range(1, max(orders) + 1):
                if n > 1:
                    if len(code) < 2:
                        break
                    code = code[:-1] * np.uint32(257) + a[n - 1 :]
                if n in orders:
                    row[((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (bits.bit_length() - 1))] = 1
    return rows


def segments(text: bytes, overlap: int) -> list[bytes]:
    """Equal pieces of at most SEGMENT bytes, which overlap by the longest n-gram."""
    n = max(1, -(-len(text) // SEGMENT))
    step = max(1, -(-len(text) // n))
    return [text[at : at + step + overlap] for at in range(0, max(1, len(text)), step)]


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows over the root of their number of bits, so that a product is the kernel."""
    size = np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.float32), 1))
    return rows.astype(np.float32) / size[:, None].astype(np.float32)


def solve(bits: np.ndarray, languages: list[str], ridge: float, per_language: int) -> Model:
    """Nystroem map and ridge regressions from training rows."""
    names = sorted(set(languages))
    index = {n: k for k, n in enumerate(names)}
    label = np.array([index[x] for x in languages])
    per = max(1, min(per_language, MOST_LANDMARKS // len(names)))
    chosen = np.concatenate([np.flatnonzero(label == k)[:per] for k in range(len(names))])
    scaled = _scaled(bits)
    landmarks = scaled[chosen]
    inner = (landmarks @ landmarks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    features = (scaled @ landmarks.T).astype(np.float64) @ root
    features = np.hstack([features, np.ones((len(features), 1))])
    wanted = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1.0 / np.bincount(label, minlength=len(names))[label]  # languages weigh alike
    left = features.T * (share * len(label) / len(names))
    weights = np.linalg.solve(left @ features + ridge * np.eye(features.shape[1]), left @ wanted)
    return Model(names, landmarks, np.vstack([root @ weights[:-1], weights[-1:]]))


def _row_bits(bits: int, orders: tuple[int, ...]):
    schema = pa.schema([("language", pa.string()), ("bits", pa.binary())])

    @tidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [segments(t, max(orders) - 1) for t in as_bytes(batch.column("text"))]
            some = [c[zlib.crc32(c[0]) % len(c)] for c in cut]  # any, but always the same
            packed = np.packbits(presence(some, bits, orders), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("language"), pa.array([r.tobytes() for r in packed], type=pa.binary())], schema=schema
            )

    return run


def fit(
    docs: DataFrame,
    language: str = "lang",
    per_language: int = PER_LANGUAGE,
    bits: int = BITS,
    orders: tuple[int, ...] = ORDERS,
    ridge: float = RIDGE,
    landmarks: int = LANDMARKS,
) -> Model:
    """Learn from at most ``per_language`` rows of each language, chosen by a hash of doc_id.

    Rows whose text, doc_id or language is null take no part.
    """
    known = docs.where(F.col(language).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = Window.partitionBy("language").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        known.select(F.col(language).alias("language"), "doc_id")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_language)
        .select("doc_id")
    )
    ids = sorted({r[0] for r in chosen.collect()})  # per_language for each language
    if not ids:
        return Model([], np.zeros((0, bits), dtype=np.float32), np.zeros((1, 0)))
    rows = (
        known.where(F.col("doc_id").isin(ids))
        .select(F.col(language).alias("language"), "text")
        .mapInArrow(_row_bits(bits, orders), "language string, bits binary")
        .collect()
    )
    rows.sort(key=lambda r: (r[0], r[1]))
    matrix = np.unpackbits(np.array([np.frombuffer(r[1], dtype=np.uint8) for r in rows]), axis=1)
    shuffled = np.random.default_rng(0).permutation(len(rows))  # landmarks are the first of each language
    return solve(matrix[shuffled], [rows[k][0] for k in shuffled], ridge, landmarks)


_RESULTS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def scores(model: Model, texts: list[bytes], orders: tuple[int, ...]) -> np.ndarray:
    """Softmax of the regression values, averaged over the segments of a text: texts by languages."""
    bits = model.landmarks.shape[1]
    value = np.zeros((len(texts), model.weights.shape[1]))
    count = np.zeros(len(texts))
    held: list[tuple[int, bytes]] = []

    def multiply() -> None:
        owner = np.array([k for k, _ in held], dtype=np.int64)
        kernel = _scaled(presence([s for _, s in held], bits, orders)) @ model.landmarks.T
        np.add.at(value, owner, kernel.astype(np.float64) @ model.weights[:-1] + model.weights[-1])
        np.add.at(count, owner, 1.0)
        held.clear()

    for k, text in enumerate(texts):
        for segment in segments(text, max(orders) - 1):
            held.append((k, segment))
            if len(held) == ROWS:
                multiply()
    if held:
        multiply()
    value /= np.maximum(count, 1.0)[:, None]
    value = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
    return value / value.sum(axis=1, keepdims=True)


def _predict(shared, orders: tuple[int, ...], schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            names: list[str] = []
            best: list[float] = []
            for at in range(0, batch.num_rows, ROWS):
                texts = as_bytes(batch.column("text").slice(at, ROWS))
                worded = [bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts]
                if not model.languages:
                    names += ["und"] * len(texts)
                    best += [0.0] * len(texts)
                    continue
                found = scores(model, texts, orders)
                top = found.argmax(axis=1)
                names += [model.languages[k] if ok else "und" for k, ok in zip(top.tolist(), worded)]
                best += [float(p) if ok else 0.0 for p, ok in zip(found.max(axis=1).tolist(), worded)]
            made = {"lang_pred": names, "score": best}
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], type=f.type) if f.name in made else batch.column(f.name) for f in schema],
                schema=schema,
            )

    return run


def identify(docs: DataFrame, model: Model, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to rows with a text.

    Other columns stay, except that results replace columns of the same names. A null text,
    an empty one or one without a letter gets "und" and score 0; so does every text if the
    model has learned no language. Equal scores go to the first language in order. Rows are
    independent; repeated rows give repeated results and an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # at most MOST_LANDMARKS rows of bits
    keep = kept_fields(docs, _RESULTS)
    schema = T.StructType(keep + _RESULTS.fields)
    return docs.select(*[f"`{f.name}`" for f in keep]).mapInArrow(_predict(shared, orders, to_arrow_schema(schema)), schema)


def op9_string_kernel(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(training_rows()))
    return (
        identify(docs.select("doc_id", "text"), model)
        .withColumn("held_out", F.coalesce(~training_rows(), F.lit(False)))
        .select("doc_id", "held_out", "lang_pred", "score")
    )
