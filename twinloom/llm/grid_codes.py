"""Vector codes of one byte per part, assigned through memoised grid cells.

A vector of integers is cut into PARTS equal parts; a part's code is the index of the nearest
entry of the codebook of its position. The codebooks are refined in rounds: assign, then move
each entry to the mean of its parts.

Assignment looks at few entries. A part's coarse cell is the grid box it lies in (each
component divided by the cell width). An entry whose least distance to the box is beyond the
largest distance that some other entry has to it can be nearest to no point of the box: it is
dominated. The entries that are left are kept by cell; only these are evaluated, exactly, for
every part in that cell. Copies and near copies meet a cell that is known already.

Codebooks are at most PARTS * ENTRIES integer vectors, whatever the size of the table; only
these, and their sums and counts, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.llm.common import run_starts, stored, tidy

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 24  # integer components are held within this
CELLS_AT_ONCE = 1024  # cells whose entries are found at once
CELLS_KEPT = 1 << 15  # cells that a worker remembers per part
PAIRS_AT_ONCE = 1 << 17  # exact distances at once


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, label, values) with values = floor(scale * x) for usable vectors."""
    x = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    whole = lambda v: F.greatest(F.least(F.floor(v * F.lit(float(scale))), F.lit(LIMIT)), F.lit(-LIMIT))
    held = lambda v: F.greatest(F.least(v, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        F.transform(x, lambda v: whole(held(v)).cast("long")).alias("values"),
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# ---- assignment --------------------------------------------------------------------


def cell_width(entries: np.ndarray) -> int:
    """A power of two near a quarter of the entries' deviation: boxes smaller than the gaps between entries."""
    deviation = float(entries.std(axis=0).mean()) if len(entries) else 0.0
    return 1 << max(0, round(np.log2(deviation / 4))) if deviation > 4 else 1


class Cells:
    """Nearest entries of one codebook (rows of integers), with the memory of its cells."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.width = cell_width(entries)
        self.place: dict[bytes, int] = {}
        self.open = np.zeros((0, len(entries)), dtype=bool)

    def not_dominated(self, cells: np.ndarray) -> np.ndarray:
        """For each cell (a row) which entries may be nearest to a point of its box."""
        least = np.zeros((len(cells), len(self.entries)), dtype=np.int64)
        most = np.zeros_like(least)
        for k in range(cells.shape[1]):
            values, at = np.unique(cells[:, k], return_inverse=True)
            below = values[:, None] * self.width - self.entries[None, :, k]
            above = -below - (self.width - 1)
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least += (near * near)[at]
            most += (far * far)[at]
        return least <= most.min(axis=1, keepdims=True)

    def candidates(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``self.open`` that hold the candidates of each part."""
        cells = parts // self.width
        keys = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        names = [k.tobytes() for k in distinct]
        new = [i for i, n in enumerate(names) if n not in self.place]
        if len(self.place) + len(new) > CELLS_KEPT:  # begin anew; what is forgotten is found again
            self.place, self.open = {}, self.open[:0]
            new = list(range(len(names)))
        if new:
            found = [
                self.not_dominated(cells[first[new[at : at + CELLS_AT_ONCE]]]) for at in range(0, len(new), CELLS_AT_ONCE)
            ]
            begin = len(self.open)
            self.open = np.concatenate([self.open, *found])
            self.place.update((names[i], begin + k) for k, i in enumerate(new))
        return np.array([self.place[n] for n in names], dtype=np.int64)[inverse]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part (ties: the lower one) and its squared distance."""
        code = np.zeros(len(parts), dtype=np.int64)
        error = np.zeros(len(parts), dtype=np.int64)
        place = self.candidates(parts)
        upto = np.cumsum(self.open[place].sum(axis=1))
        begin = 0
        while begin < len(parts):
            done = int(upto[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, "right")))
            row, entry = np.nonzero(self.open[place[begin:end]])
            apart = parts[begin:end][row] - self.entries[entry]
            distance = np.einsum("ij,ij->i", apart, apart)
            starts = run_starts(row)
            best = np.minimum.reduceat(distance, starts)
            hits = np.flatnonzero(distance == best[row])
            code[begin:end] = entry[hits[run_starts(row[hits])]]
            error[begin:end] = best
            begin = end
        return code, error


def assign(values: np.ndarray, books: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column per part) and summed squared distances of vectors."""
    width = values.shape[1] // len(books)
    found = [b.nearest(values[:, k * width : (k + 1) * width]) for k, b in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), sum(e for _, e in found)


# ---- codebooks ---------------------------------------------------------------------

_MOVES = "part int, entry int, n long, sums array<long>"
_MOVES_SCHEMA = pa.schema(
    [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]
)


def _moves(codebooks: list[np.ndarray]):
    """Count and sum of the parts of each entry, one row per entry and task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Cells(c) for c in codebooks]
        sums = [np.zeros_like(c) for c in codebooks]
        counts = [np.zeros(len(c), dtype=np.int64) for c in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix(batch.column("values"))
            codes, _ = assign(values, books)
            width = values.shape[1] // len(books)
            for k in range(len(books)):
                order = np.argsort(codes[:, k], kind="stable")
                begin = run_starts(codes[order, k])
                entry = codes[order[begin], k]
                sums[k][entry] += np.add.reduceat(values[order, k * width : (k + 1) * width], begin, axis=0)
                counts[k][entry] += np.diff(np.append(begin, len(order)))
        rows = [(k, e) for k in range(len(books)) for e in np.flatnonzero(counts[k]).tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in rows], pa.int32()),
                pa.array([e for _, e in rows], pa.int32()),
                pa.array([int(counts[k][e]) for k, e in rows], pa.int64()),
                pa.array([sums[k][e].tolist() for k, e in rows], pa.list_(pa.int64())),
            ],
            schema=_MOVES_SCHEMA,
        )

    return run


def refined(vectors: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: each entry the floor of the mean of its parts."""
    width = codebooks[0].shape[1]
    exact = T.DecimalType(38, 0)
    moved = vectors.select("values").mapInArrow(_moves(codebooks), _MOVES).groupBy("part", "entry")
    moved = moved.agg(
        F.sum("n").alias("n"),
        *[F.sum(F.get("sums", F.lit(i)).cast(exact)).alias(f"s{i}") for i in range(width)],
    )
    out = [c.copy() for c in codebooks]
    for r in moved.collect():  # one row per entry in use: at most parts * entries
        out[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of smallest vec_id; an empty list if there is no vector."""
    rows = vectors.orderBy("vec_id", "values").limit(entries).collect()
    if not rows:
        return []
    values = np.array([r["values"] for r in rows], dtype=np.int64)
    return [c.copy() for c in np.split(values, parts, axis=1)]


def codebook_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def _codes(codebooks: list[np.ndarray], schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Cells(c) for c in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = assign(matrix(batch.column("values")), books)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([text[at : at + step] for at in range(0, len(text), step)], pa.string()),
                    pa.array(error),
                ],
                schema=schema,
            )

    return run


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of integer vectors (``vec_id``, ``label``, ``values``) and the codebooks.

    The codebooks begin with the vectors of smallest vec_id (ties by values), all if there are
    fewer than ``entries`` (at most 256). Entries without parts stay. Returned rows: vec_id,
    label, code (two hex digits per part), error (summed squared distances).

    The dimension is that of the smallest vec_id whose vector can be cut into equal parts;
    vectors of another length are left out, as are null vec_ids and vectors that are null or
    hold null or non-finite components. Integer components are held within +-2**24. Rows that repeat a vec_id
    are rows of their own. Without vectors there are no codebooks and no rows.
    """
    vectors = stored(vectors)
    fits = (F.size("values") > 0) & (F.size("values") % parts == 0)
    first = vectors.where(fits).select("vec_id", F.size("values").alias("n")).orderBy("vec_id", "n").first()
    size = first["n"] if first else 0
    vectors = vectors.where(F.size("values") == size) if first else vectors.limit(0)
    codebooks = first_codebooks(vectors, parts, entries)
    label = next(f for f in vectors.schema.fields if f.name == "label")
    shape = T.StructType(
        [T.StructField("vec_id", T.LongType()), label, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )
    if not codebooks:
        return vectors.sparkSession.createDataFrame([], shape), []
    for _ in range(rounds):
        codebooks = refined(vectors, codebooks)
    from pyspark.sql.pandas.types import to_arrow_schema

    coded = vectors.select("vec_id", "label", "values").mapInArrow(_codes(codebooks, to_arrow_schema(shape)), shape)
    return coded, codebooks


def decompress(coded: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """Rows (vec_id, values): the entries that a code stands for, one after the other."""
    schema = pa.schema([("vec_id", pa.int64()), ("values", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8)
            codes = codes.reshape(batch.num_rows, len(codebooks))
            values = np.hstack([c[codes[:, k]] for k, c in enumerate(codebooks)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(values.tolist(), pa.list_(pa.int64()))], schema=schema)

    return coded.select("vec_id", "code").mapInArrow(run, "vec_id long, values array<long>")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add label_error: errors summed over equal labels (nulls together), held at the 64-bit range."""
    exact = T.DecimalType(38, 0)
    total = F.least(F.sum(F.col("error").cast(exact)), F.lit((1 << 63) - 1).cast(exact)).cast("long")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op13_grid_codes(spark, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return with_label_error(stored(coded)).select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256")
    )


def _sql() -> str:
    """The rounds as one statement each; all entries are compared."""
    steps = [
        """
v AS MATERIALIZED (
  SELECT vec_id::BIGINT AS vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
p AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS w FROM v, range(4) AS parts(part)
),
b0 AS MATERIALIZED (
  SELECT part, entry, w FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, w FROM p) WHERE entry < 256
)"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, part, w, arg_min(entry, struct_pack(d := d, e := entry)) AS entry, min(d) AS d
  FROM (
    SELECT p.vec_id, p.part, p.w, b.entry, list_sum(list_transform(list_zip(p.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM p JOIN b{r} b USING (part)
  ) GROUP BY vec_id, part, w
)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT part, entry, list(m ORDER BY place) AS w
  FROM (
    SELECT part, entry, place, floor(sum(w[place]) / count(*))::BIGINT AS m
    FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(w)) FROM p) + 1)) AS place) GROUP BY part, entry, place
  ) GROUP BY part, entry
),
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.w, b.w) AS w FROM b{r} b LEFT JOIN m{r} m USING (part, entry)
)""")
    return f"""
WITH {",".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, entry)) AS sha FROM b{ROUNDS}),
c AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha FROM h) AS codebooks_sha256
FROM c JOIN v USING (vec_id)
"""


OP13_SQL = _sql()
