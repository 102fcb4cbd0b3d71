"""CSV whose quoted fields span lines, read by many tasks per file.

A line break ends a row only outside quotes, so whether a byte range begins inside a quoted field depends on
all quotes before it. The quotes of each range are counted in one scan; a running sum of their parity by
file says how every range begins. Then each task cuts its own range in rows. What lies before its first
and after its last row border belongs to rows that cross ranges: these pieces, two per range, are
put together apart. Quotes within fields are doubled, so they do not change the parity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.runtime import pinned

ROW, HEAD, TAIL = 0, 1, 2  # a whole row; the end of a row begun in an earlier range; one that is not ended

_PIECE = "file string, start bigint, kind int, first boolean, text string"
_PIECE_SCHEMA = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("text", pa.string())]
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines with the byte range that they begin in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def ranges_inside(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether each byte range begins within quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = pinned(lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd")))  # a row per range
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of byte ranges, which come one after the other with their lines in order."""
    at: tuple | None = None
    held: list[str] = []
    inside = border = False  # within quotes; a row border was met in this range
    rows = 0
    out: list[tuple] = []

    def piece(kind: int) -> None:
        nonlocal rows
        out.append((*at, kind, kind == ROW and rows == 0 and at[1] == 0, "\n".join(held)))
        rows += kind == ROW
        held.clear()

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)
        out.clear()
        return made

    for b in batches:
        for file, start, begins, value in zip(*(b.column(c).to_pylist() for c in ("file", "start", "inside", "value"))):
            if (file, start) != at:
                if held:
                    piece(TAIL)
                at, inside, border, rows = (file, start), begins, not begins, 0
            held.append(value)
            if value.count('"') % 2:
                inside = not inside
            if not inside:
                piece(ROW if border else HEAD)
                border = True
        if out:
            yield batch()
    if held:
        piece(TAIL)
    if out:
        yield batch()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(text, first): the rows of CSV files as texts without the last line break; ``first`` marks a file's first row."""
    lines = _lines(spark, path)
    begun = F.broadcast(pinned(ranges_inside(lines)))  # a row per byte range
    pieces = lines.join(begun, ["file", "start"]).select("file", "start", "inside", "value").mapInArrow(_pieces, _PIECE)
    crossing = pinned(pieces.where(F.col("kind") != ROW))
    upto = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    numbered = crossing.withColumn("row", F.coalesce(F.sum((F.col("kind") == HEAD).cast("int")).over(upto), F.lit(0)))
    parts = F.sort_array(F.collect_list(F.struct("start", "kind", "text")))
    whole = numbered.groupBy("file", "row").agg(parts.alias("parts"))
    crossed = whole.select(F.array_join("parts.text", "\n").alias("text"), F.lit(False).alias("first"))
    return pieces.where(F.col("kind") == ROW).select("text", "first").unionByName(crossed)


def read_quoted_csv(
    spark: SparkSession, path: str, schema: T.StructType | None, options: dict
) -> DataFrame:
    """A CSV table with a header line per file; without ``schema`` types are inferred in a further pass.

    The header line must fit into the first byte range. Rows in no particular order, as from any
    read by many tasks.
    """
    records = csv_records(spark, path)
    text = F.regexp_replace("text", "\\r$", "")
    body = records.where(~F.col("first")).select(text.alias("text")).where("text <> ''")
    if schema is None:
        head = records.where("first").select(text.alias("text")).first()
        if head is None:
            return spark.createDataFrame([], T.StructType([]))
        names = spark.read.options(**options).option("header", False).csv(spark.sparkContext.parallelize([head["text"]], 1)).first()
        reader = spark.read.options(**options).option("header", False).option("inferSchema", True)
        typed = reader.csv(body.rdd.map(lambda r: r["text"])).schema
        schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, typed.fields)])
    plain = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return body.select(F.from_csv("text", ddl, plain).alias("r")).select("r.*")
