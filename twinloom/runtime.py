"""Cutting lineage and running metadata-sized work."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def tune(spark: SparkSession) -> SparkSession:
    """Settings that suit this package's plans; safe to change on a live session.

    HotSpot never compiles a method of more than 8000 bytes of bytecode, so a
    longer generated stage would run interpreted; Spark falls back to compiled
    single operators instead when told the same limit.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one in the warehouse only where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    context.setCheckpointDir(shared)
    return shared


def pinned(df: DataFrame) -> DataFrame:
    """Compute once, keep on shared storage, forget the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name on the shared storage."""
    return f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def stored(tables: dict[str, DataFrame], folder: str | None = None) -> dict[str, DataFrame]:
    """Write tables as Parquet and read them back: computed once, read by column."""
    spark = next(iter(tables.values())).sparkSession
    folder = folder or scratch_folder(spark)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Metadata as a local relation: no tasks, and Catalyst sees its size."""
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [[] for _ in fields.names]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=fields)
