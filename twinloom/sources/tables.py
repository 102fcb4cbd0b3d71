"""Table sets in files and in a catalog."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions.naming import table_name
from twinloom.runtime import small_frame, stored
from twinloom.sources.quoted import read_quoted_csv

# One dialect for all CSV files: doubled quotes, times with microseconds.
CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


def load_tables(
    spark: SparkSession,
    paths: list[str],
    schemas: dict[str, T.StructType] | None = None,
    marker_anywhere: bool = False,
    multi_line: bool = True,
) -> dict[str, DataFrame]:
    """One table per CSV or Parquet path, in the given order, named after the file.

    CSV has a header line. With ``multi_line`` quoted texts may span lines; large files are read by many
    tasks all the same (see ``read_quoted_csv``). Types are inferred, which costs an extra pass; pass
    ``schemas`` by table name for large files.
    """
    tables = {}
    for path in paths:
        name = table_name(path, marker_anywhere)
        schema = (schemas or {}).get(name)
        if path.rstrip("/").lower().endswith(".parquet"):
            tables[name] = spark.read.parquet(path)
        else:
            # without a schema times of any usual form are recognised
            options = CSV if schema else {"header": True, "quote": '"', "escape": '"'}
            if multi_line:
                tables[name] = read_quoted_csv(spark, path, schema, options)
            else:
                reader = spark.read.options(**options)
                reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
                tables[name] = reader.csv(path)
    return tables


def read_parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows; with ``order_by`` always the same ones."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def bundle_name(table: str) -> str:
    return f"synthetic_{table.lower()}.csv"


def write_csv_bundle(
    tables: dict[str, DataFrame],
    folder: str,
    methods: dict[str, str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """One CSV folder ``synthetic_<table>.csv`` per table, plus a manifest.

    A table is computed once, into Parquet on the shared storage, and written and counted from there (an
    Observation would count while writing, but a session that has used one can no longer apply
    Spark's forests). Returns the
    manifest (table, rows, method, seed), which is also written as CSV.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        flat = df.select(
            *[
                F.to_json(f"`{f.name}`").alias(f.name)
                if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
                else F.col(f"`{f.name}`")
                for f in df.schema.fields
            ]
        )
        target = f"{folder}/{bundle_name(name)}"
        flat = stored({name: flat})[name]
        flat.write.mode("overwrite").options(**CSV).csv(target)
        rows.append((name, flat.count(), (methods or {}).get(name, ""), seed))
    schema = "table string, rows bigint, method string, seed bigint"
    manifest = small_frame(spark, rows, schema)
    manifest.write.mode("overwrite").options(**CSV).csv(f"{folder}/manifest.csv")
    return spark.read.schema(schema).options(**CSV).csv(f"{folder}/manifest.csv")


def read_csv_bundle(
    spark: SparkSession, folder: str, table: str, schema: T.StructType
) -> DataFrame:
    """A table of a bundle with its own types; texts may span lines."""
    path = f"{folder}/{bundle_name(table)}"
    if any(isinstance(f.dataType, T.StringType) for f in schema.fields):
        return read_quoted_csv(spark, path, schema, CSV)
    return spark.read.schema(schema).options(**CSV).csv(path)


def save_tables(
    tables: dict[str, DataFrame],
    order: list[str],
    database: str | None = None,
    folder: str | None = None,
    jdbc_url: str | None = None,
    jdbc_properties: dict[str, str] | None = None,
) -> list[str]:
    """Replace the lower-cased tables, parents first, in a catalog, folder or JDBC target."""
    done = []
    for name in order:
        if name not in tables:
            continue
        writer = tables[name].write.mode("overwrite")
        target = name.lower()
        if jdbc_url:
            writer.jdbc(jdbc_url, target, properties=jdbc_properties or {})
        elif folder:
            writer.parquet(f"{folder}/{target}")
        else:
            writer.saveAsTable(f"{database}.{target}" if database else target)
        done.append(target)
    return done


# ---- table sets --------------------------------------------------------------------

_COMMIT = "number bigint, version string, table string, place int"


def publish_tables(tables: dict[str, DataFrame], order: list[str], folder: str) -> int:
    """Replace a whole set of tables at once; returns the number of the new set.

    All tables are written into a folder of their own first. Then one commit record names it: a single
    file, which appears whole or not at all. Until then readers get the set before, also if a
    table fails; what a failed run has written is never read. Sets before the last stay readable by number.
    One writer at a time: two that publish the same number get an error, not a mixture.
    """
    names = [n for n in order if n in tables]
    if not names:
        raise ValueError("no tables to publish")
    spark = tables[names[0]].sparkSession
    version = uuid.uuid4().hex
    for name in names:
        tables[name].write.parquet(f"{folder}/versions/{version}/{name.lower()}")
    number = max((r["number"] for r in _commits(spark, folder)), default=0) + 1
    rows = [(number, version, n.lower(), i) for i, n in enumerate(names)]
    small_frame(spark, rows, _COMMIT).coalesce(1).write.mode("error").json(f"{folder}/commits/{number:012d}")
    return number


def published_tables(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last published set (or of set ``number``), in their order; empty if there is none."""
    rows = _commits(spark, folder)
    wanted = number if number is not None else max((r["number"] for r in rows), default=None)
    mine = sorted((r for r in rows if r["number"] == wanted), key=lambda r: r["place"])
    if number is not None and not mine:
        raise ValueError(f"no set {number} in '{folder}'")
    return {r["table"]: spark.read.parquet(f"{folder}/versions/{r['version']}/{r['table']}") for r in mine}


def _commits(spark: SparkSession, folder: str) -> list:
    """Rows of the commit records: one per set and table."""
    try:
        return spark.read.schema(_COMMIT).json(f"{folder}/commits/*").collect()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
