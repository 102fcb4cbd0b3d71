"""Registry, test tables and SQL fragments shared by the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.hashing import Draws
from twinloom.functions.naming import KeyNames
from twinloom.sources.tables import read_parquet_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Column kinds: i integer, d double, s text, t timestamp, v vector.
COLUMNS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t "
    "o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d "
    "l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:v label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}
FIELDS: dict[str, list[tuple[str, str]]] = {
    t: [tuple(c.split(":")) for c in spec.split()] for t, spec in COLUMNS.items()
}
TABLES = list(COLUMNS)

# Declared keys: lineitem has no unique column and conversations none that is a key.
PRIMARY_KEYS = {t: cols[0][0] for t, cols in FIELDS.items()}
KEYS = KeyNames(suffix="_id|key", prefix="[a-z]{1,2}_")
# One-to-one and composite keys whose first column also refers to a parent.
KEY_REFERS = {"lineitem", "labels"}
KEY_SQL_PATTERN = "(_id|key)$"


def load(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return read_parquet_tables(spark, sf, list(names) or TABLES)


def md5_parity(key: str) -> F.Column:
    """0 or 1 from the key's hash: cuts a table in two comparable halves."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 1), 16, 10).cast("int") % 2


def sql_parity(key: str) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR), 1, 1))::INT % 2)"


def sql_uniform(text: str, draw: int = 0) -> str:
    """The keyed uniform draw, as DuckDB computes it."""
    start = 1 + 13 * draw
    return (
        f"((('0x' || substr(md5({text}), {start}, 13))::BIGINT)::DOUBLE + 0.5e0)"
        " / 4503599627370496e0"
    )


def sql_key(seed: int | str, *parts: str) -> str:
    """Text under a draw: stream and key parts joined by bars."""
    return " || '|' || ".join([f"'{seed}'", *[f"coalesce(({p})::VARCHAR, '')" for p in parts]])


def stream_of(table: str, seed: int = 42) -> str:
    return Draws(seed).for_table(table).stream


def sql_gaussian(text: str) -> str:
    return (
        f"sqrt(-2e0 * ln({sql_uniform(text)})) * cos(2e0 * pi() * {sql_uniform(text, 1)})"
    )


def sql_geometric(scale: str, text: str) -> str:
    up, down = (f"floor(-({scale}) * ln({sql_uniform(text, d)}))::BIGINT" for d in (0, 1))
    return f"({up} - {down})"


def as_number(column: str, kind: str) -> str:
    """A column as DOUBLE in SQL."""
    return f"epoch({column})::DOUBLE" if kind == "t" else f"{column}::DOUBLE"
