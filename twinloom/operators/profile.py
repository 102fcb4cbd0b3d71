"""Column profiles, primary keys, column types, domains and statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions.naming import KeyNames
from twinloom.functions.values import (
    Attr,
    as_double,
    attributes,
    is_integral,
    is_numeric,
    is_scalar,
    is_text,
    long_values,
    small_lookup,
    union_all,
)
from twinloom.runtime import small_frame

# The preferred target columns, best first.
PREFERRED_TARGETS = (
    "is_delayed",
    "fraud_flag",
    "is_priority",
    "oversize_flag",
    "fare_class",
    "loyalty_tier",
)
# Category limits of column typing and of target choice.
MAX_CATEGORIES = 20
TARGET_CLASSES = (2, 10)
LEAST_TARGET_ROWS = 50  # of a table whose column is worth predicting

# 2**12 registers: a standard error below 2 %.
_SKETCH_LG_K = 12
_SKETCH_ERROR = 0.02
# Ten standard errors of the sketch: a column below this share is not unique.
NEAR_UNIQUE = 1.0 - 10 * _SKETCH_ERROR


def _session(tables: dict[str, DataFrame]) -> SparkSession:
    return next(iter(tables.values())).sparkSession


def attr_frame(spark: SparkSession, attrs: list[Attr]) -> DataFrame:
    rows = [(a.id, a.table, a.column, a.position) for a in attrs]
    return small_frame(
        spark,
        rows, "attr int, table string, column string, position int"
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n); an aggregate without columns reads only file footers."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n")
            for t, df in tables.items()
        ]
    )


def column_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact rows, nulls and distinct values of every column, in one job.

    The first grouping is on (column, value), so a value that fills a third of a
    table leaves each task as one row.
    """
    attrs = attributes(tables)
    names = attr_frame(_session(tables), attrs)
    per_value = (
        long_values(tables, attrs)
        .groupBy("attr", "l", "d", "s")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    missing = F.col("l").isNull() & F.col("d").isNull() & F.col("s").isNull()
    per_attr = per_value.groupBy("attr").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("nulls"),
        F.count_if(~missing).alias("distinct"),
    )
    zero = F.lit(0).cast("bigint")
    filled = F.broadcast(names).join(per_attr, "attr", "left")
    counts = {c: F.coalesce(c, zero) for c in ("rows", "nulls", "distinct")}
    return filled.select(
        "table",
        "column",
        "position",
        *[v.alias(k) for k, v in counts.items()],
        ((counts["nulls"] == 0) & (counts["distinct"] == counts["rows"])).alias(
            "is_unique"
        ),
    )


@dataclass(frozen=True)
class Sketch:
    """Cheap facts about one column; ``approx`` is a sketch, the rest is exact."""

    attr: Attr
    rows: int
    present: int
    approx: int


def sketch_columns(tables: dict[str, DataFrame]) -> list[Sketch]:
    """One pass per table, without a shuffle of values."""
    parts, attrs = [], attributes(tables)
    for name, df in tables.items():
        facts = []
        for a in (a for a in attrs if a.table == name):
            raw = F.col(f"`{a.column}`")
            if isinstance(a.dtype, (T.FloatType, T.DoubleType)):
                raw = F.when(~F.isnan(raw), raw)
            # 64-bit hashes keep the sketch buffer one binary value per column
            hashed = F.when(raw.isNotNull(), F.xxhash64(raw))
            estimate = F.hll_sketch_estimate(F.hll_sketch_agg(hashed, _SKETCH_LG_K))
            facts.append(
                F.struct(
                    F.lit(a.id).alias("attr"),
                    F.count(raw).alias("present"),
                    F.coalesce(estimate, F.lit(0).cast("bigint")).alias("approx"),
                )
            )
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows"), F.array(*facts).alias("f")).select(
                "rows", F.explode("f").alias("f")
            )
        )
    collected = union_all(parts).select("rows", "f.*").collect()  # one row per column
    return [
        Sketch(attrs[r.attr], r.rows, r.present, r.approx)
        for r in sorted(collected, key=lambda r: r.attr)
    ]


def _exactly_unique(tables: dict[str, DataFrame], attrs: list[Attr]) -> set[int]:
    """Which of these columns hold no value twice."""
    renumbered = [Attr(i, a.table, a.column, a.position, a.dtype) for i, a in enumerate(attrs)]
    repeated = (
        long_values(tables, renumbered)
        .groupBy("attr", "l", "d", "s")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("attr")
        .agg(F.max("n").alias("most"))
        .where("most > 1")
        .collect()
    )  # at most one row per checked column
    bad = {r.attr for r in repeated}
    return {attrs[i].id for i in range(len(attrs)) if i not in bad}


def infer_primary_keys(
    tables: dict[str, DataFrame], sketches: list[Sketch] | None = None
) -> dict[str, str]:
    """``id`` if unique and complete, else the first such column, else the first.

    Sketches rule columns out; what is left is checked exactly, one column per
    table and round, so usually only one narrow column per table is shuffled.
    """
    sketches = sketches if sketches is not None else sketch_columns(tables)
    queues: dict[str, list[Attr]] = {}
    for name in tables:
        mine = [s for s in sketches if s.attr.table == name]
        fit = [
            s.attr
            for s in mine
            if s.present == s.rows and s.approx >= NEAR_UNIQUE * s.rows
        ]
        queues[name] = sorted(fit, key=lambda a: (a.column != "id", a.position))
    keys: dict[str, str] = {}
    while True:
        open_ = {t: q for t, q in queues.items() if t not in keys and q}
        if not open_:
            break
        heads = [q[0] for q in open_.values()]
        unique = _exactly_unique(tables, heads)
        for name, queue in open_.items():
            head = queue.pop(0)
            if head.id in unique:
                keys[name] = head.column
    return {t: keys.get(t, df.columns[0]) for t, df in tables.items()}


def _plain_slots(a: Attr) -> list[Column]:
    """The value in the slot of its type, as it is."""
    value = F.col(f"`{a.column}`")
    whole, real = is_integral(a.dtype), isinstance(a.dtype, T.DoubleType)
    return [
        (value.cast("bigint") if whole else F.lit(None).cast("bigint")).alias("l"),
        (value if real else F.lit(None).cast("double")).alias("d"),
        (F.lit(None).cast("string") if whole or real else value.cast("string")).alias("s"),
    ]


def small_domains(
    tables: dict[str, DataFrame],
    limit: int | Callable[[Attr], int],
    sketches: list[Sketch] | None = None,
    keep=None,
) -> DataFrame:
    """(table, column, position, value, n) of the columns with at most ``limit`` values.

    ``limit`` is a number, or gives one per column.

    Sketches drop the wide columns first, so the exact counting that follows
    shuffles no more than a few dozen rows per task and column.
    """
    spark = _session(tables)
    sketches = sketches if sketches is not None else sketch_columns(tables)
    cap = limit if callable(limit) else lambda attr: limit
    narrow = [
        s.attr
        for s in sketches
        if s.present > 0
        and s.approx <= cap(s.attr) * (1 + 10 * _SKETCH_ERROR) + 5
        and is_scalar(s.attr.dtype)
        and (keep is None or keep(s.attr))
    ]
    schema = "table string, column string, position int, value string, n bigint"
    if not narrow:
        return small_frame(spark, [], schema)
    parts = []
    for name in dict.fromkeys(a.table for a in narrow):
        cells = [
            F.struct(F.lit(i).alias("attr"), *_plain_slots(a))
            for i, a in enumerate(narrow)
            if a.table == name
        ]
        parts.append(tables[name].select(F.inline(F.array(*cells))))
    # numbers become text only after the grouping
    value = F.coalesce(F.col("l").cast("string"), F.col("d").cast("string"), F.col("s"))
    labels = small_frame(
        spark,
        [(i, a.table, a.column, a.position, cap(a)) for i, a in enumerate(narrow)],
        "attr int, table string, column string, position int, cap int",
    )
    counted = (
        union_all(parts)
        .groupBy("attr", "l", "d", "s")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("value", value)
        .where(F.col("value").isNotNull() & (F.col("value") != "NaN"))
        .join(F.broadcast(labels), "attr")
        .select("table", "column", "position", "value", "n", "cap")
    )
    width = F.count(F.lit(1)).over(Window.partitionBy("table", "column"))
    return counted.withColumn("w", width).where("w <= cap").drop("w", "cap")


@dataclass(frozen=True)
class ColumnType:
    table: str
    column: str
    position: int
    kind: str  # discrete | continuous
    categories: tuple[str, ...]  # ascending; empty when continuous or too many
    n_categories: int | None


def column_types(
    tables: dict[str, DataFrame],
    max_categories: int = MAX_CATEGORIES,
    sketches: list[Sketch] | None = None,
    count_texts: bool = True,
    small: DataFrame | None = None,
) -> list[ColumnType]:
    """Text and boolean columns, and numbers with few values, are discrete.

    The limit is for numbers: those with more than ``max_categories`` values are
    continuous. ``n_categories`` is given for every discrete column (for longer texts
    unless ``count_texts`` is off), ``categories`` up to ``max_categories``; longer lists
    are data, see ``category_domain``.

    A column with fewer than two values counts as continuous. Nested columns
    have no type here. ``small``: result of :func:`small_domains` with this limit, where it is known already.
    """
    sketches = sketches if sketches is not None else sketch_columns(tables)
    rows = (
        (small if small is not None else small_domains(tables, max_categories, sketches))
        .select("table", "column", "value")
        .collect()
    )  # a bounded number of rows per column
    values: dict[tuple[str, str], list[str]] = {}
    for r in rows:
        values.setdefault((r.table, r.column), []).append(r.value)
    long_texts = [
        s.attr
        for s in sketches
        if is_text(s.attr.dtype) and s.present and (s.attr.table, s.attr.column) not in values
    ]
    counted = distinct_counts(tables, long_texts) if count_texts else {}
    types = []
    for s in sketches:
        a = s.attr
        if not is_scalar(a.dtype):
            continue
        found = values.get((a.table, a.column), [])
        wordy = is_text(a.dtype) or isinstance(a.dtype, T.BooleanType)
        few = is_numeric(a.dtype) and 0 < len(found) <= max_categories
        # more than two by the sketch is at least two; up to two was counted exactly
        varied = len(found) >= 2 or s.approx > 2
        discrete = (wordy or few) and varied
        if is_numeric(a.dtype) and not isinstance(a.dtype, T.BooleanType):
            found = sorted(found, key=float)
        else:
            found = sorted(found)
        types.append(
            ColumnType(
                a.table,
                a.column,
                a.position,
                "discrete" if discrete else "continuous",
                tuple(found) if discrete else (),
                (len(found) or counted.get((a.table, a.column))) if discrete else None,
            )
        )
    return types


def distinct_counts(tables: dict[str, DataFrame], attrs: list[Attr]) -> dict[tuple[str, str], int]:
    """Exact number of values of text columns, by 128-bit hashes instead of whole texts."""
    parts = [
        tables[a.table]
        .where(F.col(f"`{a.column}`").isNotNull())
        .select(F.lit(i).alias("attr"), F.md5(F.col(f"`{a.column}`").cast("string")).alias("h"))
        .distinct()
        for i, a in enumerate(attrs)
    ]
    if not parts:
        return {}
    rows = union_all(parts).groupBy("attr").agg(F.count(F.lit(1)).alias("n")).collect()
    return {(attrs[r.attr].table, attrs[r.attr].column): r.n for r in rows}


def text_domains(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, value, n) of all text columns, however many values they have."""
    parts = [
        df.where(F.col(f"`{f.name}`").isNotNull())
        .groupBy(F.col(f"`{f.name}`").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(t).alias("table"), F.lit(f.name).alias("column"), "value", "n")
        for t, df in tables.items()
        for f in df.schema.fields
        if is_text(f.dataType)
    ]
    spark = _session(tables)
    return union_all(parts) if parts else small_frame(spark, [], "table string, column string, value string, n bigint")


def category_domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column, ascending; as long as the domain is."""
    value = F.col(f"`{column}`")
    return df.where(value.isNotNull()).select(value.alias("value")).distinct().orderBy("value")


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, minimum, maximum and integer flag per column.

    No value at all gives 0, 1, -1, 1; a deviation that is missing or not above
    1e-8 becomes 1.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    columns = columns or [c for c, t in fields.items() if is_scalar(t) and not is_text(t)]
    facts = []
    for pos, c in enumerate(columns):
        v = as_double(F.col(f"`{c}`"), fields[c])
        spread = F.stddev_samp(v)
        facts.append(
            F.struct(
                F.lit(pos).alias("position"),
                F.lit(c).alias("column"),
                F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
                F.when(spread > 1e-8, spread).otherwise(1.0).alias("std"),
                F.coalesce(F.min(v), F.lit(-1.0)).alias("min"),
                F.coalesce(F.max(v), F.lit(1.0)).alias("max"),
                F.lit(is_integral(fields[c])).alias("is_int"),
            )
        )
    return df.agg(F.array(*facts).alias("f")).select(F.inline("f"))


def pick_target(
    tables: dict[str, DataFrame],
    names: KeyNames = KeyNames(),
    fallback: bool = True,
    sketches: list[Sketch] | None = None,
    small: DataFrame | None = None,
) -> tuple[str, str] | None:
    """Table and column to predict.

    A preferred name with 2 to 10 values wins, then any non-key column with as
    many, then the first non-id column of the first table. Without
    ``fallback`` only preferred names count. ``small``: ``small_domains`` of at least as many values, where they are known.
    """
    low, high = TARGET_CLASSES
    found = (
        (small if small is not None else small_domains(tables, high, sketches))
        .groupBy("table", "column")
        .agg(F.count(F.lit(1)).alias("w"))
        .where(F.col("w").between(low, high))
        .collect()
    )  # at most one row per column
    fit = {(r.table, r.column) for r in found}
    for table in tables:
        for column in PREFERRED_TARGETS:
            if (table, column) in fit:
                return table, column
    if not fallback:
        return None
    for table, df in tables.items():
        for column in df.columns:
            if not names.is_key_like(column) and (table, column) in fit:
                return table, column
    table, df = next(iter(tables.items()))
    return table, next(c for c in df.columns if c != "id")


def learnable_target(
    tables: dict[str, DataFrame],
    names: KeyNames = KeyNames(),
    sketches: list[Sketch] | None = None,
    least_rows: int = LEAST_TARGET_ROWS,
) -> tuple[str, str] | None:
    """The target of :func:`pick_target` among tables that something can be learned from; None if there is none.

    Such a table has at least ``least_rows`` rows and, beside the target, a column that is no key; a table of
    five rows or with keys only would give an error instead of a score.
    """
    sketches = sketches if sketches is not None else sketch_columns(tables)
    rows = {s.attr.table: s.rows for s in sketches}

    def features(df: DataFrame) -> list[str]:
        return [f.name for f in df.schema.fields if not names.is_key_like(f.name) and is_scalar(f.dataType)]

    fit = {t: df for t, df in tables.items() if rows.get(t, 0) >= least_rows and len(features(df)) > 1}
    if not fit:
        return None
    mine = [s for s in sketches if s.attr.table in fit]
    table, column = pick_target(fit, names, sketches=mine)
    return (table, column) if column in features(fit[table]) else None


def pick_compare_columns(
    tables: dict[str, DataFrame], primary_keys: dict[str, str], k: int = 6
) -> DataFrame:
    """Up to ``k`` numeric columns: the first of each table, then the others in order."""
    spark = _session(tables)
    rows = [
        (ti, t, f.name, pi)
        for ti, (t, df) in enumerate(tables.items())
        for pi, f in enumerate(df.schema.fields)
        if is_numeric(f.dataType) and f.name != primary_keys.get(t)
    ]
    frame = small_frame(
        spark,
        rows, "table_pos int, table string, column string, position int"
    )
    turn = F.row_number().over(Window.partitionBy("table").orderBy("position"))
    return (
        frame.withColumn("later", (turn > 1).cast("int"))
        .orderBy("later", "table_pos", "position")
        .limit(k)
        .select("table", "column", "later", "table_pos", "position")
    )
