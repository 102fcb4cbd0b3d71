"""One narrow shape for values of any column type.

Profiling compares values of many columns in one job, so each value is put in
one of three typed slots instead of being cast to text: ``l`` (bigint), ``d``
(double) and ``s`` (string). All slots NULL means the value is missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG_TEXT = 48
_KINDS = "ntsbx"  # number, time, text, binary, other


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_scalar(dtype: T.DataType) -> bool:
    return is_numeric(dtype) or is_text(dtype) or is_temporal(dtype)


def compact_text(col: Column) -> Column:
    """Identity of a text: short ones as they are, long ones as SHA-256 of the whole."""
    return F.when(F.length(col) <= _LONG_TEXT, F.concat(F.lit("="), col)).otherwise(
        F.concat(F.lit("#"), F.sha2(col, 256))
    )


def micros(col: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970 of a date or time; zoneless times do not see the session's zone."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    days = F.unix_date(col.cast("date")).cast("bigint") * F.lit(86_400_000_000)
    if isinstance(dtype, T.DateType):
        return days
    clock = F.hour(col).cast("bigint") * 3600 + F.minute(col) * 60 + F.second(col)
    # zones differ by whole seconds, so the fraction may be read in any of them
    fraction = F.pmod(F.unix_micros(col.cast("timestamp")), F.lit(1_000_000))
    return days + clock * F.lit(1_000_000) + fraction


def as_double(col: Column, dtype: T.DataType) -> Column:
    """Numeric reading of a column; NaN and unreadable text become NULL."""
    if is_temporal(dtype):
        col = micros(col, dtype).cast("double") / F.lit(1e6)
    elif is_text(dtype):
        col = col.try_cast("double")
    elif is_numeric(dtype):
        col = col.cast("double")
    else:
        return F.lit(None).cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)) or is_text(dtype):
        col = F.when(~F.isnan(col), col)
    return col


def slots(col: Column, dtype: T.DataType) -> tuple[str, Column, Column, Column]:
    """(kind, l, d, s) of a column; equal numbers agree whatever their type."""
    no_l = F.lit(None).cast("bigint")
    no_d = F.lit(None).cast("double")
    no_s = F.lit(None).cast("string")
    if is_integral(dtype) or isinstance(dtype, T.BooleanType):
        return "n", col.cast("bigint"), no_d, no_s
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = F.when(~F.isnan(col), col.cast("double"))
        whole = (F.rint(d) == d) & (F.abs(d) < F.lit(float(2**53)))
        return "n", F.when(whole, d.cast("bigint")), F.when(~whole, d), no_s
    if isinstance(dtype, T.DecimalType):
        if dtype.scale == 0 and dtype.precision <= 18:
            return "n", col.cast("bigint"), no_d, no_s
        if dtype.precision <= 15:
            return slots(col.cast("double"), T.DoubleType())
        return "x", no_l, no_d, col.cast("string")
    if is_temporal(dtype):
        return "t", micros(col, dtype), no_d, no_s
    if isinstance(dtype, T.BinaryType):
        return "b", no_l, no_d, F.sha2(col, 256)
    if is_text(dtype):
        return "s", no_l, no_d, compact_text(col)
    return "x", no_l, no_d, compact_text(col.cast("string"))


@dataclass(frozen=True)
class Attr:
    """A column of a table, by number."""

    id: int
    table: str
    column: str
    position: int
    dtype: T.DataType


def attributes(tables: dict[str, DataFrame], keep=None) -> list[Attr]:
    found = [
        (name, field.name, pos, field.dataType)
        for name, df in tables.items()
        for pos, field in enumerate(df.schema.fields)
    ]
    if keep is not None:
        found = [f for f in found if keep(f[0], f[1], f[3])]
    return [Attr(i, *f) for i, f in enumerate(found)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def long_values(
    tables: dict[str, DataFrame], attrs: list[Attr], **extra: Column
) -> DataFrame:
    """Long form (attr, kind, l, d, s, extras): one row per row and chosen column.

    Each table is scanned once and only the chosen columns are read.
    """
    parts = []
    for name in dict.fromkeys(a.table for a in attrs):
        cells = []
        for a in attrs:
            if a.table != name:
                continue
            kind, l, d, s = slots(F.col(f"`{a.column}`"), a.dtype)
            cells.append(
                F.struct(
                    F.lit(a.id).alias("attr"),
                    F.lit(_KINDS.index(kind)).cast("tinyint").alias("kind"),
                    l.alias("l"),
                    d.alias("d"),
                    s.alias("s"),
                )
            )
        carried = [c.alias(k) for k, c in extra.items()]
        parts.append(
            tables[name]
            .select(F.explode(F.array(*cells)).alias("_c"), *carried)
            .select("_c.*", *extra)
        )
    return union_all(parts)


def small_lookup(attr: Column, labels: list[str]) -> Column:
    """Name of an attribute number, from a list as long as the schema is wide."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), attr + F.lit(1))
