"""Row encoding and decoding, all inside generated JVM code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions.hashing import Draws


def cap_rows(df: DataFrame, keys: list[str], n: int = 1200, seed: int = 42) -> DataFrame:
    """Uniform sample of ``n`` rows without replacement, the same on every run.

    ``orderBy + limit`` is a top-n per task, so only n rows per task move.
    """
    order = Draws(seed).digest(*[F.col(k) for k in keys])
    return df.orderBy(order, *keys).limit(n)


def one_hot(value: Column, categories: list) -> list[Column]:
    """0/1 columns in category order; missing and unknown values take the first."""
    known = value.isin(list(categories))
    flags = [
        F.when(value == F.lit(c), 1).otherwise(0).cast("int") for c in categories
    ]
    flags[0] = F.when(F.coalesce(known, F.lit(False)), flags[0]).otherwise(1).cast("int")
    return flags


def decode_discrete(block: Column, categories: list) -> Column:
    """Category of the largest entry of an encoded block (first one on ties)."""
    where = F.array_position(block, F.array_max(block)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in categories]), where)


@dataclass(frozen=True)
class Scale:
    """Statistics of one continuous column."""

    mean: float
    std: float
    low: float
    high: float
    is_int: bool


def scale_of(stats_row) -> Scale:
    return Scale(
        stats_row["mean"], stats_row["std"], stats_row["min"], stats_row["max"], stats_row["is_int"]
    )


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    # least/greatest skip NULLs, which must stay NULL here
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def standardize_clip(value: Column, s: Scale) -> Column:
    """(x - mean) / (3 std) in [-1, 1]; missing values sit at the mean."""
    filled = F.coalesce(value.cast("double"), F.lit(s.mean))
    return clamp((filled - F.lit(s.mean)) / F.lit(3.0 * s.std), -1.0, 1.0)


def decode_continuous(value: Column, s: Scale) -> Column:
    """Inverse of :func:`standardize_clip`, kept in range; integers round half to even."""
    restored = clamp(value * F.lit(3.0 * s.std) + F.lit(s.mean), s.low, s.high)
    return F.rint(restored).cast("bigint") if s.is_int else restored


def round_clip_int(value: Column, low: int, high: int) -> Column:
    """Codes and flags: round half to even, clip, integer."""
    return clamp(F.rint(value.cast("double")), float(low), float(high)).cast("int")


def rescale_to_reference(
    df: DataFrame,
    column: str,
    reference: DataFrame,
    ref_column: str,
    epsilon: float,
    keys: list[str],
    draws: Draws = Draws(),
    output: str | None = None,
) -> DataFrame:
    """Give a column the mean and deviation of a reference column, plus Gaussian noise.

    Each side is read once for its two statistics, which become constants.
    """
    mine = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).first()
    theirs = reference.agg(
        F.avg(ref_column).alias("m"), F.stddev_samp(ref_column).alias("s")
    ).first()
    noise = draws.gaussian(theirs.s * 0.5 / epsilon, *[F.col(k) for k in keys])
    centered = (F.col(column) - F.lit(mine.m)) / F.lit(mine.s + 1e-8)
    shifted = centered * F.lit(theirs.s) + F.lit(theirs.m) + noise
    return df.withColumn(output or column, shifted)
