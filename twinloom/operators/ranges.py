"""Running totals over a sorted axis without a one-task window.

A window without PARTITION BY (or partitioned by one column name) puts a whole
axis in one task. Here the distinct values are range-partitioned, every task
walks its own range with running sums that start at zero and reports a few
numbers, and the totals of the earlier ranges are added to those reports.
The values are aggregated first, so frequent values cannot fill a range, and
the ranges are cut on distinct values, so their sizes are even. The result does
not depend on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinloom.runtime import pinned

Walk = Callable[[pd.DataFrame, np.ndarray, np.ndarray], dict]


def walk_ranges(
    counts: DataFrame,
    group: str,
    axis: str,
    first: str,
    second: str,
    walk: Walk,
    schema: str,
    constants: DataFrame | None = None,
) -> DataFrame:
    """One row per (range, group) with the totals and the numbers ``walk`` reports.

    ``counts`` holds one row per (group, axis value) with two integer counts.
    ``walk(rows, a, b)`` gets rows of one group in axis order with the running
    totals before each row, and returns a dict of partial results, which combine
    as minimum, maximum or sum by the prefix ``lo_``, ``hi_`` or none of their
    names. ``constants`` (a row per group) is attached after the shuffle.
    """
    fields = [part.split()[0] for part in schema.split(",")]

    def merge(kept: dict | None, new: dict) -> dict:
        if kept is None:
            return new
        for f in fields:
            if f.startswith("lo_"):
                kept[f] = min(kept[f], new[f])
            elif f.startswith("hi_"):
                kept[f] = max(kept[f], new[f])
            else:
                kept[f] += new[f]
        return kept

    def per_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_group, starts_at, state = None, None, None
        tot_a = tot_b = 0
        done = []

        def close():
            if open_group is not None:
                done.append({group: open_group, "starts_at": starts_at, "tot_a": tot_a, "tot_b": tot_b, **state})

        for batch in batches:
            for name, rows in batch.groupby(group, sort=False):
                if name != open_group:
                    close()
                    open_group, starts_at, state = name, rows[axis].iloc[0], None
                    tot_a = tot_b = 0
                a = rows[first].to_numpy(dtype=np.int64)
                b = rows[second].to_numpy(dtype=np.int64)
                before_a = tot_a + np.cumsum(a) - a
                before_b = tot_b + np.cumsum(b) - b
                state = merge(state, walk(rows, before_a, before_b))
                tot_a += int(a.sum())
                tot_b += int(b.sum())
        close()
        if done:
            yield pd.DataFrame(done)

    key_type = dict(counts.dtypes)[group]
    axis_type = dict(counts.dtypes)[axis]
    ranged = counts.repartitionByRange(group, axis)
    if constants is not None:
        ranged = ranged.join(F.broadcast(constants), group)
    reports = (
        ranged.sortWithinPartitions(group, axis)
        .mapInPandas(
            per_range,
            f"{group} {key_type}, starts_at {axis_type}, tot_a bigint, tot_b bigint, {schema}",
        )
    )
    # As many rows as tasks and groups: small enough for a window per group.
    earlier = (
        Window.partitionBy(group)
        .orderBy("starts_at")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("bigint")
    return reports.withColumn(
        "off_a", F.coalesce(F.sum("tot_a").over(earlier), zero)
    ).withColumn("off_b", F.coalesce(F.sum("tot_b").over(earlier), zero))


def dense_index(
    df: DataFrame, key: str, buckets: int = 4096, output: str = "idx"
) -> DataFrame:
    """Number the distinct values of ``key`` 0, 1, 2, ...

    Values are spread over hash buckets, numbered inside their bucket, and
    shifted by the sizes of the earlier buckets. The bucket table has
    ``buckets`` rows at most, whatever the data size.
    """
    digits = len(f"{buckets - 1:x}")
    if 16**digits != buckets:
        raise ValueError("buckets must be a power of 16")
    hexes = F.substring(F.md5(F.col(key).cast("string")), 1, digits)
    keyed = (
        df.where(F.col(key).isNotNull())
        .select(key)
        .distinct()
        .withColumn("_b", F.conv(hexes, 16, 10).cast("int"))
    )
    sizes = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_off")
    )
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return (
        keyed.withColumn("_i", place)
        .join(F.broadcast(offsets), "_b")
        .select(key, (F.col("_off") + F.col("_i") - 1).alias(output))
    )


def ordered_index(df: DataFrame, keys: list[str], output: str = "idx") -> DataFrame:
    """Number distinct rows 0, 1, 2, ... in the order of ``keys``, without a one-task window.

    Each range numbers its own rows; the sizes of the ranges before it (a row per range) are added.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # range number and place in the range
    placed = pinned(
        df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("_m", place)
    ).select("*", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_i"))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_off"))
    return placed.join(F.broadcast(offsets), "_p").select(*df.columns, (F.col("_off") + F.col("_i")).alias(output))
