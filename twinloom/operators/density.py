"""Histogram and density curves of a column on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions.values import as_double, union_all
from twinloom.runtime import small_frame

# Points of a curve, and how far it runs past the data (in bandwidths).
GRID = 200
CUT = 3.0
FINE_BINS = 1024


def _long(pairs: dict, columns: list[tuple[str, str]]) -> DataFrame:
    """(table, column, side, v) of the chosen columns, missing values dropped."""
    parts = []
    for name in dict.fromkeys(t for t, _ in columns):
        for side, df in zip(("real", "synth"), pairs[name]):
            types = {f.name: f.dataType for f in df.schema.fields}
            cells = [
                F.struct(F.lit(c).alias("column"), as_double(F.col(f"`{c}`"), types[c]).alias("v"))
                for t, c in columns
                if t == name
            ]
            parts.append(
                df.select(F.inline(F.array(*cells))).select(
                    F.lit(name).alias("table"), "column", F.lit(side).alias("side"), "v"
                )
            )
    return union_all(parts).where(F.col("v").isNotNull())


def _facts(pairs: dict, columns: list[tuple[str, str]]) -> list[tuple]:
    """(table, column, side, n, deviation, low, high) of the chosen columns that have values.

    One pass over each side without a shuffle of rows; a row per column and side comes back.
    """
    parts = []
    for name in dict.fromkeys(t for t, _ in columns):
        for side, df in zip(("real", "synth"), pairs[name]):
            types = {f.name: f.dataType for f in df.schema.fields}
            facts = []
            for c in (c for t, c in columns if t == name):
                v = as_double(F.col(f"`{c}`"), types[c])
                found = F.count(v).alias("n"), F.stddev_samp(v).alias("s"), F.min(v).alias("low"), F.max(v).alias("high")
                facts.append(F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(side).alias("side"), *found))
            parts.append(df.agg(F.array(*facts).alias("f")).select(F.inline("f")))
    return [tuple(r) for r in union_all(parts).where("n > 0").collect()]


def _spans(pairs: dict, columns: list[tuple[str, str]]) -> list[tuple]:
    """(table, column, low, high, n_real, n_synth): the common range and the values of both sides."""
    spans: dict[tuple[str, str], list] = {}
    for table, column, side, n, _, low, high in _facts(pairs, columns):
        span = spans.setdefault((table, column), [low, high, 0, 0])
        span[0], span[1] = min(span[0], low), max(span[1], high)
        span[2 if side == "real" else 3] = n
    return [(*name, *span) for name, span in spans.items()]


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the top edge belongs to the last bin."""
    width = (high - low) / F.lit(float(bins))
    at = F.floor(F.try_divide(v - low, width))
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram_compare(
    pairs: dict[str, tuple[DataFrame, DataFrame]],
    columns: list[tuple[str, str]],
    bins: int = 20,
) -> DataFrame:
    """Counts and densities of both sides in equal bins over their common range."""
    long = _long(pairs, columns)
    span = small_frame(
        long.sparkSession,
        _spans(pairs, columns),
        "table string, column string, low double, high double, n_real bigint, n_synth bigint",
    )
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    # one row per bin that belongs to no side, so that empty bins appear too
    nowhere = F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("v")
    empty = span.select("table", "column", *nowhere, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("at"))
    long = long.withColumn("at", F.lit(None).cast("int"))
    return (
        long.unionByName(empty)
        .join(F.broadcast(span), ["table", "column"])
        .withColumn("bin", F.coalesce("at", _bin(F.col("v"), F.col("low"), F.col("high"), bins)))
        .where((F.col("high") > F.col("low")) | (F.col("bin") == 0))  # one value has one bin
        .groupBy("table", "column", "bin", "low", "high", "n_real", "n_synth")
        .agg(
            F.count_if(F.col("side") == "real").alias("real_n"),
            F.count_if(F.col("side") == "synth").alias("synth_n"),
        )
        .select(
            "table",
            "column",
            "bin",
            (F.col("low") + F.col("bin") * width).alias("lo"),
            (F.col("low") + (F.col("bin") + 1) * width).alias("hi"),
            "real_n",
            "synth_n",
            F.try_divide(F.col("real_n").cast("double"), F.col("n_real") * width).alias(
                "real_density"
            ),
            F.try_divide(F.col("synth_n").cast("double"), F.col("n_synth") * width).alias(
                "synth_density"
            ),
        )
    )


def density_curves(
    pairs: dict[str, tuple[DataFrame, DataFrame]],
    columns: list[tuple[str, str]],
    grid: int = GRID,
    fine_bins: int = FINE_BINS,
) -> DataFrame:
    """(table, column, side, point, x, density): Gaussian kernel curve on a grid.

    Scott's bandwidth, running three bandwidths past the data. The kernel is
    applied to the mean values of ``fine_bins`` fine bins, so the work per point
    is fixed while all rows count.
    """
    key = ["table", "column", "side"]
    long = _long(pairs, columns)
    facts = small_frame(
        long.sparkSession,
        _facts(pairs, columns),
        "table string, column string, side string, n bigint, s double, low double, high double",
    )
    stats = facts.where("s > 0").withColumn("bw", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    fine = (
        long.join(F.broadcast(stats), key)
        .withColumn("bin", _bin(F.col("v"), F.col("low"), F.col("high"), fine_bins))
        .groupBy(*key, "n", "bw", "low", "high", "bin")
        .agg(F.count(F.lit(1)).cast("double").alias("w"), F.avg("v").alias("at"))
        .groupBy(*key, "n", "bw", "low", "high")
        .agg(F.collect_list(F.struct("at", "w")).alias("mass"))  # fine_bins entries at most
    )
    start = F.col("low") - F.lit(CUT) * F.col("bw")
    step = (F.col("high") - F.col("low") + F.lit(2 * CUT) * F.col("bw")) / F.lit(grid - 1.0)
    peak = F.col("n") * F.col("bw") * F.sqrt(F.lit(2.0) * F.pi())

    def kernel(x: Column) -> Column:
        return F.aggregate(
            "mass",
            F.lit(0.0),
            lambda acc, m: acc
            + m["w"] * F.exp(F.lit(-0.5) * F.pow((x - m["at"]) / F.col("bw"), F.lit(2.0))),
        )

    return (
        fine.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .withColumn("x", start + F.col("point") * step)
        .select(*key, "point", "x", (kernel(F.col("x")) / peak).alias("density"))
    )
