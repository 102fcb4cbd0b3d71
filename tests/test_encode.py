import pytest
from pyspark.sql import functions as F

from twinloom.functions.hashing import Draws
from twinloom.operators import encode as E
from twinloom.runtime import small_frame


def test_cap_rows(spark):
    df = spark.range(5000)
    first = [r.id for r in E.cap_rows(df, ["id"], 1200).collect()]
    again = [r.id for r in E.cap_rows(df.repartition(7), ["id"], 1200).collect()]
    assert len(first) == len(set(first)) == 1200 and first == again
    assert E.cap_rows(df.limit(10), ["id"], 1200).count() == 10
    assert 2200 < sum(first) / len(first) < 2800


def test_one_hot_sends_missing_and_unknown_to_the_first(spark):
    df = small_frame(spark, [("a",), ("b",), ("c",), (None,), ("z",)], "v string")
    rows = df.select(*[f.alias(f"f{i}") for i, f in enumerate(E.one_hot(F.col("v"), ["a", "b", "c"]))]).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0), (1, 0, 0)]


def test_standardize_and_back(spark):
    s = E.Scale(mean=10.0, std=2.0, low=4.0, high=30.0, is_int=False)
    df = small_frame(spark, [(10.0,), (13.0,), (22.0,), (None,), (-5.0,)], "v double")
    z = E.standardize_clip(F.col("v"), s)
    rows = df.select(z.alias("z"), E.decode_continuous(z, s).alias("back")).collect()
    assert [r.z for r in rows] == [0.0, 0.5, 1.0, 0.0, -1.0]
    assert [r.back for r in rows] == [10.0, 13.0, 16.0, 10.0, 4.0]


def test_integers_round_half_to_even(spark):
    s = E.Scale(mean=0.0, std=1.0, low=-9.0, high=9.0, is_int=True)
    df = small_frame(spark, [(2.5 / 3,), (3.5 / 3,), (99.0,)], "v double")
    assert [r[0] for r in df.select(E.decode_continuous(F.col("v"), s)).collect()] == [2, 4, 9]


def test_decode_discrete_takes_the_largest(spark):
    df = small_frame(spark, [([0.1, 0.7, 0.2],), ([0.5, 0.5, 0.0],)], "b array<double>")
    got = df.select(E.decode_discrete(F.col("b"), ["x", "y", "z"])).collect()
    assert [r[0] for r in got] == ["y", "x"]


def test_round_clip_int(spark):
    df = small_frame(spark, [(0.5,), (1.5,), (7.0,), (-3.0,), (None,)], "v double")
    assert [r[0] for r in df.select(E.round_clip_int(F.col("v"), 0, 3)).collect()] == [0, 2, 3, 0, None]


def test_rescale_takes_mean_and_deviation_of_the_reference(spark):
    mine = spark.range(4000).select("id", (F.col("id") % 100).cast("double").alias("v"))
    ref = spark.range(3000).select((F.col("id") % 50 * 3 + 7).cast("double").alias("w"))
    out = E.rescale_to_reference(mine, "v", ref, "w", 1000.0, ["id"], Draws(1))
    got, want = out.agg(F.avg("v"), F.stddev("v")).first(), ref.agg(F.avg("w"), F.stddev("w")).first()
    assert tuple(got) == pytest.approx(tuple(want), rel=1e-3)
