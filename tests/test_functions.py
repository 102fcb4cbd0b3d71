import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.functions.hashing import Draws
from twinloom.functions.naming import KeyNames, normalize_token, semantic_score, table_name
from twinloom.runtime import small_frame


@pytest.mark.parametrize(
    "path, name",
    [
        ("/x/confidential_flights.csv", "Flights"),
        ("Confidential_air-ports list.csv", "Air_Ports_List"),
        ("my_confidential_x.csv", "My_Confidential_X"),
    ],
)
def test_table_name(path, name):
    assert table_name(path) == name


def test_table_name_marker_anywhere():
    assert table_name("my_confidential_x.csv", anywhere=True) == "My_X"


def test_tokens(spark):
    words = {"Airports": "airport", "Ladies": "lady", "Class": "class", "Status": "statu", "ties": "ty", "s": "s", "A-b C_1": "abc_1", "ies": "ie"}
    df = small_frame(spark, [(w,) for w in words], "w string").select("w", normalize_token(F.col("w")).alias("t"))
    assert {r.w: r.t for r in df.collect()} == words


def test_scores(spark):
    names = KeyNames()
    cases = {
        ("flight_id", "Flights", "id"): 4,
        ("origin_airport_id", "Airports", "id"): 1,
        ("ticket_id", "Flights", "id"): 0,
        ("airport_id", "Airports", "airport_id"): 6,
    }
    df = small_frame(spark, list(cases), "fk string, parent string, pk string")
    score = semantic_score(
        names.base(F.col("fk")), normalize_token(F.col("parent")), names.base(F.col("pk"))
    )
    got = {(r.fk, r.parent, r.pk): r.s for r in df.withColumn("s", score).collect()}
    assert got == cases


def test_streams_tell_tables_apart():
    streams = {Draws(42).for_table(t).stream for t in ("ab", "ca", "a", "b", "1:a")} | {Draws(42).stream}
    assert len(streams) == 6


@pytest.mark.parametrize("draws", [Draws(7), Draws.with_secret(7), Draws(7, fast=True)])
def test_draws_are_uniform_and_repeatable(spark, draws):
    df = spark.range(20000).select(
        draws.uniform(F.lit("a"), F.col("id")).alias("u"),
        draws.uniform(F.lit("a"), F.col("id"), draw=1).alias("v"),
        draws.uniform(F.lit("a"), F.col("id")).alias("again"),
        draws.geometric(2.0, F.lit("l"), F.col("id")).alias("l"),
        draws.gaussian(3.0, F.lit("g"), F.col("id")).alias("g"),
    )
    r = df.agg(
        F.min("u").alias("low"), F.max("u").alias("high"), F.avg("u").alias("mean"),
        F.corr("u", "v").alias("corr"), F.count_if(F.col("u") != F.col("again")).alias("changed"),
        F.stddev("l").alias("l"), F.stddev("g").alias("g"), F.avg("g").alias("gm"),
    ).first()
    assert 0 < r.low < r.high < 1 and abs(r.mean - 0.5) < 0.01 and abs(r["corr"]) < 0.03
    assert r.changed == 0
    assert abs(r.l - 2.0 * 2**0.5) < 0.15 and abs(r.g - 3.0) < 0.1 and abs(r.gm) < 0.1


@pytest.mark.parametrize("variance", [0.3, 2.0, 150.0])
def test_discrete_gaussian_has_its_moments(spark, variance):
    draws = Draws(11)
    df = spark.range(8000).select(
        draws.discrete_gaussian(variance, F.col("id")).alias("x"), draws.discrete_gaussian(variance, F.col("id")).alias("again")
    )
    rows = [(r.x, r.again) for r in df.collect()]
    assert all(a == b for a, b in rows)
    values = np.array([a for a, _ in rows])
    grid = np.arange(-200, 201)
    p = np.exp(-(grid**2) / (2 * variance))
    p /= p.sum()
    spread = (p * grid**2).sum()
    assert abs(values.mean()) < 4 * (spread / 8000) ** 0.5
    assert abs(values.var() / spread - 1) < 0.08
    for x in (-1, 0, 1, 2):
        share = p[grid == x][0]
        assert abs((values == x).mean() - share) < 4.5 * (share / 8000) ** 0.5 + 1e-3


def test_secret_draws_differ():
    assert Draws.with_secret().secret != Draws.with_secret().secret
