from pyspark.sql import functions as F

from twinloom.functions.naming import KeyNames
from twinloom.operators import profile as P
from twinloom.runtime import small_frame


def test_primary_key_rules(spark):
    tables = {
        "id_wins": small_frame(spark, [(1, 10), (2, 11)], "a int, id int"),
        "first_unique": small_frame(spark, [(1, "x", 5), (1, "y", 6)], "a int, b string, c int"),
        "null_disqualifies": small_frame(spark, [(1, 1), (None, 2)], "a int, b int"),
        "none": small_frame(spark, [(1, 1), (1, 1)], "a int, b int"),
        "id_repeats": small_frame(spark, [(1, 5), (1, 6)], "id int, b int"),
        "empty": small_frame(spark, [], "a int, b int"),
    }
    assert P.infer_primary_keys(tables) == {
        "id_wins": "id",
        "first_unique": "b",
        "null_disqualifies": "b",
        "none": "a",
        "id_repeats": "b",
        "empty": "a",
    }


def test_one_duplicate_among_many_is_seen(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") == 17, 18).otherwise(F.col("id")).alias("almost"),
        (F.col("id") * 3).alias("sure"),
    )
    assert P.infer_primary_keys({"t": df}) == {"t": "sure"}


def test_column_profile(spark):
    df = small_frame(
        spark,
        [(1, 1.5, "a", None), (1, float("nan"), "b", None), (2, 1.5, None, None)],
        "i int, d double, s string, n string",
    )
    got = {r.column: (r.rows, r.nulls, r.distinct, r.is_unique) for r in P.column_profile({"t": df}).collect()}
    assert got == {
        "i": (3, 0, 2, False),
        "d": (3, 1, 1, False),
        "s": (3, 1, 2, False),
        "n": (3, 3, 0, False),
    }


def test_column_profile_of_an_empty_table(spark):
    rows = P.column_profile({"t": small_frame(spark, [], "a int")}).collect()
    assert [(r.rows, r.nulls, r.distinct) for r in rows] == [(0, 0, 0)]


def test_types_follow_the_limit_of_twenty(spark):
    df = spark.range(2100).select(
        (F.col("id") % 20).alias("twenty"),
        (F.col("id") % 21).alias("twentyone"),
        F.lit("same").alias("constant"),
        F.lit(3).alias("constant_number"),
        F.concat(F.lit("w"), F.col("id")).alias("words"),
        (F.col("id") % 2 == 0).alias("flag"),
        (F.col("id") % 3 / 2).alias("ratio"),
    )
    got = {t.column: (t.kind, t.n_categories) for t in P.column_types({"t": df})}
    assert got == {
        "twenty": ("discrete", 20),
        "twentyone": ("continuous", None),
        "constant": ("continuous", None),
        "constant_number": ("continuous", None),
        "words": ("discrete", 2100),  # every discrete column is counted
        "flag": ("discrete", 2),
        "ratio": ("discrete", 3),
    }
    (ratio,) = [t for t in P.column_types({"t": df}) if t.column == "ratio"]
    assert ratio.categories == ("0.0", "0.5", "1.0")
    (twenty,) = [t for t in P.column_types({"t": df}) if t.column == "twenty"]
    assert twenty.categories == tuple(str(i) for i in range(20))


def test_column_stats(spark):
    df = small_frame(
        spark, [(1, None, 5, 2.0), (3, None, 5, 4.0)], "a int, none double, same int, d double"
    )
    got = {r.column: (r.mean, r.std, r.min, r.max, r.is_int) for r in P.column_stats(df).collect()}
    assert got["none"] == (0.0, 1.0, -1.0, 1.0, False)
    assert got["same"] == (5.0, 1.0, 5.0, 5.0, True)
    assert got["a"][0] == 2.0 and abs(got["a"][1] - 2**0.5) < 1e-12 and got["a"][4] is True


def test_category_domain_is_sorted(spark):
    df = small_frame(spark, [(3,), (None,), (1,), (3,)], "a int")
    assert [r.value for r in P.category_domain(df, "a").collect()] == [1, 3]


def test_pick_target(spark):
    plain = small_frame(spark, [(1, 1, 7), (2, 2, 8)], "id int, x_id int, y int")
    named = small_frame(spark, [(1, 0), (2, 1)], "id int, fare_class int")
    flat = small_frame(spark, [(1, 5), (2, 5)], "id int, fare_class int")
    assert P.pick_target({"A": plain, "B": named}) == ("B", "fare_class")
    assert P.pick_target({"A": plain, "B": flat}) == ("A", "y")
    assert P.pick_target({"A": plain, "B": flat}, fallback=False) is None
    wide = spark.range(30).select("id", F.col("id").alias("v"))
    assert P.pick_target({"W": wide}) == ("W", "v")
    assert P.pick_target({"A": plain}, KeyNames(suffix="_id|y")) == ("A", "x_id")


def test_pick_compare_columns(spark):
    a = small_frame(spark, [(1, 1, 1, 1)], "id int, x int, y int, z int")
    b = small_frame(spark, [(1, "s", 1.0)], "id int, s string, w double")
    got = P.pick_compare_columns({"A": a, "B": b}, {"A": "id", "B": "id"}, k=3)
    rows = got.orderBy("later", "table_pos", "position").collect()
    assert [(r.table, r.column) for r in rows] == [("A", "x"), ("B", "w"), ("A", "y")]
