import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import twinloom as tl
from twinloom.runtime import small_frame
from twinloom.sources.quoted import read_quoted_csv
from twinloom.sources.tables import (
    CSV,
    bundle_name,
    load_tables,
    publish_tables,
    published_tables,
    read_csv_bundle,
    write_csv_bundle,
)


def test_load_tables(spark, tmp_path):
    (tmp_path / "confidential_air-ports.csv").write_text("id,size,name\n1,2.5,x\n2,,y\n")
    (tmp_path / "Flights.csv").write_text("id,air_id\n1,1\n")
    tables = tl.load_tables(spark, [str(tmp_path / "confidential_air-ports.csv"), str(tmp_path / "Flights.csv")])
    assert list(tables) == ["Air_Ports", "Flights"]
    assert [t for _, t in tables["Air_Ports"].dtypes] == ["int", "double", "string"]
    assert tables["Air_Ports"].where("size is null").count() == 1


def test_csv_bundle_round_trip(spark, tmp_path):
    df = small_frame(
        spark, [(1, 'says "hi"\nand, more', 0.1), (2, None, 2.0)], "id int, note string, v double"
    )
    manifest = tl.write_csv_bundle({"My_Table": df}, str(tmp_path), {"My_Table": "made up"}, 7)
    assert [tuple(r) for r in manifest.collect()] == [("My_Table", 2, "made up", 7)]
    assert (tmp_path / "synthetic_my_table.csv").is_dir()
    back = read_csv_bundle(spark, str(tmp_path), "My_Table", df.schema).orderBy("id").collect()
    assert back == df.orderBy("id").collect()


def test_save_tables_replaces_in_order(spark, tmp_path):
    tables = {"B": spark.range(3), "A": spark.range(2)}
    for _ in range(2):
        assert tl.save_tables(tables, ["A", "B", "Missing"], folder=str(tmp_path)) == ["a", "b"]
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3


def test_save_to_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS twin_test")
    tl.save_tables({"T": spark.range(4)}, ["T"], database="twin_test")
    assert spark.table("twin_test.t").count() == 4
    spark.sql("DROP DATABASE twin_test CASCADE")


def test_preview(spark):
    df = spark.range(100).repartition(5)
    assert tl.preview(df).count() == 10
    assert [r.id for r in tl.preview(df, 3, ["id"]).collect()] == [0, 1, 2]


def test_whole_run_at_two_budgets(spark):
    shops = spark.range(1, 31).select("id", (F.col("id") % 3).cast("int").alias("tier"))
    sales = spark.range(1, 601).select(
        "id", (F.col("id") % 30 + 1).cast("int").alias("shop_id"), (F.col("id") % 2).cast("int").alias("is_priority"),
        (F.col("id") * 7 % 97 + F.col("id") % 2 * 50).cast("double").alias("amount"),
    )
    tables = {"Shops": shops, "Sales": sales}
    out = tl.epsilon_sweep(tables, [2.0, 20.0], secret_noise=False, trees=10, depth=4).collect()
    assert [r.eps for r in out] == [2.0, 20.0]
    assert {(r.target_table, r.target_col) for r in out} == {("Sales", "is_priority")}
    assert out[1].avg_ks < 0.2 and out[1].tstr_auc > 0.6


def test_the_reader_understands_the_writer(spark, tmp_path):
    """Quoted quotes, commas and line breaks, and microseconds, survive a bundle."""
    rows = [(1, 'a "quoted", text', "2024-01-02 03:04:05.123456"), (2, "two\nlines", "2024-01-02 03:04:05"), (3, "plain", None)]
    df = spark.createDataFrame(rows, "id int, note string, t string").selectExpr("id", "note", "cast(t as timestamp) as at")
    manifest = write_csv_bundle({"Notes": df}, str(tmp_path))
    assert manifest.first().rows == 3
    want = sorted(map(tuple, df.collect()))
    path = f"{tmp_path}/{bundle_name('Notes')}"
    assert sorted(map(tuple, read_csv_bundle(spark, str(tmp_path), "Notes", df.schema).collect())) == want
    (table,) = load_tables(spark, [path]).values()
    assert sorted(map(tuple, table.collect())) == want


def _texts(rng, n):
    def text():
        return "".join(rng.choice(["a", "b", " ", '"', "\n", ",", "é", "\r\n", "'"]) for _ in range(rng.randint(0, 30)))

    return [(i, text(), rng.random(), text() or None) for i in range(n)]


def test_quoted_lines_are_read_by_many_tasks(spark, tmp_path):
    """As multiLine reads them, whatever the ranges; one row is longer than many ranges."""
    rng = random.Random(4)
    rows = [*_texts(rng, 600), (9999, 'x"\n' * 2000, 1.0, "end"), *_texts(rng, 300)]
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["id", "a", "v", "b"])
        out.writerows(rows)
    schema = T._parse_datatype_string("id bigint, a string, v double, b string")
    want = sorted(map(tuple, spark.read.schema(schema).options(**CSV).option("multiLine", True).csv(path).collect()), key=str)
    assert len(want) == 901
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = read_quoted_csv(spark, path, schema, CSV)
            assert sorted(map(tuple, got.collect()), key=str) == want
        assert spark.read.text(path).rdd.getNumPartitions() > 50
        typed = read_quoted_csv(spark, path, None, CSV)
        assert [t for _, t in typed.dtypes] == ["int", "string", "double", "string"] and typed.count() == 901
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "none.csv").write_text("a,b\n")
    (tmp_path / "blank.csv").write_text("")
    schema = T._parse_datatype_string("a int, b string")
    assert read_quoted_csv(spark, str(tmp_path / "none.csv"), schema, CSV).collect() == []
    assert read_quoted_csv(spark, str(tmp_path / "blank.csv"), None, CSV).columns == []


def test_a_failure_between_tables_leaves_the_old_set(spark, tmp_path):
    folder = str(tmp_path / "set")
    assert published_tables(spark, folder) == {}
    old = {"A": spark.range(3), "B": spark.range(5)}
    assert publish_tables(old, ["A", "B"], folder) == 1
    broken = {"A": spark.range(30), "B": spark.range(5).select(F.raise_error(F.lit("lost")).alias("id"))}
    with pytest.raises(Exception, match="lost"):
        publish_tables(broken, ["A", "B"], folder)
    assert {t: df.count() for t, df in published_tables(spark, folder).items()} == {"a": 3, "b": 5}
    assert publish_tables({"A": spark.range(7)}, ["A", "B"], folder) == 2
    assert {t: df.count() for t, df in published_tables(spark, folder).items()} == {"a": 7}
    assert {t: df.count() for t, df in published_tables(spark, folder, 1).items()} == {"a": 3, "b": 5}
    with pytest.raises(ValueError):
        published_tables(spark, folder, 9)
