"""Encoding and decoding of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinloom.functions.hashing import Draws
from twinloom.operators import encode, features, profile
from workload.base import KEYS, load, md5_parity, query, sql_gaussian, sql_key, sql_parity


@query(
    "cap_rows",
    f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        ORDER BY md5({sql_key(42, "o_orderkey")}), o_orderkey LIMIT 1200""",
)
def cap_rows(spark, sf):
    orders = load(spark, sf, "orders")["orders"].select("o_orderkey", "o_custkey", "o_totalprice")
    return encode.cap_rows(orders, ["o_orderkey"])


def _domain(df, column):
    return [r.value for r in profile.category_domain(df, column).collect()]


@query(
    "one_hot",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              CASE WHEN l_returnflag = 'N' OR l_returnflag = 'R' THEN 0 ELSE 1 END AS flag_0,
              CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS flag_1,
              CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag_2 FROM lineitem""",
)
def one_hot(spark, sf):
    li = load(spark, sf, "lineitem")["lineitem"]
    flags = encode.one_hot(F.col("l_returnflag"), _domain(li, "l_returnflag"))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        *[f.alias(f"flag_{i}") for i, f in enumerate(flags)],
    )


def _scale(df, column):
    return encode.scale_of(profile.column_stats(df, [column]).first())


@query(
    "standardize_clip",
    """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey,
              round(least(greatest((coalesce(l_extendedprice, m) - m) / (3 * d), -1e0), 1e0), 6)
                AS scaled FROM lineitem, s""",
)
def standardize_clip(spark, sf):
    li = load(spark, sf, "lineitem")["lineitem"]
    scaled = encode.standardize_clip(F.col("l_extendedprice"), _scale(li, "l_extendedprice"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(scaled, 6).alias("scaled")
    )


@query(
    "decode_roundtrip",
    """SELECT p_partkey, p_size::BIGINT AS size_back, round(p_retailprice, 4) AS price_back,
              p_type AS type_back FROM part""",
)
def decode_roundtrip(spark, sf):
    """Encoding then decoding gives the row back: integer, float and category column."""
    part = load(spark, sf, "part")["part"]
    size, price = _scale(part, "p_size"), _scale(part, "p_retailprice")
    types = _domain(part, "p_type")
    block = F.array(*encode.one_hot(F.col("p_type"), types))
    return part.select(
        "p_partkey",
        encode.decode_continuous(encode.standardize_clip(F.col("p_size"), size), size).alias(
            "size_back"
        ),
        F.round(
            encode.decode_continuous(
                encode.standardize_clip(F.col("p_retailprice"), price), price
            ),
            4,
        ).alias("price_back"),
        encode.decode_discrete(block, types).alias("type_back"),
    )


_HALVES = f"""a AS (SELECT * FROM events WHERE {sql_parity("event_id")} = 0),
b AS (SELECT * FROM events WHERE {sql_parity("event_id")} = 1)"""


def _halves(spark, sf):
    events = load(spark, sf, "events")["events"]
    return events.where(md5_parity("event_id") == 0), events.where(md5_parity("event_id") == 1)


@query(
    "dummies_align",
    f"""WITH {_HALVES}, shared AS (
          SELECT 'event_type' AS c, event_type AS v FROM a INTERSECT SELECT 'event_type', event_type FROM b
          UNION ALL
          (SELECT 'props' AS c, props AS v FROM a INTERSECT SELECT 'props', props FROM b))
        SELECT c || '_' || v AS feature,
               (SELECT sum(CASE WHEN (s.c = 'props' AND props = s.v) OR (s.c = 'event_type' AND event_type = s.v)
                           THEN 1e0 ELSE 0e0 END) FROM a) AS real_sum,
               (SELECT sum(CASE WHEN (s.c = 'props' AND props = s.v) OR (s.c = 'event_type' AND event_type = s.v)
                           THEN 1e0 ELSE 0e0 END) FROM b) AS synth_sum
        FROM shared s
        UNION ALL SELECT 'value', (SELECT round(sum(value), 4) FROM a), (SELECT round(sum(value), 4) FROM b)""",
)
def dummies_align(spark, sf):
    """Column sums of the aligned feature matrices of two halves of ``events``."""
    real, synth = _halves(spark, sf)
    space = features.feature_space(real, synth, KEYS, exclude=("ts",))

    def sums(df, alias):
        return space.sums(df).select("idx", F.round("total", 4).alias(alias))

    named = space.names(real).join(sums(real, "real_sum"), "idx").join(sums(synth, "synth_sum"), "idx")
    return named.select("feature", "real_sum", "synth_sum")


@query(
    "rescale_to_reference",
    f"""WITH {_HALVES}, m AS (SELECT avg(value) AS m, stddev_samp(value) + 1e-8 AS s FROM a),
             r AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM b)
        SELECT event_id, round((value - m.m) / m.s * r.s + r.m
               + r.s * 0.5e0 / 6e0 * {sql_gaussian(sql_key(42, "event_id"))}, 5) AS rescaled
        FROM a, m, r""",
)
def rescale_to_reference(spark, sf):
    mine, reference = _halves(spark, sf)
    return encode.rescale_to_reference(
        mine, "value", reference, "value", 6.0, ["event_id"], Draws(42), "rescaled"
    ).select("event_id", F.round("rescaled", 5).alias("rescaled"))


@query(
    "round_clip_int",
    """SELECT event_id, least(greatest(round_even(value, 0), 0), 100)::INT AS code FROM events""",
)
def round_clip_int(spark, sf):
    events = load(spark, sf, "events")["events"]
    return events.select("event_id", encode.round_clip_int(F.col("value"), 0, 100).alias("code"))
