"""Comparison of two versions of tables: distributions, keys, utility, privacy."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from twinloom.functions.naming import KeyNames
from twinloom.functions.values import as_double, union_all
from twinloom.operators import auc, compare, density, features, fidelity, integrity, learn, nearest
from twinloom.operators.graph import parents_of
from twinloom.plans.evaluate import evaluate
from twinloom.plans.sweep import epsilon_sweep
from twinloom.plans.discover import Discovery
from twinloom.operators.profile import sketch_columns
from twinloom.runtime import stored
from workload.base import (
    KEYS,
    PRIMARY_KEYS,
    as_number,
    load,
    md5_parity,
    query,
    sql_gaussian,
    sql_key,
    sql_parity,
)
from workload.synthesis import _CHAIN_KEYS, _CHAIN_RELS, _CHAIN_TABLES, _STAR_RELS, _synthesis

# ---------------------------------------------------------------- distributions

# Halves of all rows by a hash of the order, in words that both engines understand.
_HALF = "substr(md5(cast(l_orderkey AS string)), 1, 1) {} '8'"
_REAL, _SYNTH = _HALF.format("<"), _HALF.format(">=")


def _halves(spark, sf):
    li = load(spark, sf, "lineitem")["lineitem"]
    return li.where(_REAL), li.where(_SYNTH)


def _ks_sql(value, real=_REAL, synth=_SYNTH, table="lineitem"):
    """One scalar: the largest gap of the two distribution functions."""
    return f"""(SELECT max(abs(r / nr - s / ns)) FROM (
      SELECT sum(a) OVER (ORDER BY v) AS r, sum(b) OVER (ORDER BY v) AS s,
             sum(a) OVER () AS nr, sum(b) OVER () AS ns
      FROM (SELECT {value} AS v, count(*) FILTER ({real})::DOUBLE AS a,
                   count(*) FILTER ({synth})::DOUBLE AS b
            FROM {table} WHERE ({real} OR {synth}) AND {value} IS NOT NULL GROUP BY 1)))"""


def _js_sql(value, real=_REAL, synth=_SYNTH, table="lineitem"):
    def plogp(p):
        return f"CASE WHEN {p} > 0 THEN {p} * ln({p}) ELSE 0e0 END"

    return f"""(SELECT greatest(sum(0.5e0 * {plogp("p")} + 0.5e0 * {plogp("q")} - {plogp("((p + q) * 0.5e0)")}), 0e0)
      FROM (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q
            FROM (SELECT {value} AS v, count(*) FILTER ({real})::DOUBLE AS a,
                         count(*) FILTER ({synth})::DOUBLE AS b
                  FROM {table} WHERE ({real} OR {synth}) AND {value} IS NOT NULL GROUP BY 1)))"""


@query(
    "ks_statistic",
    f"""SELECT 'l_extendedprice' AS "column", round({_ks_sql("l_extendedprice")}, 9) AS ks
        UNION ALL SELECT 'l_quantity', round({_ks_sql("l_quantity")}, 9)
        UNION ALL SELECT 'l_shipdate', round({_ks_sql(as_number("l_shipdate", "t"))}, 9)""",
)
def ks_statistic(spark, sf):
    columns = {"lineitem": ["l_extendedprice", "l_quantity", "l_shipdate"]}
    return fidelity.ks_statistics({"lineitem": _halves(spark, sf)}, columns).select(
        "column", F.round("value", 9).alias("ks")
    )


@query(
    "js_divergence",
    f"""SELECT 'l_linestatus' AS "column", round({_js_sql("l_linestatus")}, 9) AS jsd
        UNION ALL SELECT 'l_discount', round({_js_sql("l_discount")}, 9)
        UNION ALL SELECT 'l_shipdate', round({_js_sql("l_shipdate")}, 9)
        UNION ALL SELECT 'l_returnflag', round({_js_sql("l_returnflag")}, 9)""",
)
def js_divergence(spark, sf):
    columns = {"lineitem": ["l_linestatus", "l_discount", "l_shipdate", "l_returnflag"]}
    return fidelity.js_divergences({"lineitem": _halves(spark, sf)}, columns).select(
        "column", F.round("value", 9).alias("jsd")
    )


_MARGINAL_SQL = "\nUNION ALL\n".join(
    [
        f"SELECT '{c}' AS \"column\", 'KS_{c}' AS metric, round({_ks_sql(c)}, 9) AS value"
        for c in ("l_quantity", "l_extendedprice")
    ]
    + [
        f"SELECT '{c}', 'JSD_{c}', round({_js_sql(c)}, 9)"
        for c in (
            "l_linenumber",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
            "l_shipdate",
        )
    ]
)


def _marginal(spark, sf):
    real, synth = _halves(spark, sf)
    return fidelity.marginal_fidelity({"lineitem": real}, {"lineitem": synth}, KEYS)


@query("marginal_fidelity", _MARGINAL_SQL)
def marginal_fidelity(spark, sf):
    return _marginal(spark, sf).select("column", "metric", F.round("value", 9).alias("value"))


_BINS_SQL = f"""long AS (SELECT l_extendedprice AS v, CASE WHEN {_REAL} THEN 'A' ELSE 'R' END AS f
      FROM lineitem WHERE l_extendedprice IS NOT NULL)"""


@query(
    "distribution_compare",
    f"""WITH {_BINS_SQL}, span AS (SELECT min(v) AS low, max(v) AS high, (max(v) - min(v)) / 20e0 AS w,
            count(*) FILTER (f = 'A') AS nr, count(*) FILTER (f = 'R') AS ns FROM long)
        SELECT b.bin, round(low + b.bin * w, 6) AS lo,
               count(*) FILTER (f = 'A') AS real_n, count(*) FILTER (f = 'R') AS synth_n,
               round(count(*) FILTER (f = 'A')::DOUBLE / (any_value(nr) * any_value(w)), 12) AS real_density,
               round(count(*) FILTER (f = 'R')::DOUBLE / (any_value(ns) * any_value(w)), 12) AS synth_density
        FROM span, (SELECT unnest(range(20))::INT AS bin) b
        LEFT JOIN long ON least(greatest(floor((v - low) / w), 0), 19) = b.bin
        GROUP BY b.bin, low, w""",
)
def distribution_compare(spark, sf):
    pairs = {"lineitem": _halves(spark, sf)}
    return density.histogram_compare(pairs, [("lineitem", "l_extendedprice")]).select(
        "bin",
        F.round("lo", 6).alias("lo"),
        "real_n",
        "synth_n",
        F.round("real_density", 12).alias("real_density"),
        F.round("synth_density", 12).alias("synth_density"),
    )


@query(
    "density_curve",
    f"""WITH {_BINS_SQL}, stats AS (
          SELECT f, count(*) AS n, stddev_samp(v) AS s, min(v) AS low, max(v) AS high,
                 stddev_samp(v) * pow(count(*)::DOUBLE, -0.2e0) AS bw FROM long GROUP BY f),
        fine AS (
          SELECT l.f, least(greatest(floor((v - low) / ((high - low) / 1024e0)), 0), 1023) AS bin,
                 count(*)::DOUBLE AS w, avg(v) AS mid
          FROM long l JOIN stats s ON s.f = l.f GROUP BY 1, 2),
        grid AS (
          SELECT f, n, bw, point,
                 low - 3e0 * bw + point * ((high - low + 6e0 * bw) / 199e0) AS x
          FROM stats, (SELECT unnest(generate_series(0, 199)) AS point))
        SELECT CASE g.f WHEN 'A' THEN 'real' ELSE 'synth' END AS side, point::INT AS point,
               round(any_value(x), 4) AS x,
               round(sum(w * exp(-0.5e0 * pow((x - mid) / bw, 2)))
                     / (any_value(n) * any_value(bw) * sqrt(2e0 * pi())), 12) AS density
        FROM grid g JOIN fine ON fine.f = g.f GROUP BY g.f, point""",
)
def density_curve(spark, sf):
    pairs = {"lineitem": _halves(spark, sf)}
    return density.density_curves(pairs, [("lineitem", "l_extendedprice")]).select(
        "side", "point", F.round("x", 4).alias("x"), F.round("density", 12).alias("density")
    )


# ---------------------------------------------------------------- keys

_RELS = [
    ("nation", "n_nationkey", "customer", "c_nationkey"),
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("part", "p_partkey", "lineitem", "l_partkey"),
    ("supplier", "s_suppkey", "lineitem", "l_suppkey"),
]
_REL_TABLES = ("nation", "customer", "orders", "part", "supplier", "lineitem")
# The "synthetic" side: shifted keys leave orphans, some keys are missing, rows are dropped.
_SHIFTED = {
    "customer": ("c_nationkey", "c_nationkey + 1", "c_custkey"),
    "orders": (
        "o_custkey",
        "CASE WHEN o_orderkey % 100 = 7 THEN NULL ELSE o_custkey + 30 END",
        "o_orderkey",
    ),
    "lineitem": ("l_partkey", "l_partkey + l_linenumber", "l_orderkey"),
}
_SHIFTED_SQL = ", ".join(
    f"synth_{t} AS (SELECT * REPLACE ({e} AS {c}) FROM {t} WHERE {sql_parity(k)} = 0 OR '{t}' = 'lineitem')"
    for t, (c, e, k) in _SHIFTED.items()
)


def _shifted(spark, sf):
    real = load(spark, sf, *_REL_TABLES)
    synth = dict(real)
    for t, (c, e, k) in _SHIFTED.items():
        df = real[t] if t == "lineitem" else real[t].where(md5_parity(k) == 0)
        synth[t] = df.withColumn(c, F.expr(e))
    return real, synth


def _synth_name(t):
    return f"synth_{t}" if t in _SHIFTED else t


def _rate_sql(p, pk, c, fk):
    return (
        f"(SELECT count(*)::DOUBLE FROM {c} c LEFT JOIN (SELECT DISTINCT {pk} FROM {p}) p"
        f" ON c.{fk} = p.{pk} WHERE p.{pk} IS NULL) / nullif((SELECT count(*) FROM {c}), 0)"
    )


def _mean_sql(p, pk, c, fk):
    return (
        f"(SELECT avg(n) FROM (SELECT p.{pk}, count(c.{fk}) AS n FROM {p} p"
        f" LEFT JOIN {c} c ON p.{pk} = c.{fk} GROUP BY p.{pk}))"
    )


def _rel_sql(measures):
    """One row per relationship with the given SQL measures of its two sides."""
    parts = []
    for p, pk, c, fk in _RELS:
        synth = (_synth_name(p), pk, _synth_name(c), fk)
        values = ", ".join(f"round({m((p, pk, c, fk), synth)}, 9) AS {n}" for n, m in measures.items())
        parts.append(f"SELECT '{p}' AS parent, '{c}' AS child, '{fk}' AS child_fk, {values}")
    return f"WITH {_SHIFTED_SQL} " + " UNION ALL ".join(parts)


_M_RATE = lambda real, synth: f"coalesce({_rate_sql(*synth)}, 0e0)"
_M_REAL = lambda real, synth: f"coalesce({_mean_sql(*real)}, 0e0)"
_M_SYNTH = lambda real, synth: f"coalesce({_mean_sql(*synth)}, 0e0)"
_M_RATIO = (
    lambda real, synth: f"coalesce({_mean_sql(*synth)}, 0e0) / {_mean_sql(*real)}"
)


def _rounded(df, *names):
    return df.select(
        "parent", "child", "child_fk", *[F.round(s, 9).alias(d) for s, d in names]
    )


@query("fk_violation_rate", _rel_sql({"rate": _M_RATE}))
def fk_violation_rate(spark, sf):
    _, synth = _shifted(spark, sf)
    return _rounded(integrity.link_report(synth, _RELS), ("fk_violation_rate", "rate"))


@query("avg_cardinality", _rel_sql({"mean_children": _M_SYNTH}))
def avg_cardinality(spark, sf):
    _, synth = _shifted(spark, sf)
    return _rounded(integrity.link_report(synth, _RELS), ("avg_cardinality", "mean_children"))


@query("cardinality_ratio", _rel_sql({"ratio": _M_RATIO}))
def cardinality_ratio(spark, sf):
    real, synth = _shifted(spark, sf)
    return _rounded(
        integrity.relational_integrity(real, synth, _RELS), ("cardinality_ratio", "ratio")
    )


_INTEGRITY_SQL = _rel_sql(
    {"rate": _M_RATE, "real_mean": _M_REAL, "synth_mean": _M_SYNTH, "ratio": _M_RATIO}
)


@query("relational_integrity", _INTEGRITY_SQL)
def relational_integrity(spark, sf):
    real, synth = _shifted(spark, sf)
    return _rounded(
        integrity.relational_integrity(real, synth, _RELS),
        ("fk_violation_rate", "rate"),
        ("real_cardinality", "real_mean"),
        ("synth_cardinality", "synth_mean"),
        ("cardinality_ratio", "ratio"),
    )


@query(
    "quality_summary",
    f"""WITH rel AS ({_INTEGRITY_SQL}), mar AS ({_MARGINAL_SQL})
        SELECT round((SELECT avg(rate) FROM rel), 6) AS average_fk_violation_rate,
               round((SELECT avg(abs(1e0 - ratio)) FROM rel), 6) AS average_cardinality_error,
               round((SELECT avg(value) FROM mar WHERE metric LIKE 'KS%'), 6) AS average_ks_score""",
)
def quality_summary(spark, sf):
    real, synth = _shifted(spark, sf)
    links = compare.long_links(integrity.relational_integrity(real, synth, _RELS))
    metrics = links.select("metric", "value").unionByName(
        _marginal(spark, sf).select("metric", "value")
    )
    names = ("average_fk_violation_rate", "average_cardinality_error", "average_ks_score")
    return compare.quality_summary(metrics).select(*[F.round(n, 6).alias(n) for n in names])


# ---------------------------------------------------------------- learning

_HIT = "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END"
_GUESS = "CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END"


def _auc_sql(score, hit, table="lineitem", where="true"):
    return f"""(SELECT (sum(CASE WHEN y = 1 THEN r ELSE 0e0 END) - sum(y)::DOUBLE * (sum(y) + 1) / 2e0)
        / nullif(sum(y)::DOUBLE * (count(*) - sum(y)), 0)
      FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS r
            FROM (SELECT {score} AS s, {hit} AS y FROM {table} WHERE {where})))"""


@query(
    "accuracy",
    f"SELECT round(avg(CASE WHEN ({_GUESS}) = l_linestatus THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM lineitem",
)
def accuracy(spark, sf):
    li = load(spark, sf, "lineitem")["lineitem"].withColumn("guess", F.expr(_GUESS))
    return auc.accuracy(li, "l_linestatus", "guess").select(F.round("accuracy", 9).alias("accuracy"))


@query(
    "auc_binary",
    f"""SELECT 'l_extendedprice' AS score, round({_auc_sql("l_extendedprice", _HIT)}, 9) AS auc
        UNION ALL SELECT 'l_quantity', round({_auc_sql("l_quantity", _HIT)}, 9)""",
)
def auc_binary(spark, sf):
    li = load(spark, sf, "lineitem")["lineitem"].withColumn("hit", F.expr(_HIT))
    return union_all(
        [
            auc.auc_binary(li, s, "hit").select(
                F.lit(s).alias("score"), F.round("auc", 9).alias("auc")
            )
            for s in ("l_extendedprice", "l_quantity")
        ]
    )


_CLASS_SCORES = ("l_quantity", "l_discount", "l_extendedprice")
_CLASSES = ("A", "N", "R")


@query(
    "auc_ovr",
    "SELECT round(("
    + " + ".join(
        _auc_sql(s, f"CASE WHEN l_returnflag = '{c}' THEN 1 ELSE 0 END")
        for s, c in zip(_CLASS_SCORES, _CLASSES)
    )
    + ") / 3e0, 9) AS auc",
)
def auc_ovr(spark, sf):
    li = load(spark, sf, "lineitem")["lineitem"].withColumn(
        "cls", F.array_position(F.array(*[F.lit(c) for c in _CLASSES]), F.col("l_returnflag")) - 1
    )
    return auc.auc_one_vs_rest(li, list(_CLASS_SCORES), "cls").select(F.round("auc", 9).alias("auc"))


def _order_halves(spark, sf):
    orders = load(spark, sf, "orders")["orders"]
    return orders.where(md5_parity("o_orderkey") == 0), orders.where(md5_parity("o_orderkey") == 1)


@query(
    "tstr_features",
    f"""SELECT o_orderkey, epoch(o_orderdate)::DOUBLE AS o_orderdate,
          CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END AS "o_orderstatus_F",
          CASE WHEN o_orderstatus = 'O' THEN 1e0 ELSE 0e0 END AS "o_orderstatus_O",
          CASE WHEN o_orderstatus = 'P' THEN 1e0 ELSE 0e0 END AS "o_orderstatus_P",
          o_totalprice, {sql_parity("o_orderkey")} = 0 AS is_real FROM orders""",
)
def tstr_features(spark, sf):
    """Features of both sides, aligned by the real side's columns and categories."""
    real, synth = _order_halves(spark, sf)
    space = features.feature_space(real, synth, KEYS, ("o_orderpriority",))
    names = [r.feature for r in space.names(real).orderBy("idx").collect()]  # three states and two numbers
    value = vector_to_array("features")

    def rows(df, is_real):
        vectors = space.vectors(df, F.col("o_orderkey"))
        columns = [F.get(value, F.lit(i)).alias(n) for i, n in enumerate(names)]
        return vectors.select("o_orderkey", *columns, F.lit(is_real).alias("is_real"))

    return rows(real, True).unionByName(rows(synth, False))


@query(
    "label_index",
    "SELECT o_orderpriority AS label, row_number() OVER (ORDER BY o_orderpriority) - 1 AS idx"
    " FROM (SELECT DISTINCT o_orderpriority FROM orders)",
)
def label_index(spark, sf):
    return features.label_index(*_order_halves(spark, sf), "o_orderpriority")


@query(
    "stratified_split",
    f"""SELECT o_orderkey, rn <= round(0.3e0 * n) AS is_test FROM (
          SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS n,
                 row_number() OVER (PARTITION BY o_orderpriority
                   ORDER BY md5({sql_key(42, "o_orderkey")}), o_orderkey) AS rn FROM orders)""",
)
def stratified_split(spark, sf):
    orders = load(spark, sf, "orders")["orders"].select("o_orderkey", "o_orderpriority")
    return features.stratified_split(orders, "o_orderpriority", ["o_orderkey"]).select(
        "o_orderkey", "is_test"
    )


@query("tstr")
def tstr(spark, sf):
    """Forest trained on one half of ``orders``, tested on 30 % of the other."""
    real, synth = _order_halves(spark, sf)
    return learn.tstr(real, synth, "o_orderstatus", ["o_orderkey"], KEYS)


# ---------------------------------------------------------------- nearest records


def _balances(spark, sf):
    t = load(spark, sf, "supplier", "customer")
    real = t["supplier"].select("s_suppkey", F.array("s_acctbal", F.col("s_nationkey").cast("double")).alias("x"))
    synth = t["customer"].select(F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("x"))
    return real, synth


_GAP = "sqrt((q.a - c_acctbal) * (q.a - c_acctbal) + (q.b - c_nationkey) * (q.b - c_nationkey))"


@query(
    "dcr",
    f"""WITH q AS (SELECT s_acctbal AS a, s_nationkey::DOUBLE AS b, count(*) AS n FROM supplier GROUP BY 1, 2)
        SELECT a AS acctbal, b AS nationkey, n, round((SELECT min({_GAP}) FROM customer), 6) AS dist FROM q""",
)
def dcr(spark, sf):
    real, synth = _balances(spark, sf)
    return nearest.nearest_distance(real, synth).select(
        F.col("x")[0].alias("acctbal"),
        F.col("x")[1].alias("nationkey"),
        "n",
        F.round("dist", 6).alias("dist"),
    )


@query(
    "dcr_summary",
    f"""WITH q AS (SELECT (SELECT min({_GAP}) FROM customer) AS dist
                   FROM (SELECT s_acctbal AS a, s_nationkey::DOUBLE AS b FROM supplier) q)
        SELECT round(avg(dist), 6) AS mean_dcr, round(min(dist), 6) AS min_dcr FROM q""",
)
def dcr_summary(spark, sf):
    real, synth = _balances(spark, sf)
    return nearest.dcr_summary(nearest.nearest_distance(real, synth)).select(
        F.round("mean_dcr", 6).alias("mean_dcr"), F.round("min_dcr", 6).alias("min_dcr")
    )


@query(
    "dcr_vectors",
    """SELECT round(a.embedding[1]::DOUBLE, 6) AS first_value,
              round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS dist
       FROM embeddings a, embeddings b WHERE a.label % 2 = 0 AND b.label % 2 = 1
       GROUP BY a.vec_id, a.embedding""",
)
def dcr_vectors(spark, sf):
    vectors = load(spark, sf, "embeddings")["embeddings"].select(
        "label", F.col("embedding").cast("array<double>").alias("x")
    )
    return nearest.nearest_distance(
        vectors.where("label % 2 = 0"), vectors.where("label % 2 = 1")
    ).select(
        F.round(F.col("x")[0], 6).alias("first_value"), F.round("dist", 6).alias("dist")
    )


@query(
    "dcr_cells",
    f"""WITH q AS (SELECT DISTINCT o_totalprice AS a, epoch(o_orderdate) / 86400e0 AS b FROM orders
                   WHERE {sql_parity("o_orderkey")} = 0),
             p AS (SELECT DISTINCT o_totalprice AS a, epoch(o_orderdate) / 86400e0 AS b FROM orders
                   WHERE {sql_parity("o_orderkey")} = 1)
        SELECT q.a AS price, q.b AS day, round(min(sqrt((q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b))), 6) AS dist
        FROM q, p GROUP BY q.a, q.b""",
)
def dcr_cells(spark, sf):
    """The search for point sets too large to broadcast, on whole ``orders``."""

    def points(df):
        day = as_double(F.col("o_orderdate"), df.schema["o_orderdate"].dataType) / 86400.0
        return df.select(F.array("o_totalprice", day).alias("x"))

    real, synth = _order_halves(spark, sf)
    return nearest.nearest_distance(points(real), points(synth), broadcast_points=1000).select(
        F.col("x")[0].alias("price"), F.col("x")[1].alias("day"), F.round("dist", 6).alias("dist")
    )


_ATTACK_FEATURES = {"acctbal": "s_acctbal", "nationkey": "s_nationkey"}


def _attack(spark, sf):
    t = load(spark, sf, "supplier", "customer")
    real = t["supplier"].select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nationkey"))
    synth = t["customer"].select(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").cast("double").alias("nationkey"))
    columns = {"acctbal": F.col("acctbal"), "nationkey": F.col("nationkey")}
    return learn.attack_distances(real, synth, columns, ["s_suppkey"])


def _noisy(name, column):
    return f"{column} + {sql_gaussian(sql_key(42, repr(name), 's_suppkey'))}"


@query(
    "mia_distance_auc",
    f"""WITH q AS (SELECT 1 AS member, s_acctbal AS a, s_nationkey::DOUBLE AS b FROM supplier
                   UNION ALL SELECT 0, {_noisy("acctbal", "s_acctbal")}, {_noisy("nationkey", "s_nationkey")} FROM supplier),
             d AS (SELECT member, (SELECT min({_GAP}) FROM customer) AS dist FROM q)
        SELECT round({_auc_sql("-dist", "member", "d")}, 6) AS auc""",
)
def mia_distance_auc(spark, sf):
    scored = _attack(spark, sf).withColumn("score", -F.col("dist"))
    return learn.weighted_auc(scored, "score", "member", "n").select(F.round("auc", 6).alias("auc"))


@query("mia_forest")
def mia_forest(spark, sf):
    return learn.attack_auc(_attack(spark, sf))


# ---------------------------------------------------------------- runs

# Two runs: the quarters of the real half, each against the other half.
_QUARTER = _REAL + " AND substr(md5(cast(l_orderkey AS string)), 2, 1) {} '8'"
_RUNS = {"a": _QUARTER.format("<"), "b": _QUARTER.format(">=")}


def _run_sql(where):
    return (
        f"SELECT 'avg_ks' AS metric, ({_ks_sql('l_quantity', where, _SYNTH)} +"
        f" {_ks_sql('l_extendedprice', where, _SYNTH)}) / 2e0 AS v"
        f" UNION ALL SELECT 'tstr_acc_pct', (SELECT avg(CASE WHEN ({_GUESS}) = l_linestatus"
        f" THEN 1e0 ELSE 0e0 END) * 100e0 FROM lineitem WHERE {where})"
        f" UNION ALL SELECT 'tstr_auc', {_auc_sql('l_extendedprice', _HIT, where=where)}"
    )


def _run(li, where):
    """The three headline metrics of a part of ``lineitem``."""
    mine = li.where(where).withColumn("guess", F.expr(_GUESS)).withColumn("hit", F.expr(_HIT))
    ks = fidelity.ks_statistics(
        {"lineitem": (mine, li.where(_SYNTH))}, {"lineitem": ["l_quantity", "l_extendedprice"]}
    ).agg(F.avg("value").alias("value"))
    right = auc.accuracy(mine, "l_linestatus", "guess").select(
        (F.col("accuracy") * 100.0).alias("value")
    )
    area = auc.auc_binary(mine, "l_extendedprice", "hit").select(F.col("auc").alias("value"))
    return union_all(
        [
            df.select(F.lit(m).alias("metric"), "value")
            for m, df in (("avg_ks", ks), ("tstr_acc_pct", right), ("tstr_auc", area))
        ]
    )


@query(
    "compare_runs",
    f"""WITH a AS ({_run_sql(_RUNS["a"])}), b AS ({_run_sql(_RUNS["b"])}),
             l(metric, lim) AS (VALUES ('avg_ks', 0.05e0), ('tstr_acc_pct', 1e0), ('tstr_auc', 0.01e0))
        SELECT l.metric, round(a.v, 6) AS a, round(b.v, 6) AS b, round(abs(b.v - a.v), 6) AS diff,
               abs(b.v - a.v) > lim AS differs
        FROM l JOIN a ON a.metric = l.metric JOIN b ON b.metric = l.metric""",
)
def compare_runs(spark, sf):
    li = load(spark, sf, "lineitem")["lineitem"]
    return compare.compare_runs(_run(li, _RUNS["a"]), _run(li, _RUNS["b"])).select(
        "metric",
        F.round("a", 6).alias("a"),
        F.round("b", 6).alias("b"),
        F.round("diff", 6).alias("diff"),
        "differs",
    )


@query(
    "runs_differ",
    f"""WITH a AS ({_run_sql(_RUNS["a"])}), b AS ({_run_sql(_RUNS["b"])}),
             l(metric, lim) AS (VALUES ('avg_ks', 0.05e0), ('tstr_acc_pct', 1e0), ('tstr_auc', 0.01e0))
        SELECT coalesce(bool_or(abs(b.v - a.v) > lim), false) AS differs
        FROM l JOIN a ON a.metric = l.metric JOIN b ON b.metric = l.metric""",
)
def runs_differ(spark, sf):
    """Whether two runs differ in any metric by more than its tolerance."""
    li = load(spark, sf, "lineitem")["lineitem"]
    return compare.runs_differ(compare.compare_runs(_run(li, _RUNS["a"]), _run(li, _RUNS["b"])))


_EXPECTED = {"avg_ks": 0.274, "tstr_acc_pct": 50.0, "tstr_auc": 0.509, "cardinality_error": 0.0}


@query(
    "match_expected",
    f"""WITH a AS ({_run_sql(_REAL)}),
             e(metric, expected) AS (VALUES {", ".join(f"('{m}', {v}::DOUBLE)" for m, v in _EXPECTED.items())})
        SELECT e.metric, round(a.v, 6) AS value, expected, coalesce(abs(a.v - expected) < 0.02e0, false) AS matches
        FROM e LEFT JOIN a ON a.metric = e.metric""",
)
def match_expected(spark, sf):
    """Measured metrics against recorded ones; a metric that was not measured does not match."""
    li = load(spark, sf, "lineitem")["lineitem"]
    return compare.match_expected(_run(li, _REAL), _EXPECTED).select(
        "metric", F.round("value", 6).alias("value"), "expected", "matches"
    )


@query("evaluate_all")
def evaluate_all(spark, sf):
    """All metrics of the synthetic star schema."""
    real, made = _synthesis(spark, sf)
    return evaluate(real, stored(made.tables), _STAR_RELS, _CHAIN_KEYS, KEYS)


@query("epsilon_sweep")
def sweep(spark, sf):
    """Synthesis and evaluation at budgets 2 and 20 (without the runtime column)."""
    tables = load(spark, sf, *_CHAIN_TABLES)
    schema_def = parents_of(_CHAIN_RELS, list(_CHAIN_TABLES))
    found = Discovery(
        _CHAIN_KEYS, _CHAIN_RELS, [], schema_def, list(_CHAIN_TABLES), sketch_columns(tables), []
    )
    return epsilon_sweep(tables, [2.0, 20.0], KEYS, found, secret_noise=False).drop("runtime_sec")
