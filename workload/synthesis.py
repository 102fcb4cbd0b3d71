"""Noisy marginals, sampled rows and synthetic tables; writing them out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.functions.hashing import TRIES, Draws
from twinloom.functions.values import union_all
from twinloom.operators import ledger, marginals, sampling
from twinloom.operators.graph import parents_of
from twinloom.operators.integrity import link_report
from twinloom.operators.marginals import MISSING, Domain
from twinloom.operators.profile import category_domain, row_counts
from twinloom.operators.ranges import dense_index
from twinloom.plans.synthesize import synthesize
from twinloom.runtime import pinned, scratch_folder, small_frame
from twinloom.sources.tables import (
    load_tables,
    preview,
    publish_tables,
    published_tables,
    read_csv_bundle,
    save_tables,
    write_csv_bundle,
)
from workload.base import PRIMARY_KEYS, load, query, sql_geometric, sql_key, sql_uniform, stream_of

_DRAWS = Draws(42).for_table("lineitem")
_SEED = _DRAWS.stream
_EPS = 1.0


def _flag_chain(li, *columns):
    return [
        (c, Domain("category", tuple(r.value for r in category_domain(li, c).collect())))
        for c in columns
    ]


_FLAGS = f"(SELECT DISTINCT l_returnflag AS v FROM lineitem UNION ALL SELECT '{MISSING}')"
_STATES = f"(SELECT DISTINCT l_linestatus AS v FROM lineitem UNION ALL SELECT '{MISSING}')"


def _noisy_sql(scale):
    """Noisy chain l_returnflag -> l_linestatus with two histograms at ``scale``."""
    noise = sql_geometric(scale, sql_key(_SEED, "link", "given", "cell"))
    return f"""counts AS (
      SELECT 0 AS link, '' AS given, f.v AS cell,
             (SELECT count(*) FROM lineitem WHERE coalesce(l_returnflag, '{MISSING}') = f.v) AS n
      FROM {_FLAGS} f
      UNION ALL
      SELECT 1, f.v, s.v,
             (SELECT count(*) FROM lineitem WHERE coalesce(l_returnflag, '{MISSING}') = f.v
                AND coalesce(l_linestatus, '{MISSING}') = s.v)
      FROM {_FLAGS} f, {_STATES} s),
    noisy AS (SELECT *, greatest(n + {noise}, 0e0) AS noisy FROM counts)"""


@query(
    "noisy_histogram",
    f"""WITH {_noisy_sql("1e0")} SELECT cell, n, round(noisy, 6) AS noisy,
          round(noisy / (SELECT sum(noisy) FROM noisy WHERE link = 0), 9) AS share
        FROM noisy WHERE link = 0""",
)
def noisy_histogram(spark, sf):
    li = load(spark, sf, "lineitem")["lineitem"]
    ((column, domain),) = _flag_chain(li, "l_returnflag")
    return marginals.noisy_histogram(li, column, domain, _EPS, _DRAWS).select(
        "cell", "n", F.round("noisy", 6).alias("noisy"), F.round("share", 9).alias("share")
    )


@query(
    "noisy_pairs",
    f"""WITH {_noisy_sql("2e0")} SELECT link, given, cell, n, round(noisy, 6) AS noisy FROM noisy""",
)
def noisy_pairs(spark, sf):
    li = load(spark, sf, "lineitem")["lineitem"]
    chain = _flag_chain(li, "l_returnflag", "l_linestatus")
    return marginals.noisy_chain(li, chain, _EPS, _DRAWS).select(
        "link", "given", "cell", "n", F.round("noisy", 6).alias("noisy")
    )


_TREE_COLUMNS = ("l_returnflag", "l_linestatus", "l_linenumber")


def _tree_sql():
    """Noisy counts of all pairs, their information, the two best pairs, and the noisy counts of that tree."""
    label = {c: f"coalesce({c}::VARCHAR, '{MISSING}')" for c in _TREE_COLUMNS}
    lists = {c: f"(SELECT DISTINCT {c}::VARCHAR AS v FROM lineitem WHERE {c} IS NOT NULL UNION ALL SELECT '{MISSING}')" for c in _TREE_COLUMNS}

    def counted(given, cell):
        if given is None:
            return f"""SELECT '' AS given, f.v AS cell, (SELECT count(*) FROM lineitem WHERE {label[cell]} = f.v) AS n
                       FROM {lists[cell]} f"""
        return f"""SELECT f.v AS given, s.v AS cell, coalesce(c.n, 0) AS n FROM {lists[given]} f CROSS JOIN {lists[cell]} s
                   LEFT JOIN (SELECT {label[given]} AS g, {label[cell]} AS e, count(*) AS n FROM lineitem GROUP BY 1, 2) c
                   ON c.g = f.v AND c.e = s.v"""

    pairs = [(0, 1), (0, 2), (1, 2)]
    first, all_pairs = len(_TREE_COLUMNS), " UNION ALL ".join(
        f"SELECT {3 + i} AS link, {a} AS a, {b} AS b, * FROM ({counted(_TREE_COLUMNS[a], _TREE_COLUMNS[b])})"
        for i, (a, b) in enumerate(pairs)
    )
    key = sql_key(_SEED, "link", "given", "cell")
    # the tree as links (parent, child) by which pair is left out
    trees = {(1, 2): [(None, 0), (0, 1), (0, 2)], (0, 2): [(None, 0), (0, 1), (1, 2)], (0, 1): [(None, 0), (0, 2), (2, 1)]}
    name = lambda i: None if i is None else _TREE_COLUMNS[i]
    edges = " UNION ALL ".join(
        f"SELECT {a} AS a, {b} AS b, {k} AS link, '{name(p) or ''}' AS parent, '{name(c)}' AS child, * FROM ({counted(name(p), name(c))})"
        for (a, b), links in trees.items()
        for k, (p, c) in enumerate(links)
    )
    return f"""
    pairs AS ({all_pairs}),
    chosen AS (SELECT *, greatest(n + {sql_geometric(f"{first / 0.5}e0", key)}, 0e0) AS noisy FROM pairs),
    p AS (SELECT a, b, given, cell, noisy / sum(noisy) OVER (PARTITION BY link) AS p FROM chosen WHERE noisy > {3 * first / 0.5}e0),
    m AS (SELECT a, b, p * ln(p / (sum(p) OVER (PARTITION BY a, b, given) * sum(p) OVER (PARTITION BY a, b, cell))) AS gain FROM p),
    i AS (SELECT a, b, sum(gain) AS information FROM m GROUP BY a, b),
    out AS (SELECT a, b FROM i ORDER BY information, a DESC, b DESC LIMIT 1),
    edges AS ({edges})
    SELECT link, parent, child, given, cell, n, round(greatest(n + {sql_geometric(f"{first / 1.0}e0", key)}, 0e0), 6) AS noisy
    FROM edges JOIN out USING (a, b)"""


@query("tree_pairs", f"WITH {_tree_sql()}")
def tree_pairs(spark, sf):
    """A tree over three columns, chosen for half a unit of budget and released for one."""
    li = load(spark, sf, "lineitem")["lineitem"]
    chain = _flag_chain(li, "l_returnflag", "l_linestatus")
    numbers = [str(r.value) for r in category_domain(li, "l_linenumber").collect()]
    chain.append(("l_linenumber", Domain("category", tuple(numbers))))
    found = marginals.noisy_dependence(li, chain, 0.5, _DRAWS).collect()
    tree = marginals.spanning_tree(3, [(r.given_column, r.cell_column, r.information) for r in found])
    ordered, parents = marginals.in_order(chain, tree)
    names = [(i, ordered[p][0] if p >= 0 else "", c) for i, ((c, _), p) in enumerate(zip(ordered, parents))]
    edges = F.broadcast(small_frame(spark, names, "link int, parent string, child string"))  # a row per column
    noisy = marginals.noisy_chain(li, ordered, _EPS, _DRAWS, links=marginals.links_of(parents))
    return noisy.join(edges, "link").select(
        "link", "parent", "child", "given", "cell", "n", F.round("noisy", 6).alias("noisy")
    )


@query(
    "stable_histogram",
    f"""WITH counts AS (SELECT coalesce(p_name, '{MISSING}') AS cell, count(*) AS n FROM part GROUP BY 1),
        noisy AS (SELECT cell, n, (n + {sql_geometric("1e0", sql_key(stream_of("part"), "0", "''", "cell"))})::DOUBLE
                  AS noisy FROM counts),
        kept AS (SELECT * FROM noisy WHERE noisy >= 1e0 + ln(1e0 / 1e-6))
        SELECT cell, n, round(noisy, 6) AS noisy,
               round(noisy / (SELECT sum(noisy) FROM kept), 9) AS share FROM kept""",
)
def stable_histogram(spark, sf):
    """Categories without a declared list: rare ones are withheld."""
    part = load(spark, sf, "part")["part"]
    return marginals.noisy_histogram(
        part, "p_name", Domain("category"), 1.0, Draws(42).for_table("part")
    ).select("cell", "n", F.round("noisy", 6).alias("noisy"), F.round("share", 9).alias("share"))


def _gaussian_sql(variance: float, *key: str) -> str:
    """The discrete Gaussian draw, as DuckDB computes it."""
    width = int(variance**0.5) + 1
    number = sql_geometric(f"{width}e0", sql_key(_SEED, *key, "'try'", "t"))
    accept = sql_uniform(sql_key(_SEED, *key, "'accept'", "t"))
    gap = f"(abs(x) - {variance / width!r}::DOUBLE)"
    tried = f"list_transform(range({TRIES}), lambda t: struct_pack(x := {number}, u := {accept}))"
    ok = f"a.u < exp(-({gap.replace('x)', 'a.x)')} * {gap.replace('x)', 'a.x)')}) / {2 * variance!r}::DOUBLE)"
    return f"coalesce(list_filter({tried}, lambda a: {ok})[1].x, 0)"


_RHO = ledger.rho_of(_EPS, marginals.DELTA)


@query(
    "gaussian_histogram",
    f"""WITH counts AS (
          SELECT 0 AS link, '' AS given, f.v AS cell,
                 (SELECT count(*) FROM lineitem WHERE coalesce(l_returnflag, '{MISSING}') = f.v) AS n FROM {_FLAGS} f)
        SELECT cell, n, round(greatest(n + {_gaussian_sql(1 / (2 * _RHO), "link", "given", "cell")}, 0)::DOUBLE, 6) AS noisy FROM counts""",
)
def gaussian_histogram(spark, sf):
    """Discrete Gaussian noise whose rho is what (1, 1e-6) allows."""
    li = load(spark, sf, "lineitem")["lineitem"]
    chain = _flag_chain(li, "l_returnflag")
    noisy = marginals.noisy_chain(li, chain, _EPS, _DRAWS, mechanism="gaussian")
    return noisy.select("cell", "n", F.round("noisy", 6).alias("noisy"))


def _conditionals_sql():
    return f"""{_noisy_sql("2e0")},
    kept AS (SELECT * FROM noisy WHERE cell <> '{MISSING}' AND given <> '{MISSING}' AND noisy > 0),
    cumulative AS (
      SELECT link, given, cell,
             sum(noisy) OVER (PARTITION BY link, given ORDER BY cell) / sum(noisy) OVER (PARTITION BY link, given) AS hi,
             lead(cell) OVER (PARTITION BY link, given ORDER BY cell) IS NULL AS is_last
      FROM kept),
    bounds AS (
      SELECT link, given, cell, CASE WHEN is_last THEN 1e0 ELSE hi END AS hi,
             coalesce(lag(hi) OVER (PARTITION BY link, given ORDER BY cell), 0e0) AS lo
      FROM cumulative)"""


@query(
    "sample_rows",
    f"""WITH {_conditionals_sql()},
        ids AS (SELECT unnest(generate_series(1, (SELECT count(*) FROM lineitem))) AS id),
        draws AS (SELECT id, {sql_uniform(sql_key(_SEED, "'cell0'", "id"))} AS u0,
                         {sql_uniform(sql_key(_SEED, "'cell1'", "id"))} AS u1 FROM ids)
        SELECT d.id, f.cell AS returnflag, s.cell AS linestatus
        FROM draws d
        JOIN bounds f ON f.link = 0 AND d.u0 >= f.lo AND d.u0 < f.hi
        JOIN bounds s ON s.link = 1 AND s.given = f.cell AND d.u1 >= s.lo AND d.u1 < s.hi""",
)
def sample_rows(spark, sf):
    li = load(spark, sf, "lineitem")["lineitem"]
    chain = _flag_chain(li, "l_returnflag", "l_linestatus")
    noisy = pinned(marginals.noisy_chain(li, chain, _EPS, _DRAWS))
    cells = pinned(marginals.conditionals(noisy))
    return sampling.sample_chain(
        spark, cells, len(chain), li.count(), _DRAWS, "id"
    ).select("id", F.col("_c0").alias("returnflag"), F.col("_c1").alias("linestatus"))


@query(
    "surrogate_keys",
    """SELECT i AS o_orderkey, 'Customer_' || i AS c_code
       FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM orders))) AS i)""",
)
def surrogate_keys(spark, sf):
    orders = load(spark, sf, "orders")["orders"]
    return sampling.row_ids(spark, orders.count()).select(
        sampling.surrogate_key("Orders", orders.schema["o_orderkey"].dataType, F.col("id")).alias(
            "o_orderkey"
        ),
        sampling.surrogate_key("Customer", T.StringType(), F.col("id")).alias(
            "c_code"
        ),
    )


_DENSE = """dense AS (
  SELECT c_custkey, row_number() OVER (
           ORDER BY ('0x' || substr(md5(c_custkey::VARCHAR), 1, 3))::INT, c_custkey) - 1 AS idx
  FROM (SELECT DISTINCT c_custkey FROM customer))"""


@query("dense_index", f"WITH {_DENSE} SELECT c_custkey, idx FROM dense")
def dense_index_query(spark, sf):
    return dense_index(load(spark, sf, "customer")["customer"], "c_custkey")


@query(
    "assign_fk",
    f"""WITH {_DENSE}, n AS (SELECT count(*) AS n FROM dense)
        SELECT o_orderkey, c_custkey AS o_custkey FROM orders, n, dense
        WHERE dense.idx = floor({sql_uniform(sql_key(42, "'fk.o_custkey'", "o_orderkey"))} * n.n)::BIGINT""",
)
def assign_fk(spark, sf):
    t = load(spark, sf, "orders", "customer")
    return sampling.assign_foreign_key(
        t["orders"].select("o_orderkey"), "o_custkey", t["customer"], "c_custkey", Draws(42), "o_orderkey"
    )


@query(
    "propagate_fk",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_custkey AS l_custkey
       FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey""",
)
def propagate_fk(spark, sf):
    t = load(spark, sf, "lineitem", "orders")
    li = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey")
    return sampling.propagate_key(
        li, "l_orderkey", t["orders"], "o_orderkey", "o_custkey", "l_custkey"
    )


_CHAIN_TABLES = ("customer", "orders", "lineitem")
_CHAIN_RELS = [
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
]
# The star schema; lineitem has no key of one column.
_STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_STAR_RELS = [
    ("region", "r_regionkey", "nation", "n_regionkey"),
    ("nation", "n_nationkey", "customer", "c_nationkey"),
    ("nation", "n_nationkey", "supplier", "s_nationkey"),
    *_CHAIN_RELS,
    ("part", "p_partkey", "lineitem", "l_partkey"),
    ("supplier", "s_suppkey", "lineitem", "l_suppkey"),
    ("customer", "c_custkey", "events", "user_id"),
]
_CHAIN_KEYS = {t: k for t, k in PRIMARY_KEYS.items() if t != "lineitem"}


def _synthesis(spark, sf):
    tables = load(spark, sf, *_STAR_TABLES)
    counts = {r["table"]: r.n for r in row_counts(tables).collect()}
    return tables, synthesize(
        tables,
        parents_of(_STAR_RELS, list(_STAR_TABLES)),
        {t: _CHAIN_KEYS[t] for t in _STAR_TABLES if t in _CHAIN_KEYS},
        _STAR_RELS,
        num_rows=0,
        epsilon=6.0,
        table_row_counts=counts,
        secret_noise=False,
    )


@query(
    "synthesize_tables",
    " UNION ALL ".join(
        f"SELECT '{p}' AS parent, '{c}' AS child, '{fk}' AS fk, (SELECT count(*) FROM {c}) AS n_rows,"
        " 0::BIGINT AS orphans, true AS same_schema"
        for p, _, c, fk in _STAR_RELS
    ),
)
def synthesize_tables(spark, sf):
    """Rows, orphans and column types of the whole star schema, by link."""
    tables, made = _synthesis(spark, sf)
    same = all(
        [(f.name, f.dataType) for f in tables[t].schema.fields]
        == [(f.name, f.dataType) for f in made.tables[t].schema.fields]
        for t in tables
    )
    return link_report(made.tables, _STAR_RELS).select(
        "parent", "child", F.col("child_fk").alias("fk"), F.col("children").alias("n_rows"), "orphans", F.lit(same).alias("same_schema")
    )


@query("synthetic_lineitem")
def synthetic_lineitem(spark, sf):
    return _synthesis(spark, sf)[1].tables["lineitem"]


@query(
    "synthetic_text",
    f"""WITH counts AS (SELECT p_name AS value, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1),
        noisy AS (SELECT value, n + {sql_geometric("2e0", sql_key(stream_of("part"), "0", "''", "value"))} AS noisy
                  FROM counts)
        SELECT value, noisy >= 1e0 + 2e0 * ln(1e0 / 1e-6) AS released FROM noisy""",
)
def synthetic_text(spark, sf):
    """Which real texts of a column without a declared list come out of a synthesis."""
    real = load(spark, sf, "part")["part"].select("p_partkey", "p_name")
    made = synthesize(
        {"part": real}, {"part": []}, {"part": "p_partkey"}, [], 20 * real.count(), 0.5, secret_noise=False
    ).tables["part"]
    out = made.select(F.col("p_name").alias("value")).distinct().withColumn("released", F.lit(True))
    values = real.where(F.col("p_name").isNotNull()).select(F.col("p_name").alias("value")).distinct()
    return values.join(out, "value", "left").select("value", F.coalesce("released", F.lit(False)).alias("released"))


@query(
    "mechanism_ledger",
    f"""WITH columns AS (SELECT table_name AS t, column_name AS c FROM duckdb_columns()
          WHERE (table_name, column_name) NOT IN ({", ".join(f"('{c}', '{fk}')" for _, _, c, fk in _STAR_RELS)})
            AND (table_name, column_name) NOT IN ({", ".join(f"('{t}', '{_CHAIN_KEYS[t]}')" for t in _STAR_TABLES if t in _CHAIN_KEYS)})
            AND table_name IN ({", ".join(f"'{t}'" for t in _STAR_TABLES)}))
        SELECT t AS "table", count(*) AS mechanisms, round(sum(6e0 / n), 9) AS spent, true AS within
        FROM (SELECT t, count(*) OVER (PARTITION BY t) AS n FROM columns) GROUP BY t""",
)
def mechanism_ledger(spark, sf):
    """Mechanisms and spending of the synthesis of the star schema, against each table's budget."""
    return ledger.mechanism_summary(_synthesis(spark, sf)[1].ledger).select(
        "table", "mechanisms", F.round("spent", 9).alias("spent"), "within"
    )


# ---------------------------------------------------------------- output


@query(
    "write_read_csv",
    """SELECT 'customer' AS "table", count(*) AS n_rows, round(sum(c_acctbal), 2) AS checksum FROM customer
       UNION ALL SELECT 'orders', count(*), round(sum(o_totalprice), 2) FROM orders
       UNION ALL SELECT 'documents', count(*), sum(length(text))::DOUBLE FROM documents""",
)
def write_read_csv(spark, sf):
    """Write a CSV bundle, read it back with the tables' types, count and sum."""
    tables = load(spark, sf, "customer", "orders", "documents")
    folder = scratch_folder(spark)
    manifest = write_csv_bundle(tables, folder, {t: "copied" for t in tables})
    measures = {
        "customer": F.sum("c_acctbal"),
        "orders": F.sum("o_totalprice"),
        "documents": F.sum(F.length("text")).cast("double"),
    }
    out = None
    for t, measure in measures.items():
        part = read_csv_bundle(spark, folder, t, tables[t].schema).agg(
            F.round(measure, 2).alias("checksum")
        )
        part = part.select(F.lit(t).alias("table"), "checksum")
        out = part if out is None else out.unionByName(part)
    return manifest.join(out, "table").select("table", F.col("rows").alias("n_rows"), "checksum")


@query(
    "load_csv",
    """SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_nationkey""",
)
def load_csv(spark, sf):
    """Read a headed CSV with inferred types under the name its path gives it."""
    folder = scratch_folder(spark)
    path = f"{folder}/confidential_key-customer.csv"
    load(spark, sf, "customer")["customer"].write.option("header", True).csv(path)
    table = load_tables(spark, [path])["Key_Customer"]
    return table.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query(
    "save_tables",
    """SELECT 'customer' AS "table", 1 AS place, count(*) AS n FROM customer
       UNION ALL SELECT 'orders', 2, count(*) FROM orders
       UNION ALL SELECT 'lineitem', 3, count(*) FROM lineitem""",
)
def save_tables_query(spark, sf):
    tables = load(spark, sf, *_CHAIN_TABLES)
    folder = scratch_folder(spark)
    out = None
    for i, t in enumerate(save_tables(tables, list(_CHAIN_TABLES), folder=folder), start=1):
        part = spark.read.parquet(f"{folder}/{t}").agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(t).alias("table"), F.lit(i).alias("place"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "publish_tables",
    """SELECT s.number, s."table", s.n FROM (
         SELECT 1 AS number, 'customer' AS "table", count(*) AS n FROM customer
         UNION ALL SELECT 1, 'orders', count(*) FROM orders
         UNION ALL SELECT 2, 'orders', count(*) FROM orders WHERE o_totalprice > 100000
         UNION ALL SELECT 2, 'lineitem', count(*) FROM lineitem) s""",
)
def publish_tables_query(spark, sf):
    """Two sets published one after the other; both are readable whole."""
    tables = load(spark, sf, *_CHAIN_TABLES)
    folder = scratch_folder(spark)
    publish_tables(tables, ["customer", "orders"], folder)
    large = {"orders": tables["orders"].where("o_totalprice > 100000"), "lineitem": tables["lineitem"]}
    publish_tables(large, ["orders", "lineitem"], folder)
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(number).alias("number"), F.lit(t).alias("table"), "n")
        for number in (1, 2)
        for t, df in published_tables(spark, folder, number).items()
    ]
    return union_all(parts)


@query(
    "preview",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10",
)
def preview_query(spark, sf):
    orders = load(spark, sf, "orders")["orders"]
    return preview(orders, 10, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")
