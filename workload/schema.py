"""Profiles, keys, the table graph and its budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinloom.operators import graph, inclusion, profile
from twinloom.operators.integrity import link_report
from twinloom.runtime import small_frame
from workload.base import (
    FIELDS,
    KEY_REFERS,
    KEY_SQL_PATTERN,
    KEYS,
    PRIMARY_KEYS,
    TABLES,
    as_number,
    load,
    query,
)

EPSILON = 6.0


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- profiles

_PROFILE = _union(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {ti} AS ti, {pi} AS pi, count(*) AS n_rows,"
    f" count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM {t}"
    for ti, t in enumerate(TABLES)
    for pi, (c, _) in enumerate(FIELDS[t])
)


@query(
    "pk_profile",
    f"""SELECT "table", "column", n_rows, n_nulls, n_distinct,
        n_nulls = 0 AND n_distinct = n_rows AS is_unique FROM ({_PROFILE})""",
)
def pk_profile(spark, sf):
    return profile.column_profile(load(spark, sf)).select(
        "table",
        "column",
        F.col("rows").alias("n_rows"),
        F.col("nulls").alias("n_nulls"),
        F.col("distinct").alias("n_distinct"),
        "is_unique",
    )


@query(
    "infer_primary_key",
    f"""SELECT "table", arg_min("column", (CASE WHEN n_nulls = 0 AND n_distinct = n_rows
          THEN 0 ELSE 1 END) * 100000 + (CASE WHEN n_nulls = 0 AND n_distinct = n_rows
          AND "column" <> 'id' THEN 1000 ELSE 0 END) + pi) AS primary_key
        FROM ({_PROFILE}) GROUP BY "table" """,
)
def infer_primary_key(spark, sf):
    keys = profile.infer_primary_keys(load(spark, sf))
    return small_frame(spark, list(keys.items()), "table string, primary_key string")


@query("row_counts", _union(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in TABLES))
def row_counts(spark, sf):
    return profile.row_counts(load(spark, sf))


# ---------------------------------------------------------------- inclusion

_KEY_COLUMNS = [
    (t, c)
    for t in TABLES
    for c, k in FIELDS[t]
    if KEYS.matches(c) or c == PRIMARY_KEYS[t]
]
_VALUES = f"""
key_values AS ({_union(
    f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {c}::BIGINT AS v FROM {t} WHERE {c} IS NOT NULL"
    for t, c in _KEY_COLUMNS)}),
primary_keys(t, c, pos) AS (VALUES {", ".join(
    f"('{t}', '{PRIMARY_KEYS[t]}', {i})" for i, t in enumerate(TABLES))}),
sizes AS (SELECT t, c, count(*) AS n FROM key_values GROUP BY t, c),
parent_values AS (SELECT v.* FROM key_values v JOIN primary_keys p ON v.t = p.t AND v.c = p.c),
pair_overlaps AS (
  SELECT c.t AS child, c.c AS fk, p.t AS parent, p.c AS pk,
         count(*)::DOUBLE / any_value(s.n) AS overlap
  FROM key_values c
  JOIN parent_values p ON c.v = p.v AND c.t <> p.t
  JOIN sizes s ON s.t = c.t AND s.c = c.c
  WHERE regexp_matches(c.c, '{KEY_SQL_PATTERN}')
  GROUP BY c.t, c.c, p.t, p.c
  HAVING count(*)::DOUBLE / any_value(s.n) >= 0.5)"""


@query(
    "fk_overlap",
    f"""WITH {_VALUES} SELECT child, fk, parent, pk, round(overlap, 9) AS overlap FROM pair_overlaps""",
)
def fk_overlap(spark, sf):
    tables = load(spark, sf)
    return inclusion.inclusion_matrix(tables, PRIMARY_KEYS, KEYS, allow_pk_as_fk=True).withColumn(
        "overlap", F.round("overlap", 9)
    )


@query(
    "fk_overlap_pair",
    """SELECT round(count(p.k) / count(*)::DOUBLE, 9) AS overlap
       FROM (SELECT DISTINCT user_id AS k FROM events WHERE user_id IS NOT NULL) c
       LEFT JOIN (SELECT DISTINCT s_suppkey AS k FROM supplier) p ON c.k = p.k""",
)
def fk_overlap_pair(spark, sf):
    t = load(spark, sf, "events", "supplier")
    return inclusion.fk_overlap(t["events"], "user_id", t["supplier"], "s_suppkey").select(
        F.round("overlap", 9).alias("overlap")
    )


def _token(x):
    """The token rule in SQL."""
    t = f"regexp_replace(lower({x}), '[^a-z0-9_]', '', 'g')"
    return (
        f"CASE WHEN {t} LIKE '%ies' AND length({t}) > 3 THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' AND length({t}) > 1 "
        f"THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def _base(x):
    return _token(f"regexp_replace(regexp_replace({x}, '^{KEYS.prefix}', ''), '{KEY_SQL_PATTERN}', '')")


_ALLOWED = ", ".join(f"'{t}'" for t in sorted(KEY_REFERS))
_COLUMN_POSITIONS = ", ".join(
    f"('{t}', '{c}', {i})" for t in TABLES for i, (c, _) in enumerate(FIELDS[t])
)
_CANDIDATES = f"""{_VALUES},
table_rows AS ({_union(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in TABLES)}),
positions(t, c, i) AS (VALUES {_COLUMN_POSITIONS}),
bases AS (
  SELECT o.*, {_base("o.fk")} AS fb, {_token("o.parent")} AS pb, {_base("o.pk")} AS kb,
         pp.pos AS parent_pos, cp.pos AS child_pos, pc.i AS fk_pos,
         CASE WHEN pr.n <= cr.n THEN 1 ELSE 0 END AS fits
  FROM pair_overlaps o
  JOIN primary_keys pp ON pp.t = o.parent
  JOIN primary_keys cp ON cp.t = o.child
  JOIN positions pc ON pc.t = o.child AND pc.c = o.fk
  JOIN table_rows pr ON pr.t = o.parent
  JOIN table_rows cr ON cr.t = o.child
  WHERE cp.c <> o.fk OR o.child IN ({_ALLOWED})),
scored AS (
  SELECT *, (CASE WHEN fb = pb THEN 3 ELSE 0 END)
          + (CASE WHEN kb <> '' AND fb = kb THEN 2 ELSE 0 END)
          + (CASE WHEN contains(fb, pb) OR contains(pb, fb) THEN 1 ELSE 0 END) AS score
  FROM bases),
candidates AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY child, fk
             ORDER BY score DESC, overlap DESC, fits DESC, parent_pos) AS turn FROM scored)
  WHERE turn = 1),
edges AS (SELECT DISTINCT parent, child FROM candidates),
reach AS (
  SELECT parent AS a, child AS b FROM edges
  UNION
  SELECT r.a, e.child FROM reach r JOIN edges e ON e.parent = r.b),
fanouts AS (
  SELECT p.t AS "table", p.pos, count(r.b) AS fanout
  FROM primary_keys p LEFT JOIN reach r ON r.a = p.t GROUP BY p.t, p.pos),
walks AS (
  SELECT t, 0 AS level FROM primary_keys
  UNION
  SELECT e.child, w.level + 1 FROM walks w JOIN edges e ON e.parent = w.t),
levels AS (SELECT t AS "table", max(level) AS level FROM walks GROUP BY t),
weights AS (
  SELECT f.*, l.level, 1e0 + ln(1e0 + fanout) AS weight
  FROM fanouts f JOIN levels l ON l."table" = f."table"),
allocation AS (
  SELECT *, {EPSILON}::DOUBLE * weight / (SELECT sum(weight) FROM weights) AS epsilon FROM weights)"""


def _candidates(spark, sf):
    return inclusion.candidates(load(spark, sf), PRIMARY_KEYS, KEYS, KEY_REFERS)


@query(
    "fk_candidates",
    f"""WITH RECURSIVE {_CANDIDATES}
        SELECT child, fk, parent, pk, round(overlap, 9) AS overlap, score, fits FROM candidates""",
)
def fk_candidates(spark, sf):
    return _candidates(spark, sf).select(
        "child", "fk", "parent", "pk", F.round("overlap", 9).alias("overlap"), "score", "fits"
    )


def accepted(spark, sf):
    """Accepted and dropped relationships, best first; a row per foreign key."""
    rows = [r.asDict() for r in _candidates(spark, sf).orderBy("child_pos", "fk_pos").collect()]
    return graph.accept_relationships(rows)


def table_graph(spark, sf):
    rels = [
        (r["parent"], r["pk"], r["child"], r["fk"]) for r in accepted(spark, sf) if r["kept"]
    ]
    return graph.parents_of(rels, TABLES)


@query(
    "schema_dag",
    f"""WITH RECURSIVE {_CANDIDATES}
        SELECT parent, pk AS parent_pk, child, fk AS child_fk, score,
               NOT EXISTS (SELECT 1 FROM reach r WHERE r.a = c.child AND r.b = c.parent) AS kept
        FROM candidates c""",
)
def schema_dag(spark, sf):
    rows = [
        (r["parent"], r["pk"], r["child"], r["fk"], r["score"], r["kept"])
        for r in accepted(spark, sf)
    ]
    return small_frame(
        spark,
        rows,
        "parent string, parent_pk string, child string, child_fk string, score int, kept boolean",
    )


@query("fanout", f"""WITH RECURSIVE {_CANDIDATES} SELECT "table", fanout FROM fanouts""")
def fanout(spark, sf):
    return graph.fanout(spark, table_graph(spark, sf)).select("table", "fanout")


@query(
    "edge_levels",
    f"""WITH RECURSIVE {_CANDIDATES} SELECT "table", level, fanout, false AS cyclic FROM weights""",
)
def edge_levels(spark, sf):
    """Levels and fan-out by a recursive query over the discovered links."""
    links = [(r["parent"], r["child"]) for r in accepted(spark, sf) if r["kept"]]
    edges = small_frame(spark, links, "parent string, child string")
    return graph.edge_levels(edges, small_frame(spark, [(t,) for t in TABLES], "table string"))


@query(
    "allocation",
    f"""WITH RECURSIVE {_CANDIDATES}
        SELECT "table", fanout, round(weight, 9) AS weight, round(epsilon, 9) AS epsilon
        FROM allocation""",
)
def allocation(spark, sf):
    return graph.allocation(spark, table_graph(spark, sf), EPSILON).select(
        "table", "fanout", F.round("weight", 9).alias("weight"), F.round("epsilon", 9).alias("epsilon")
    )


@query(
    "generation_order",
    f"""WITH RECURSIVE {_CANDIDATES}
        SELECT "table", level, row_number() OVER (ORDER BY level, pos) AS place FROM weights""",
)
def generation_order(spark, sf):
    tree = table_graph(spark, sf)
    depth = graph.levels(tree)
    rows = [(t, depth[t], i) for i, t in enumerate(graph.generation_order(tree), start=1)]
    return small_frame(spark, rows, "table string, level int, place bigint")


@query(
    "budget_report",
    f"""WITH RECURSIVE {_CANDIDATES}
        SELECT "table", level, fanout, round(epsilon, 4) AS allocated_epsilon,
               round(epsilon / (SELECT sum(epsilon) FROM allocation) * 100, 2) AS pct_of_budget
        FROM allocation""",
)
def budget_report(spark, sf):
    return graph.budget_report(spark, table_graph(spark, sf), EPSILON)


# ---------------------------------------------------------------- flagship

_RELATIONSHIPS = [
    ("region", "r_regionkey", "nation", "n_regionkey"),
    ("nation", "n_nationkey", "customer", "c_nationkey"),
    ("nation", "n_nationkey", "supplier", "s_nationkey"),
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("part", "p_partkey", "lineitem", "l_partkey"),
    ("supplier", "s_suppkey", "lineitem", "l_suppkey"),
    ("documents", "doc_id", "labels", "doc_id"),
]


def _discovered_links_sql():
    """Links by name score of at least 1, with their measures."""
    parts = []
    for p, pk, c, fk in _RELATIONSHIPS:
        parts.append(
            f"SELECT '{p}' AS parent, '{c}' AS child, '{fk}' AS child_fk,"
            f" (SELECT count(*) FROM {c} x WHERE NOT EXISTS"
            f" (SELECT 1 FROM {p} y WHERE y.{pk} = x.{fk})) AS orphans,"
            f" (SELECT count(*) FROM {c} x JOIN {p} y ON y.{pk} = x.{fk})::DOUBLE"
            f" / (SELECT count(DISTINCT {pk}) FROM {p}) AS avg_children"
        )
    return (
        f"WITH RECURSIVE {_CANDIDATES}, links AS ({_union(parts)})"
        " SELECT c.parent, c.child, c.fk AS child_fk, round(c.overlap, 9) AS overlap, l.orphans,"
        " round(l.avg_children, 6) AS avg_children FROM candidates c"
        " LEFT JOIN links l ON l.parent = c.parent AND l.child = c.child AND l.child_fk = c.fk"
        " WHERE c.score >= 1"
    )


@query("discovered_links", _discovered_links_sql())
def discovered_links(spark, sf):
    """For each relationship found by value and name: overlap, orphans, mean children."""
    found = [r for r in accepted(spark, sf) if r["kept"] and r["score"] >= 1]
    rels = [(r["parent"], r["pk"], r["child"], r["fk"]) for r in found]
    shares = small_frame(
        spark,
        [(r["parent"], r["child"], r["fk"], r["overlap"]) for r in found],
        "parent string, child string, child_fk string, overlap double",
    )
    return (
        link_report(load(spark, sf), rels)
        .join(F.broadcast(shares), ["parent", "child", "child_fk"])
        .select(
            "parent",
            "child",
            "child_fk",
            F.round("overlap", 9).alias("overlap"),
            "orphans",
            F.round("avg_cardinality", 6).alias("avg_children"),
        )
    )


# ---------------------------------------------------------------- column facts

_STAT_TABLES = ("orders", "lineitem", "events")


@query(
    "column_stats",
    _union(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\","
        f" round(coalesce(avg({as_number(c, k)}), 0e0), 2) AS mean,"
        f" round(CASE WHEN stddev_samp({as_number(c, k)}) > 1e-8 THEN stddev_samp({as_number(c, k)})"
        f" ELSE 1e0 END, 2) AS std,"
        f" coalesce(min({as_number(c, k)}), -1e0) AS min_value,"
        f" coalesce(max({as_number(c, k)}), 1e0) AS max_value,"
        f" {'true' if k == 'i' else 'false'} AS is_int FROM {t}"
        for t in _STAT_TABLES
        for c, k in FIELDS[t]
        if k in "idt"
    ),
)
def column_stats(spark, sf):
    out = None
    for t, df in load(spark, sf, *_STAT_TABLES).items():
        part = profile.column_stats(df).select(
            F.lit(t).alias("table"),
            "column",
            F.round("mean", 2).alias("mean"),
            F.round("std", 2).alias("std"),
            F.col("min").alias("min_value"),
            F.col("max").alias("max_value"),
            "is_int",
        )
        out = part if out is None else out.unionByName(part)
    return out


_TEXTS = ", ".join(f"('{t}', '{c}')" for t in TABLES for c, k in FIELDS[t] if k == "s")
_SCALARS = [(t, c, k) for t in TABLES for c, k in FIELDS[t] if k in "ids"]


@query(
    "category_domain",
    "SELECT \"table\", \"column\", value, n FROM ("
    + "SELECT *, count(*) OVER (PARTITION BY \"table\", \"column\") AS w FROM ("
    + _union(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n"
        f" FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
        for t, c, _ in _SCALARS
    )
    + f")) WHERE w <= 20 OR (\"table\", \"column\") IN ({_TEXTS})",
)
def category_domain(spark, sf):
    """Values and counts of every text column, and of numbers with at most 20 values."""
    from twinloom.functions.values import is_temporal, is_text

    tables = load(spark, sf)
    numbers = profile.small_domains(
        tables, 20, keep=lambda a: not is_temporal(a.dtype) and not is_text(a.dtype)
    )
    return numbers.select("table", "column", "value", "n").unionByName(profile.text_domains(tables))


@query(
    "distinct_values",
    "SELECT DISTINCT l_shipdate AS value FROM lineitem WHERE l_shipdate IS NOT NULL",
)
def distinct_values(spark, sf):
    return profile.category_domain(load(spark, sf, "lineitem")["lineitem"], "l_shipdate")


def _type_sql(t, c, k):
    n = f"count(DISTINCT {c})"
    discrete = {
        "s": f"{n} >= 2",
        "i": f"{n} BETWEEN 2 AND 20",
        "d": f"{n} BETWEEN 2 AND 20",
        "t": "false",
    }[k]
    return (
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\","
        f" CASE WHEN {discrete} THEN 'discrete' ELSE 'continuous' END AS kind,"
        f" CASE WHEN {discrete} THEN {n} END AS n_categories FROM {t}"
    )


@query(
    "column_types",
    _union(_type_sql(t, c, k) for t in TABLES for c, k in FIELDS[t] if k != "v"),
)
def column_types(spark, sf):
    rows = [
        (x.table, x.column, x.kind, x.n_categories) for x in profile.column_types(load(spark, sf))
    ]
    return small_frame(spark, rows, "table string, column string, kind string, n_categories bigint")


@query(
    "pick_target",
    f"""SELECT "table", "column" FROM ({_PROFILE})
        WHERE NOT regexp_matches("column", '{KEY_SQL_PATTERN}') AND "column" <> 'id'
          AND "column" <> 'embedding' AND n_distinct BETWEEN 2 AND 10
        ORDER BY ti, pi LIMIT 1""",
)
def pick_target(spark, sf):
    return small_frame(
        spark, [profile.pick_target(load(spark, sf), KEYS)], "table string, column string"
    )


_COMPARE = ("customer", "supplier", "part", "orders", "lineitem")


@query(
    "pick_compare_columns",
    'SELECT "table", "column", mean_value FROM (SELECT *, row_number() OVER (PARTITION BY "table"'
    " ORDER BY pi) AS turn FROM ("
    + _union(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {ti} AS ti, {pi} AS pi,"
        f" round(avg({c}), 2) AS mean_value FROM {t}"
        for ti, t in enumerate(_COMPARE)
        for pi, (c, k) in enumerate(FIELDS[t])
        if k in "id" and c != PRIMARY_KEYS[t]
    )
    + ")) ORDER BY CASE WHEN turn > 1 THEN 1 ELSE 0 END, ti, pi LIMIT 6",
)
def pick_compare_columns(spark, sf):
    """The chosen columns, with their means so that the data is read too."""
    tables = load(spark, sf, *_COMPARE)
    chosen = profile.pick_compare_columns(tables, PRIMARY_KEYS)
    means = None
    for t, df in tables.items():
        part = profile.column_stats(df).select(F.lit(t).alias("table"), "column", "mean")
        means = part if means is None else means.unionByName(part)
    return chosen.join(means, ["table", "column"]).select(
        "table", "column", F.round("mean", 2).alias("mean_value")
    )
